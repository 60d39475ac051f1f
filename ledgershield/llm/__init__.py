"""Training-data operators: extraction, decontamination, PII, packing, deduplication and scans."""
