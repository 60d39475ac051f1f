"""Audit hashing: SHA-256 of text and of the canonical JSON form of an entry.

Canonical form = JSON with keys sorted, no whitespace, non-ASCII escaped as
``\\uXXXX`` (Python ``json.dumps`` defaults), with ``hash`` and ``prev_hash``
left out and any unknown extra fields kept.

Two paths produce it:
* native: ``to_json`` of a struct whose fields are in sorted order with nulls
  kept and the stats map sorted by key.  Byte-identical to the canonical form
  when every string is printable ASCII (no escapes where the two JSON writers
  differ);
* Python: one Arrow-batched pandas UDF (``json.loads`` -> ``json.dumps``) for
  everything else, including verification of raw log lines.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# FIXED VALUES: audit entry fields (hash and prev_hash are excluded from the body hash)
ENTRY_FIELDS = ("timestamp", "tenant", "user", "tier", "model", "request_id", "prompt_hash",
                "redacted_prompt_hash", "response_hash", "redaction_stats", "duration_ms", "status",
                "error", "host", "prev_hash", "hash")
HASH_EXCLUDED = ("hash", "prev_hash")
BODY_FIELDS = tuple(sorted(f for f in ENTRY_FIELDS if f not in HASH_EXCLUDED))
STRING_FIELDS = tuple(f for f in BODY_FIELDS if f not in ("redaction_stats", "duration_ms"))

PRINTABLE_ASCII = r"^[\x20-\x7E]*$"


def sha256_text(c: Column) -> Column:
    """SHA-256 hex of the UTF-8 bytes of a string."""
    return F.sha2(c, 256)


def sorted_map(m: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,int>")))))


def body_struct(fields: tuple[str, ...] = BODY_FIELDS) -> Column:
    return F.struct(*[(sorted_map(F.col(f)) if f == "redaction_stats" else F.col(f)).alias(f) for f in fields])


def body_json(fields: tuple[str, ...] = BODY_FIELDS) -> Column:
    return F.to_json(body_struct(fields), {"ignoreNullFields": "false"})


def ascii_safe(fields: tuple[str, ...] = STRING_FIELDS) -> Column:
    """True when every string (and stats key) is printable ASCII."""
    joined = F.concat_ws("", *[F.coalesce(F.col(f), F.lit("")) for f in fields],
                         F.array_join(F.map_keys(F.coalesce(F.col("redaction_stats"),
                                                            F.create_map().cast("map<string,int>"))), ""))
    return joined.rlike(PRINTABLE_ASCII)


def _canonical_hash(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        obj = json.loads(text)
    except (json.JSONDecodeError, TypeError):
        return None
    if not isinstance(obj, dict):
        return None
    body = {k: v for k, v in obj.items() if k not in HASH_EXCLUDED}
    canonical = json.dumps(body, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(canonical.encode("utf-8")).hexdigest()


@F.pandas_udf(T.StringType())
def canonical_hash_udf(lines: pd.Series) -> pd.Series:
    """Canonical body hash of JSON texts; null for malformed or non-object lines."""
    return lines.map(_canonical_hash)


def canonical_hash_py(text: str) -> str | None:
    """Plain-Python form (tests, small checks)."""
    return _canonical_hash(text)
