"""Detector patterns and policy constants.

FIXED VALUES — these must equal the behaviour being matched (entity names,
patterns, pattern order, token format, tier names, default rules).  They are
stated once, plainly, in natural order.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Detector:
    entity: str          # upper-case type used in tokens, e.g. EMAIL -> [EMAIL_0001]
    pattern: str         # regex, Python/Java syntax
    flags: str = ""      # inline flags other than the unicode flag, e.g. "i"
    # literal substrings of which at least one must occur for any match; used as
    # a cheap pre-filter that can never change the result.  Empty = no filter.
    needles: tuple[str, ...] = ()
    # what every match starts with (regex).  Tested before the pattern's leading \\b,
    # which is dear under the Unicode flag; it can never change the result.
    start: str = ""


# --- FIXED VALUES: detectors, applied in this order -------------------------
DETECTORS: tuple[Detector, ...] = (
    Detector("SWISS_ACCT", r"\b\d{2}\.\d{3}\.\d{3}\.\d{3}\.\d\b", needles=(".",), start=r"\d{2}\."),
    Detector("SYGNUM_REF", r"\bzv\d{8}/\d{6}/\d+\b", flags="i", needles=("/",), start="z"),
    Detector("IBAN", r"\b[A-Z]{2}\d{2}(?:\s?\w{4}){2,7}\s?\w{1,4}\b", start="[A-Z]{2}"),
    Detector("CC", r"\b(?:\d[ -]*?){13,19}\b", start=r"\d"),
    Detector("EMAIL", r"\b[\w._%+-]+@[\w.-]+\.[A-Za-z]{2,}\b", needles=("@",)),
    Detector("AMOUNT", r"\b(?:CHF|USD|EUR|GBP)\s?\d{4,}(?:[.,]\d{2})?\b",
             needles=("CHF", "USD", "EUR", "GBP"), start="[CUEG]"),
    Detector("VENDOR",
             r"\b(?:[A-Z][a-zA-Z0-9]{1,}\s){0,4}[A-Z][a-zA-Z0-9]{1,}\s?(?:AG|GmbH|SA|Ltd|LLC|Inc|KG)\b",
             needles=("AG", "GmbH", "SA", "Ltd", "LLC", "Inc", "KG"), start="[A-Z]"),
)

# Token format: "[" + TYPE + "_" + 4-digit zero padded number + "]".
TOKEN_FORMAT = "[%s_%04d]"
TOKEN_PATTERN = r"\[[A-Z_]+_\d{4,}\]"

# Tiers.
TIERS = ("public", "private", "sealed")

# Default policy when a tenant has none / has no ``rules`` key.
DEFAULT_TIER = "public"
DEFAULT_RULES = (
    {"if_entity_in": ["SWISS_ACCT", "SYGNUM_REF"], "then_tier": "sealed"},
    {"if_max_entities_gt": 0, "then_tier": "private"},
)
# The shipped demo tenant policy.
DEMO_POLICY = {
    "name": "Demo Tenant",
    "default_tier": "public",
    "allow_tier_override_via_header": True,
    "rules": [
        {"if_entity_in": ["SWISS_ACCT", "SYGNUM_REF", "IBAN", "CC"], "then_tier": "sealed"},
        {"if_max_entities_gt": 0, "then_tier": "private"},
    ],
}

# Request defaults.
DEFAULT_MODEL = "claude-sonnet-4-6"
DEFAULT_MAX_TOKENS = 1024

# Authorisation: data classes, tenant id patterns, AP actions.
DATA_CLASSES = ("public", "internal", "confidential", "restricted")
SOVEREIGN_TENANT_RE = r"^[a-zA-Z0-9][a-zA-Z0-9_-]{0,63}$"
AP_TENANT_RE = r"^[A-Za-z0-9_-]{1,64}$"
CURRENCY_RE = r"^[A-Z]{3}$"
AP_ACTIONS = ("invoice.extract", "invoice.validate", "purchase_order.match",
              "gl_coding.propose", "payment.propose")
DEFAULT_PRIVATE_MODEL = "sealed"
MODEL_INVOKE = "model:invoke"

# Denial reasons, in check order.
AUTHZ_REASONS = ("unverified principal", "invalid tenant", "cross-tenant access", "permission denied")
ROUTE_REASONS = ("classification incomplete", "invalid data classification", "missing model",
                 "redaction incomplete", "external model egress disabled", "model not approved",
                 "data class not approved for external processing")
CONTRACT_REASONS = ("invalid tenant identifier", "AP worker agents cannot approve or release payments")
PROPOSAL_REASONS = ("cross-tenant AP proposal", "action not authorised", "invalid amount", "invalid currency",
                    "missing evidence or idempotency reference")
# --- end of fixed values ------------------------------------------------------


def java_pattern(d: Detector) -> str:
    """Pattern for Spark (java.util.regex).  ``U`` makes \\w, \\d, \\b and \\s
    Unicode-aware, as they are for Python ``str`` patterns."""
    return f"(?U{d.flags})" + (f"(?={d.start})" if d.start else "") + d.pattern


def re2_pattern(d: Detector) -> str:
    """Pattern for the DuckDB oracle (RE2)."""
    return (f"(?{d.flags})" if d.flags else "") + d.pattern
