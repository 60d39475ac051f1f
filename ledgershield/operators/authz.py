"""Fail-closed authorisation and AP proposal validation as ordered CASE columns.

Every check becomes one boolean column; the first failing check (in the order
of the original guard clauses) names the reason.  Policies and contracts are
joined on their key; the policy side is broadcast only after a size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import (AP_TENANT_RE, AUTHZ_REASONS, CONTRACT_REASONS, CURRENCY_RE, DATA_CLASSES,
                                  DEFAULT_PRIVATE_MODEL, MODEL_INVOKE, PROPOSAL_REASONS, ROUTE_REASONS,
                                  SOVEREIGN_TENANT_RE)


def full_match(col: Column, anchored_pattern: str) -> Column:
    """Whole-string regex match (``^``/``$`` turned into ``\\A``/``\\z`` so a
    trailing newline cannot sneak through, as with Python ``fullmatch``)."""
    p = anchored_pattern
    if p.startswith("^"):
        p = p[1:]
    if p.endswith("$"):
        p = p[:-1]
    return F.coalesce(col.rlike("\\A(?:" + p + ")\\z"), F.lit(False))


def first_failure(checks: list[tuple[Column, str]]) -> Column:
    """Reason of the first failing check, null when all pass."""
    out = None
    for failed, reason in checks:
        out = F.when(failed, F.lit(reason)) if out is None else out.when(failed, F.lit(reason))
    return out


def authorize_checks(verified: Column, principal_tenant: Column, tenant_id: Column,
                     permissions: Column, permission: Column | str = MODEL_INVOKE) -> list[tuple[Column, str]]:
    perm = F.lit(permission) if isinstance(permission, str) else permission
    return [
        (~F.coalesce(verified, F.lit(False)), AUTHZ_REASONS[0]),
        (~full_match(tenant_id, SOVEREIGN_TENANT_RE), AUTHZ_REASONS[1]),
        (~F.coalesce(principal_tenant == tenant_id, F.lit(False)), AUTHZ_REASONS[2]),
        (~F.coalesce(F.array_contains(permissions, perm), F.lit(False)), AUTHZ_REASONS[3]),
    ]


def authorize(requests: DataFrame, permission: str = MODEL_INVOKE) -> DataFrame:
    """requests: verified, principal_tenant, tenant_id, permissions (+ any).
    Adds allowed, deny_reason."""
    reason = first_failure(authorize_checks(F.col("verified"), F.col("principal_tenant"), F.col("tenant_id"),
                                            F.col("permissions"), permission))
    return requests.withColumn("deny_reason", reason).withColumn("allowed", F.col("deny_reason").isNull())


def model_route(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """requests: principal columns + tenant_id, data_class, requested_model,
    classification_complete, redaction_complete.  policies: tenant_id,
    allowed_external_models, allowed_external_classes, private_model,
    external_egress_enabled.  A tenant without a policy row gets the default
    policy (no external model, egress disabled).  Adds allowed, deny_reason, model.
    """
    pol = policies.select(
        "tenant_id", F.col("allowed_external_models").alias("_models"),
        F.col("allowed_external_classes").alias("_classes"), F.col("private_model").alias("_private"),
        F.col("external_egress_enabled").alias("_egress"))
    j = requests.join(pol, "tenant_id", "left")
    models = F.coalesce(F.col("_models"), F.array().cast("array<string>"))
    classes = F.coalesce(F.col("_classes"), F.array().cast("array<string>"))
    private = F.coalesce(F.col("_private"), F.lit(DEFAULT_PRIVATE_MODEL))
    egress = F.coalesce(F.col("_egress"), F.lit(False))
    req_model = F.col("requested_model")
    has_model = req_model.isNotNull() & (req_model != "")
    is_private = has_model & (req_model == private)
    checks = authorize_checks(F.col("verified"), F.col("principal_tenant"), F.col("tenant_id"),
                              F.col("permissions"))
    checks += [
        (~F.coalesce(F.col("classification_complete"), F.lit(False)), ROUTE_REASONS[0]),
        (~F.coalesce(F.col("data_class").isin(*DATA_CLASSES), F.lit(False)), ROUTE_REASONS[1]),
        (~has_model, ROUTE_REASONS[2]),
    ]
    # the private model is allowed at once: later checks apply only to external models
    ext = [
        (~F.coalesce(F.col("redaction_complete"), F.lit(False)), ROUTE_REASONS[3]),
        (~egress, ROUTE_REASONS[4]),
        (~F.coalesce(F.array_contains(models, req_model), F.lit(False)), ROUTE_REASONS[5]),
        (~F.coalesce(F.array_contains(classes, F.col("data_class")), F.lit(False)), ROUTE_REASONS[6]),
    ]
    checks += [(~is_private & failed, reason) for failed, reason in ext]
    out = j.withColumn("deny_reason", first_failure(checks)).drop("_models", "_classes", "_private", "_egress")
    return (out.withColumn("allowed", F.col("deny_reason").isNull())
            .withColumn("model", F.when(F.col("allowed"), req_model)))


def check_contracts(contracts: DataFrame) -> DataFrame:
    """contracts: agent_id, tenant_id, may_approve, may_release_payment (+ any).
    Adds valid, reason."""
    reason = first_failure([
        (~full_match(F.col("tenant_id"), AP_TENANT_RE), CONTRACT_REASONS[0]),
        (F.coalesce(F.col("may_approve"), F.lit(False)) | F.coalesce(F.col("may_release_payment"), F.lit(False)),
         CONTRACT_REASONS[1]),
    ])
    return contracts.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


NUMBER_RE = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def check_proposals(proposals: DataFrame, contracts: DataFrame) -> DataFrame:
    """Validate proposals against the contract of their agent.

    proposals: proposal_id, agent_id, tenant_id, invoice_id, action, amount_raw,
    currency, evidence_id, idempotency_key.  A proposal whose agent has no valid
    contract is rejected first ('no valid contract').  The amount
    must be a finite number that is not negative, judged on its text: NaN, infinities and garbage fail, 0
    and -0 pass, -0.004 fails, any number of digits and exponents pass.  Adds amount (to ten decimals, null
    beyond DECIMAL(38,10)), valid, reason.
    """
    c = check_contracts(contracts).select(
        "agent_id", F.col("tenant_id").alias("_c_tenant"), F.col("allowed_actions").alias("_c_actions"),
        F.col("valid").alias("_c_valid"))
    # contracts are keyed by agent and can be as many as agents: plain equi-join
    j = proposals.join(c, "agent_id", "left")
    amount = F.expr("try_cast(amount_raw AS DECIMAL(38,10))")
    raw = F.trim(F.coalesce(F.col("amount_raw"), F.lit("")))
    negative = raw.startswith("-") & F.regexp_replace(raw, "[eE].*$", "").rlike("[1-9]")
    empty = lambda col: F.coalesce(F.col(col), F.lit("")) == ""
    reason = first_failure([
        (~F.coalesce(F.col("_c_valid"), F.lit(False)), "no valid contract"),
        (~F.coalesce(F.col("tenant_id") == F.col("_c_tenant"), F.lit(False)), PROPOSAL_REASONS[0]),
        (~F.coalesce(F.array_contains(F.col("_c_actions"), F.col("action")), F.lit(False)), PROPOSAL_REASONS[1]),
        (~raw.rlike(NUMBER_RE) | negative, PROPOSAL_REASONS[2]),
        (~full_match(F.col("currency"), CURRENCY_RE), PROPOSAL_REASONS[3]),
        (empty("invoice_id") | empty("evidence_id") | empty("idempotency_key"), PROPOSAL_REASONS[4]),
    ])
    return (j.withColumn("amount", amount).withColumn("reason", reason)
            .drop("_c_tenant", "_c_actions", "_c_valid")
            .withColumn("valid", F.col("reason").isNull()))
