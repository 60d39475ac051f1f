"""Tier routing by per-tenant policy.

Policies are configuration (one small row per tenant with its ordered rule
list).  They are joined to the request table once, without a hint: while the
policy table is below Spark's broadcast threshold, routing adds no shuffle of
the request table.  The first firing rule is chosen row-locally with
higher-order functions.

A rule's conditions are looked up by their key in the policy document:
``RULE_TYPES`` holds the built-in ones, ``with_rule_type`` adds one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.patterns import DEFAULT_RULES, DEFAULT_TIER, TIERS
from ..functions.redact import sensitivity_total
from ..sources import files

RULE_TYPE = T.StructType([
    T.StructField("rule_no", T.IntegerType()),
    T.StructField("entity_in", T.ArrayType(T.StringType())),
    T.StructField("max_entities_gt", T.IntegerType()),
    T.StructField("then_tier", T.StringType()),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())),
])
POLICY_SCHEMA = T.StructType([
    T.StructField("tenant", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("default_tier", T.StringType()),
    T.StructField("allow_override", T.BooleanType()),
    T.StructField("rules", T.ArrayType(RULE_TYPE)),
    T.StructField("policy_found", T.BooleanType()),
])


BUILT_IN = ("if_entity_in", "if_max_entities_gt", "then_tier")


def _policy_row(tenant: str, doc: dict | None) -> tuple:
    """Apply the loading defaults: no document -> all defaults with name = tenant;
    missing ``rules`` key -> default rules; explicit empty list -> no rules.
    Keys that are not built in go to ``params`` as JSON."""
    found = doc is not None
    doc = doc or {}
    rules = doc.get("rules")
    if rules is None:
        rules = list(DEFAULT_RULES)
    rows = []
    for i, r in enumerate(rules, start=1):
        wanted = r.get("if_entity_in")
        thr = r.get("if_max_entities_gt")
        rows.append((i, list(wanted) if wanted else None, int(thr) if thr is not None else None,
                     r.get("then_tier"), {k: json.dumps(v) for k, v in r.items() if k not in BUILT_IN}))
    return (tenant, doc.get("name", tenant), doc.get("default_tier", DEFAULT_TIER),
            bool(doc.get("allow_tier_override_via_header", False)), rows, found)


def policies_from_docs(spark: SparkSession, docs: dict[str, dict | None]) -> DataFrame:
    """Policy table from parsed policy documents (tenant -> document or None)."""
    return spark.createDataFrame([_policy_row(t, d) for t, d in sorted(docs.items())], POLICY_SCHEMA)


def load_policies(spark: SparkSession, tenants_dir: str) -> DataFrame:
    """The policies in ``<tenants_dir>/<tenant>.yaml``, read by Spark as whole files from any file system and parsed
    in the tasks.  A folder that is missing or empty has no policies; an empty document has all defaults."""
    if not files.exists(spark, tenants_dir):
        return spark.createDataFrame([], POLICY_SCHEMA)
    docs = spark.read.option("pathGlobFilter", "*.yaml").text(tenants_dir, wholetext=True) \
        .select(F.regexp_replace(F.col("_metadata.file_name"), r"\.yaml$", "").alias("tenant"), F.col("value").alias("doc"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml
        for b in batches:
            rows = [_policy_row(t, yaml.safe_load(d) or {}) for t, d in zip(b["tenant"], b["doc"])]
            out = pd.DataFrame(rows, columns=POLICY_SCHEMA.names)
            out["rules"] = [[dict(zip(RULE_TYPE.names, r)) for r in rules] for rules in out["rules"]]
            yield out
    return docs.mapInPandas(parse, POLICY_SCHEMA)


def rules_long(policies: DataFrame) -> DataFrame:
    """One row per (tenant, rule): tenant, rule_no, entity_in, max_entities_gt, then_tier."""
    return policies.select("tenant", F.explode("rules").alias("r")).select("tenant", "r.*")


def _present(stats: Column) -> Column:
    return F.map_keys(F.map_filter(stats, lambda k, v: v > 0))


def entity_condition(rule: Column, stats: Column) -> Column:
    wanted = F.transform(F.coalesce(rule["entity_in"], F.array().cast("array<string>")), F.lower)
    return (F.size(wanted) > 0) & F.coalesce(F.arrays_overlap(wanted, F.transform(_present(stats), F.lower)),
                                             F.lit(False))


def threshold_condition(rule: Column, total: Column) -> Column:
    return rule["max_entities_gt"].isNotNull() & (total > rule["max_entities_gt"])


@dataclass(frozen=True)
class Request:
    """What a condition may look at: the counts per type, their sum, and any other column of the request."""
    stats: Column
    total: Column

    def __getitem__(self, name: str) -> Column:
        return F.col(name)


Condition = Callable[[Column, Request], Column]
# key in a rule document -> whether the rule's condition of that kind holds
RULE_TYPES: dict[str, Condition] = {
    "if_entity_in": lambda rule, request: entity_condition(rule, request.stats),
    "if_max_entities_gt": lambda rule, request: threshold_condition(rule, request.total),
}


def param(rule: Column, key: str, kind: str) -> Column:
    """The value that a rule document has under ``key``, as ``kind``; null if it has none or one of another kind."""
    return F.from_json(F.concat(F.lit('{"v":'), rule["params"][key], F.lit("}")), f"v {kind}")["v"]


def with_rule_type(key: str, condition: Condition, types: dict[str, Condition] = RULE_TYPES) -> dict[str, Condition]:
    """``types`` and one more, for rule documents that use ``key``.  ``condition`` gets the rule (``param`` reads its value)
    and the request; a rule without the key never fires by it."""
    if key in BUILT_IN:
        raise ValueError(f"{key} is built in")
    return types | {key: lambda rule, request: F.map_contains_key(rule["params"], F.lit(key)) & F.coalesce(condition(rule, request), F.lit(False))}


def rule_fires(rule: Column, stats: Column, total: Column, types: dict[str, Condition] = RULE_TYPES) -> Column:
    """A rule fires when it names a tier and any of its conditions holds (OR)."""
    request = Request(stats, total)
    return rule["then_tier"].isNotNull() & reduce(Column.__or__, [holds(rule, request) for holds in types.values()])


def _rules_literal(rows: list[tuple]) -> Column:
    items = [F.struct(F.lit(n).cast("int").alias("rule_no"),
                      (F.array(*[F.lit(x) for x in ents]) if ents else F.lit(None)).cast("array<string>")
                      .alias("entity_in"),
                      F.lit(thr).cast("int").alias("max_entities_gt"),
                      F.lit(tier).cast("string").alias("then_tier"),
                      F.create_map().cast("map<string,string>").alias("params"))
             for n, ents, thr, tier, _ in rows]
    return F.array(*items).cast(T.ArrayType(RULE_TYPE))


def with_policy(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """Left join requests to their tenant policy.  A tenant without a policy row gets the defaults;
    ``policy_found`` says so."""
    default_rules = _rules_literal(_policy_row("_", None)[4])
    j = requests.join(policies, "tenant", "left")
    return j.select(
        *[F.col(c) for c in requests.columns],
        F.coalesce(F.col("name"), F.col("tenant")).alias("policy_name"),
        F.coalesce(F.col("default_tier"), F.lit(DEFAULT_TIER)).alias("default_tier"),
        F.coalesce(F.col("allow_override"), F.lit(False)).alias("allow_override"),
        F.coalesce(F.col("rules"), default_rules).alias("rules"),
        F.coalesce(F.col("policy_found"), F.lit(False)).alias("policy_found"),
    )


def route(requests: DataFrame, policies: DataFrame, stats_col: str = "stats",
          explicit_col: str = "explicit_tier", rule_types: dict[str, Condition] = RULE_TYPES) -> DataFrame:
    """Routing decision per request.

    Order: honoured override -> first firing rule (lowest rule_no) -> default tier.
    Adds: tier, reason ('override' | 'rule' | 'default'), rule_no, override_denied,
    tier_valid, policy_found.
    """
    j = with_policy(requests, policies)
    stats = F.col(stats_col)
    total = sensitivity_total(stats)
    rules_sorted = F.array_sort(F.col("rules"), lambda a, b: F.when(a["rule_no"] < b["rule_no"], -1)
                                .when(a["rule_no"] > b["rule_no"], 1).otherwise(0))
    fired = F.filter(rules_sorted, lambda r: rule_fires(r, stats, total, rule_types))
    first = F.when(F.size(fired) > 0, F.element_at(fired, 1))
    explicit = F.col(explicit_col)
    has_explicit = explicit.isNotNull() & (explicit != "")
    override = has_explicit & F.col("allow_override")
    tier = (F.when(override, explicit).when(first.isNotNull(), first["then_tier"])
            .otherwise(F.col("default_tier")))
    reason = F.when(override, "override").when(first.isNotNull(), "rule").otherwise("default")
    out = j.select(*requests.columns, "policy_found",
                   tier.alias("tier"), reason.alias("reason"),
                   F.when(~override, first["rule_no"]).alias("rule_no"),
                   (has_explicit & ~F.col("allow_override")).alias("override_denied"))
    return out.withColumn("tier_valid", F.col("tier").isin(*TIERS))


def fired_rules(requests: DataFrame, policies: DataFrame, stats_col: str = "stats",
                which: str = "any") -> DataFrame:
    """Every (request, rule) pair whose condition holds: request columns +
    rule_no, then_tier.  ``which`` = 'any' (rule fires), 'entity' or 'threshold'
    (that condition alone, regardless of then_tier)."""
    j = with_policy(requests, policies)
    stats = F.col(stats_col)
    total = sensitivity_total(stats)
    ex = j.select(*requests.columns, F.explode("rules").alias("r"))
    r = F.col("r")
    cond = {"any": rule_fires(r, stats, total),
            "entity": entity_condition(r, stats),
            "threshold": threshold_condition(r, total)}[which]
    return ex.where(cond).select(*requests.columns, F.col("r.rule_no").alias("rule_no"),
                                 F.col("r.then_tier").alias("then_tier"))


def tier_breakdown(df: DataFrame, tier_col: str = "tier") -> DataFrame:
    """Count per tier, missing tier shown as '?', largest first."""
    return (df.groupBy(F.coalesce(F.col(tier_col), F.lit("?")).alias("tier"))
            .agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc("tier")))
