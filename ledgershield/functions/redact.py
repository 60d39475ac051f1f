"""Native (JVM-side) redaction expressions.

Every step is a built-in Spark expression, so the whole redaction runs inside
whole-stage code generation with no Python worker.  Per detector *k*, applied
to the text already rewritten by the earlier detectors:

    hits   = regexp_extract_all(t, p, 0)                 all matches, in order
    new    = array_except(hits, values_seen_so_far)       first-occurrence order, distinct
    tokens = tokens ++ [([K_0001], v1), ([K_0002], v2), ...]
    t'     = concat of split(t, p, -1)[i] ++ token(hits[i])      (``gaps``)

A value already tokenised by an earlier detector keeps its earlier token and is
not counted again; the per-type count is the number of *new distinct* values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .patterns import DETECTORS, TOKEN_PATTERN, Detector, java_pattern

TOKEN_STRUCT = T.StructType([
    T.StructField("token", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("entity", T.StringType()),
])
TOKENS_TYPE = T.ArrayType(TOKEN_STRUCT)


def stat_col(d: Detector) -> str:
    return "n_" + d.entity.lower()


def _needle_guard(text: Column, d: Detector) -> Column | None:
    if not d.needles:
        return None
    return reduce(lambda a, b: a | b, [F.instr(text, n) > 0 for n in d.needles])


def detect(text: Column, d: Detector) -> Column:
    """All matches of one detector (``detect_*`` keys), as array<string>."""
    hits = F.regexp_extract_all(text, F.lit(java_pattern(d)), F.lit(0))
    guard = _needle_guard(text, d)
    if guard is None:
        return hits
    return F.when(guard, hits).otherwise(F.array().cast("array<string>"))


MARK = "\x01"


def gaps(text: Column, pattern: str) -> Column:
    """The pieces between the matches, ``split(text, pattern, -1)``.

    ``split`` compiles its pattern anew for every row, which costs more than the search; ``regexp_replace``
    keeps it, and splitting at one character needs none.  A text that has the mark itself is split by pattern."""
    marked = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(MARK)), MARK, -1)
    return F.when(F.instr(text, MARK) == 0, marked).otherwise(F.split(text, pattern, -1))


def _step(cur: DataFrame, d: Detector, t: str, vals: str, toks: str, count: str) -> DataFrame:
    """One detector over the columns text, values seen and tokens; adds its count.

    Plain projections: every expression of a step is used more than once by the next, so Catalyst keeps them
    apart and evaluates each once a row, in generated code; lambdas run only on rows
    with several hits.  A sole hit is replaced at once, without a second search by pattern if it can be told by its characters."""
    entity = d.entity
    h, new = "__ls_hits", "__ls_new"
    none = F.array().cast("array<string>")
    cur = cur.withColumn(h, detect(F.col(t), d))
    cur = cur.withColumn(new, F.when(F.size(h) > 0, F.array_except(h, vals)).otherwise(none))
    new_toks = F.transform(new, lambda v, i: F.struct(F.format_string(f"[{entity}_%04d]", i + 1).alias("token"), v.alias("value"),
                                                      F.lit(entity).alias("entity")))
    only_tok = F.array(F.struct(F.lit(f"[{entity}_0001]").alias("token"), F.element_at(F.col(new), 1).alias("value"), F.lit(entity).alias("entity")))
    new_toks = F.when(F.size(new) == 1, only_tok).otherwise(new_toks)
    some = F.size(new) > 0
    cur = cur.withColumns({vals: F.when(some, F.concat(vals, new)).otherwise(F.col(vals)),
                           toks: F.when(some, F.concat(toks, new_toks)).otherwise(F.col(toks)), count: F.size(new)})

    def token(x: Column) -> Column:
        return F.element_at(F.col(toks), F.array_position(vals, x).cast("int"))["token"]
    replaced = F.transform(h, token)
    rebuilt = F.array_join(F.zip_with(gaps(F.col(t), java_pattern(d)), F.concat(replaced, F.array(F.lit(""))),
                                      lambda g, k: F.concat(g, k)), "")
    quoted = F.replace(F.replace(token(F.element_at(F.col(h), 1)), F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    # a hit whose characters stand nowhere else in the text needs no second search by pattern
    hit = F.element_at(F.col(h), 1)
    alone = (hit != "") & (F.position(hit, F.col(t), F.instr(F.col(t), hit) + 1) == 0)
    one = F.when(alone, F.replace(F.col(t), hit, token(hit))).otherwise(F.regexp_replace(F.col(t), F.lit(java_pattern(d)), quoted))
    return cur.withColumn(t, F.when(F.size(h) == 0, F.col(t)).when(F.size(h) == 1, one).otherwise(rebuilt)).drop(h, new)


def redact(df: DataFrame, text_col: str, detectors: tuple[Detector, ...] = DETECTORS,
           out_prefix: str = "") -> DataFrame:
    """Append redaction columns to ``df``.

    Output columns (optionally prefixed): ``redacted_text``, ``tokens``
    (array<struct<token,value,entity>>, the rehydration map in first-seen order),
    ``stats`` (map<string,int>, lower-case type -> distinct values, zero types
    absent, detector order), ``n_entities`` and one ``n_<type>`` per detector.
    A null text is treated as the empty string.
    """
    from ..plans.joins import widen
    df = widen(df)
    keep = df.columns
    t, vals, toks = "__ls_t", "__ls_vals", "__ls_toks"
    ns = [f"__ls_n{i}" for i in range(len(detectors))]
    cur = df.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(t),
                    F.array().cast("array<string>").alias(vals), F.array().cast(TOKENS_TYPE).alias(toks))
    for d, n in zip(detectors, ns):
        cur = _step(cur, d, t, vals, toks, n)
    # inline(array(state)): the Generate node is a barrier, so later filters and projections
    # cannot take the steps apart and evaluate them per reference.
    state = F.struct(F.col(t).alias("t"), F.col(toks).alias("toks"), F.array(*ns).cast("array<int>").alias("counts"))
    cur = cur.select(*keep, F.inline(F.array(state)).alias("__ls_t", "__ls_toks", "__ls_counts"))
    counts = [F.element_at(F.col("__ls_counts"), i + 1) for i in range(len(detectors))]
    stats_entries = F.array(*[F.struct(F.lit(d.entity.lower()).alias("k"), c.alias("v"))
                              for d, c in zip(detectors, counts)])
    stats = F.map_from_entries(F.filter(stats_entries, lambda e: e["v"] > 0))
    total = F.aggregate(F.col("__ls_counts"), F.lit(0), lambda a, v: a + v)
    return cur.select(
        *keep,
        F.col("__ls_t").alias(out_prefix + "redacted_text"),
        F.col("__ls_toks").alias(out_prefix + "tokens"),
        stats.alias(out_prefix + "stats"),
        total.cast("int").alias(out_prefix + "n_entities"),
        *[c.alias(out_prefix + stat_col(d)) for d, c in zip(detectors, counts)],
    )


def rehydrate_expr(text: Column, tokens: Column) -> Column:
    """Replace every known token in ``text`` by its original value.

    Unknown token-like strings and text without tokens pass through unchanged.
    Exact lookup makes the longest-first ordering of a sequential replace moot.
    """
    found = F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))
    vals = F.transform(tokens, lambda x: x["value"])
    toks = F.transform(tokens, lambda x: x["token"])
    def _lookup(k):
        pos = F.array_position(toks, k).cast("int")
        return F.when(pos > 0, F.element_at(vals, pos)).otherwise(k)
    lookup = F.transform(found, _lookup)
    rebuilt = F.array_join(F.zip_with(gaps(text, TOKEN_PATTERN), F.concat(lookup, F.array(F.lit(""))),
                                      lambda g, v: F.concat(g, v)), "")
    return F.when(text.isNull(), F.lit(None)).when(F.size(found) > 0, rebuilt).otherwise(text)


def sensitivity_total(stats: Column) -> Column:
    """Sum of all counts in a stats map (0 for an empty map)."""
    return F.aggregate(F.map_values(stats), F.lit(0), lambda acc, v: acc + v)
