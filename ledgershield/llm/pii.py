"""Personal data: patterns of known kinds, and bootstrapped contextual extraction of unseen identifiers.

Everything is DataFrame expressions.  The base kinds are regular expressions; their matches are the seeds.

1. Every base match is an identifier as a whole, however long or short its tokens.  Every other token with a
   digit or an at sign, and every run of number tokens (``555 123 4567``), of ``SHORTEST`` to ``LONGEST``
   characters is a candidate.  Its context gives up to three lexical patterns: the word before its first
   token, the two words before it, and the words on both sides.
2. (pattern, identifier) pairs form a graph.  In turn, a pattern's confidence for a kind is the share of
   that kind among its distinct identifiers (less for rare patterns: ``DOUBT`` is added to the divisor, more of it
   for one word than for two), and an identifier's score is the probability that at least one of its patterns is
   right (noisy or).  Only kinds count whose characters the identifier could have.  Seeds keep score 1; after
   ``ROUNDS`` rounds, patterns that only unseen identifiers link to seeds have scores too.
3. Tokens and runs outside base spans whose score reaches ``CONFIDENT`` through a pattern of that confidence are
   reported as ``context_<kind>``; a token in a reported run is not reported besides.

Patterns and identifiers are aggregated before they are joined, and only patterns above ``USEFUL`` go on, so
a word that stands before a third of all tokens is one row of partial sums per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

KINDS = ("email", "ip", "card", "phone")
# The patterns as stated, with possessive repeats, and starts only where an earlier start could not have
# matched: the same matches in time linear in the text.
_LOCAL, _OCTET = "[A-Za-z0-9._%+-]", "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {"email": "@", "phone": "+"}                 # a text without the character has no match
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"         # tokens with a digit or at sign
# two or more number tokens with one space between them: an identifier written in groups
_GROUP = r"[0-9]++(?:[().+/-]++[0-9]++)*+\)?+"
RUN = rf"(?<![^\s(\[{{<\"'])\+?\(?{_GROUP}(?:\x20\(?{_GROUP}(?![^\s)\]}}>\"'.,;:!?]))++"
PIECE = 1000                                         # code points of the pieces that masked texts are cut from
CONTEXT, LONGEST, SHORTEST = 60, 64, 5               # characters of context looked at; bounds of an unseen identifier
ROUNDS, USEFUL, CONFIDENT = 5, 0.5, 0.9
DOUBT = {"1": 1.0, "2": 0.3, "3": 0.3}               # by the words of a pattern: s seeds alone give s / (s + doubt)
# what an unseen identifier of a kind looks like at least
SHAPES = {"email": "@", "ip": r"^[0-9a-f]*[.:][0-9a-f.:/]*[0-9a-f]$", "card": r"^[0-9](?:[\x20./-]?[0-9])*$", "phone": r"^[+(]?[0-9][0-9\x20()./+-]*$"}


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    digits = F.reverse(_digits(m))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        double = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, double).otherwise(d)
    right_size = F.length(digits).between(12, 19)
    return F.when(right_size, F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))


VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
    "card": _luhn,
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}


def _matches(df: DataFrame, text: str, pattern: str, prefix: str, hint: str | None = None) -> DataFrame:
    """Adds arrays ``prefix``m (matches) and ``prefix``b (the text between them, one more), empty arrays
    where nothing matches."""
    none = F.array().cast("array<string>")
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    df = df.withColumn(f"{prefix}m", F.when(F.contains(F.col(text), F.lit(hint)), found).otherwise(none) if hint else found)
    return df.withColumn(f"{prefix}b", F.when(F.size(f"{prefix}m") > 0, F.split(F.col(text), pattern, -1)).otherwise(none))


def _spans(prefix: str) -> Column:
    """(s, e, m, k): bounds in code points, match and its number."""
    empty = F.array().cast("array<struct<s:int,e:int,m:string,k:int>>")

    def add(acc: Column, k: Column) -> Column:
        match = F.get(F.col(f"{prefix}m"), k)
        start = acc["at"] + F.length(F.get(F.col(f"{prefix}b"), k))
        end = start + F.length(match)
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("s"), end.alias("e"), match.alias("m"), k.alias("k"))).alias("out"))
    n = F.size(f"{prefix}m")
    walked = F.aggregate(F.sequence(F.lit(0), n - 1), F.struct(F.lit(0).alias("at"), empty.alias("out")), add, lambda acc: acc["out"])
    return F.when(n > 0, walked).otherwise(empty)


def _valid_spans(prefix: str, order: int, kind: str) -> Column:
    valid = F.filter(_spans(prefix), lambda x: VALID[kind](x["m"]))
    return F.transform(valid, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("o"), F.lit(kind).alias("kind"), x["e"].alias("e"),
                                                F.lower(x["m"]).alias("value")))


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


def with_base_spans(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: array of (s, o, kind, e, value) of the valid base matches, in order."""
    kept, names = df.columns, []
    for o, kind in enumerate(KINDS):
        df = _matches(df, text, PATTERNS[kind], f"{kind}_", HINTS.get(kind))
        df = df.withColumn(f"{kind}_spans", _valid_spans(f"{kind}_", o, kind))
        df = df.drop(f"{kind}_m", f"{kind}_b")
        names.append(f"{kind}_spans")
    return df.withColumn(out, F.array_sort(F.concat(*names))).select(*kept, out)


def with_candidates(df: DataFrame, text: str, out: str, runs: str) -> DataFrame:
    """Adds ``out``: array of (s, e, value, before, before2, after) of the tokens with a digit or at sign (a value
    out of bounds is null: such a token is no candidate), and ``runs``: array of (s, e, value) of the number runs."""
    kept = df.columns
    df = _matches(df, text, CANDIDATE, "candidate_").withColumn("candidate_s", _spans("candidate_"))

    def clean(word: Column) -> Column:
        return F.regexp_replace(F.lower(word), "[0-9]+", "0")

    def describe(x: Column) -> Column:
        left = F.right(F.get(F.col("candidate_b"), x["k"]), F.lit(CONTEXT))
        right = F.left(F.get(F.col("candidate_b"), x["k"] + 1), F.lit(CONTEXT))
        head = F.length(F.regexp_extract(x["m"], "^[(\\[{<\"']*+", 0))
        tail = F.length(F.regexp_extract(x["m"], "(?<![)\\]}>\"'.,;:!?])[)\\]}>\"'.,;:!?]++$", 0))
        start, end = x["s"] + head, x["e"] - tail
        fits = F.length(x["m"]).between(SHORTEST, LONGEST) & (end - start >= SHORTEST)
        one = F.regexp_extract(left, r"(?<!\S)(\S++)\s++$", 1)
        return F.struct(start.alias("s"), end.alias("e"), F.when(fits, F.lower(F.substring(x["m"], head + 1, end - start))).alias("value"),
                        clean(one).alias("before"), clean(F.regexp_extract(left, r"(?<!\S)(\S++\s++\S++)\s++$", 1)).alias("before2"),
                        clean(F.regexp_extract(right, r"^\s++(\S++)", 1)).alias("after"))
    df = df.withColumn(out, F.transform("candidate_s", describe)).select(*kept, out)
    df = _matches(df, text, RUN, "run_").withColumn("run_s", _spans("run_"))
    fitting = F.filter("run_s", lambda x: F.length(x["m"]).between(SHORTEST, LONGEST))
    return df.withColumn(runs, F.transform(fitting, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("value")))) \
        .select(*kept, out, runs)


def score_identifiers(occurrences: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(value, kind, score) of unseen identifiers of score ``CONFIDENT`` or more.

    ``occurrences``: value, before, before2, after, seed (a base kind, or null)."""
    b, b2, a = F.col("before"), F.col("before2"), F.col("after")
    patterns = F.array(F.when(b != "", F.concat(F.lit("1 "), b)), F.when(b2 != "", F.concat(F.lit("2 "), b2)),
                       F.when((b != "") & (a != ""), F.concat(F.lit("3 "), b, F.lit(" _ "), a)))
    seeds = [F.max((F.col("seed") == kind).cast("double")).alias(kind) for kind in KINDS]
    pairs = occurrences.select("value", "seed", F.explode(patterns).alias("pattern")).filter("pattern is not null")
    graph = written(pairs.groupBy("pattern", "value").agg(*[F.coalesce(s, F.lit(0.0)).alias(k) for s, k in zip(seeds, KINDS)]), "graph")
    # a value is a seed of a kind wherever it stands
    known = written(graph.groupBy("value").agg(*[F.max(k).alias(k) for k in KINDS]), "identifiers")
    scores = known
    doubt = F.element_at(F.create_map(*[F.lit(x) for pair in DOUBT.items() for x in pair]), F.left("pattern", F.lit(1)))
    for _ in range(rounds):
        sums = graph.select("pattern", "value").join(scores, "value").groupBy("pattern") \
            .agg(F.count(F.lit(1)).alias("n"), *[F.sum(k).alias(k) for k in KINDS])
        useful = sums.select("pattern", *[(F.col(k) / (F.col("n") + doubt)).alias(k) for k in KINDS]) \
            .filter(F.greatest(*KINDS) >= USEFUL)
        votes = graph.select("pattern", "value").join(useful, "pattern").groupBy("value") \
            .agg(*[(1 - F.exp(F.sum(F.log1p(-F.when(F.col(k) >= USEFUL, F.least(F.col(k), F.lit(0.999999))).otherwise(0.0))))).alias(f"v_{k}") for k in KINDS],
                 *[F.max(k).alias(f"best_{k}") for k in KINDS])
        all_ = known.join(votes, "value", "left")

        def fitting(name: str, kind: str) -> Column:
            return F.when(F.col("value").rlike(SHAPES[kind]), F.coalesce(name, F.lit(0.0))).otherwise(0.0)
        scores = written(all_.select("value", *[F.greatest(k, fitting(f"v_{k}", k)).alias(k) for k in KINDS],
                                     *[fitting(f"best_{k}", k).alias(f"best_{k}") for k in KINDS]), "scores")
        best, scores = scores, scores.select("value", *KINDS)
    unseen = best.join(known.filter(F.greatest(*KINDS) == 0).select("value"), "value", "left_semi")
    top = F.array_max(F.array(*[F.struct(F.col(k).alias("score"), F.lit(-o).alias("o"), F.lit(k).alias("kind"), F.col(f"best_{k}").alias("best"))
                                for o, k in enumerate(KINDS)]))
    return unseen.select("value", top.alias("t")).filter((F.col("t.score") >= CONFIDENT) & (F.col("t.best") >= CONFIDENT)) \
        .select("value", F.col("t.kind").alias("kind"), F.col("t.score").alias("score"))


def _overlap(x: Column, y: Column) -> Column:
    return (x["s"] < y["e"]) & (y["s"] < x["e"])


def _occurrences(found: DataFrame) -> DataFrame:
    """(row_, s, e, value, before, before2, after, seed): every base span, and the runs and tokens that touch none."""
    def untouched(x: Column) -> Column:
        return ~F.exists("base_", lambda s: _overlap(x, s))

    def held(x: Column, seed: Column) -> Column:
        return F.struct(x.alias("x"), seed.cast("string").alias("seed"), F.filter("tokens_", lambda c: _overlap(c, x)).alias("in"))

    def described(w: Column) -> Column:
        first, last = F.get(w["in"], F.lit(0)), F.get(w["in"], F.size(w["in"]) - 1)
        return F.struct(w["x"]["s"].alias("s"), w["x"]["e"].alias("e"), w["x"]["value"].alias("value"), first["before"].alias("before"),
                        first["before2"].alias("before2"), last["after"].alias("after"), w["seed"].alias("seed"))
    seeds = F.transform(F.transform("base_", lambda x: held(x, x["kind"])), described)
    runs = F.transform(F.transform(F.filter("runs_", untouched), lambda x: held(x, F.lit(None))), described)
    tokens = F.transform(F.filter("tokens_", lambda c: c["value"].isNotNull() & untouched(c)),
                         lambda c: F.struct(*[c[n].alias(n) for n in ("s", "e", "value", "before", "before2", "after")], F.lit(None).cast("string").alias("seed")))
    return found.select("row_", F.explode(F.concat(seeds, runs, tokens)).alias("c")).select("row_", "c.*")


def _annotated(docs: DataFrame, text_col: str, cols: list[str], keep_text: bool) -> DataFrame:
    """Written rows: ``cols`` as in0_, in1_, ..., text_ if asked for, base_ and extra_ (contextual spans)."""
    kept = [f"in{i}_" for i in range(len(cols))] + ["text_"] * keep_text
    rows = docs.select(F.monotonically_increasing_id().alias("row_"), *[F.col(c).alias(n) for c, n in zip(cols, kept)],
                       F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    found = with_candidates(with_base_spans(rows, "text_", "base_"), "text_", "tokens_", "runs_")
    found = written(found.select("row_", *kept, "base_", "tokens_", "runs_"), "pii_rows")
    occurrences = _occurrences(found)
    named = score_identifiers(occurrences)
    extra = occurrences.filter("seed is null").join(named, "value").groupBy("row_").agg(F.array_sort(F.collect_list(F.struct(
        F.col("s"), F.lit(len(KINDS)).alias("o"), F.concat(F.lit("context_"), F.col("kind")).alias("kind"), F.col("e")))).alias("all_"))
    longest = F.filter("all_", lambda x: ~F.exists("all_", lambda y: (y["s"] <= x["s"]) & (x["e"] <= y["e"]) & (y["e"] - y["s"] > x["e"] - x["s"])))
    extra = extra.select("row_", longest.alias("extra_"))
    plain = F.transform("base_", lambda x: F.struct(*[x[n].alias(n) for n in ("s", "o", "kind", "e")]))
    return found.select("row_", *kept, plain.alias("base_")).join(extra, "row_", "left")


def _every(rows: DataFrame) -> Column:
    """Base and contextual spans in order."""
    return F.array_sort(F.concat(F.col("base_"), F.coalesce("extra_", F.array().cast(rows.schema["base_"].dataType))))


def _text_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: id, n_email, n_ip, n_card, n_phone, base_sha256 (of kind:start:end of the base
    spans) and spans (those and the contextual ones).  Positions count code points, ends are exclusive.

    Null and empty texts have no spans.  Texts of any length are searched whole.  Repeated rows give
    repeated results; null ids give rows too; extra columns are ignored; an empty table gives an empty
    result.  No contextual span overlaps a base one.  Unseen identifiers are single tokens or runs of number
    tokens with one space between them, of 5 to 64 characters; base spans of any length teach contexts."""
    out = _annotated(docs, text_col, [id_col], False)
    every = _every(out)
    counts = [F.size(F.filter("base_", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select(F.col("in0_").alias(id_col), *counts, F.sha2(_text_of(F.col("base_")), 256).alias("base_sha256"), _text_of(every).alias("spans"))


def mask_personal_data(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span in ``text_col`` replaced by its kind in brackets, such as ``[EMAIL]`` (spans that
    overlap: their whole stretch, by the kind of the first), and
    ``length_col`` (if there is one) set to the new length.  Null texts stay null; texts without spans and all
    other columns stay as they are."""
    rows = _annotated(docs, text_col, docs.columns, True)
    rows = _splice(rows, "text_", _every(rows))
    # what a span had kept from matching can match now
    for kind in KINDS:
        rows = _replace(rows, "text_", PATTERNS[kind], _mask_if_valid(kind), (F.size("base_") > 0) | F.col("extra_").isNotNull())
    changed = (F.size("base_") > 0) | F.col("extra_").isNotNull()

    def column(i: int, c: str):
        if c == text_col:
            return F.when(F.col(f"in{i}_").isNotNull(), F.col("text_"))
        if c == length_col:
            return F.when(changed, F.length("text_").cast(docs.schema[c].dataType)).otherwise(F.col(f"in{i}_"))
        return F.col(f"in{i}_")
    return rows.select(*[column(i, c).alias(c) for i, c in enumerate(docs.columns)])


def _splice(df: DataFrame, text: str, spans: Column) -> DataFrame:
    """Replaces ``spans`` (in order) in one go; overlapping ones are one stretch.  The text is cut into pieces of
    ``PIECE`` code points first, so that a cut far into it does not count its characters from the start."""
    kept = [c for c in df.columns if c != text]
    empty = F.array().cast("array<struct<s:int,e:int,kind:string>>")

    def merge(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        own = F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))
        longer = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"), last["kind"].alias("kind"))
        return F.when((F.size(acc) > 0) & (x["s"] < last["e"]), F.array_append(F.slice(acc, 1, F.size(acc) - 1), longer)).otherwise(F.array_append(acc, own))

    df = df.withColumn("cuts_", F.aggregate(spans, empty, merge))
    df = df.withColumn("pieces_", F.when(F.size("cuts_") > 0, F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))))

    def cut(s: Column, e: Column) -> Column:
        first = F.floor(s / PIECE).cast("int")
        held = F.slice(F.col("pieces_"), first + 1, F.floor(e / PIECE).cast("int") - first + 1)
        return F.substring(F.array_join(held, ""), s - first * PIECE + 1, e - s)

    def part(x: Column, i: Column) -> Column:
        before = F.when(i == 0, 0).otherwise(F.get(F.col("cuts_"), i - 1)["e"])
        return F.concat(cut(before, x["s"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
    n = F.size("cuts_")
    tail = cut(F.get(F.col("cuts_"), n - 1)["e"], F.size("pieces_") * PIECE)
    joined = F.concat(F.array_join(F.transform("cuts_", part), ""), tail)
    return df.withColumn(text, F.when(n > 0, joined).otherwise(F.col(text))).select(*kept, text)


def _mask_if_valid(kind: str):
    return lambda m, k: F.when(VALID[kind](m), F.lit(f"[{kind.upper()}]"))


def _replace(df: DataFrame, text: str, pattern: str, stand_in, where: Column) -> DataFrame:
    """Where ``where`` holds, each match of ``pattern`` becomes ``stand_in(match, number)``, or stays if that is null."""
    kept = [c for c in df.columns if c != text]
    df = df.withColumn("here_", where).withColumn("m_", F.when(F.col("here_"), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))))
    df = df.withColumn("b_", F.when(F.size("m_") > 0, F.split(F.col(text), pattern, -1)))
    n = F.size("m_")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.concat(
        F.get(F.col("b_"), k), F.coalesce(stand_in(F.get(F.col("m_"), k), k), F.get(F.col("m_"), k))))
    joined = F.concat(F.array_join(parts, ""), F.get(F.col("b_"), n))
    return df.withColumn(text, F.when(F.col("b_").isNotNull(), joined).otherwise(F.col(text))).select(*kept, text)
