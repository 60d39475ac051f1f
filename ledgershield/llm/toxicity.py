"""Toxicity: a convolutional text classifier trained in numpy.

A word's vector is the sum of hashed embeddings of the word and of its prefixes of 3, 4 and 5 letters, so
inflected forms of a stem share evidence.  Filters of widths 1, 2 and 3 slide over the vectors, the
largest response of each over the whole text is kept (max pooling), and a logistic layer scores them.
Embeddings, filters and layer are trained together by Adagrad; the gradient of max pooling touches only
the words that gave the largest responses.  The first embedding dimension starts from the smoothed
log-odds of the bucket in the sample.

Training uses every labelled row that is not held out.  Four fifths of them, chosen by hash of the id, are
learned from: the log-odds are counted over all of them, then they are dealt to shards of about ``shard_rows``
rows by hash of the id, and in each of ``ROUNDS`` rounds every shard is learned in a task of its own from the
common model (``EPOCHS`` passes each).  A round's model is the mean of its shards': filters and layer weighted by
rows, an embedding by the updates that it had in each.  The remaining fifth fits the score's scale (Platt) and a
threshold for each language, from counts of its logits in steps of 1 / ``STEPS``.  The driver holds only the model
and these counts, whatever the number of rows; counts and changes of the buckets reach it as Arrow columns, since a
Python object for each of their numbers would take many times the model's memory.  Scoring is a pass over the texts without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field as dc_field, replace
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name, written

WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 19
DIM, FILTERS, WIDTHS, PREFIXES = 8, 8, (1, 2, 3), (3, 4, 5)
SEGMENT = 50_000        # words of one text that are convolved at a time; longer texts take the maximum of their segments
CACHE = 300_000
ROUNDS, EPOCHS, RATE = 2, 2, 0.05
SHARD_BYTES = 32 << 20      # text of a shard, on average at most
UNIT = float(1 << 24)       # updates are added as whole numbers of 1 / UNIT, so that no order of adding changes a model
DRAWN = 1 << 15             # embeddings that are drawn at a time
STEPS = 64                  # logits are counted in steps of 1 / STEPS


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Buckets:
    """Hash buckets of a word: its own, and those of its longer prefixes (kept, as few words begin anew)."""

    def __init__(self) -> None:
        self.prefixes: dict[str, tuple[int, ...]] = {}

    def __call__(self, word: str) -> tuple[int, ...]:
        start = word if len(word) <= PREFIXES[-1] else word[:PREFIXES[-1]] + "_"
        of_prefixes = self.prefixes.get(start)
        if of_prefixes is None:
            if len(self.prefixes) > CACHE:
                self.prefixes.clear()
            of_prefixes = tuple(_hash(f"{n}{word[:n]}") for n in PREFIXES if len(word) > n)
            self.prefixes[start] = of_prefixes
        return (_hash(word), *of_prefixes)


def _hash(part: str) -> int:
    return zlib.crc32(part.encode("utf-8", "surrogatepass")) % BUCKETS


@dataclass
class Model:
    embed: np.ndarray                       # (BUCKETS, DIM)
    filters: list[np.ndarray]               # per width k: (k * DIM, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray                         # over all pooled responses, and the intercept last
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str | None, float] = dc_field(default_factory=dict)
    threshold: float = 0.5


def _responses(model: Model, x: np.ndarray) -> list[np.ndarray]:
    """Filter responses at every position of word vectors ``x``, which end in padding."""
    n = len(x) - max(WIDTHS) + 1
    out = []
    for k, w, b in zip(WIDTHS, model.filters, model.bias):
        r = x[:n] @ w[:DIM]
        for j in range(1, k):
            r += x[j:n + j] @ w[j * DIM:(j + 1) * DIM]
        out.append(np.maximum(r + b, 0))
    return out


# -- training ----------------------------------------------------------------------------------------

def features(texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The buckets of every different word, one row each (filled up with ``BUCKETS``, whose vector is zero), and the
    texts as row numbers."""
    buckets_of = Buckets()
    rows: dict[str, int] = {}
    docs = []
    for t in texts:
        words = words_of(t)
        for w in words:
            if w not in rows:
                rows[w] = len(rows)
        docs.append(np.fromiter(map(rows.__getitem__, words), np.int32, len(words)))
    fill = [(BUCKETS,) * n for n in range(len(PREFIXES) + 2)]
    flat = chain.from_iterable(ids + fill[len(PREFIXES) + 1 - len(ids)] for ids in map(buckets_of, rows))
    return np.fromiter(flat, np.int32, len(rows) * (len(PREFIXES) + 1)).reshape(len(rows), len(PREFIXES) + 1), docs


def count_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (text, y): the number of texts of either class that have a bucket, one row per bucket met."""
    seen = np.zeros((2, BUCKETS + 1), np.int64)
    for b in batches:
        table, docs = features(b["text"].tolist())
        for doc, y in zip(docs, b["y"].tolist()):
            seen[int(y), table[doc]] += 1            # once, however often a text has it
    met = np.flatnonzero(seen[:, :BUCKETS].any(axis=0))
    yield pd.DataFrame({"bucket": met, "n0": seen[0, met], "n1": seen[1, met]})


def start_model(buckets: np.ndarray, n0: np.ndarray, n1: np.ndarray, rows: np.ndarray, seed: int = 7) -> Model:
    """The model before training: ``n0`` and ``n1`` texts of either class have a bucket, of ``rows`` in all."""
    rng = np.random.default_rng(seed)
    embed = np.empty((BUCKETS, DIM), np.float32)
    for at in range(0, BUCKETS, DRAWN):          # the same numbers as at once, without all of them in double precision
        part = embed[at:at + DRAWN]
        part[:] = rng.standard_normal(part.shape) * 0.05
    odds = np.log((n1 + 0.5) / (max(rows[1], 1) + 1)) - np.log((n0 + 0.5) / (max(rows[0], 1) + 1))
    embed[:, 0] = 0
    embed[buckets, 0] = np.where(n0 + n1 > 2, np.clip(odds, -3, 3), 0) / (1 + len(PREFIXES))
    filters = [(rng.standard_normal((k * DIM, FILTERS)) * 0.1).astype(np.float32) for k in WIDTHS]
    for w in filters:
        w[0, : FILTERS // 2] = 1.0
    return Model(embed, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
                 np.concatenate((np.full(FILTERS * len(WIDTHS), 0.05, np.float32), [-0.5])).astype(np.float32))


REACH = max(WIDTHS)
#: The numbers of a filter of a smaller width are those of the first words of one of the largest.
USED = np.concatenate([np.repeat(np.arange(REACH * DIM)[:, None] < k * DIM, FILTERS, axis=1) for k in WIDTHS], axis=1)


@dataclass
class State:
    """A model in training: embeddings (the last is zero), [filters side by side, biases, layer], and the squared
    gradients that Adagrad has summed for either."""
    embed: np.ndarray
    past_embed: np.ndarray
    dense: list[np.ndarray]
    past: list[np.ndarray]

    @classmethod
    def of(cls, model: Model) -> State:
        filters = np.concatenate([np.pad(w, ((0, REACH * DIM - len(w)), (0, 0))) for w in model.filters], axis=1)
        dense = [filters, np.concatenate(model.bias), model.out.copy()]
        return cls(np.concatenate((model.embed, np.zeros((1, DIM), np.float32))), np.full(BUCKETS + 1, 1e-3, np.float32), dense,
                   [np.full_like(p, 1e-3) for p in dense])

    def model(self) -> Model:
        filters, bias, out = self.dense
        cuts = [slice(i * FILTERS, (i + 1) * FILTERS) for i in range(len(WIDTHS))]
        return Model(self.embed[:BUCKETS], [filters[:k * DIM, c] for k, c in zip(WIDTHS, cuts)], [bias[c] for c in cuts], out)

    def copy(self) -> State:
        return State(self.embed.copy(), self.past_embed.copy(), [p.copy() for p in self.dense], [p.copy() for p in self.past])

    def numbers(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in (*self.dense, *self.past)]).astype(float)

    def add(self, means: pa.Table) -> None:
        """Take over the mean changes of a round (bucket, ``PARTS``)."""
        bucket = means["bucket"].to_numpy()
        met = bucket[bucket >= 0]
        for d in range(DIM):
            self.embed[met, d] += means[PARTS[d]].to_numpy()[bucket >= 0]
        self.past_embed[met] += means[PARTS[DIM]].to_numpy()[bucket >= 0]
        rest, at = self.numbers(), 0
        rest[-1 - bucket[bucket < 0]] += means[PARTS[0]].to_numpy()[bucket < 0]
        for p in (*self.dense, *self.past):
            p[...] = rest[at:at + p.size].reshape(p.shape)
            at += p.size


PARTS = [f"v{d}" for d in range(DIM + 1)]       # of an embedding: its change, and that of its squared gradients
UPDATES = "bucket int, weight long, " + ", ".join(f"{c} long" for c in PARTS)


def learn_shard(state: State, texts: list[str | None], labels: np.ndarray, weight: np.ndarray, seed: int) -> pd.DataFrame:
    """``EPOCHS`` passes over a shard from ``state``.  Its changes times their weights, in units of 1 / ``UNIT``: rows
    of the buckets that it updated, and one row per number of ``State.numbers`` (in ``v0``; their buckets are -1 and
    below)."""
    own = state.copy()
    table, docs = features(texts)
    hits = np.zeros(BUCKETS + 1, np.int32)
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(docs)):
            step(own, table, docs[i], labels[i], weight[int(labels[i])], RATE, hits)
    met = np.flatnonzero(hits[:BUCKETS])
    change = np.column_stack((own.embed[met].astype(float) - state.embed[met], own.past_embed[met].astype(float) - state.past_embed[met]))
    rest = (own.numbers() - state.numbers()) * len(docs)
    out = np.zeros((len(met) + len(rest), DIM + 1))
    out[:len(met)], out[len(met):, 0] = change * hits[met][:, None], rest
    made = pd.DataFrame(np.rint(out * UNIT).astype(np.int64), columns=PARTS)
    made.insert(0, "weight", np.concatenate((hits[met], np.full(len(rest), len(docs)))).astype(np.int64))
    made.insert(0, "bucket", np.concatenate((met, -1 - np.arange(len(rest)))).astype(np.int32))
    return made


def step(state: State, table: np.ndarray, doc: np.ndarray, y: float, weight: float, rate: float, hits: np.ndarray) -> None:
    """One Adagrad step on one text; ``hits`` counts the updates of every bucket."""
    n = len(doc)
    filters, bias, layer = state.dense
    x = np.zeros((max(n, 1) + REACH - 1, DIM), np.float32)     # ends in padding
    ids = table[doc]
    for part in range(ids.shape[1]):
        x[:n] += state.embed[ids[:, part]]
    windows = np.lib.stride_tricks.as_strided(x, (max(n, 1), REACH * DIM), (x.strides[0], x.strides[1]), writeable=False)
    responses = windows @ filters
    at = responses.argmax(axis=0)
    top = np.maximum(responses[at, np.arange(len(at))] + bias, 0)
    pooled = np.append(top, np.float32(1))
    error = np.float32(weight * (1 / (1 + np.exp(-float(pooled @ layer))) - y))
    back = error * layer[:-1] * (top > 0)
    grads = [windows[at].T * back * USED, back, error * pooled]
    wanted = (filters * back).T.reshape(len(at), REACH, DIM)
    places = at[:, None] + np.arange(REACH)
    used = USED[::DIM].T & (back != 0)[:, None] & (places < n)
    wanted, places = wanted[used], places[used]
    for p, g, h in zip(state.dense, grads, state.past):
        h += g * g
        p -= rate * g / np.sqrt(h)
    if len(places):
        words, which = np.unique(places, return_inverse=True)
        of_words = np.zeros((len(words), DIM), np.float32)
        np.add.at(of_words, which, wanted)
        buckets = ids[words]
        np.add.at(state.past_embed, buckets, ((of_words * of_words).sum(axis=1) / DIM)[:, None])
        scale = rate / np.sqrt(state.past_embed[buckets])
        np.subtract.at(state.embed, buckets.ravel(), (of_words[:, None, :] * scale[:, :, None]).reshape(-1, DIM))
        np.add.at(hits, buckets, 1)
        state.embed[BUCKETS] = 0


def calibrate(model: Model, logits: np.ndarray, labels: np.ndarray, langs: list[str | None], rates: np.ndarray,
              counts: np.ndarray, least: int = 8) -> None:
    """Platt scale under the class rates of all labels, and by language the threshold of the best F1 on the
    scale (``threshold`` where a language has fewer than ``least`` rows of either class).  Each logit, label and
    language stands for ``counts`` rows."""
    logits = logits.astype(np.float64)
    held = np.maximum(np.bincount(labels.astype(int), counts, minlength=2), 1)
    weight = (rates / held)[labels.astype(int)] * counts
    target = np.where(labels > 0, (held[1] + 1) / (held[1] + 2), 1 / (held[0] + 2))

    def probability(a: float, b: float) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30)))

    def intercept(a: float) -> float:
        low, high = -60.0 - a * np.max(np.abs(logits)), 60.0 + a * np.max(np.abs(logits))
        for _ in range(80):                      # the weighted mean probability grows with the intercept
            mid = (low + high) / 2
            low, high = (low, mid) if np.sum(weight * (probability(a, mid) - target)) > 0 else (mid, high)
        return (low + high) / 2

    def loss(a: float) -> float:
        p = np.clip(probability(a, intercept(a)), 1e-12, 1 - 1e-12)
        return -float(np.sum(weight * (target * np.log(p) + (1 - target) * np.log(1 - p))))
    a = min(np.geomspace(0.02, 4, 60).tolist(), key=loss)
    model.scale = (a, float(intercept(a)))
    scores = probability(*model.scale)

    def best(own: np.ndarray) -> float:
        s, y = scores[own], labels[own] > 0
        options = np.linspace(0.2, 0.9, 71)
        f1 = [2 * np.sum(weight[own][y & (s >= t)]) / max(1e-12, np.sum(weight[own][s >= t]) + np.sum(weight[own][y])) for t in options]
        good = options[np.asarray(f1) >= max(f1) - 1e-9]
        return float(good[len(good) // 2])
    model.threshold = best(np.ones(len(labels), bool))
    for lang in sorted({x for x in langs if x is not None}):
        own = np.array([x == lang for x in langs])
        if min(np.bincount(labels[own].astype(int), counts[own], minlength=2)) >= least:
            model.thresholds[lang] = best(own)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[DataFrame | None, np.ndarray]:
    """Every labelled row that is not held out (id, y, text, lang, aside: one of a fifth for the calibration), written,
    and the class rates among all usable labels; no rows where a class has none."""
    usable = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("y")) \
        .filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id"))).distinct()
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = np.array([counts.get(0, 0), counts.get(1, 0)], float)
    rates = total / max(1.0, total.sum())
    if not rates.all():
        return None, rates
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    # merged by id whatever the number of labels: a broadcast of them would grow with the input
    rows = src.join(usable.hint("merge"), "id").select("id", "y", "text", "lang", F.row_number().over(
        Window.partitionBy("id", "y").orderBy(F.xxhash64("text"), F.xxhash64("lang"))).alias("copy")).filter("copy = 1").drop("copy")
    return written(rows.withColumn("aside", F.pmod(F.xxhash64("id", F.lit("aside")), F.lit(5)) == 0), "toxicity-rows"), rates


def held_out(id_: Column) -> Column:
    return F.crc32(id_.cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, shard_rows: int = 2048, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> Model | None:
    """A model from all labelled rows that are not held out, or None if either class is missing."""
    rows, rates = training_rows(docs, labels, id_col, text_col, lang_col)
    if rows is None:
        return None
    spark = docs.sparkSession
    found = {(r["aside"], r["y"]): r for r in rows.groupBy("aside", "y").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).collect()}
    if not all(any((a, y) in found for a in (False, True)) for y in (0, 1)):
        return None
    # a part without one of the classes is joined by the other
    learned, held = (rows.filter(F.col("aside") == a) if all((a, y) in found for y in (0, 1)) else rows for a in (False, True))
    used = [r for (a, _), r in found.items() if not a or not all((False, y) in found for y in (0, 1))]
    of_class = np.array([sum(r["n"] for r in used if r["y"] == y) for y in (0, 1)])
    shards = int(max(1, -(-of_class.sum() // shard_rows), -(-sum(r["bytes"] for r in used) // SHARD_BYTES)))
    seen = learned.select("text", "y").mapInPandas(count_buckets, "bucket int, n0 long, n1 long") \
        .groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).filter("n0 + n1 > 2").toArrow()
    state = State.of(start_model(*(seen[c].to_numpy() for c in ("bucket", "n0", "n1")), of_class))
    weight = of_class.sum() / (2.0 * np.maximum(of_class, 1))
    name = F.col("id").cast("string")
    dealt = learned.select(F.pmod(F.xxhash64("id", F.lit("shard")), F.lit(shards)).cast("int").alias("shard"),
                           F.crc32(name.cast("binary")).alias("place"), name.alias("id"), "y", "text")
    means = [(F.sum(c) / F.sum("weight") / UNIT).cast("float").alias(c) for c in PARTS]
    for number in range(ROUNDS):
        shipped = spark.sparkContext.broadcast((state.embed, state.past_embed, state.dense, state.past))

        def learn(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
            own = own.sort_values(["place", "id", "y"], kind="stable")
            return learn_shard(State(*shipped.value), own["text"].tolist(), own["y"].to_numpy(), weight, seed=7 + number + ROUNDS * int(key[0]))
        state.add(dealt.groupBy("shard").applyInPandas(learn, UPDATES).groupBy("bucket").agg(*means).toArrow())
        shipped.destroy()
    model = state.model()
    shipped = _shipped(spark, model)
    logit = F.floor(_scores(shipped, "logits")(F.col("text")) * STEPS + 0.5).cast("long")
    bins = held.select("lang", "y", logit.alias("logit")).groupBy("lang", "y", "logit").agg(F.count(F.lit(1)).alias("n")).toPandas() \
        .sort_values(["lang", "y", "logit"], kind="stable", na_position="first")
    shipped.destroy()
    langs = [x if isinstance(x, str) else None for x in bins["lang"]]
    calibrate(model, bins["logit"].to_numpy() / STEPS, bins["y"].to_numpy(float), langs, rates, bins["n"].to_numpy(float))
    return model


# -- scoring -----------------------------------------------------------------------------------------

class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = replace(model, embed=model.embed.astype(np.float32))
        self.buckets_of = Buckets()
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.vectors = np.zeros((1024, DIM), np.float32)     # row 0 is padding

    def _rows(self, words: list[str]) -> np.ndarray:
        new = [w for w in set(words) if w not in self.rows]
        if len(self.rows) + len(new) > CACHE and self.rows:
            self._clear()
            new = list(set(words))
        first = len(self.rows) + 1
        while first + len(new) > len(self.vectors):
            self.vectors = np.concatenate((self.vectors, np.zeros_like(self.vectors)))
        if new:
            ids = list(map(self.buckets_of, new))
            flat = np.fromiter(chain.from_iterable(ids), np.int64)
            starts = np.cumsum([0, *map(len, ids[:-1])])
            self.vectors[first:first + len(new)] = np.add.reduceat(self.model.embed[flat], starts, axis=0)
            self.rows.update(zip(new, range(first, first + len(new))))
        return np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))

    def logits(self, texts: list[str | None]) -> np.ndarray:
        pad = max(WIDTHS)                 # zero rows after each part, so that no window reaches the next text
        pooled = np.zeros((len(texts), FILTERS * len(WIDTHS)), np.float32)
        parts: list[list[str]] = []
        owners: list[int] = []
        counts: list[int] = []            # window positions of each part

        def flush() -> None:
            if not parts:
                return
            rows = self._rows([w for p in parts for w in p])
            lengths = np.array([len(p) for p in parts])
            starts = np.cumsum(lengths + pad) - lengths - pad
            x = np.zeros(int((lengths + pad).sum()) + pad, np.int64)
            x[np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(rows))] = rows
            responses = _responses(self.model, self.vectors[x])
            positions = np.array(counts)
            valid = np.arange(len(responses[0])) < np.repeat(starts + positions, np.diff([*starts, len(responses[0])]))
            tops = [np.maximum.reduceat(r * valid[:, None], starts, axis=0) for r in responses]
            np.maximum.at(pooled, np.array(owners), np.concatenate(tops, axis=1))
            parts.clear(), owners.clear(), counts.clear()

        size = 0
        for i, t in enumerate(texts):
            words = words_of(t)
            for at in range(0, max(1, len(words)), SEGMENT):
                parts.append(words[at:at + SEGMENT + pad - 1])
                owners.append(i)
                counts.append(max(1, min(SEGMENT, len(words) - at)))
                size += len(parts[-1])
                if size >= SEGMENT:
                    flush()
                    size = 0
        flush()
        return pooled @ self.model.out[:-1] + self.model.out[-1]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        a, b = self.model.scale
        return 1 / (1 + np.exp(-np.clip(a * self.logits(texts).astype(np.float64) + b, -30, 30)))


def _shipped(spark: SparkSession, model: Model) -> Broadcast:
    # arrays and numbers only: a broadcast is unpickled by name, and executors need no copy of this package.
    # BUCKETS x DIM half-precision numbers: 8 MB whatever the data
    return spark.sparkContext.broadcast((model.embed.astype(np.float16), model.filters, model.bias, model.out, model.scale))


def _scores(shipped: Broadcast, method: str):
    """A column function: ``scores`` or ``logits`` of texts by a shipped model."""
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(Model(*shipped.value))
        for texts in batches:
            yield pd.Series(getattr(scorer, method)(texts.tolist()).astype(np.float64))
    return score.asNondeterministic()


def score_column(model: Model | None, text: Column, spark: SparkSession | None = None) -> Column:
    if model is None:
        return F.lit(0.0)
    return _scores(_shipped(spark or SparkSession.getActiveSession(), model), "scores")(text)


def threshold_column(model: Model | None, lang: Column) -> Column:
    if model is None:
        return F.lit(1.0)
    out = F.lit(model.threshold)
    for name, t in sorted(model.thresholds.items()):
        out = F.when(lang == name, F.lit(t)).otherwise(out)
    return out


def toxicity(docs: DataFrame, labels: DataFrame, shard_rows: int = 2048, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", cut: float = 0.7) -> DataFrame:
    """Per document row: id, held_out, score, predicted (score >= ``cut``), threshold (its language's),
    toxic (score >= threshold).

    The score depends on the text alone; null and empty texts have the score of a text without words.
    Labels that are null or not 0 or 1, and null label ids, are ignored; equal label rows count once.
    A null id is not held out.  Without labels of both classes every score is 0.  Extra columns are
    ignored; an empty table gives an empty result."""
    model = fit(docs, labels, shard_rows, id_col, text_col, lang_col)
    out = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"),
                      score_column(model, F.col(text_col), docs.sparkSession).alias("score"))
    threshold = threshold_column(model, F.col("lang"))
    return out.select(F.col("id").alias(id_col), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= cut).cast("int").alias("predicted"), threshold.alias("threshold"),
                      (F.col("score") >= threshold).alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, shard_rows: int = 2048, id_col: str = "doc_id", text_col: str = "text",
               lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose score is below their language's threshold, with their columns as they are."""
    model = fit(docs, labels, shard_rows, id_col, text_col, lang_col)
    score = free_name(docs, "score")
    return docs.withColumn(score, score_column(model, F.col(text_col), docs.sparkSession)) \
        .filter(F.col(score) < threshold_column(model, F.col(lang_col).cast("string"))).select(*docs.columns)
