"""Versioned snapshots of computed views: publish, scan, metadata, archive (keep the newest versions), diff between
versions, and the ingest-run log.

Layout below a root folder on shared storage:
  <root>/<dataset>/data/snapshot_as_of=<date>/attempt=<id>/   records of one publish
  <root>/<dataset>/manifests/<number>.json                    one line per version: where its records are
  <root>/_runs/snapshot_as_of=<date>/...                      run log, one file per run key

The newest manifest says which versions exist.  Publishing and archiving write all they need first and then add one
manifest, in one rename: a reader sees the set before or the set after, never half of it.  Folders that no manifest
names any more are deleted after that, and by the next archive if a run ended in between.  A dataset has one writer at
a time; of two, the second finds the manifest's number taken and stops.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import files

META_SCHEMA = T.StructType([
    T.StructField("dataset", T.StringType()), T.StructField("snapshot_as_of", T.DateType()),
    T.StructField("output", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("n_rows", T.LongType()),
    T.StructField("bytes", T.LongType()), T.StructField("fetched_at", T.TimestampType()),
    T.StructField("parsed_at", T.TimestampType()), T.StructField("place", T.StringType()),
])


def _manifest_numbers(spark: SparkSession, root: str, dataset: str) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n in files.names(spark, f"{root}/{dataset}/manifests") if n.endswith(".json"))


def meta_scan(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    """One row per version that the newest manifest names, history included (``place``)."""
    numbers = _manifest_numbers(spark, root, dataset)
    if not numbers:
        return spark.createDataFrame([], META_SCHEMA)
    return spark.read.schema(META_SCHEMA).json(f"{root}/{dataset}/manifests/{numbers[-1]:09d}.json")


def _commit(spark: SparkSession, root: str, dataset: str, versions: DataFrame) -> None:
    """Add the manifest that follows the newest one; one line per version, so it is small."""
    numbers = _manifest_numbers(spark, root, dataset)
    lines = [r[0] for r in versions.select(F.to_json(F.struct(*META_SCHEMA.names))).collect()]
    files.put_once(spark, f"{root}/{dataset}/manifests/{(numbers or [0])[-1] + 1:09d}.json", "\n".join(lines) + "\n")


def latest_version(spark: SparkSession, root: str, dataset: str) -> str | None:
    r = meta_scan(spark, root, dataset).where("place = 'current'").agg(F.max("snapshot_as_of")).first()[0]
    return None if r is None else r.isoformat()


def scan(spark: SparkSession, root: str, dataset: str, schema: T.StructType, place: str = "current") -> DataFrame:
    """Records of every version in ``place``; ``snapshot_as_of`` comes from the folder, so filters on it prune folders."""
    found = [r["output"] for r in meta_scan(spark, root, dataset).where(F.col("place") == place).select("output").collect()]
    full = T.StructType([f for f in schema.fields if f.name != "snapshot_as_of"] + [T.StructField("snapshot_as_of", T.DateType())])
    if not found:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", f"{root}/{dataset}/data").json(found).drop("attempt")


def version_changes(rows: DataFrame, versions: list[str], key_cols: list[str]) -> DataFrame:
    """(snapshot_as_of, added, changed, removed) of every version against the one before, in one pass: the versions of a
    key are looked at together (a window per key, of as many rows as there are versions)."""
    spark = rows.sparkSession
    numbers = spark.createDataFrame([(v, i) for i, v in enumerate(versions)], "snapshot_as_of string, i int") \
        .withColumn("snapshot_as_of", F.col("snapshot_as_of").cast("date"))
    values = sorted(c for c in rows.columns if c not in {*key_cols, "snapshot_as_of", "source"})
    own = Window.partitionBy(*key_cols).orderBy("i")
    x = rows.join(F.broadcast(numbers), "snapshot_as_of") \
        .select(*key_cols, "i", F.sha2(F.to_json(F.struct(*values), {"ignoreNullFields": "false"}), 256).alias("hash"))
    x = x.withColumns({"before": F.lag("i").over(own), "old": F.lag("hash").over(own), "after": F.lead("i").over(own)})
    known = F.col("before") == F.col("i") - 1
    change = F.when(known & (F.col("old") == F.col("hash")), "unchanged").when(known, "changed").otherwise("added")
    gone = F.when(F.col("after").isNull() | (F.col("after") > F.col("i") + 1), F.col("i") + 1)
    events = x.select(F.explode(F.array(F.struct(F.col("i").alias("i"), change.alias("change")),
                                        F.struct(gone.alias("i"), F.lit("removed").alias("change")))).alias("e")).select("e.*")
    counts = events.groupBy("i").agg(*[F.count(F.when(F.col("change") == c, 1)).alias(c) for c in ("added", "changed", "removed")])
    return numbers.join(counts, "i", "left").fillna(0).select("snapshot_as_of", "added", "changed", "removed")


def publish_versions(rows: DataFrame, root: str, dataset: str, source: str, key_cols: list[str], attempt: int = 1) -> DataFrame:
    """Publish every version in ``rows`` (column ``snapshot_as_of``, a date) with one pass over them, and log the runs.

    A version that is published again replaces the one before; of its run log, the run of the same ``attempt``.
    ``key_cols`` identify records for the change counts.  Returns the run records."""
    spark = rows.sparkSession
    t0 = time.time()
    started = F.lit(time.time()).cast("timestamp")
    folder, token = f"{root}/{dataset}/data", uuid.uuid4().hex
    out = rows.withColumn("source", F.lit(source)).withColumn("attempt", F.lit(token))
    out.write.mode("append").partitionBy("snapshot_as_of", "attempt").json(folder)
    mine = [n for n in files.names(spark, folder) if files.exists(spark, f"{folder}/{n}/attempt={token}")]
    new = sorted(n.removeprefix("snapshot_as_of=") for n in mine)
    places = [(dataset, f"{folder}/snapshot_as_of={v}/attempt={token}", source, "ok", v) for v in new]
    if not new:
        return spark.createDataFrame([], RUN_SCHEMA)
    schema = T.StructType([f for f in out.schema.fields if f.name not in ("snapshot_as_of", "attempt")] + [T.StructField("snapshot_as_of", T.DateType())])
    before = meta_scan(spark, root, dataset)
    kept = before.where(~F.col("snapshot_as_of").cast("string").isin(new))
    prior = {r["v"]: r["output"] for r in kept.select(F.col("snapshot_as_of").cast("string").alias("v"), "output").collect()}
    every = sorted([*new, *prior])
    previous = {v: every[i - 1] if i else None for i, v in enumerate(every)}
    against = {v: path for v, path in prior.items() if v in {previous[n] for n in new}}      # what the new ones are compared with
    everything = spark.read.schema(schema).option("basePath", folder).json([p[1] for p in places] + list(against.values())).drop("attempt")
    fresh = everything.where(F.col("snapshot_as_of").cast("string").isin(new))
    sizes = {p[4]: files.size(spark, p[1]) for p in places}
    versions = spark.createDataFrame([(*p, sizes[p[4]]) for p in places], "dataset string, output string, source string, status string, v string, bytes long") \
        .withColumn("snapshot_as_of", F.col("v").cast("date"))
    facts = versions.join(fresh.groupBy("snapshot_as_of").agg(F.count(F.lit(1)).alias("n_rows")), "snapshot_as_of", "left").fillna(0, ["n_rows"])
    facts = facts.withColumns({"fetched_at": started, "parsed_at": F.lit(time.time()).cast("timestamp"), "place": F.lit("current")})
    changes = version_changes(everything, sorted([*new, *against]), key_cols).where(F.col("snapshot_as_of").cast("string").isin(new))
    runs = facts.join(changes, "snapshot_as_of").select(
        "dataset", F.concat_ws(" ", F.lit("publish"), "dataset", "v").alias("command"), "status", F.lit(0).cast("long").alias("exit_code"),
        F.col("v").alias("snapshot_as_of"), F.create_map(*[F.lit(x).cast("string") for v in new for x in (v, previous[v])])[F.col("v")].alias("previous"),
        "n_rows", *[F.col(c).cast("long").alias(f"files_{c}") for c in ("added", "changed", "removed")],
        F.lit(int((time.time() - t0) * 1000)).cast("long").alias("duration_ms"), F.lit(attempt).alias("attempt"))
    records = spark.createDataFrame(runs.collect(), RUN_SCHEMA)           # one row per version
    _commit(spark, root, dataset, kept.unionByName(facts.select(*META_SCHEMA.names)))
    records.withColumn("of", F.col("dataset")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("of", "snapshot_as_of", "attempt").json(f"{root}/_runs")
    return records


def publish(df: DataFrame, root: str, dataset: str, as_of: str, source: str, key_cols: list[str], attempt: int = 1) -> DataFrame:
    """Write one version (see ``publish_versions``)."""
    return publish_versions(df.withColumn("snapshot_as_of", F.lit(as_of).cast("date")), root, dataset, source, key_cols, attempt)


def archive_plan(meta: DataFrame, keep: int) -> DataFrame:
    """Per (dataset, version): its rank (1 = newest) and whether it is kept
    or goes to history.  Versions per dataset are few: a window per dataset
    over the metadata table only."""
    v = meta.select("dataset", "snapshot_as_of").distinct()
    rk = F.dense_rank().over(Window.partitionBy("dataset").orderBy(F.desc("snapshot_as_of")))
    return v.withColumn("rank", rk).withColumn("kept", F.col("rank") <= keep)


def archive(spark: SparkSession, root: str, dataset: str, keep: int, keep_history: int) -> DataFrame:
    """Keep the ``keep`` newest versions current, the next ``keep_history`` as history, and drop the older ones.

    Only the manifest changes: no record is read or moved.  Folders that it no longer names are deleted once it stands.
    Returns (dataset, snapshot_as_of, rank, place: current, history or pruned) of the versions there were."""
    meta = meta_scan(spark, root, dataset)
    place = F.when(F.col("rank") <= keep, "current").when(F.col("rank") <= keep + keep_history, "history").otherwise("pruned")
    plan = archive_plan(meta, keep).select("snapshot_as_of", "rank", place.alias("to"))
    rows = [tuple(r) for r in plan.select(F.lit(dataset), "snapshot_as_of", "rank", "to").orderBy("rank").collect()]
    after = meta.join(F.broadcast(plan), "snapshot_as_of").where("to != 'pruned'").withColumn("place", F.col("to"))
    _commit(spark, root, dataset, after.select(*META_SCHEMA.names))
    vacuum(spark, root, dataset)
    return spark.createDataFrame(rows, "dataset string, snapshot_as_of date, rank int, place string")


def vacuum(spark: SparkSession, root: str, dataset: str) -> None:
    """Delete the folders of records that the newest manifest does not name, and the manifests before it."""
    named = {r["output"] for r in meta_scan(spark, root, dataset).select("output").collect()}
    for number in _manifest_numbers(spark, root, dataset)[:-1]:
        files.delete(spark, f"{root}/{dataset}/manifests/{number:09d}.json")
    folder = f"{root}/{dataset}/data"
    for version in files.names(spark, folder):
        attempts = [f"{folder}/{version}/{a}" for a in files.names(spark, f"{folder}/{version}")] if version.startswith("snapshot_as_of=") else []
        old = [a for a in attempts if a not in named]
        for path in old if len(old) < len(attempts) else [f"{folder}/{version}"] if attempts else []:
            files.delete(spark, path)


def diff(old: DataFrame, new: DataFrame, key_cols: list[str]) -> DataFrame:
    """Full outer join of two versions on the key with a content hash of the
    other columns: change = added | removed | changed | unchanged."""
    skip = set(key_cols) | {"snapshot_as_of", "source"}

    def hashed(df, name):
        vals = sorted(c for c in df.columns if c not in skip)
        return df.select(*key_cols, F.sha2(F.to_json(F.struct(*vals)), 256).alias(name))
    j = hashed(old, "_old").join(hashed(new, "_new"), key_cols, "full_outer")
    change = (F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed")
              .when(F.col("_old") != F.col("_new"), "changed").otherwise("unchanged"))
    return j.select(*key_cols, change.alias("change"))


def added_removed(old: DataFrame, new: DataFrame, key_cols: list[str]) -> DataFrame:
    """Set differences of the keys (anti joins): added = new - old, removed = old - new."""
    o, n = old.select(*key_cols), new.select(*key_cols)
    return (n.join(o, key_cols, "left_anti").withColumn("change", F.lit("added"))
            .unionByName(o.join(n, key_cols, "left_anti").withColumn("change", F.lit("removed"))))


RUN_SCHEMA = T.StructType([
    T.StructField("dataset", T.StringType()), T.StructField("command", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("exit_code", T.LongType()),
    T.StructField("snapshot_as_of", T.StringType()), T.StructField("previous", T.StringType()),
    T.StructField("n_rows", T.LongType()), T.StructField("files_added", T.LongType()),
    T.StructField("files_changed", T.LongType()), T.StructField("files_removed", T.LongType()),
    T.StructField("duration_ms", T.LongType()), T.StructField("attempt", T.IntegerType()),
])


def run_log(spark: SparkSession, root: str) -> DataFrame:
    """One row per run key (dataset, version, attempt)."""
    return spark.read.schema(RUN_SCHEMA).json(f"{root}/_runs").drop("of")
