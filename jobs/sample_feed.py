"""Keeps pooled correlations current while samples of many studies arrive as files.

A file stream takes the files that are new since the last run (its checkpoint knows the old ones). Of
each batch only moments of pairs are kept, which add up over batches; after the stream has ended, studies
with new moments get new correlations, and only the pooled pairs whose features they have are pooled
again. No sample is read a second time, and no study that stays the same is touched.

Writes under ``out``:

  samples       ids that have been counted, a folder per batch: a study's sample that comes again counts once
  moments       moments of each batch's pairs, a folder per batch
  correlations  moments of all batches up to column through, r, p and n: a folder per study
  state         the studies of each pair, weight and z: a folder per bucket of feature_1
  pooled        effects over the studies of each pair: a folder per bucket of feature_1
  merged        the last batch that all of this holds: earlier moments needn't be read

Reruns: a batch that is repeated replaces its own folders; it leaves out samples of earlier batches
only. A study's correlations, with the last batch they hold, are written after state and pooled pairs,
and the mark after them: a run that stopped anywhere is made up for by the next one, and a run without
new files changes nothing.
Checkpoint and output belong together: output without its checkpoint is an error, as all files would
count twice.

Cases: rows with a null sample, study or vector take no part; null and non-finite values are missing;
of rows of one sample of a study in a batch the smallest values count, over batches the first; ids need
be unique within a study only; an input without files leaves an empty output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import LOG, command, logged
from pairweave.functions.special import corr_p_value
from pairweave.operators.clean import finite
from pairweave.operators.moments import MOMENTS, PAIR, merge_moments, moments_r, partial_moments
from pairweave.operators.pooling import pool_from_state
from pairweave.plans.scratch import materialized
from pairweave.sources.writers import refresh_pool_state, table_exists


def as_glob(path: str) -> str:
    """A pattern that only ``path`` fits: file streams read a folder or what fits a pattern, but not a single file."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def _put(df: DataFrame, path: str, by: str) -> None:
    """Replace the folders of ``by`` that ``df`` has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(by).parquet(path)


def take_batch(batch: DataFrame, number: int, out: str, config: dict) -> None:
    """Count the samples of a batch that no earlier batch has had."""
    spark = batch.sparkSession
    sample, study = F.col(config["sample"]).cast("string"), F.col(config["study"]).cast("string")
    rows = batch.select(sample.alias("sample_id"), F.concat(F.lit(config["study_prefix"]), study).alias("study_id"), F.col(config["values"]).cast("array<double>").alias("v")).dropna()
    rows = rows.groupBy("study_id", "sample_id").agg(F.min("v").alias("v"))
    if table_exists(spark, f"{out}/samples"):
        before = spark.read.schema("sample_id string, study_id string, batch long").parquet(f"{out}/samples").filter(F.col("batch") < number)
        rows = rows.join(before.select("study_id", "sample_id"), ["study_id", "sample_id"], "left_anti")
    rows = materialized(rows)
    stamp = F.lit(number).cast("long").alias("batch")
    _put(rows.select("sample_id", "study_id", stamp), f"{out}/samples", "batch")
    cells = rows.select("study_id", "sample_id", F.posexplode("v").alias("i", "value"))
    feature = F.concat(F.lit(config["feature_prefix"]), F.lpad((F.col("i") + 1).cast("string"), 7, "0"))
    obs = materialized(cells.select("study_id", "sample_id", feature.alias("feature"), finite(F.col("value")).alias("value")))
    _put(partial_moments(obs, slice_rows=config["slice_rows"]).withColumn("batch", stamp), f"{out}/moments", "batch")
    LOG.info("batch %d: %d samples", number, rows.count())


def refresh(spark: SparkSession, out: str, config: dict) -> None:
    """Correlations, state and pooled pairs of the studies that have moments of batches not merged yet."""
    if not table_exists(spark, f"{out}/moments"):
        return LOG.info("nothing has arrived")
    kinds = ", ".join([f"{c} string" for c in PAIR] + ["n long"] + [f"{c} double" for c in MOMENTS])
    parts = spark.read.schema(f"{kinds}, batch long").parquet(f"{out}/moments")
    mark = spark.read.schema("through long").parquet(f"{out}/merged").first() if table_exists(spark, f"{out}/merged") else None
    parts = parts.filter(F.col("batch") > (mark["through"] if mark else -1))  # folders
    if table_exists(spark, f"{out}/correlations"):
        stored = spark.read.schema(f"{kinds}, corr double, p_value double, through long").parquet(f"{out}/correlations")
        merged = stored.groupBy("study_id").agg(F.max("through").alias("merged"))  # a row per study
        newer = materialized(parts.join(merged, "study_id", "left").filter("merged IS NULL OR batch > merged").drop("merged"))
        known = stored.join(newer.select("study_id").distinct(), "study_id", "left_semi").withColumn("batch", F.col("through"))
        parts = newer.unionByName(known.select(*newer.columns))
    last = parts.groupBy("study_id").agg(F.max("batch").alias("through"))
    found = merge_moments(parts).withColumn("corr", moments_r()).withColumn("p_value", corr_p_value(F.col("corr"), F.col("n").cast("double")))
    found = materialized(found.join(last, "study_id").select(*PAIR, "n", *MOMENTS, "corr", "p_value", "through"))
    if found.isEmpty():
        return LOG.info("no study is new or has new samples")
    pairs = found.filter("p_value IS NOT NULL").select(*PAIR, "corr", F.col("n").cast("double").alias("n"))
    touched = refresh_pool_state(pairs, f"{out}/state", config["buckets"])
    state = spark.read.parquet(f"{out}/state").filter(F.col("bucket").isin(touched))
    pooled = pool_from_state(state).withColumn("bucket", F.pmod(F.xxhash64("feature_1"), F.lit(config["buckets"])).cast("int"))
    _put(pooled.repartition("bucket"), f"{out}/pooled", "bucket")
    _put(found.repartition("study_id"), f"{out}/correlations", "study_id")
    found.agg(F.max("through").alias("through")).coalesce(1).write.mode("overwrite").parquet(f"{out}/merged")
    logged(found.groupBy("study_id").count(), "wrote studies", f"{out}/correlations")
    LOG.info("wrote %d buckets, %s", len(touched), f"{out}/pooled")


def run(spark: SparkSession, samples: str, out: str, checkpoint: str, config: dict) -> None:
    if table_exists(spark, f"{out}/moments") and not table_exists(spark, f"{checkpoint}/offsets"):
        raise ValueError(f"{out} has been written with another checkpoint than {checkpoint}: its samples would count twice")
    schema = spark.read.parquet(samples).schema
    LOG.info("reading what is new in %s", samples)
    arrivals = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(as_glob(samples))
    feed = arrivals.writeStream.foreachBatch(lambda batch, number: take_batch(batch, number, out, config))
    feed.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    refresh(spark, out, config)


if __name__ == "__main__":
    command("sample_feed", ("samples", "out", "checkpoint"), run)
