"""Writers. Spark's committers make each job all or nothing; there are no partial files to clean up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairweave.operators.pooling import PAIR, merge_states, pool_state
from pairweave.plans.scratch import materialized


def write_observations(obs: DataFrame, path: str, overwrite: bool = False) -> None:
    """Long observations as Parquet, a folder per study; studies that are there are kept unless ``overwrite``."""
    if not overwrite:
        obs = without_existing(obs, path, ["study_id"])
    obs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("study_id").parquet(path)


def write_correlations(corr: DataFrame, path: str, overwrite: bool = False) -> None:
    """A folder per (method, study_id); existing ones are skipped unless ``overwrite``."""
    if not overwrite:
        corr = without_existing(corr, path, ["method", "study_id"])
    corr.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("method", "study_id").parquet(path)


def without_correlated(obs: DataFrame, path: str, method: str) -> DataFrame:
    """Observations of the studies that have no correlations by ``method`` under ``path`` yet: filtered before any work."""
    done = existing_keys(obs.sparkSession, path, ["method", "study_id"])
    return obs if done is None else obs.join(done.filter(F.col("method") == method).select("study_id"), "study_id", "left_anti")


def existing_keys(spark, path: str, keys: list[str]) -> DataFrame | None:
    """The partitions of a table that is there, from its folder names."""
    if not table_exists(spark, path):
        return None
    return spark.read.parquet(path).select(*(F.col(k).cast("string") for k in keys)).distinct()


def without_existing(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    done = existing_keys(df.sparkSession, path, keys)
    return df if done is None else df.join(done, keys, "left_anti")


def table_exists(spark, path: str) -> bool:
    """Whether a folder is there, in any file system that Spark reaches."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def refresh_pool_state(corr: DataFrame, path: str, buckets: int = 64) -> list[int]:
    """Bring the stored state of pooling under ``path`` up to date with studies that are new or changed.

    corr has all correlations of these studies. Only buckets that hold their pairs, now or before, are
    read and replaced; their numbers are returned (there are at most ``buckets``). Studies replace what
    the state has of them, so that a second call with the same rows changes nothing.
    """
    spark = corr.sparkSession
    corr = materialized(corr.select(*PAIR, "study_id", *(c for c in ("corr", "z", "n") if c in corr.columns)))  # read three times
    new = materialized(pool_state(corr, buckets))
    touched = new.select("bucket")
    old = None
    if table_exists(spark, path):
        old = spark.read.parquet(path)
        seen = old.select("bucket", F.explode("studies.study_id").alias("study_id"))
        touched = touched.union(seen.join(corr.select("study_id").distinct(), "study_id", "left_semi").select("bucket"))
    numbers = sorted(r["bucket"] for r in touched.distinct().collect())
    if old is not None:
        new = merge_states(old.filter(F.col("bucket").isin(numbers)), new, corr.select("study_id"))
    merged = materialized(new)  # whole before the first bucket is replaced
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("bucket").parquet(path)
    return numbers


def write_sorted(corr: DataFrame, path: str, partitions: int | None = None) -> None:
    """Combined correlations, zstd, sorted by pair: row groups then hold ranges of pairs."""
    by = ["feature_1", "feature_2", "study_id"]
    ranged = corr.repartitionByRange(partitions, *by) if partitions else corr.repartitionByRange(*by)
    ranged.sortWithinPartitions(*by).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_pooled(pooled: DataFrame, path: str) -> None:
    pooled.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_network(edges: DataFrame, nodes: DataFrame, distances: DataFrame, folder: str) -> None:
    for name, df in (("edges", edges), ("nodes", nodes), ("distances", distances)):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_enrichment(results: DataFrame, path: str) -> None:
    """CSV with a header, also where there is no row."""
    from pairweave.operators.enrich import flat_results

    flat = flat_results(results)
    if flat.isEmpty():
        flat.sparkSession.createDataFrame([(",".join(flat.columns),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    else:
        flat.write.mode("overwrite").option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_page(spark, page: str, path: str) -> None:
    """One page (HTML or SVG) as a file of this name, in any file system that Spark reaches."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(page.encode()))
    out.close()
