"""A network of terms whose frequencies rise and fall together within documents of many sources.

Sources are the studies, documents their samples, terms the features, and a term's share of a document's
words its value: correlations within each source are pooled over the sources, and pairs whose interval
leaves out zero are the network's edges. A source that writes more of everything, or in another style,
thus adds no edges by itself, as one correlation over all documents would.

Reads a table of documents. Writes under ``out``: ``terms`` (documents of each term that takes part),
``correlations`` (a folder per method and study), ``pooled``, ``edges`` and ``nodes`` (degree and
component). Each run replaces all of it; equal input gives equal output.

Terms are runs of a-z (after A-Z are lowered) and characters beyond ASCII. A term takes part if at least
``min_share`` of all documents have it; the number of these is bounded by the terms of a mean document
over the share, whatever the number of documents. Documents without a source belong to no study; rows
without text or terms have no values; repeated rows and identifiers are documents of their own.

Scale: one pass counts the documents of each term with map-side sums; a second one counts the terms that
take part within each document, without a shuffle. Correlations are matrix products over slices of
documents, so that a source may hold most of them.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import LOG, command, logged
from pairweave.functions.special import corr_p_value
from pairweave.operators import clean, correlate, graph, pooling
from pairweave.plans.scratch import materialized

TERM = r"[^\x00-\x60\x7B-\x7F]+"


def _terms(config: dict):
    """A document's terms, repeats included."""
    return F.regexp_extract_all(F.translate(F.col(config["text"]), string.ascii_uppercase, string.ascii_lowercase), F.lit(TERM), 0)


def document_counts(docs: DataFrame, config: dict) -> DataFrame:
    """feature, documents: how many documents have each term."""
    return docs.select(F.explode(F.array_distinct(_terms(config))).alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("documents"))


def term_counts(docs: DataFrame, config: dict) -> DataFrame:
    """study_id, sample_id, row_id, words, feature, k: how often each document has each of its terms.

    Equal terms are runs of a document's sorted terms, so that nothing is shuffled.
    """
    ids = F.col(config["source"]).cast("string").alias("study_id"), F.col(config["document"]).cast("string").alias("sample_id")
    rows = docs.select(*ids, F.monotonically_increasing_id().cast("string").alias("row_id"), F.array_sort(_terms(config)).alias("terms"))
    begins = F.transform("terms", lambda t, i: F.when((i == 0) | (t != F.get("terms", i - 1)), i))
    rows = rows.withColumn("words", F.size("terms")).withColumn("runs", F.array_compact(begins))
    each = F.transform("runs", lambda p, j: F.struct(F.get("terms", p).alias("feature"), (F.coalesce(F.get("runs", j + 1), F.col("words")) - p).cast("long").alias("k")))
    return rows.select("study_id", "sample_id", "row_id", "words", F.inline(each))


def run(spark: SparkSession, documents: str, out: str, config: dict) -> None:
    docs = logged(spark.read.parquet(documents), "read documents", documents)
    overwrite = lambda df: df.write.mode("overwrite").option("partitionOverwriteMode", "static").option("compression", "zstd")

    least = config["min_share"] * docs.count()
    overwrite(document_counts(docs, config).filter(F.col("documents") >= least)).parquet(f"{out}/terms")
    terms = logged(spark.read.parquet(f"{out}/terms"), "wrote terms", f"{out}/terms")

    share = (F.col("k") * float(config["per_words"]) / F.col("words")).alias("value")
    counts = term_counts(docs, config).filter("study_id IS NOT NULL").join(terms, "feature", "left_semi")
    obs = materialized(counts.select("study_id", F.col("row_id").alias("sample_id"), "feature", share))  # only terms that take part are written
    prepared = materialized(clean.prepare(obs, keep_unmapped=True, transform="log", min_unique=config["min_unique"]))
    found = correlate.pearson(prepared, "gram", all_pairs=False).withColumn("p_value", corr_p_value(F.col("corr"), F.col("n")))
    overwrite(found).partitionBy("method", "study_id").parquet(f"{out}/correlations")
    found = logged(spark.read.schema(found.schema).parquet(f"{out}/correlations"), "wrote correlations", f"{out}/correlations")

    pooled = pooling.pool_new(pooling.eligible(found, None), None, min_studies=config["min_studies"])
    overwrite(pooled).parquet(f"{out}/pooled")
    pooled = logged(spark.read.parquet(f"{out}/pooled"), "wrote pooled pairs", f"{out}/pooled")

    overwrite(graph.significant_edges(pooled)).parquet(f"{out}/edges")
    edges = logged(spark.read.parquet(f"{out}/edges"), "wrote edges", f"{out}/edges")
    nodes = graph.degrees(edges).join(graph.components(edges), "node_id")
    overwrite(nodes).parquet(f"{out}/nodes")
    logged(spark.read.parquet(f"{out}/nodes"), "wrote nodes", f"{out}/nodes")
    LOG.info("done: %s", out)


if __name__ == "__main__":
    command("term_network", ("documents", "out"), run)
