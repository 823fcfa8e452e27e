"""Both jobs as registered queries: run twice into one new folder, which stays, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import sample_feed, term_network
from jobs.common import settings
from pairweave import catalogue as c
from pairweave.plans.scratch import kept_folder

_COLUMNS = ["z_fixed", "r_fixed", "Q", "I2", "tau2", "z_random", "r_random", "ci_r_random_low", "ci_r_random_high"]
#: Decimals: Fisher's z magnifies the last places of correlations near 1 (few documents have both terms) by up to 1e9.
_DIGITS = 4
_SELECT = "SELECT feature_1, feature_2, n_studies, " + ", ".join(f"round({'qq' if x == 'Q' else x}, {_DIGITS}) + 0.0 AS {x}" for x in _COLUMNS)


def job1_term_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled pairs of terms, whether they are an edge, and the degree of both."""
    out, config = kept_folder(spark), settings("term_network")
    for _ in range(2):
        term_network.run(spark, f"{sf_dir}/documents.parquet", out, config)
    pooled, nodes = spark.read.parquet(f"{out}/pooled"), spark.read.parquet(f"{out}/nodes")
    edges = spark.read.parquet(f"{out}/edges").select(F.col("source").alias("feature_1"), F.col("target").alias("feature_2"), F.lit(True).alias("edge"))
    degree = [nodes.select(F.col("node_id").alias(f"feature_{k}"), F.col("degree").alias(f"degree_{k}")) for k in (1, 2)]
    every = pooled.join(edges, ["feature_1", "feature_2"], "left").join(degree[0], "feature_1", "left").join(degree[1], "feature_2", "left")
    return c.rounded(every.select("feature_1", "feature_2", "n_studies", *_COLUMNS, F.coalesce("edge", F.lit(False)).alias("edge"), *(F.coalesce(f"degree_{k}", F.lit(0)).alias(f"degree_{k}") for k in (1, 2))), _DIGITS)


def job2_sample_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled pairs of at least four studies."""
    folder, config = kept_folder(spark), settings("sample_feed")
    for _ in range(2):
        sample_feed.run(spark, f"{sf_dir}/embeddings.parquet", f"{folder}/out", f"{folder}/checkpoint", config)
    pooled = spark.read.parquet(f"{folder}/out/pooled").filter("n_studies >= 4")
    return c.rounded(pooled.select("feature_1", "feature_2", "n_studies", *_COLUMNS), _DIGITS)


_TERMS = r"""
words AS (SELECT source AS study_id, row_number() OVER () AS sample_id,
  regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x60\x7B-\x7F]+') AS terms FROM documents),
each AS (SELECT study_id, sample_id, len(terms) AS words, unnest(terms) AS feature FROM words),
counts AS (SELECT *, count(*) AS k FROM each GROUP BY ALL),
vocabulary AS (SELECT feature FROM counts GROUP BY feature HAVING count(*) >= 0.1::DOUBLE * (SELECT count(*) FROM documents)),
obs AS (SELECT study_id, sample_id, feature, k * 1000.0::DOUBLE / words AS value FROM counts SEMI JOIN vocabulary USING (feature) WHERE study_id IS NOT NULL)"""
_ANY_ID = c._pool_sql().replace(r"AND regexp_matches(feature_1, '^RM\d{7}$') AND regexp_matches(feature_2, '^RM\d{7}$')", "")
_TERM_EDGES = """, edges AS (SELECT *, ci_r_random_low > 0 OR ci_r_random_high < 0 AS edge FROM pooled),
degrees AS (SELECT node_id, count(*) AS degree FROM (SELECT feature_1 AS node_id FROM edges WHERE edge UNION ALL SELECT feature_2 FROM edges WHERE edge) GROUP BY 1)"""
_SAMPLES = """
obs AS (SELECT 'ST' || label AS study_id, vec_id::VARCHAR AS sample_id, 'RM' || lpad(i::VARCHAR, 7, '0') AS feature, embedding[i]::DOUBLE AS value
  FROM embeddings, range(1, 65) r(i) WHERE label IS NOT NULL)"""

QUERIES = {"job1_term_network": job1_term_network, "job2_sample_feed": job2_sample_feed}
ORACLES = {
    "job1_term_network": f"WITH {_TERMS}{c._PREPARED}{c._ROWS.format(t='prepared')}{c._CORR}{_ANY_ID}{_TERM_EDGES} {_SELECT}, coalesce(edge, false) AS edge, coalesce(a.degree, 0) AS degree_1, coalesce(b.degree, 0) AS degree_2 "
    "FROM edges LEFT JOIN degrees a ON a.node_id = feature_1 LEFT JOIN degrees b ON b.node_id = feature_2",
    "job2_sample_feed": f"WITH {_SAMPLES}{c._ROWS.format(t='obs')}{c._CORR}{c._pool_sql()} {_SELECT} FROM pooled",
}
