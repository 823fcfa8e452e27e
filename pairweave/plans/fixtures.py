"""Inputs of the registered queries, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tokens that the raw fixture puts in place of single-line cells, in rotation.
TOKENS = [" ND", "&lt; LOD", "<LOD", "LOQ ", "1d", "inf", "1_000", "< loq"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_linenumber", "l_returnflag")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    feature = F.concat(F.lit("RM"), F.lpad(F.regexp_extract("p_brand", r"(\d+)", 1), 7, "0"))
    joined = lines.join(parts, "l_partkey")
    return joined.select(F.concat(F.lit("ST"), F.year("l_shipdate").cast("string")).alias("study_id"), F.concat(F.col("l_returnflag"), F.col("l_linenumber").cast("string")).alias("analysis_id"), F.col("l_suppkey").cast("string").alias("sample_id"), feature.alias("feature"), "l_quantity")


def obs_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studies are ship years, samples suppliers, features brands, values quantities."""
    return _lines(spark, sf_dir).groupBy("study_id", "sample_id", "feature").agg(F.sum("l_quantity").alias("value"))


def obs_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, by return flag and line number as the analysis: some samples miss one."""
    return _lines(spark, sf_dir).groupBy("study_id", "analysis_id", "sample_id", "feature").agg(F.sum("l_quantity").alias("value"))


def obs_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as text: cells of one line are tokens, and two brands also come unmapped."""
    cells = _lines(spark, sf_dir).groupBy("study_id", "sample_id", "feature").agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("k"))
    token = F.get(F.array(*map(F.lit, TOKENS)), (F.col("sample_id").cast("int") % len(TOKENS)))
    raw = cells.select("study_id", "sample_id", "feature", F.when(F.col("k") == 1, token).otherwise(F.col("q").cast("int").cast("string")).alias("raw"))
    extra = raw.filter(F.col("feature").isin("RM0000011", "RM0000012")).withColumn("feature", F.concat(F.lit("UNMAPPED:"), "feature"))
    return raw.unionByName(extra)


def matrix_files(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """The same as wide CSV files, study=.../part-*.csv: a line per supplier, whose ids are halved and so repeat, and
    a column per brand, whose numbers are halved and so repeat too; lines without a value are cells that are empty."""
    obs = obs_lines(spark, sf_dir)
    brands = obs.groupBy().agg(F.array_sort(F.collect_set("feature")).alias("brands"))  # as many as there are brands
    half = lambda c: F.floor(c.cast("int") / 2).cast("int").cast("string")
    names = F.transform("brands", lambda b: F.concat(F.lit("RM"), F.lpad(half(F.substring(b, 3, 7)), 7, "0")))
    heads = obs.select("study_id").distinct().crossJoin(brands).select("study_id", F.lit("").alias("k"), F.concat_ws(",", F.lit("sample"), names).alias("value"))
    cells = obs.groupBy("study_id", "sample_id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("m")).crossJoin(brands)
    values = F.transform("brands", lambda b: F.coalesce(F.try_element_at("m", b).cast("string"), F.lit("")))
    rows = cells.select("study_id", F.col("sample_id").alias("k"), F.concat_ws(",", half(F.col("sample_id")), values).alias("value"))
    every = heads.union(rows).withColumn("study", F.col("study_id")).repartition("study").sortWithinPartitions("study", "k")
    every.select("study", "value").write.partitionBy("study").option("lineSep", "\n").text(folder)


def obs_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studies are eighths of the vectors, samples vectors, features positions: no cell is missing."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    feature = F.concat(F.lit("RM"), F.lpad((F.col("i") + 1).cast("string"), 7, "0"))
    return vectors.select(F.concat(F.lit("ST"), (F.col("vec_id") % 8).cast("string")).alias("study_id"), F.col("vec_id").cast("string").alias("sample_id"), feature.alias("feature"), F.col("e").cast("double").alias("value"))


def obs_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order a study of its own, with as many features as brands: often only one."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.concat(F.lit("ST"), F.col("l_orderkey").cast("string")).alias("study_id"))
    return lines.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("feature")), "l_partkey").select("study_id", "feature")


def part_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, cluster: parts by how often they are ordered, in six clusters."""
    sold = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("k"))
    return sold.select(part_id("l_partkey").alias("node_id"), (F.col("k") % 6 + 1).cast("int").alias("cluster"))


def part_id(key: str):
    return F.concat(F.lit("RM"), F.lpad(F.col(key).cast("string"), 7, "0"))


def part_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature, super_class: the part's type; small parts have none."""
    return table(spark, sf_dir, "part").filter("p_size > 5").select(part_id("p_partkey").alias("feature"), F.col("p_type").alias("super_class"))


def _member():
    return F.concat(F.lit("C"), F.lpad(F.floor(F.col("p_partkey") / 2).cast("string"), 6, "0"))


def part_xref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature, member_id: two parts share one; large parts have none."""
    parts = table(spark, sf_dir, "part")
    return parts.select(part_id("p_partkey").alias("feature"), F.when(F.col("p_size") <= 45, _member()).alias("member_id"))


def part_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of each brand and of each brand's single sizes."""
    parts = table(spark, sf_dir, "part").select("p_brand", "p_size", _member().alias("m"))
    by = lambda name, key: parts.groupBy(key.alias("set_id")).agg(F.array_sort(F.collect_set("m")).alias("members")).select("set_id", F.concat(F.lit(name), "set_id").alias("set_name"), "members")
    return by("brand ", F.col("p_brand")).union(by("brand and size ", F.concat_ws(" ", "p_brand", (F.col("p_size") % 4).cast("string"))))


def numbered(feature: str):
    return F.substring(feature, 3, 7).cast("int")


def clusters_of(nodes: DataFrame) -> DataFrame:
    """Six clusters by number."""
    return nodes.select("node_id", (numbered("node_id") % 6 + 1).alias("cluster"))


def vector_nodes(spark: SparkSession) -> DataFrame:
    return spark.range(1, 65).select(F.concat(F.lit("RM"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("node_id"))


def annotation(spark: SparkSession) -> DataFrame:
    """Five classes; every seventh feature has none."""
    k = numbered("node_id")
    return vector_nodes(spark).filter(k % 7 != 0).select(F.col("node_id").alias("feature"), F.concat(F.lit("class "), (k % 5).cast("string")).alias("super_class"))


def xref(spark: SparkSession) -> DataFrame:
    """Member ids shared by features; every fifth feature has none."""
    k = numbered("node_id")
    member = F.concat(F.lit("C"), F.lpad((k % 20).cast("string"), 5, "0"))
    return vector_nodes(spark).select(F.col("node_id").alias("feature"), F.when(k % 5 != 0, member).alias("member_id"))


def sets(spark: SparkSession) -> DataFrame:
    """Ten sets of multiples, one of a single member, one that nothing is in."""
    s = F.col("id").cast("int")
    name = lambda m: F.concat(F.lit("C"), F.lpad(m.cast("string"), 5, "0"))
    multiples = F.transform(F.filter(F.sequence(F.lit(0), F.lit(19)), lambda m: m % (s + 1) == 0), name)
    far = F.transform(F.sequence(F.lit(100), F.lit(104)), name)
    members = F.when(s <= 10, multiples).when(s == 11, F.array(F.lit("C00001"))).otherwise(far)
    return spark.range(1, 13).select(F.format_string("S%02d", s).alias("set_id"), F.concat(F.lit("set "), s.cast("string")).alias("set_name"), members.alias("members"))


LINES_SQL = r"""
lines AS (SELECT 'ST' || year(l_shipdate) AS study_id, l_returnflag || l_linenumber AS analysis_id, l_suppkey::VARCHAR AS sample_id,
  'RM' || lpad(regexp_extract(p_brand, '(\d+)', 1), 7, '0') AS feature, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey),
obs AS (SELECT study_id, sample_id, feature, sum(l_quantity) AS value, count(*) AS k FROM lines GROUP BY ALL)"""

MATRIX_SQL = (
    LINES_SQL
    + """, named AS (SELECT feature, 'RM' || lpad((substr(feature, 3)::INT // 2)::VARCHAR, 7, '0') AS base, row_number() OVER (PARTITION BY substr(feature, 3)::INT // 2 ORDER BY feature) AS nth
  FROM (SELECT DISTINCT feature FROM obs)),
wide AS (SELECT study_id, sample_id, base || CASE WHEN nth > 1 THEN '.' || (nth - 1) ELSE '' END AS feature, value FROM obs JOIN named USING (feature))"""
)

RAW_SQL = (
    LINES_SQL
    + ", raw0 AS (SELECT study_id, sample_id, feature, CASE WHEN k = 1 THEN ["
    + ", ".join(f"'{t}'" for t in TOKENS)
    + f"][sample_id::INT % {len(TOKENS)} + 1] ELSE value::INT::VARCHAR END AS raw FROM obs), raw AS (SELECT * FROM raw0 UNION ALL "
    "SELECT study_id, sample_id, 'UNMAPPED:' || feature, raw FROM raw0 WHERE feature IN ('RM0000011', 'RM0000012'))"
)

VECTORS_SQL = """
obs AS (SELECT 'ST' || (vec_id % 8) AS study_id, vec_id::VARCHAR AS sample_id, 'RM' || lpad(i::VARCHAR, 7, '0') AS feature, embedding[i]::DOUBLE AS value
  FROM embeddings, range(1, 65) r(i))"""

SMALL_SQL = """
vnodes AS (SELECT 'RM' || lpad(k::VARCHAR, 7, '0') AS node_id, k FROM range(1, 65) r(k)),
clusters AS (SELECT node_id, (k % 6 + 1)::INT AS cluster FROM vnodes),
annotation AS (SELECT node_id AS feature, 'class ' || (k % 5) AS super_class FROM vnodes WHERE k % 7 <> 0),
xref AS (SELECT node_id AS feature, CASE WHEN k % 5 <> 0 THEN 'C' || lpad((k % 20)::VARCHAR, 5, '0') END AS member_id FROM vnodes),
members AS (SELECT 'S' || lpad(s::VARCHAR, 2, '0') AS set_id, 'set ' || s AS set_name, 'C' || lpad(m::VARCHAR, 5, '0') AS member_id
  FROM range(1, 13) a(s), range(0, 105) b(m)
  WHERE (s <= 10 AND m < 20 AND m % (s + 1) = 0) OR (s = 11 AND m = 1) OR (s = 12 AND m >= 100)),
sets AS (SELECT DISTINCT set_id, set_name FROM members)"""

PARTS_SQL = """
pclusters AS (SELECT 'RM' || lpad(l_partkey::VARCHAR, 7, '0') AS node_id, (count(*) % 6 + 1)::INT AS cluster FROM lineitem GROUP BY l_partkey),
clusters AS (SELECT * FROM pclusters),
annotation AS (SELECT 'RM' || lpad(p_partkey::VARCHAR, 7, '0') AS feature, p_type AS super_class FROM part WHERE p_size > 5),
pm AS (SELECT p_partkey, p_brand, p_size, 'C' || lpad((p_partkey // 2)::VARCHAR, 6, '0') AS m FROM part),
xref AS (SELECT 'RM' || lpad(p_partkey::VARCHAR, 7, '0') AS feature, CASE WHEN p_size <= 45 THEN m END AS member_id FROM pm),
members AS (SELECT DISTINCT p_brand AS set_id, 'brand ' || p_brand AS set_name, m AS member_id FROM pm
  UNION SELECT DISTINCT p_brand || ' ' || (p_size % 4), 'brand and size ' || p_brand || ' ' || (p_size % 4), m FROM pm),
sets AS (SELECT DISTINCT set_id, set_name FROM members)"""
