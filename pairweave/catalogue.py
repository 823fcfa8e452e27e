"""Registered queries and their DuckDB twins. Computed doubles are rounded to six decimals in both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairweave.functions.special import adjust_bh, adjust_p, corr_p_value
from pairweave.operators import clean, cluster, correlate, enrich, graph, pooling, report
from pairweave.plans import fixtures as fx
from pairweave.plans.fixtures import LINES_SQL, PARTS_SQL, RAW_SQL, SMALL_SQL, VECTORS_SQL
from pairweave.plans.scratch import materialized, shared_folder
from pairweave.sources import responses
from pairweave.sources.readers import read_raw_blocks, read_study_matrices
from pairweave.sources.writers import refresh_pool_state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def r6(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


# --- cleaning -------------------------------------------------------------------------------------

_NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"
_LIMIT = ", ".join(f"'{t}'" for t in clean.BELOW_LIMIT)
_VALUE_SQL = rf"CASE WHEN lower(trim(raw)) IN ({_LIMIT}) THEN 0.0 WHEN regexp_matches(raw, '{_NUMBER}') THEN try_cast(trim(raw) AS DOUBLE) END"


@query("obs_long", f"WITH {LINES_SQL} SELECT study_id, sample_id, feature, value FROM obs")
def obs_long(spark, d):
    return fx.obs_lines(spark, d)


@query("clean_tokens", f"WITH {RAW_SQL} SELECT study_id, sample_id, feature, {_VALUE_SQL} AS value FROM raw WHERE feature NOT LIKE 'UNMAPPED:%'")
def clean_tokens(spark, d):
    return clean.drop_unmapped(clean.parse_cells(fx.obs_raw(spark, d)))


@query("clean_tokens_null", rf"WITH {RAW_SQL} SELECT study_id, sample_id, feature, CASE WHEN regexp_matches(raw, '{_NUMBER}') THEN try_cast(trim(raw) AS DOUBLE) END AS value FROM raw")
def clean_tokens_null(spark, d):
    return clean.parse_cells(fx.obs_raw(spark, d), below_limit="null")


def _names(spark, d):
    parts = fx.table(spark, d, "part")
    parts = parts.withColumn("p_name", F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")))
    raw = parts.select(F.col("p_name").alias("raw_name"), "p_partkey")
    k = F.col("p_partkey")
    ref = F.when(k % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("ref "), (k % 50).cast("string")))
    name_map = parts.filter(k % 11 != 0).groupBy(F.col("p_name").alias("raw_name")).agg(F.min(ref).alias("ref_name"))
    n = F.col("id")
    number = lambda p: F.concat(F.lit(p), F.lpad(n.cast("string"), 7, "0"))
    ref_of = F.concat(F.lit("ref "), n.cast("string")).alias("ref_name")
    ids = spark.range(0, 30).select(ref_of, number("RM").alias("feature"))
    aliases = spark.range(25, 40).select(ref_of, number("RM1").alias("feature"))
    return clean.standardize_names(raw, name_map, ids, aliases)


_NAMES_SQL = """
part AS (SELECT * REPLACE (p_name || ' ' || p_partkey AS p_name) FROM main.part),
m AS (SELECT p_name AS raw_name, min(CASE WHEN p_partkey % 7 = 0 THEN '' ELSE 'ref ' || (p_partkey % 50) END) AS ref_name FROM part WHERE p_partkey % 11 <> 0 GROUP BY 1),
ids AS (SELECT 'ref ' || k AS ref_name, 'RM' || lpad(k::VARCHAR, 7, '0') AS feature FROM range(0, 30) r(k)),
alt AS (SELECT 'ref ' || k AS ref_name, 'RM1' || lpad(k::VARCHAR, 7, '0') AS feature FROM range(25, 40) r(k)),
named AS (SELECT p_name AS raw_name, p_partkey, CASE WHEN coalesce(m.ref_name, '') = '' THEN 'UNMAPPED:' || p_name ELSE coalesce(ids.feature, alt.feature, m.ref_name) END AS feature
  FROM part LEFT JOIN m ON m.raw_name = p_name LEFT JOIN ids ON ids.ref_name = m.ref_name LEFT JOIN alt ON alt.ref_name = m.ref_name)"""


@query("standardize_names", f"WITH {_NAMES_SQL} SELECT raw_name, p_partkey, feature FROM named")
def standardize_names(spark, d):
    return _names(spark, d).select("raw_name", "p_partkey", "feature")


@query("rogue_names", rf"WITH {_NAMES_SQL} SELECT feature, count(*) AS cells FROM named WHERE feature NOT LIKE 'UNMAPPED:%' AND NOT regexp_matches(feature, '^RM\d+$') GROUP BY 1")
def rogue_names(spark, d):
    return clean.rogue_names(_names(spark, d))


@query("raw_blocks", """
SELECT 'ST' || (event_id % 5) AS study_id, event_id::VARCHAR AS analysis_id, 'kind' AS sample_id, event_type AS raw_name, user_id::VARCHAR AS raw FROM events WHERE event_id % 3 <> 2""")
def raw_blocks(spark, d):
    """Documents of two kinds of block (and some without) made from events."""
    block = F.when(F.col("event_id") % 3 == 0, "MS_METABOLITE_DATA").when(F.col("event_id") % 3 == 1, "NMR_METABOLITE_DATA").otherwise("OTHER")
    body = F.concat(F.lit('{"'), block, F.lit('":{"Data":[{"Metabolite":"'), F.col("event_type"), F.lit('","kind":"'), F.col("user_id").cast("string"), F.lit('"}]}}'))
    docs = fx.table(spark, d, "events").select(F.concat(F.lit("ST"), (F.col("event_id") % 5).cast("string")).alias("study_id"), F.col("event_id").cast("string").alias("analysis_id"), body.alias("body"))
    return read_raw_blocks(docs)[0]


def _answers(spark, d):
    """Answers about parts, asked by id or by name: some refused, some empty, some without a part."""
    k, part = F.col("p_partkey"), fx.table(spark, d, "part")
    rm = fx.part_id("p_partkey")
    asked = part.select(k, "p_name", "p_type", "p_brand", F.when(k % 3 == 0, F.concat("p_name", F.lit(" "), k.cast("string"))).otherwise(rm).alias("id"), rm.alias("rm"))
    first = F.to_json(F.struct(F.when(k % 11 != 0, F.col("rm")).alias("refmet_id"), F.col("p_name").alias("name"), F.col("p_type").alias("super_class")))
    whole = asked.select("id", F.lit("all").alias("part"), F.when(k % 13 == 0, 404).otherwise(200).alias("status"), first.alias("body"))
    kegg = asked.filter(k % 17 != 0).select("id", F.lit("kegg_id"), F.lit(200), F.when(k % 4 == 0, F.lit("[]")).otherwise(F.to_json(F.struct(F.concat(F.lit("C"), F.floor(k / 2).cast("string")).alias("kegg_id")))))
    smiles = asked.select("id", F.lit("smiles"), F.lit(200), F.to_json(F.struct(F.col("p_brand").alias("smiles"))))
    return whole.union(kegg).union(smiles).withColumn("kind", F.lit("compound"))


_ANSWERED = """asked AS (SELECT p_partkey AS k, p_name, p_type, p_brand, 'RM' || lpad(p_partkey::VARCHAR, 7, '0') AS rm, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' ' || p_partkey ELSE 'RM' || lpad(p_partkey::VARCHAR, 7, '0') END AS query FROM part)"""


@query("compound_records", f"""WITH {_ANSWERED} SELECT query, CASE WHEN k % 3 = 0 THEN 'name' ELSE 'refmet_id' END AS id_type, rm AS refmet_id, p_name AS name, p_type AS super_class,
  CASE WHEN k % 4 <> 0 THEN 'C' || (k // 2) END AS kegg_id, p_brand AS smiles FROM asked WHERE k % 13 <> 0 AND k % 11 <> 0 AND k % 17 <> 0""")
def compound_records(spark, d):
    """Written in two halves, read again, put together."""
    path, answers = shared_folder(spark), _answers(spark, d)
    for half in (0, 1):
        responses.write_answers(answers.filter(F.pmod(F.xxhash64("id"), F.lit(2)) == half), path)
    found = responses.read_compounds(responses.read_answers(spark, path, "compound"))[0]
    return found.select("query", "id_type", "refmet_id", "name", "super_class", "kegg_id", "smiles")


@query("compound_failures", f"""WITH {_ANSWERED} SELECT query, CASE WHEN k % 13 = 0 THEN 'status 404' WHEN k % 11 = 0 THEN 'no entry' ELSE 'no answer: kegg_id' END AS reason FROM asked WHERE k % 13 = 0 OR k % 11 = 0 OR k % 17 = 0""")
def compound_failures(spark, d):
    return responses.read_compounds(_answers(spark, d))[1]


@query("compound_requests", f"""WITH {_ANSWERED} SELECT query, 'all' AS part, CASE WHEN k % 3 = 0 THEN 'name' ELSE 'refmet_id' END || '/' || replace(replace(query, ' ', '%20'), '#', '%23') || '/all' AS path FROM asked WHERE k % 13 = 0
  UNION ALL SELECT query, 'kegg_id', CASE WHEN k % 3 = 0 THEN 'name' ELSE 'refmet_id' END || '/' || replace(replace(query, ' ', '%20'), '#', '%23') || '/kegg_id' FROM asked WHERE k % 17 = 0""")
def compound_requests(spark, d):
    """What is to be asked again."""
    answers = _answers(spark, d)
    return responses.compound_requests(answers.select(F.col("id").alias("query")), answers)


_ANALYSES_SQL = LINES_SQL + ", parts AS (SELECT study_id, analysis_id, sample_id, feature, sum(l_quantity) AS value FROM lines GROUP BY ALL)"


@query("merge_outer", f"WITH {_ANALYSES_SQL} SELECT study_id, analysis_id, sample_id, feature, value FROM parts")
def merge_outer(spark, d):
    return clean.merge_analyses(fx.obs_analyses(spark, d), how="outer")


@query("merge_inner", f"""WITH {_ANALYSES_SQL},
k AS (SELECT study_id, sample_id, count(DISTINCT analysis_id) AS k FROM parts GROUP BY ALL), n AS (SELECT study_id, count(DISTINCT analysis_id) AS n FROM parts GROUP BY ALL)
SELECT p.study_id, p.analysis_id, p.sample_id, feature, value FROM parts p JOIN k USING (study_id, sample_id) JOIN n ON n.study_id = p.study_id WHERE k = n""")
def merge_inner(spark, d):
    return clean.merge_analyses(fx.obs_analyses(spark, d), how="inner").select("study_id", "analysis_id", "sample_id", "feature", "value")


@query("dedupe_mean", f"WITH {_ANALYSES_SQL} SELECT study_id, sample_id, feature, {r6('avg(value)', 'value')} FROM parts GROUP BY study_id, sample_id, feature")
def dedupe_mean(spark, d):
    return rounded(clean.average_duplicates(fx.obs_analyses(spark, d)))


@query("low_variance_filter", f"""WITH {LINES_SQL}, few AS (SELECT study_id, feature FROM obs GROUP BY ALL HAVING count(DISTINCT value) >= 72)
SELECT study_id, sample_id, feature, value FROM obs SEMI JOIN few USING (study_id, feature)""")
def low_variance_filter(spark, d):
    return clean.drop_low_variance(fx.obs_lines(spark, d), 72).select("study_id", "sample_id", "feature", "value")


@query("pqn_normalize", f"""WITH {LINES_SQL}, s AS (SELECT *, value / sum(value) OVER (PARTITION BY study_id, sample_id) AS share FROM obs),
t AS (SELECT study_id, feature, median(share) AS typical FROM s GROUP BY ALL),
q AS (SELECT study_id, sample_id, median(share / typical) AS dilution FROM s JOIN t USING (study_id, feature) GROUP BY ALL)
SELECT study_id, sample_id, feature, {r6('value / dilution', 'value')} FROM obs JOIN q USING (study_id, sample_id)""")
def pqn_normalize(spark, d):
    return rounded(clean.normalize_pqn(fx.obs_lines(spark, d)).select("study_id", "sample_id", "feature", "value"))


@query("transform_log", f"WITH {LINES_SQL} SELECT study_id, sample_id, feature, {r6('ln(1 + value)', 'value')} FROM obs")
def transform_log(spark, d):
    return rounded(clean.transform_values(fx.obs_lines(spark, d), "log"))


@query("transform_sqrt", f"WITH {VECTORS_SQL} SELECT study_id, sample_id, feature, {r6('CASE WHEN value >= 0 THEN sqrt(value) END', 'value')} FROM obs")
def transform_sqrt(spark, d):
    return rounded(clean.transform_values(fx.obs_vectors(spark, d), "sqrt"))


@query("sample_studies", f"WITH {LINES_SQL} SELECT DISTINCT study_id FROM obs ORDER BY study_id LIMIT 3")
def sample_studies(spark, d):
    return clean.first_studies(fx.obs_lines(spark, d).select("study_id").distinct(), 3)


@query("sample_studies_random", f"WITH {LINES_SQL} SELECT study_id FROM (SELECT DISTINCT study_id FROM obs) ORDER BY md5(study_id || '|1'), study_id LIMIT 3")
def sample_studies_random(spark, d):
    return clean.first_studies(fx.obs_lines(spark, d).select("study_id").distinct(), 3, seed=1)


# --- correlation ----------------------------------------------------------------------------------

_PREPARED = ", prepared AS (SELECT study_id, sample_id, feature, ln(1 + value) AS value FROM obs SEMI JOIN (SELECT study_id, feature FROM obs GROUP BY ALL HAVING count(DISTINCT value) >= 3) v USING (study_id, feature))"
_ROWS = """, pr AS (SELECT a.study_id, a.feature AS feature_1, b.feature AS feature_2, a.value AS x, b.value AS y FROM {t} a JOIN {t} b ON a.study_id = b.study_id AND a.sample_id = b.sample_id AND a.feature < b.feature),
grid AS (SELECT DISTINCT a.study_id, a.feature AS feature_1, b.feature AS feature_2 FROM (SELECT DISTINCT study_id, feature FROM {t}) a JOIN (SELECT DISTINCT study_id, feature FROM {t}) b ON a.study_id = b.study_id AND a.feature < b.feature)"""
_CORR = """, cr AS (SELECT study_id, feature_1, feature_2, CASE WHEN count(*) > 1 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END AS corr, count(*)::DOUBLE AS n FROM pr GROUP BY ALL)"""
_PEARSON = LINES_SQL + _PREPARED + _ROWS.format(t="prepared") + _CORR
_RESULT = "SELECT feature_1, feature_2, '{m}' AS method, " + r6("corr", "corr") + ", coalesce(n, 0.0) AS n, study_id FROM grid LEFT JOIN cr USING (study_id, feature_1, feature_2)"


def _prepared(spark, d):
    """Written once: the grid, both sides of the pair join and the variance filter all read it."""
    return materialized(clean.prepare(materialized(fx.obs_lines(spark, d))))


@query("pearson_pairs", f"WITH {_PEARSON} {_RESULT.format(m='pearson')}")
def pearson_pairs(spark, d):
    return rounded(correlate.pearson(_prepared(spark, d)))


@query("pearson_gram", f"WITH {_PEARSON} {_RESULT.format(m='pearson')}")
def pearson_gram(spark, d):
    return rounded(correlate.pearson(_prepared(spark, d), plan="gram"))


@query("study_matrix_pairs", f"WITH {fx.MATRIX_SQL}{_ROWS.format(t='wide')}{_CORR} {_RESULT.format(m='pearson')}")
def study_matrix_pairs(spark, d):
    """CSV files with repeated names of columns and repeated sample ids, written and read again."""
    folder = shared_folder(spark)
    fx.matrix_files(spark, d, folder)
    return rounded(correlate.pearson(materialized(read_study_matrices(spark, folder, ".txt", study="/study=([^/]+)/")), "gram"))


_RANKS = """, rk AS (SELECT study_id, feature_1, feature_2,
  rank() OVER (PARTITION BY study_id, feature_1, feature_2 ORDER BY x) + (count(*) OVER (PARTITION BY study_id, feature_1, feature_2, x) - 1) / 2.0 AS x,
  rank() OVER (PARTITION BY study_id, feature_1, feature_2 ORDER BY y) + (count(*) OVER (PARTITION BY study_id, feature_1, feature_2, y) - 1) / 2.0 AS y FROM pr)"""


@query("spearman_pairs", f"WITH {LINES_SQL}{_PREPARED}{_ROWS.format(t='prepared')}{_RANKS}{_CORR.replace('FROM pr', 'FROM rk')} {_RESULT.format(m='spearman')}")
def spearman_pairs(spark, d):
    return rounded(correlate.spearman(_prepared(spark, d)))


@query("spearman_sorted", f"WITH {LINES_SQL}{_PREPARED}{_ROWS.format(t='prepared')}{_RANKS}{_CORR.replace('FROM pr', 'FROM rk')} {_RESULT.format(m='spearman')}")
def spearman_sorted(spark, d):
    return rounded(correlate.spearman(_prepared(spark, d), plan="sorted"))


@query("spearman_complete", f"WITH {VECTORS_SQL}{_ROWS.format(t='obs')}{_RANKS}{_CORR.replace('FROM pr', 'FROM rk')} {_RESULT.format(m='spearman')}")
def spearman_complete(spark, d):
    return rounded(correlate.spearman(fx.obs_vectors(spark, d)))


_KENDALL = f"""{LINES_SQL}{_ROWS.format(t='obs')},
ix AS (SELECT *, row_number() OVER (PARTITION BY study_id, feature_1, feature_2) AS i FROM pr),
sg AS (SELECT a.study_id, a.feature_1, a.feature_2, sum(sign(a.x - b.x) * sign(a.y - b.y)) AS s, sum(abs(sign(a.x - b.x))) AS ux, sum(abs(sign(a.y - b.y))) AS uy
  FROM ix a JOIN ix b ON a.study_id = b.study_id AND a.feature_1 = b.feature_1 AND a.feature_2 = b.feature_2 AND a.i < b.i GROUP BY ALL),
kt AS (SELECT study_id, feature_1, feature_2, s / nullif(sqrt(ux * uy), 0) AS corr, s, ux, uy FROM sg)"""


@query("kendall_pairs", f"WITH {_KENDALL} SELECT feature_1, feature_2, study_id, {r6('corr', 'corr')} FROM grid LEFT JOIN kt USING (study_id, feature_1, feature_2)")
def kendall_pairs(spark, d):
    return rounded(correlate.kendall(materialized(fx.obs_lines(spark, d))).select("feature_1", "feature_2", "study_id", "corr"))


# Tie-corrected normal p, or counts of permutations by inversions (without ties, up to 33 samples).
_ties = lambda c: f"SELECT study_id, feature_1, feature_2, sum(t * (t - 1) * (2 * t + 5)) AS v_{c}, sum(t * (t - 1)) AS a_{c}, sum(t * (t - 1) * (t - 2)) AS b_{c} FROM (SELECT study_id, feature_1, feature_2, count(*)::DOUBLE AS t FROM pr GROUP BY study_id, feature_1, feature_2, {c}) GROUP BY ALL"
_KENDALL_P = f"""{_KENDALL}, tx AS ({_ties('x')}), ty AS ({_ties('y')}), pn AS (SELECT study_id, feature_1, feature_2, count(*)::DOUBLE AS n FROM pr GROUP BY ALL),
ways(k, p) AS (SELECT 1, [CASE WHEN c = 0 THEN 1.0::DOUBLE ELSE 0 END for c in range(0, 265)]
  UNION ALL SELECT k + 1, [list_sum(p[greatest(1, c - k + 1) : c + 1]) / (k + 1) for c in range(0, 265)] FROM ways WHERE k < 33),
kp AS (SELECT kt.*, n, (a_x + a_y = 0 AND n <= 33) AS exact, least(n * (n - 1) / 2 + s, n * (n - 1) / 2 - s) / 2 AS c,
  abs(s) / sqrt((n * (n - 1) * (2 * n + 5) - v_x - v_y) / 18 + a_x * a_y / (2 * n * (n - 1)) + CASE WHEN n > 2 THEN b_x * b_y / (9 * n * (n - 1) * (n - 2)) ELSE 0 END) / sqrt(2) AS z
  FROM kt JOIN tx USING (study_id, feature_1, feature_2) JOIN ty USING (study_id, feature_1, feature_2) JOIN pn USING (study_id, feature_1, feature_2)),
pv AS (SELECT kp.*, CASE WHEN corr IS NULL THEN NULL WHEN exact THEN least(1, 2 * list_sum(p[1 : c::INT + 1])) WHEN z < 1e-12 THEN 1 WHEN z > 6 THEN 0
  ELSE 1 - 2 / sqrt(pi()) * exp(-z * z) * list_sum([exp(2 * j * ln(2) + lgamma(j + 1) - lgamma(2 * j + 2) + (2 * j + 1) * ln(z)) for j in range(0, 200)]) END AS p_value
  FROM kp LEFT JOIN ways ON k = n::INT AND exact)"""


@query("kendall_p_values", f"WITH RECURSIVE {_KENDALL_P} SELECT feature_1, feature_2, 'kendall' AS method, {r6('pv.corr', 'corr')}, {r6('p_value', 'p_value')}, coalesce(pn.n, 0.0) AS n, study_id FROM grid LEFT JOIN pn USING (study_id, feature_1, feature_2) LEFT JOIN pv USING (study_id, feature_1, feature_2)")
def kendall_p_values(spark, d):
    return rounded(correlate.kendall(materialized(fx.obs_lines(spark, d))))


@query("one_pair", f"SELECT {r6('corr(l_quantity, l_extendedprice)', 'corr')}, count(*)::DOUBLE AS n FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL")
def one_pair(spark, d):
    return rounded(correlate.one_pair(fx.table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "pearson").select("corr", "n"))


@query("studies_with_pairs", "SELECT 'ST' || l_orderkey AS study_id, count(DISTINCT p_brand) AS features FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def studies_with_pairs(spark, d):
    return correlate.studies_with_pairs(fx.obs_orders(spark, d))


_THETA = "atan(abs(corr) * sqrt((n - 2) / (1 - corr * corr)) / sqrt(n - 2))"
_SERIES = f"""list_sum(list_transform(range(0, CASE WHEN n::INT % 2 = 1 THEN (n::INT - 3) // 2 ELSE (n::INT - 2) // 2 END),
  lambda j: CASE WHEN n::INT % 2 = 1 THEN exp(2 * j * ln(2) + 2 * lgamma(j + 1) - lgamma(2 * j + 2)) * pow(cos({_THETA}), 2 * j + 1)
                 ELSE exp(lgamma(2 * j + 1) - 2 * j * ln(2) - 2 * lgamma(j + 1)) * pow(cos({_THETA}), 2 * j) END))"""
_P = f"""CASE WHEN abs(corr) >= 1 THEN 0.0 WHEN n < 3 OR corr IS NULL THEN NULL
  WHEN n::INT % 2 = 1 THEN 1 - 2 / pi() * ({_THETA} + sin({_THETA}) * coalesce({_SERIES}, 0)) ELSE 1 - sin({_THETA}) * coalesce({_SERIES}, 0) END"""


@query("corr_pvalue", f"WITH {_PEARSON} SELECT feature_1, feature_2, study_id, {r6(_P, 'p_value')} FROM grid LEFT JOIN cr USING (study_id, feature_1, feature_2)")
def corr_pvalue(spark, d):
    found = correlate.pearson(_prepared(spark, d)).withColumn("p_value", corr_p_value(F.col("corr"), F.col("n")))
    return rounded(found.select("feature_1", "feature_2", "study_id", "p_value"))


@query("concat_sorted", f"WITH {_PEARSON} SELECT feature_1, feature_2, study_id, {r6('corr', 'corr')}, coalesce(n, 0.0) AS n FROM grid LEFT JOIN cr USING (study_id, feature_1, feature_2) ORDER BY 1, 2, 3")
def concat_sorted(spark, d):
    return rounded(correlate.pearson(_prepared(spark, d)).select("feature_1", "feature_2", "study_id", "corr", "n").orderBy("feature_1", "feature_2", "study_id"))


@query("concat_stats", f"WITH {_PEARSON} SELECT count(*) AS n_rows, count(DISTINCT study_id) AS n_studies, count(DISTINCT (feature_1, feature_2)) AS n_pairs FROM grid")
def concat_stats(spark, d):
    grid = correlate.pair_grid(_prepared(spark, d))
    return grid.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("study_id").alias("n_studies"), F.count_distinct("feature_1", "feature_2").alias("n_pairs"))


# --- pooling --------------------------------------------------------------------------------------

_POOL = r"""
, el AS (SELECT *, count(*) OVER (PARTITION BY feature_1, feature_2) AS rows FROM cr WHERE n > 3 AND corr IS NOT NULL AND regexp_matches(feature_1, '^RM\d{7}$') AND regexp_matches(feature_2, '^RM\d{7}$')),
w AS (SELECT feature_1, feature_2, n - 3 AS w, atanh(greatest(-1 + 1e-10, least(1 - 1e-10, corr))) AS z FROM el WHERE rows >= {k}),
f AS (SELECT feature_1, feature_2, count(*) AS n_studies, sum(w) AS sw, sum(w * z) / sum(w) AS z_fixed, sum(w) - sum(w * w) / sum(w) AS c FROM w GROUP BY ALL),
q AS (SELECT f.*, 1 / sqrt(sw) AS se_fixed, (SELECT sum(w * (z - z_fixed) * (z - z_fixed)) FROM w WHERE w.feature_1 = f.feature_1 AND w.feature_2 = f.feature_2) AS q FROM f),
h AS (SELECT *, CASE WHEN n_studies >= 2 THEN q END AS Q, CASE WHEN n_studies >= 2 THEN n_studies - 1 END AS df,
  CASE WHEN n_studies >= 2 THEN CASE WHEN q > 0 THEN greatest(0, (q - (n_studies - 1)) / q) * 100 ELSE 0 END END AS I2,
  CASE WHEN n_studies >= 4 THEN greatest(0, coalesce((q - (n_studies - 1)) / c, 0)) END AS tau2 FROM q),
x AS (SELECT h.*, (SELECT sum(1 / (1 / w + tau2)) FROM w WHERE w.feature_1 = h.feature_1 AND w.feature_2 = h.feature_2) AS sr,
  (SELECT sum(z / (1 / w + tau2)) FROM w WHERE w.feature_1 = h.feature_1 AND w.feature_2 = h.feature_2) AS sz FROM h),
pooled AS (SELECT feature_1, feature_2, n_studies, z_fixed, se_fixed, tanh(z_fixed) AS r_fixed, tanh(z_fixed - 1.96 * se_fixed) AS ci_r_fixed_low, tanh(z_fixed + 1.96 * se_fixed) AS ci_r_fixed_high,
  q AS qq, df, I2, tau2, sz / sr AS z_random, 1 / sqrt(sr) AS se_random, tanh(sz / sr) AS r_random, tanh(sz / sr - 1.96 / sqrt(sr)) AS ci_r_random_low, tanh(sz / sr + 1.96 / sqrt(sr)) AS ci_r_random_high FROM x)"""
_POOL = _POOL.replace("{7}", "@7@").replace("CASE WHEN n_studies >= 2 THEN q END AS Q, ", "")
_pool_sql = lambda k=4: _POOL.replace("{k}", str(k)).replace("@7@", "{7}")
_POOLED_LINES = _PEARSON + _pool_sql()
_POOLED_VECTORS = VECTORS_SQL + _ROWS.format(t="obs") + _CORR + _pool_sql()
_FIXED = ["z_fixed", "se_fixed", "r_fixed", "ci_r_fixed_low", "ci_r_fixed_high"]
_RANDOM = ["tau2", "z_random", "se_random", "r_random", "ci_r_random_low", "ci_r_random_high"]
_cols = lambda names: ", ".join(r6(c, c) for c in names)


def _pool(corr, min_studies=4, **more):
    """The p value is that of the correlation: pairs without one are not pooled."""
    with_p = corr.withColumn("p_value", corr_p_value(F.col("corr"), F.col("n")))
    return pooling.pool_new(pooling.eligible(with_p), None, min_studies=min_studies, **more)


def _pooled_lines(spark, d, **more):
    return _pool(correlate.pearson(_prepared(spark, d), all_pairs=False), **more)


@query("pool_fixed", f"WITH {_POOLED_LINES} SELECT feature_1, feature_2, n_studies, {_cols(_FIXED)} FROM pooled")
def pool_fixed(spark, d):
    return rounded(_pooled_lines(spark, d).select("feature_1", "feature_2", "n_studies", *_FIXED))


@query("pool_heterogeneity", f"WITH {_POOLED_LINES} SELECT feature_1, feature_2, {r6('qq', 'Q')}, df, {r6('I2', 'I2')} FROM pooled")
def pool_heterogeneity(spark, d):
    return rounded(_pooled_lines(spark, d).select("feature_1", "feature_2", "Q", "df", "I2"))


@query("pool_random", f"WITH {_POOLED_LINES} SELECT feature_1, feature_2, n_studies, {_cols(_RANDOM)} FROM pooled")
def pool_random(spark, d):
    return rounded(_pooled_lines(spark, d).select("feature_1", "feature_2", "n_studies", *_RANDOM))


@query("pool_min_studies", f"WITH {_PEARSON.replace('>= 3)', '>= 72)')}{_pool_sql(5)} SELECT feature_1, feature_2, n_studies, {_cols(_FIXED[:1] + _RANDOM)} FROM pooled")
def pool_min_studies(spark, d):
    """Features with few distinct values go, so that pairs are in two to seven studies."""
    varied = materialized(clean.prepare(materialized(fx.obs_lines(spark, d)), min_unique=72))
    return rounded(_pool(correlate.pearson(varied, all_pairs=False), 5).select("feature_1", "feature_2", "n_studies", "z_fixed", *_RANDOM))


@query("pool_distribution", f"WITH {_POOLED_LINES} SELECT feature_1, feature_2, {r6('coalesce(z_random, z_fixed)', 'loc')}, {r6('coalesce(se_random, se_fixed)', 'scale')} FROM pooled")
def pool_distribution(spark, d):
    return rounded(pooling.pooled_distribution(_pooled_lines(spark, d)).select("feature_1", "feature_2", "loc", "scale"))


_NORMAL = [(0.025, -1.9599639845400545), (0.25, -0.6744897501960817), (0.5, 0.0), (0.975, 1.9599639845400545)]


@query("pool_quantiles", f"WITH {_POOLED_LINES}, nq AS (SELECT unnest([{', '.join(f'{p}::DOUBLE' for p, _ in _NORMAL)}]) AS probability, unnest([{', '.join(f'{z}::DOUBLE' for _, z in _NORMAL)}]) AS z) "
       f"SELECT feature_1, feature_2, probability, {r6('tanh(coalesce(z_random, z_fixed) + z * coalesce(se_random, se_fixed))', 'r')} FROM pooled, nq")
def pool_quantiles(spark, d):
    return rounded(pooling.pooled_quantiles(_pooled_lines(spark, d), [p for p, _ in _NORMAL]))


_UNIFORM = "('0x' || substr(md5(feature_1 || '|' || feature_2 || '|' || draw || '|0'), {at}, 8))::BIGINT / 4294967296.0::DOUBLE"


@query("pool_sampling", f"""WITH {_POOLED_LINES}, dw AS (SELECT *, {_UNIFORM.format(at=1)} AS u1, {_UNIFORM.format(at=9)} AS u2 FROM pooled, (SELECT unnest(range(1, 6))::INT AS draw))
SELECT feature_1, feature_2, draw, {r6('tanh(coalesce(z_random, z_fixed) + coalesce(se_random, se_fixed) * sqrt(-2 * ln(1 - u1)) * cos(2 * pi() * u2))', 'r')} FROM dw""")
def pool_sampling(spark, d):
    return rounded(pooling.sample_pooled(_pooled_lines(spark, d), 5))


@query("pool_resume", f"WITH {_POOLED_LINES} SELECT feature_1, feature_2, n_studies, {_cols(['z_fixed'])} FROM pooled")
def pool_resume(spark, d):
    """Half of the pairs are there; the others are added."""
    rows = pooling.with_enough_studies(pooling.eligible(correlate.correlations(_prepared(spark, d), ("pearson",))))
    existing = pooling.pool(rows.filter("feature_1 < 'RM0000030'"))
    return rounded(pooling.pool_new(rows, existing, overwrite=False).select("feature_1", "feature_2", "n_studies", "z_fixed"))


@query("pool_merge", f"WITH {_POOLED_LINES} SELECT feature_1, feature_2, n_studies, {_cols(_FIXED + _RANDOM)} FROM pooled")
def pool_merge(spark, d):
    """Three refreshes of a stored state: the first studies, one of them as of half of its samples; then that one whole; then the rest."""
    whole = _prepared(spark, d)
    with_p = lambda obs: pooling.eligible(correlate.pearson(obs, all_pairs=False).withColumn("p_value", corr_p_value(F.col("corr"), F.col("n"))))
    path, study = shared_folder(spark), F.col("study_id")
    refresh_pool_state(with_p(whole.filter((study < "ST1997") & ((study != "ST1996") | (F.col("sample_id").cast("int") % 2 == 0)))), path)
    refresh_pool_state(with_p(whole.filter(study == "ST1996")), path)
    refresh_pool_state(with_p(whole.filter(study >= "ST1997")), path)
    return rounded(pooling.pool_from_state(spark.read.parquet(path), min_studies=4).select("feature_1", "feature_2", "n_studies", *_FIXED, *_RANDOM))


@query("pool_limit", f"WITH {_POOLED_LINES} SELECT feature_1, feature_2, n_studies, {_cols(['z_fixed'])} FROM pooled ORDER BY 1, 2 LIMIT 10")
def pool_limit(spark, d):
    return rounded(_pooled_lines(spark, d, limit=10).select("feature_1", "feature_2", "n_studies", "z_fixed"))


# --- network --------------------------------------------------------------------------------------

_EDGES = """, edges AS (SELECT feature_1 AS source, feature_2 AS target, abs(r_random) AS weight, 1 - abs(r_random) AS distance, (1 - r_random * r_random * r_random) / 2 AS distance_signed,
  r_random AS r, ci_r_random_low AS ci_low, ci_r_random_high AS ci_high FROM pooled WHERE ci_r_random_low > 0 OR ci_r_random_high < 0),
ends AS (SELECT source AS node_id FROM edges UNION ALL SELECT target FROM edges), nodes AS (SELECT DISTINCT node_id FROM ends)"""
_NET = _POOLED_VECTORS + _EDGES
_SMALL = _NET + ", " + SMALL_SQL


def _edges(spark, d):
    return graph.significant_edges(_pool(correlate.pearson(fx.obs_vectors(spark, d), all_pairs=False)))


@query("significant_edges", f"WITH {_POOLED_LINES}{_EDGES} SELECT source, target, {_cols(['r', 'ci_low', 'ci_high'])} FROM edges")
def significant_edges(spark, d):
    return rounded(graph.significant_edges(_pooled_lines(spark, d)).select("source", "target", "r", "ci_low", "ci_high"))


@query("edge_attrs", f"WITH {_NET} SELECT source, target, {_cols(['weight', 'distance', 'distance_signed', 'r', 'ci_low', 'ci_high'])} FROM edges")
def edge_attrs(spark, d):
    return rounded(_edges(spark, d))


@query("positive_subgraph", f"WITH {_NET} SELECT source, target, {_cols(['r'])} FROM edges WHERE r > 0")
def positive_subgraph(spark, d):
    return rounded(graph.positive_edges(_edges(spark, d)).select("source", "target", "r"))


@query("node_degree", f"WITH {_NET} SELECT node_id, count(*) AS degree FROM ends GROUP BY 1")
def node_degree(spark, d):
    return graph.degrees(_edges(spark, d))


@query("annotate_nodes", f"WITH {_SMALL} SELECT node_id, super_class FROM nodes LEFT JOIN annotation ON feature = node_id")
def annotate_nodes(spark, d):
    return graph.annotated_nodes(_edges(spark, d), fx.annotation(spark))


@query("components", f"""WITH RECURSIVE {_NET}, both_ways AS (SELECT source AS u, target AS v FROM edges WHERE r > 0 UNION SELECT target, source FROM edges WHERE r > 0),
reach AS (SELECT DISTINCT u AS node_id, u AS other FROM both_ways UNION SELECT reach.node_id, v FROM reach JOIN both_ways ON reach.other = u)
SELECT node_id, min(other) AS component FROM reach GROUP BY 1""")
def components(spark, d):
    return graph.components(graph.positive_edges(_edges(spark, d)))


_PATHS = """, e AS (SELECT source AS u, target AS v, distance AS w FROM edges WHERE r > 0 UNION ALL SELECT target, source, distance FROM edges WHERE r > 0),
sp(source, target, d) USING KEY (source, target) AS (SELECT DISTINCT u, u, 0.0::DOUBLE FROM e
  UNION SELECT sp.source, e.v, min(sp.d + e.w) FROM sp JOIN e ON sp.target = e.u LEFT JOIN recurring.sp AS best ON best.source = sp.source AND best.target = e.v
  WHERE best.d IS NULL OR sp.d + e.w < best.d - 1e-12 GROUP BY sp.source, e.v)"""


@query("shortest_paths", f"WITH RECURSIVE {_NET}{_PATHS} SELECT source, target, {r6('d', 'd')} FROM sp")
def shortest_paths(spark, d):
    return rounded(graph.scenario_distances(materialized(_edges(spark, d)), "posonly"))


_DIRECT = """, direct AS (SELECT a.node_id AS source, b.node_id AS target, CASE WHEN a.node_id = b.node_id THEN 0.0 ELSE coalesce(e.distance_signed, f.distance_signed, 0.5) END AS d
  FROM nodes a, nodes b LEFT JOIN edges e ON e.source = a.node_id AND e.target = b.node_id LEFT JOIN edges f ON f.source = b.node_id AND f.target = a.node_id)"""


@query("direct_fill", f"WITH {_NET}{_DIRECT} SELECT source, target, {r6('d', 'd')} FROM direct")
def direct_fill(spark, d):
    return rounded(graph.scenario_distances(_edges(spark, d), "signed"))


@query("symmetrize", f"WITH {_NET}{_DIRECT} SELECT a.source, a.target, {r6('CASE WHEN a.source = a.target THEN 0 ELSE (a.d * 1.5 + b.d * 0.5) / 2 END', 'd')} FROM direct a JOIN direct b ON a.source = b.target AND a.target = b.source WHERE a.source <= a.target "
       f"UNION ALL SELECT a.target, a.source, {r6('(a.d * 1.5 + b.d * 0.5) / 2', 'd')} FROM direct a JOIN direct b ON a.source = b.target AND a.target = b.source WHERE a.source < a.target")
def symmetrize(spark, d):
    skewed = graph.scenario_distances(_edges(spark, d), "signed").withColumn("d", F.when(F.col("source") < F.col("target"), 1.5 * F.col("d")).otherwise(0.5 * F.col("d")))
    return rounded(graph.symmetrize(skewed))


# --- clusters -------------------------------------------------------------------------------------


def _largest(spark, d):
    edges = materialized(graph.positive_edges(_edges(spark, d)))
    return graph.restrict_connected(graph.shortest_paths(edges), edges, "largest")


# The distances of the largest component, then one merge per step: the nearest two clusters, and what Lance and Williams give to the others.
_LARGEST = """, both_ways AS (SELECT source AS u, target AS v FROM edges WHERE r > 0 UNION SELECT target, source FROM edges WHERE r > 0),
reach AS (SELECT DISTINCT u AS node_id, u AS other FROM both_ways UNION SELECT reach.node_id, v FROM reach JOIN both_ways ON reach.other = u),
comp AS (SELECT node_id, min(other) AS component FROM reach GROUP BY 1), big AS (SELECT component FROM comp GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1),
leaf AS (SELECT node_id, (row_number() OVER (ORDER BY node_id) - 1)::INT AS i FROM comp SEMI JOIN big USING (component)),
dd AS (SELECT least(a.i, b.i) AS i, greatest(a.i, b.i) AS j, avg(d) AS d FROM sp JOIN leaf a ON a.node_id = source JOIN leaf b ON b.node_id = target WHERE a.i <> b.i GROUP BY ALL)"""
_TO = "list_filter(ds, lambda x: x.i = least(c.id, m.{e}) AND x.j = greatest(c.id, m.{e}))[1].d"
_MERGED = {
    "average": f"(ni * {_TO.format(e='i')} + nj * {_TO.format(e='j')}) / (ni + nj)",
    "ward": f"sqrt(greatest(0, ((ni + c.n) * pow({_TO.format(e='i')}, 2) + (nj + c.n) * pow({_TO.format(e='j')}, 2) - c.n * m.d * m.d) / (ni + nj + c.n)))",
}
_linkage_sql = lambda method: f"""{_PATHS}{_LARGEST},
lk(k, n, cl, ds, a, b, h, s) AS (
  SELECT 0, (SELECT count(*)::INT FROM leaf), (SELECT list({{'id': i, 'n': 1, 'leaves': [i]}} ORDER BY i) FROM leaf), (SELECT list({{'d': d, 'i': i, 'j': j}}) FROM dd), 0, 0, 0.0::DOUBLE, 0
  UNION ALL
  SELECT k + 1, n, list_append(list_filter(cl, lambda c: c.id <> m.i AND c.id <> m.j), {{'id': n + k, 'n': ni + nj, 'leaves': list_concat(p, q)}}),
    list_concat(list_filter(ds, lambda x: x.i <> m.i AND x.i <> m.j AND x.j <> m.i AND x.j <> m.j),
      list_transform(list_filter(cl, lambda c: c.id <> m.i AND c.id <> m.j), lambda c: {{'d': {_MERGED[method]}, 'i': c.id, 'j': n + k}})), m.i, m.j, m.d, ni + nj
  FROM (SELECT *, list_filter(cl, lambda c: c.id = m.i)[1].n AS ni, list_filter(cl, lambda c: c.id = m.j)[1].n AS nj, list_filter(cl, lambda c: c.id = m.i)[1].leaves AS p, list_filter(cl, lambda c: c.id = m.j)[1].leaves AS q
    FROM (SELECT *, list_sort(ds)[1] AS m FROM lk WHERE len(cl) > 1)))"""  # noqa: E731


@query("ward_clusters", f"""WITH RECURSIVE {_NET}{_linkage_sql('ward')}, cut AS (SELECT unnest(cl) AS c FROM lk WHERE k = greatest(0, n - 6))
SELECT node_id, dense_rank() OVER (ORDER BY first)::INT AS cluster FROM (SELECT list_min(c.leaves) AS first, unnest(c.leaves) AS i FROM cut) JOIN leaf USING (i)""")
def ward_clusters(spark, d):
    return cluster.cluster_nodes(_largest(spark, d), 6)


@query("avg_linkage", f"WITH RECURSIVE {_NET}{_linkage_sql('average')} SELECT k AS step, a AS left, b AS right, {r6('h', 'height')}, s AS size FROM lk WHERE k > 0")
def avg_linkage(spark, d):
    return rounded(cluster.linkage_table(_largest(spark, d), "average"))


@query("tsne_layout")
def tsne_layout(spark, d):
    return cluster.layout(_largest(spark, d))


@query("cluster_layout")
def cluster_layout(spark, d):
    edges = materialized(_edges(spark, d))
    return cluster.cluster_layout(cluster.cluster_jaccard(edges, fx.clusters_of(graph.nodes_of(edges))))


@query("cluster_block_means", f"""WITH {_SMALL}{_DIRECT}, m AS (SELECT a.cluster AS cluster_i, b.cluster AS cluster_j, avg(d) AS d FROM direct JOIN clusters a ON a.node_id = source JOIN clusters b ON b.node_id = target GROUP BY ALL)
SELECT cluster_i, cluster_j, {r6('CASE WHEN cluster_i = cluster_j THEN 0 ELSE d END', 'd')} FROM m""")
def cluster_block_means(spark, d):
    distances = graph.scenario_distances(_edges(spark, d), "signed")
    return rounded(cluster.block_means(distances, fx.clusters_of(fx.vector_nodes(spark))))


@query("cluster_composition", f"""WITH {PARTS_SQL}, c AS (SELECT cluster, coalesce(super_class, 'unknown') AS class, count(*) AS n FROM clusters LEFT JOIN annotation ON feature = node_id GROUP BY ALL)
SELECT cluster, class, n, {r6('100.0 * n / sum(n) OVER (PARTITION BY cluster)', 'percent')} FROM c""")
def cluster_composition(spark, d):
    return rounded(cluster.composition(fx.part_clusters(spark, d), fx.part_annotation(spark, d)))


@query("cluster_sizes", f"WITH {PARTS_SQL} SELECT cluster, count(*) AS n FROM clusters GROUP BY 1")
def cluster_sizes(spark, d):
    return cluster.cluster_sizes(fx.part_clusters(spark, d))


_JACCARD = """, bt AS (SELECT least(a.cluster, b.cluster) AS cluster_i, greatest(a.cluster, b.cluster) AS cluster_j, sum(r) AS w FROM edges JOIN clusters a ON a.node_id = source JOIN clusters b ON b.node_id = target WHERE a.cluster <> b.cluster GROUP BY ALL),
lv AS (SELECT c, sum(w) AS o FROM (SELECT cluster_i AS c, w FROM bt UNION ALL SELECT cluster_j, w FROM bt) GROUP BY 1),
cl AS (SELECT DISTINCT cluster FROM clusters),
jac AS (SELECT a.cluster AS cluster_i, b.cluster AS cluster_j, coalesce(w, 0) AS w, coalesce(x.o, 0) + coalesce(y.o, 0) - coalesce(w, 0) AS u
  FROM cl a JOIN cl b ON a.cluster < b.cluster LEFT JOIN bt ON bt.cluster_i = a.cluster AND bt.cluster_j = b.cluster LEFT JOIN lv x ON x.c = a.cluster LEFT JOIN lv y ON y.c = b.cluster),
jaccard AS (SELECT cluster_i, cluster_j, CASE WHEN u = 0 THEN 0 ELSE w / u END AS similarity FROM jac)"""


@query("cluster_jaccard", f"WITH {_SMALL}{_JACCARD} SELECT cluster_i, cluster_j, {_cols(['similarity'])} FROM jaccard")
def cluster_jaccard(spark, d):
    return rounded(cluster.cluster_jaccard(_edges(spark, d), fx.clusters_of(fx.vector_nodes(spark))))


@query("jaccard_permutation")
def jaccard_permutation(spark, d):
    edges = materialized(_edges(spark, d))
    return rounded(cluster.permutation_test(edges, fx.clusters_of(graph.nodes_of(edges)), permutations=999))


@query("jaccard_adjusted")
def jaccard_adjusted(spark, d):
    return rounded(adjust_bh(jaccard_permutation(spark, d), "p", "p_adj", [], ["cluster_i", "cluster_j"]))


@query("cluster_edges", f"WITH {_SMALL}{_JACCARD} SELECT cluster_i, cluster_j, {_cols(['similarity'])}, {r6('1 + 9 * abs(similarity) / (SELECT max(abs(similarity)) FROM jaccard)', 'width')} FROM jaccard WHERE similarity <> 0")
def cluster_edges(spark, d):
    return rounded(report.cluster_edges(cluster.cluster_jaccard(_edges(spark, d), fx.clusters_of(fx.vector_nodes(spark)))))


# --- enrichment -----------------------------------------------------------------------------------

_ORA = PARTS_SQL + """
, hits AS (SELECT DISTINCT cluster, member_id FROM clusters JOIN xref ON feature = node_id WHERE member_id IS NOT NULL),
bg AS (SELECT DISTINCT member_id FROM hits), inside AS (SELECT DISTINCT set_id, set_name, member_id FROM members SEMI JOIN bg USING (member_id)),
tested AS (SELECT set_id, set_name, count(*) AS n_set FROM inside GROUP BY ALL HAVING count(*) >= 2),
drawn AS (SELECT cluster, count(*) AS n_drawn FROM hits GROUP BY 1), tot AS (SELECT count(*) AS n_background FROM bg),
lap AS (SELECT cluster, set_id, count(*) AS n_hits, list_sort(list(member_id)) AS hit_ids FROM hits JOIN inside USING (member_id) GROUP BY ALL),
g AS (SELECT cluster, set_id, set_name, n_set, n_drawn, n_background, coalesce(n_hits, 0) AS n_hits, hit_ids FROM drawn CROSS JOIN tested CROSS JOIN tot LEFT JOIN lap USING (cluster, set_id)),
pv AS (SELECT *, CASE WHEN n_hits <= 0 THEN 1.0 ELSE least(1.0, coalesce(list_sum(list_transform(range(greatest(n_hits, n_drawn - (n_background - n_set)), least(n_set, n_drawn) + 1), lambda i:
  exp(lgamma(n_set + 1) - lgamma(i + 1) - lgamma(n_set - i + 1) + lgamma(n_background - n_set + 1) - lgamma(n_drawn - i + 1) - lgamma(n_background - n_set - n_drawn + i + 1)
    - lgamma(n_background + 1) + lgamma(n_drawn + 1) + lgamma(n_background - n_drawn + 1)))), 0)) END AS pval FROM g),
rk AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(pval, 9), set_id) AS rank, count(*) OVER (PARTITION BY cluster) AS m FROM pv),
ora AS (SELECT *, least(1.0, min(pval * m / rank) OVER (PARTITION BY cluster ORDER BY rank DESC ROWS UNBOUNDED PRECEDING)) AS padj FROM rk)"""


def _ora(spark, d):
    """Read by several branches of a plan, so written once."""
    found = materialized(enrich.cluster_members(fx.part_xref(spark, d), fx.part_clusters(spark, d)))
    return enrich.over_representation(found, materialized(fx.part_sets(spark, d)), found)


@query("ora", f"WITH {_ORA} SELECT cluster, set_id, set_name, n_hits, n_set, n_background, {_cols(['pval', 'padj'])}, coalesce(array_to_string(hit_ids, ';'), '') AS hit_ids FROM ora")
def ora(spark, d):
    return rounded(enrich.flat_results(_ora(spark, d)))


@query("bh_adjust", f"WITH {_ORA} SELECT cluster, set_id, {_cols(['padj'])} FROM ora")
def bh_adjust(spark, d):
    return rounded(adjust_bh(_ora(spark, d).drop("padj"), "pval", "padj", ["cluster"], ["set_id"]).select("cluster", "set_id", "padj"))


@query("adjust_holm", f"""WITH {_ORA} SELECT cluster, set_id, {r6('least(1.0, max(pval * (m - rank + 1)) OVER (PARTITION BY cluster ORDER BY rank ROWS UNBOUNDED PRECEDING))', 'padj')} FROM rk""")
def adjust_holm(spark, d):
    tests = _ora(spark, d).drop("padj").withColumn("pval", F.round("pval", 9))
    return rounded(adjust_p(tests, "pval", "padj", ["cluster"], ["set_id"], "holm").select("cluster", "set_id", "padj"))


@query("adjust_by", f"""WITH {_ORA} SELECT cluster, set_id, {r6('least(1.0, min(pval * m / rank * list_sum(list_transform(range(1, m + 1), lambda k: 1.0::DOUBLE / k))) OVER (PARTITION BY cluster ORDER BY rank DESC ROWS UNBOUNDED PRECEDING))', 'padj')} FROM rk""")
def adjust_by(spark, d):
    return rounded(adjust_p(_ora(spark, d).drop("padj"), "pval", "padj", ["cluster"], ["set_id"], "fdr_by").select("cluster", "set_id", "padj"))


@query("enrich_clusters", f"WITH {_ORA} SELECT cluster, set_id, n_hits, {_cols(['padj'])} FROM ora WHERE padj < 0.6")
def enrich_clusters(spark, d):
    found = enrich.enrich_clusters(fx.part_xref(spark, d), fx.part_clusters(spark, d), fx.part_sets(spark, d), 0.6)
    return rounded(found.select("cluster", "set_id", "n_hits", "padj"))


@query("top_sets", f"WITH {_ORA} SELECT set_id, set_name, {r6('min(padj)', 'best_padj')} FROM ora GROUP BY ALL ORDER BY round(min(padj), 9), set_id LIMIT 5")
def top_sets(spark, d):
    rounded_padj = _ora(spark, d).withColumn("padj", F.round("padj", 9))
    return rounded(enrich.top_sets(rounded_padj, 5).select("set_id", "set_name", "best_padj"))


@query("set_abundance", f"""WITH {PARTS_SQL}, fo AS (SELECT cluster, member_id FROM clusters JOIN xref ON feature = node_id WHERE member_id IS NOT NULL),
kn AS (SELECT cluster, count(*) AS known FROM fo GROUP BY 1), mp AS (SELECT cluster, set_id, count(*) AS mapped FROM fo JOIN members USING (member_id) GROUP BY ALL)
SELECT c.cluster, s.set_id, {r6('coalesce(coalesce(mapped, 0)::DOUBLE / known, 0)', 'abundance')} FROM (SELECT DISTINCT cluster FROM clusters) c, sets s
LEFT JOIN kn ON kn.cluster = c.cluster LEFT JOIN mp ON mp.cluster = c.cluster AND mp.set_id = s.set_id""")
def set_abundance(spark, d):
    return rounded(enrich.set_abundance(fx.part_xref(spark, d), fx.part_clusters(spark, d), fx.part_sets(spark, d)))


@query("set_significance", f"WITH {_ORA} SELECT c.cluster, s.set_id, coalesce(padj < 0.6, false) AS significant FROM (SELECT DISTINCT cluster FROM clusters) c, sets s LEFT JOIN ora ON ora.cluster = c.cluster AND ora.set_id = s.set_id")
def set_significance(spark, d):
    return enrich.set_significance(_ora(spark, d), fx.part_clusters(spark, d), fx.part_sets(spark, d), 0.6)


_GSEA = VECTORS_SQL + ", " + SMALL_SQL + """
, sc AS (SELECT member_id, avg(m) AS score FROM (SELECT feature, avg(value) AS m FROM obs GROUP BY 1) JOIN xref USING (feature) WHERE member_id IS NOT NULL GROUP BY 1),
rk AS (SELECT *, row_number() OVER (ORDER BY score DESC, member_id) AS rank, count(*) OVER () AS total FROM sc),
st AS (SELECT s.set_id, rank, CASE WHEN m.member_id IS NOT NULL THEN abs(score) ELSE 0 END AS up, CASE WHEN m.member_id IS NULL THEN 1 ELSE 0 END AS down, total FROM sets s, rk LEFT JOIN members m ON m.set_id = s.set_id AND m.member_id = rk.member_id),
sz AS (SELECT set_id, sum(1 - down) AS size, sum(up) AS su, any_value(total) AS total FROM st GROUP BY 1 HAVING sum(1 - down) BETWEEN 2 AND 500),
ru AS (SELECT set_id, size, sum(up / su - down::DOUBLE / (sz.total - size)) OVER (PARTITION BY set_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS run FROM st JOIN sz USING (set_id))"""


def _scores(spark, d):
    means = fx.obs_vectors(spark, d).groupBy("feature").agg(F.avg("value").alias("score"))
    return means.join(fx.xref(spark), "feature").filter("member_id IS NOT NULL").select("member_id", "score")


@query("gsea_es", f"WITH {_GSEA} SELECT set_id, size::BIGINT AS size, {r6('CASE WHEN abs(min(run)) > abs(max(run)) THEN min(run) ELSE max(run) END', 'es')} FROM ru GROUP BY ALL")
def gsea_es(spark, d):
    return rounded(enrich.enrichment_scores(_scores(spark, d), fx.sets(spark)).select("set_id", "size", "es"))


@query("gsea_permutation")
def gsea_permutation(spark, d):
    return rounded(enrich.ranked_enrichment(_scores(spark, d), fx.sets(spark), permutations=1000))


# --- reports --------------------------------------------------------------------------------------

_VIEW = """, dg AS (SELECT node_id, count(*) AS degree FROM ends GROUP BY 1),
vw AS (SELECT node_id, coalesce(super_class, 'unknown') AS class, degree FROM dg LEFT JOIN annotation ON feature = node_id),
cd AS (SELECT class, (row_number() OVER (ORDER BY class) - 1)::INT AS code FROM (SELECT DISTINCT class FROM vw))"""


@query("viewer_nodes", f"WITH {_SMALL}{_VIEW} SELECT node_id, class, code, degree, {r6('3 + 19 * sqrt(degree / (SELECT max(degree) FROM dg))', 'marker_size')} FROM vw JOIN cd USING (class)")
def viewer_nodes(spark, d):
    return rounded(report.viewer_nodes(materialized(_edges(spark, d)), fx.annotation(spark)))


@query("viewer_hover", f"WITH {_SMALL}{_VIEW} SELECT node_id, concat_ws(chr(10), node_id, super_class, 'super_class: ' || class, 'degree: ' || degree) AS hover FROM vw LEFT JOIN annotation ON feature = node_id")
def viewer_hover(spark, d):
    nodes = report.viewer_nodes(materialized(_edges(spark, d)), fx.annotation(spark))
    return report.hover_text(nodes, fx.annotation(spark), ["super_class"], "super_class").select("node_id", "hover")


@query("edge_categories", f"""WITH {_SMALL}{_VIEW}, ec AS (SELECT source, target, CASE WHEN v.class = u.class THEN 'within ' || v.class WHEN v.class <> 'unknown' AND u.class <> 'unknown' THEN 'between' ELSE 'unknown' END AS label
  FROM edges JOIN vw v ON v.node_id = source JOIN vw u ON u.node_id = target) SELECT source, target, (dense_rank() OVER (ORDER BY label) - 1)::INT AS code, label FROM ec""")
def edge_categories(spark, d):
    """Edges coloured by whether their ends are of one class."""
    edges = materialized(_edges(spark, d))
    nodes = report.viewer_nodes(edges, fx.annotation(spark))
    a, b = (nodes.select(F.col("node_id").alias(e), F.col("class").alias(f"c_{e}")) for e in ("source", "target"))
    kind = F.when(F.col("c_source") == F.col("c_target"), F.concat(F.lit("within "), F.col("c_source"))).when((F.col("c_source") != "unknown") & (F.col("c_target") != "unknown"), "between")
    return report.edge_groups(edges.join(a, "source").join(b, "target").withColumn("kind", kind), "kind")


_POS = ", ps AS (SELECT node_id, round(sin(k), 4) AS x, round(cos(k), 4) AS y FROM vnodes)"


@query("viewer_edges", f"""WITH {_SMALL}{_VIEW}{_POS} SELECT source, target, a.x + 0.0 AS x_source, a.y + 0.0 AS y_source, b.x + 0.0 AS x_target, b.y + 0.0 AS y_target, c.code AS code_source, e.code AS code_target, (r >= 0)::INT AS positive
FROM edges JOIN ps a ON a.node_id = source JOIN ps b ON b.node_id = target JOIN vw v ON v.node_id = source JOIN cd c ON c.class = v.class JOIN vw u ON u.node_id = target JOIN cd e ON e.class = u.class""")
def viewer_edges(spark, d):
    edges = materialized(_edges(spark, d))
    k = fx.numbered("node_id")
    positions = fx.vector_nodes(spark).select("node_id", F.sin(k).alias("x"), F.cos(k).alias("y"))
    return rounded(report.viewer_edges(edges, positions, report.viewer_nodes(edges, fx.annotation(spark))))


@query("binned_edges", f"WITH {_NET}, l AS (SELECT min(r) AS lo, max(r) AS hi FROM edges) SELECT source, target, least(14, greatest(0, trunc((r - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END * 15)))::INT AS bin FROM edges, l")
def binned_edges(spark, d):
    return report.binned_edges(materialized(_edges(spark, d)), "r")


@query("visible_edges", f"WITH {_SMALL}{_VIEW} SELECT source, target FROM edges JOIN vw a ON a.node_id = source JOIN vw b ON b.node_id = target WHERE a.class IN ('class 1', 'class 2') AND b.class IN ('class 1', 'class 2')")
def visible_edges(spark, d):
    edges = materialized(_edges(spark, d))
    nodes = report.viewer_nodes(edges, fx.annotation(spark))
    both = edges.join(nodes.select(F.col("node_id").alias("source"), F.col("class").alias("a")), "source").join(nodes.select(F.col("node_id").alias("target"), F.col("class").alias("b")), "target")
    return both.filter(graph.is_edge_visible(["class 1", "class 2"], F.col("a"), F.col("b"))).select("source", "target")
