"""Meta-analysis of one pair's correlations over studies, with Fisher's z.

One shuffle by pair; the studies of a pair are gathered in an array (their number is that of the
studies) and everything else is arithmetic on it inside the JVM.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Correlations are clipped this near to 1; half the width of a 95 % interval in standard errors.
NEAR_ONE, Z95 = 1 - 1e-10, 1.96
ID_PATTERN = r"^RM\d{7}$"
PAIR = ["feature_1", "feature_2"]


def eligible(corr: DataFrame, id_pattern: str | None = ID_PATTERN) -> DataFrame:
    """Rows that can be pooled: over three samples, a p value, and both features' ids well formed."""
    kept = corr.filter("n > 3 AND p_value IS NOT NULL AND corr IS NOT NULL")
    return kept if id_pattern is None else kept.filter(F.col("feature_1").rlike(id_pattern) & F.col("feature_2").rlike(id_pattern))


def with_enough_studies(corr: DataFrame, min_studies: int = 4) -> DataFrame:
    """Rows of pairs with at least ``min_studies`` rows."""
    return corr.withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy(*PAIR))).filter(F.col("_k") >= min_studies).drop("_k")


def _interval(z: str, se: str, name: str) -> list[Column]:
    return [F.tanh(F.col(z) - Z95 * F.col(se)).alias(f"ci_r_{name}_low"), F.tanh(F.col(z) + Z95 * F.col(se)).alias(f"ci_r_{name}_high")]


def pool(corr: DataFrame, by: list[str] | None = None, min_studies_random: int = 4, min_studies: int = 1) -> DataFrame:
    """Fixed and random effects per pair (or per ``by``).

    corr needs corr and n, or z instead of corr. Rows with n of 3 or less or nothing to pool are
    left out. Heterogeneity needs two studies; the random effect (DerSimonian-Laird) needs
    ``min_studies_random``, else its columns are NULL.
    """
    by = by or PAIR
    rows = _fisher(corr)
    return _effects(rows.groupBy(*by).agg(F.collect_list(_weighed()).alias("s")), by, min_studies_random, min_studies)


def _fisher(corr: DataFrame) -> DataFrame:
    """Rows that can be pooled, with their Fisher z in _z."""
    if not {"corr", "z"} & set(corr.columns) or "n" not in corr.columns:
        raise ValueError("pooling needs n and one of corr and z")
    r = F.lit(None)
    if "corr" in corr.columns:  # greatest and least skip nulls
        r = F.when(F.col("corr").isNotNull(), F.greatest(F.lit(-NEAR_ONE), F.least(F.lit(NEAR_ONE), F.col("corr"))))
    z = F.coalesce(F.col("z"), F.atanh(r)) if "z" in corr.columns else F.atanh(r)
    return corr.withColumn("_z", z).filter(F.col("_z").isNotNull() & (F.col("n") > 3))


def _weighed() -> Column:
    return F.struct((F.col("n") - 3.0).alias("w"), F.col("_z").alias("z"))


def _effects(held: DataFrame, by: list[str], min_studies_random: int, min_studies: int) -> DataFrame:
    """Pooled columns from ``s``, the weights and z of a pair's studies."""
    total = lambda array, f: F.aggregate(array, F.lit(0.0), lambda a, x: a + f(x))
    held = held.withColumn("s", F.array_sort("s"))  # the order of a sum must not depend on the shuffle
    held = held.withColumn("n_studies", F.size("s").cast("long")).filter(F.col("n_studies") >= min_studies)
    held = held.withColumn("sw", total("s", lambda x: x.w)).withColumn("z_fixed", total("s", lambda x: x.w * x.z) / F.col("sw")).withColumn("se_fixed", 1 / F.sqrt("sw"))
    several = F.col("n_studies") >= 2
    held = held.withColumn("Q", F.when(several, total("s", lambda x: x.w * (x.z - F.col("z_fixed")) * (x.z - F.col("z_fixed")))))
    held = held.withColumn("df", F.when(several, F.col("n_studies") - 1))
    held = held.withColumn("I2", F.when(F.col("Q") > 0, F.greatest(F.lit(0.0), (F.col("Q") - F.col("df")) / F.col("Q")) * 100).when(several, 0.0))
    spread = F.col("sw") - total("s", lambda x: x.w * x.w) / F.col("sw")
    random = F.col("n_studies") >= max(2, min_studies_random)
    held = held.withColumn("tau2", F.when(random, F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("Q") - F.col("df"), spread), F.lit(0.0)))))
    held = held.withColumn("sr", total("s", lambda x: 1 / (1 / x.w + F.col("tau2"))))
    held = held.withColumn("z_random", total("s", lambda x: x.z / (1 / x.w + F.col("tau2"))) / F.col("sr")).withColumn("se_random", 1 / F.sqrt("sr"))
    return held.select(
        *by, "n_studies", "z_fixed", "se_fixed", F.tanh("z_fixed").alias("r_fixed"), *_interval("z_fixed", "se_fixed", "fixed"), "Q", "df", "I2",
        "tau2", "z_random", "se_random", F.tanh("z_random").alias("r_random"), *_interval("z_random", "se_random", "random"),
    )


def pool_new(corr: DataFrame, existing: DataFrame | None, overwrite: bool = True, limit: int | None = None, **options) -> DataFrame:
    """Pool all pairs, or only those not in ``existing``, to which they are added.

    ``limit`` keeps the first pairs in order, for trials.
    """
    if existing is not None and not overwrite:
        corr = corr.join(existing.select(*PAIR), PAIR, "left_anti")
    if limit is not None:
        corr = corr.join(corr.select(*PAIR).distinct().orderBy(*PAIR).limit(limit), PAIR, "left_semi")
    fresh = pool(corr, **options)
    return fresh if existing is None or overwrite else existing.unionByName(fresh, allowMissingColumns=True)


def pool_state(corr: DataFrame, buckets: int = 64) -> DataFrame:
    """What pooling needs of each pair: feature_1, feature_2, studies (study_id, w, z) and bucket.

    States of disjoint studies add up (``merge_states``), so that a new study doesn't need the
    correlations of the others. ``bucket`` is that of feature_1. Of rows of one pair and study the
    greatest (w, z) counts.
    """
    rows = _fisher(corr).groupBy(*PAIR, "study_id").agg(F.max(_weighed()).alias("x"))
    held = rows.groupBy(*PAIR).agg(F.array_sort(F.collect_list(F.struct("study_id", "x.w", "x.z"))).alias("studies"))
    return held.withColumn("bucket", F.pmod(F.xxhash64("feature_1"), F.lit(buckets)).cast("int"))


def merge_states(old: DataFrame, new: DataFrame, refreshed: DataFrame) -> DataFrame:
    """``old`` without the studies of ``refreshed`` (study_id), and with those of ``new``; one shuffle by pair.

    A pair that loses its last study stays with none, so that a table's partition can be replaced whole.
    """
    entry = old.select(*PAIR, "bucket", F.explode_outer("studies").alias("e")).select(*PAIR, "bucket", "e.*")
    gone = refreshed.select("study_id").distinct().withColumn("gone", F.lit(True))
    kept = entry.join(gone, "study_id", "left").withColumns({c: F.when(F.col("gone").isNull(), F.col(c)) for c in ("study_id", "w", "z")}).drop("gone")
    added = new.select(*PAIR, "bucket", F.explode("studies").alias("e")).select(*PAIR, "bucket", "e.*")
    studies = F.array_sort(F.collect_list(F.when(F.col("study_id").isNotNull(), F.struct("study_id", "w", "z"))))  # nulls aren't collected
    return kept.unionByName(added).groupBy(*PAIR, "bucket").agg(studies.alias("studies")).select(*PAIR, "studies", "bucket")


def pool_from_state(state: DataFrame, min_studies_random: int = 4, min_studies: int = 1) -> DataFrame:
    """What ``pool`` gives for all the studies of a state."""
    held = state.select(*PAIR, F.transform("studies", lambda e: F.struct(e.w.alias("w"), e.z.alias("z"))).alias("s"))
    return _effects(held, PAIR, min_studies_random, max(1, min_studies))


def pooled_distribution(pooled: DataFrame) -> DataFrame:
    """Location and scale of the pooled z: the random effect's if there is one."""
    return pooled.withColumn("loc", F.coalesce("z_random", "z_fixed")).withColumn("scale", F.coalesce("se_random", "se_fixed"))


def pooled_quantiles(pooled: DataFrame, probabilities: list[float]) -> DataFrame:
    """feature_1, feature_2, probability, r: quantiles of each pair's pooled distribution, on the scale of r."""
    if not all(0 < p < 1 for p in probabilities):
        raise ValueError("probabilities lie between 0 and 1")
    known = F.explode(F.array(*(F.struct(F.lit(float(p)).alias("p"), F.lit(NormalDist().inv_cdf(p)).alias("z")) for p in probabilities))).alias("q")
    placed = pooled_distribution(pooled).select(*PAIR, "loc", "scale", known)
    return placed.select(*PAIR, F.col("q.p").alias("probability"), F.tanh(F.col("loc") + F.col("scale") * F.col("q.z")).alias("r"))


def sample_pooled(pooled: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """``draws`` draws of r from each pair's pooled distribution.

    A draw depends on the pair, its number and the seed alone, however rows are dealt: a digest of these
    gives two uniform numbers, and these a normal one.
    """
    drawn = pooled_distribution(pooled).select(*PAIR, "loc", "scale", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    digest = F.md5(F.concat_ws("|", *PAIR, F.col("draw").cast("string"), F.lit(str(seed))))
    uniform = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("double") / 2.0**32
    z = F.sqrt(-2 * F.ln(1 - uniform(1))) * F.cos(2 * F.pi() * uniform(9))
    return drawn.withColumn("r", F.tanh(F.col("loc") + F.col("scale") * z)).drop("loc", "scale")
