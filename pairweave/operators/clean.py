"""From raw cells to the observations that are correlated: long format throughout.

Missing is NULL everywhere: NaN and infinities become NULL on entry, as Spark treats NaN as a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairweave.operators.order import exact_medians
from pairweave.plans.scratch import materialized

#: Cells that mean "below the limit of detection or quantification", trimmed and lower-cased.
BELOW_LIMIT = ["lod", "blod", "< lod", "&lt; lod", "loq", "bloq", "< loq", "&lt; loq"]
UNMAPPED = "UNMAPPED:"
_NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"


def finite(value: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def to_number(raw: Column) -> Column:
    """Numbers as written in decimal, anything else NULL (no type suffixes, hexadecimal or words)."""
    return F.when(raw.rlike(_NUMBER), finite(raw.try_cast("double")))


def parse_cells(raw: DataFrame, below_limit: str = "zero") -> DataFrame:
    """raw to value; ``below_limit``: "zero" counts such cells as 0, "null" as missing."""
    if below_limit not in ("zero", "null"):
        raise ValueError(f"below_limit must be 'zero' or 'null', not {below_limit!r}")
    value = to_number(F.col("raw"))
    if below_limit == "zero":
        value = F.when(F.lower(F.trim("raw")).isin(BELOW_LIMIT), F.lit(0.0)).otherwise(value)
    return raw.withColumn("value", value).drop("raw")


def standardize_names(raw: DataFrame, name_map: DataFrame, ids: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Raw names to features.

    name_map (raw_name, ref_name), ids (ref_name, feature), aliases (ref_name, feature). Without a
    reference name the feature is UNMAPPED: and the raw name; else the id, the alias's id, or the
    bare reference name, in this order. Of several ids of a name the largest counts (``read_lookup``
    has settled duplicates of a file before, the last one counting); an id that is NULL or empty is none.
    """
    ids = ids.filter("feature != ''").groupBy("ref_name").agg(F.max("feature").alias("_id"))
    named = raw.join(name_map, "raw_name", "left").join(ids, "ref_name", "left")
    alias = F.lit(None).cast("string")
    if aliases is not None:
        named = named.join(aliases.groupBy("ref_name").agg(F.max("feature").alias("_alias")), "ref_name", "left")
        alias = F.col("_alias")
    unnamed = F.coalesce(F.col("ref_name"), F.lit("")) == ""
    feature = F.when(unnamed, F.concat(F.lit(UNMAPPED), F.col("raw_name"))).otherwise(F.coalesce("_id", alias, "ref_name"))
    return named.withColumn("feature", feature).drop("_id", "_alias", "ref_name")


def rogue_names(named: DataFrame, id_pattern: str = r"^RM\d+$") -> DataFrame:
    """Features that are neither ids nor marked unmapped, with the number of their cells."""
    odd = ~F.col("feature").startswith(UNMAPPED) & ~F.col("feature").rlike(id_pattern)
    return named.filter(odd).groupBy("feature").agg(F.count(F.lit(1)).alias("cells"))


def drop_unmapped(obs: DataFrame) -> DataFrame:
    return obs.filter(~F.col("feature").startswith(UNMAPPED))


def merge_analyses(obs: DataFrame, samples: DataFrame | None = None, how: str = "outer") -> DataFrame:
    """Analyses of a study by sample: all samples, or those that every analysis of the study has.

    obs has analysis_id; samples (study_id, analysis_id, sample_id) lists samples by presence, which
    doesn't depend on values; without it the rows of obs do.
    """
    if how == "outer":
        return obs
    if how != "inner":
        raise ValueError(f"how must be 'outer' or 'inner', not {how!r}")
    present = (obs if samples is None else samples).select("study_id", "analysis_id", "sample_id").distinct()
    everywhere = present.groupBy("study_id", "sample_id").agg(F.count(F.lit(1)).alias("k"))
    analyses = present.select("study_id", "analysis_id").distinct().groupBy("study_id").agg(F.count(F.lit(1)).alias("k"))
    return obs.join(everywhere.join(analyses, ["study_id", "k"]).select("study_id", "sample_id"), ["study_id", "sample_id"], "left_semi")


def row_key(obs: DataFrame) -> Column:
    """What tells a study's rows apart: row_id where there is one (sample ids of a file may repeat), else sample_id."""
    return F.coalesce("row_id", "sample_id") if "row_id" in obs.columns else F.col("sample_id")


def average_duplicates(obs: DataFrame) -> DataFrame:
    """One value per (study, row, feature): the mean of those present."""
    keys = [c for c in ("study_id", "sample_id", "row_id", "feature") if c in obs.columns]
    return obs.groupBy(*keys).agg(F.avg("value").alias("value"))


def unique_cells(obs: DataFrame) -> DataFrame:
    """study_id, row, feature, value: cells with a value, repeated ones of a row as their mean; dealt by (study_id, row)."""
    cells = obs.filter(F.col("value").isNotNull()).select("study_id", row_key(obs).alias("row"), "feature", "value")
    return cells.repartition("study_id", "row").groupBy("study_id", "row", "feature").agg(F.avg("value").alias("value"))


def drop_low_variance(obs: DataFrame, min_unique: int | None = 3) -> DataFrame:
    """Without features that have fewer than ``min_unique`` distinct values in a study; None keeps all."""
    if min_unique is None:
        return obs
    varied = obs.groupBy("study_id", "feature").agg(F.count_distinct("value").alias("u")).filter(F.col("u") >= min_unique)
    return obs.join(varied.select("study_id", "feature"), ["study_id", "feature"], "left_semi")


def normalize_pqn(obs: DataFrame) -> DataFrame:
    """Probabilistic quotient normalisation of each sample's dilution.

    Each value as a share of its sample's sum; over the feature's median share; the sample's median
    of these quotients divides the sample's values. Unmapped features take part. A feature's median is
    taken over all samples of a study, however many, by ``order.exact_medians``; a sample's is an
    aggregate over its features.
    """
    obs = obs.withColumn("_row", row_key(obs))
    sample = Window.partitionBy("study_id", "_row")
    shares = materialized(obs.withColumn("_share", F.try_divide("value", F.sum("value").over(sample))))
    typical = exact_medians(shares, ["study_id", "feature"], "_share", "_typical")
    quotients = shares.join(typical, ["study_id", "feature"]).withColumn("_quotient", F.try_divide("_share", "_typical"))
    dilution = quotients.groupBy("study_id", "_row").agg(F.median("_quotient").alias("_dilution"))
    out = shares.join(dilution, ["study_id", "_row"], "left")
    return out.withColumn("value", F.try_divide("value", "_dilution")).drop("_dilution", "_row", "_share")


def transform_values(obs: DataFrame, transform: str | None) -> DataFrame:
    """log (of 1 + value), sqrt, or None."""
    if transform is None:
        return obs
    if transform == "log":
        return obs.withColumn("value", F.log1p("value"))
    if transform == "sqrt":
        return obs.withColumn("value", F.when(F.col("value") >= 0, F.sqrt("value")))
    raise ValueError(f"transform must be 'log', 'sqrt' or None, not {transform!r}")


def prepare(obs: DataFrame, keep_unmapped: bool = False, transform: str | None = "log", pqn: bool = False, min_unique: int | None = 3) -> DataFrame:
    """The whole of it, in this order: variance, PQN, unmapped, transform."""
    obs = drop_low_variance(obs, min_unique)
    obs = normalize_pqn(obs) if pqn else obs
    obs = obs if keep_unmapped else drop_unmapped(obs)
    return transform_values(obs, transform).withColumn("value", finite(F.col("value")))


def first_studies(studies: DataFrame, n: int | None = None, seed: int | None = None) -> DataFrame:
    """The first n studies by id, n at random with a seed, or all."""
    if n is None:
        return studies
    return studies.orderBy("study_id" if seed is None else F.md5(F.concat_ws("|", "study_id", F.lit(str(seed)))), "study_id").limit(n)
