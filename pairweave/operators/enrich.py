"""Over-represented sets in clusters, set abundance, and ranked enrichment.

sets: set_id, set_name, members (array). xref: feature, member_id (NULL where unknown).
clusters: node_id, cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairweave.functions.special import adjust_p
from pairweave.operators.order import numbered
from pairweave.plans.scratch import materialized


def set_members(sets: DataFrame, prefix: str | None = "C") -> DataFrame:
    """set_id, set_name, member_id, each once; only members with the prefix."""
    members = sets.select("set_id", "set_name", F.explode("members").alias("member_id")).filter(F.col("member_id").isNotNull())
    return (members if prefix is None else members.filter(F.col("member_id").startswith(prefix))).distinct()


def cluster_members(xref: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, node_id, member_id of the clustered nodes that have one."""
    return clusters.join(xref.select(F.col("feature").alias("node_id"), "member_id"), "node_id").filter(F.col("member_id").isNotNull())


_LOG_FACTORIALS = [np.zeros(1)]


def log_factorials(n: int) -> np.ndarray:
    """ln 0!, ln 1!, ... at least up to ln n!; kept in each Python worker."""
    if n >= len(_LOG_FACTORIALS[0]):
        _LOG_FACTORIALS[0] = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 2 * n + 1, dtype=float)))))
    return _LOG_FACTORIALS[0]


def hypergeometric_tail(k: Column, big_k: Column, n: Column, total: Column) -> Column:
    """P(X >= k) of k hits among n draws, with big_k marked of ``total``."""

    @F.pandas_udf("double")
    def tail(k: pd.Series, big_k: pd.Series, n: pd.Series, total: pd.Series) -> pd.Series:
        lf = log_factorials(int(total.max()) if len(total) else 0)
        choose = lambda a, b: lf[a] - lf[b] - lf[a - b]
        out = np.ones(len(k))
        for row, (x, marked, drawn, whole) in enumerate(zip(k.tolist(), big_k.tolist(), n.tolist(), total.tolist(), strict=True)):
            if x > 0:
                i = np.arange(max(x, drawn - (whole - marked)), min(marked, drawn) + 1)
                out[row] = min(1.0, float(np.exp(choose(marked, i) + choose(whole - marked, drawn - i) - choose(whole, drawn)).sum()))
        return pd.Series(out)

    return tail(*(c.cast("long") for c in (k, big_k, n, total)))


def outside_background(hits: DataFrame, background: DataFrame) -> DataFrame:
    """cluster, member_id of the hits that a test against ``background`` (member_id) leaves out."""
    known = background.select("member_id").filter(F.col("member_id").isNotNull())
    return hits.select("cluster", "member_id").distinct().join(known, "member_id", "left_anti").select("cluster", "member_id")


def over_representation(hits: DataFrame, sets: DataFrame, background: DataFrame | None = None, min_set_size: int = 2, prefix: str | None = None, fdr_method: str = "fdr_bh") -> DataFrame:
    """Test every set in every cluster (hits: cluster, member_id) against a background (member_id).

    All sets with at least ``min_set_size`` members in the background are tested in each cluster
    that has a hit there, also with no overlap (p = 1), and adjusted within the cluster. Without a
    background it is all members of all sets. Hits outside it don't count (see ``outside_background``).
    """
    members = set_members(sets, prefix)
    background = (members if background is None else background).select("member_id").filter(F.col("member_id").isNotNull()).distinct()
    inside = members.join(background, "member_id", "left_semi")
    tested = inside.groupBy("set_id", "set_name").agg(F.count(F.lit(1)).alias("n_set")).filter(F.col("n_set") >= min_set_size)
    drawn = hits.select("cluster", "member_id").distinct().join(background, "member_id", "left_semi")
    sizes = drawn.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_drawn"))
    overlap = drawn.join(inside, "member_id").groupBy("cluster", "set_id").agg(F.count(F.lit(1)).alias("n_hits"), F.array_sort(F.collect_set("member_id")).alias("hit_ids"))
    total = background.agg(F.count(F.lit(1)).alias("n_background"))
    grid = sizes.crossJoin(F.broadcast(total)).crossJoin(tested)  # one row; and every cluster is tested against every set
    full = grid.join(overlap, ["cluster", "set_id"], "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0).cast("long")))
    full = full.withColumn("pval", hypergeometric_tail(F.col("n_hits"), F.col("n_set"), F.col("n_drawn"), F.col("n_background")))
    full = full.withColumn("hit_ids", F.coalesce("hit_ids", F.array().cast("array<string>")))
    adjusted = adjust_p(full, "pval", "padj", ["cluster"], ["set_id"], fdr_method)
    return adjusted.select("cluster", "set_id", "set_name", "n_hits", "n_set", "n_background", "pval", "hit_ids", "padj")


def enrich_clusters(xref: DataFrame, clusters: DataFrame, sets: DataFrame, threshold: float = 0.05, background: DataFrame | None = None) -> DataFrame:
    """Significant sets of every cluster; the background is all known members of the graph unless given."""
    found = cluster_members(xref, clusters)
    tests = over_representation(found, sets, found if background is None else background)
    return tests.filter(F.col("padj") < threshold)


def top_sets(results: DataFrame, n: int | None = None) -> DataFrame:
    """set_id, set_name, best_padj over clusters, best first."""
    best = results.groupBy("set_id").agg(F.min("padj").alias("best_padj"), F.min_by("set_name", "cluster").alias("set_name")).orderBy("best_padj", "set_id")
    return best if n is None else best.limit(n)


def set_abundance(xref: DataFrame, clusters: DataFrame, sets: DataFrame, prefix: str | None = "C") -> DataFrame:
    """For every cluster and set: which share of the cluster's known nodes are members; 0 without any."""
    found = cluster_members(xref, clusters)
    known = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("known"))
    mapped = found.join(set_members(sets, prefix).select("set_id", "member_id"), "member_id").groupBy("cluster", "set_id").agg(F.count(F.lit(1)).alias("mapped"))
    grid = clusters.select("cluster").distinct().crossJoin(sets.select("set_id").distinct())
    full = grid.join(known, "cluster", "left").join(mapped, ["cluster", "set_id"], "left")
    share = F.coalesce(F.try_divide(F.coalesce("mapped", F.lit(0)).cast("double"), F.col("known").cast("double")), F.lit(0.0))
    return full.select("cluster", "set_id", share.alias("abundance"))


def set_significance(results: DataFrame, clusters: DataFrame, sets: DataFrame, threshold: float = 0.05) -> DataFrame:
    """For every cluster and set: whether it is significant there."""
    grid = clusters.select("cluster").distinct().crossJoin(sets.select("set_id").distinct())
    found = results.filter(F.col("padj") < threshold).select("cluster", "set_id", F.lit(True).alias("s"))
    return grid.join(found, ["cluster", "set_id"], "left").select("cluster", "set_id", F.coalesce("s", F.lit(False)).alias("significant"))


def flat_results(results: DataFrame) -> DataFrame:
    """For files without arrays: hit_ids joined by semicolons."""
    return results.withColumn("hit_ids", F.concat_ws(";", "hit_ids"))


def ranking(scores: DataFrame) -> DataFrame:
    """member_id, score with duplicates averaged and nulls dropped: one row per member."""
    return scores.filter(F.col("score").isNotNull()).groupBy("member_id").agg(F.avg("score").alias("score"))


def enrichment_scores(scores: DataFrame, sets: DataFrame, min_size: int = 2, max_size: int = 500, prefix: str | None = "C") -> DataFrame:
    """set_id, set_name, size, es, lead: the extreme of the running sum over the ranking, up by |score| at members,
    down elsewhere; and the members up to it (from it on, if it is negative) by rank.

    Only the ranks of members matter: between two members the sum falls linearly, so its extremes
    are at a member or just before one. Each set is a window over its own members; ranks come from range
    partitions (``order.numbered``).
    """
    return _set_scores(ranks(scores), sets, min_size, max_size, prefix)


def ranks(scores: DataFrame) -> DataFrame:
    """member_id, score, rank from 1 by falling score, ties by id; a written table."""
    return numbered(ranking(scores), F.desc("score"), "member_id")


def _set_scores(ranked: DataFrame, sets: DataFrame, min_size: int = 2, max_size: int = 500, prefix: str | None = "C") -> DataFrame:
    ranked = ranked.withColumn("total", F.lit(ranked.count()))
    own = ranked.join(set_members(sets, prefix), "member_id")
    group = Window.partitionBy("set_id")
    upto = group.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = own.withColumn("size", F.count(F.lit(1)).over(group)).filter((F.col("size") >= min_size) & (F.col("size") <= max_size) & (F.col("size") < F.col("total")))
    own = own.withColumn("hit", F.try_divide(F.sum(F.abs("score")).over(upto), F.sum(F.abs("score")).over(group)))
    own = own.withColumn("step", F.try_divide(F.abs("score"), F.sum(F.abs("score")).over(group)))
    own = own.withColumn("miss", (F.col("rank") - F.row_number().over(group.orderBy("rank"))) / (F.col("total") - F.col("size")))
    own = own.withColumn("up", F.col("hit") - F.col("miss")).withColumn("down", F.col("hit") - F.col("step") - F.col("miss"))
    found = own.groupBy("set_id", "set_name", "size").agg(
        F.max(F.struct("up", (-F.col("rank")).alias("rank"))).alias("h"), F.min(F.struct("down", "rank")).alias("l"), F.array_sort(F.collect_list(F.struct("rank", "member_id"))).alias("members")
    )  # a set has at most max_size members
    below = F.abs("l.down") > F.abs("h.up")
    lead = F.filter("members", lambda m: F.when(below, m.rank >= F.col("l.rank")).otherwise(m.rank <= -F.col("h.rank")))
    return found.select("set_id", "set_name", "size", F.when(below, F.col("l.down")).otherwise(F.col("h.up")).alias("es"), F.transform(lead, lambda m: m.member_id).alias("lead"))


def _null_scores(ranked: DataFrame, sizes: DataFrame, permutations: int, seed: int) -> DataFrame:
    """size, sets, null: ``permutations`` enrichment scores of random sets for each row (size, sets) of ``sizes``.

    A task draws the places of a size's random sets; the scores there come by a join with the ranking,
    and each set's running sum is folded over its few places in order. The ranking stays where it is.
    """
    n = ranked.count()
    kind = pa.schema([("size", pa.int64()), ("draw", pa.int32()), ("rank", pa.int64())])

    def draw(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for size in part.column("size").to_pylist():
                rng = np.random.default_rng([seed, size])
                for number in range(permutations):
                    at = rng.choice(n, size, replace=False) + 1
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(size, size)), pa.array(np.full(size, number, np.int32)), pa.array(at)], schema=kind)

    places = sizes.select("size").mapInArrow(draw, "size long, draw int, rank long")
    drawn = places.join(ranked.select("rank", F.abs("score").alias("w")), "rank").groupBy("size", "draw").agg(F.array_sort(F.collect_list(F.struct("rank", "w"))).alias("s"))  # size entries
    total = F.greatest(F.aggregate("s", F.lit(0.0), lambda a, x: a + x.w), F.lit(1e-300))
    drawn = drawn.withColumn("s", F.transform("s", lambda x, i: F.struct((x.w / total).alias("step"), ((x["rank"] - 1 - i) / (F.lit(n) - F.col("size"))).alias("miss"))))
    start = F.struct(F.lit(0.0).alias("hit"), F.lit(float("-inf")).alias("up"), F.lit(float("inf")).alias("down"))

    def step(a: Column, x: Column) -> Column:
        hit = a.hit + x.step
        return F.struct(hit.alias("hit"), F.greatest(a.up, hit - x.miss).alias("up"), F.least(a.down, a.hit - x.miss).alias("down"))

    drawn = drawn.withColumn("e", F.aggregate("s", start, step))
    es = F.when(F.abs("e.down") > F.abs("e.up"), F.col("e.down")).otherwise(F.col("e.up"))
    nulls = drawn.groupBy("size").agg(F.transform(F.array_sort(F.collect_list(F.struct("draw", es.alias("es")))), lambda x: x.es).alias("null"))
    return sizes.join(nulls, "size")


def ranked_enrichment(scores: DataFrame, sets: DataFrame, permutations: int = 1000, seed: int = 0, **limits) -> DataFrame:
    """set_id, set_name, size, es, nes, p, q, lead: against random sets of the same size, by sign.

    nes is es over the mean of its size's null scores of the same sign; p the share of these beyond
    es; q (the false discovery rate) the share of all sets' null scores of that sign, normalised too,
    that are beyond nes, over the share of the sets' own ones.

    Null distributions depend on the size alone. The ranking may have any length: its scores at random
    places are joined in, at most max_size x permutations of them for each distinct size. The null scores
    of all sizes (at most max_size times ``permutations``) are put together on the driver.
    """
    ranked = ranks(scores)
    found = materialized(_set_scores(ranked, sets, **limits))
    sizes = found.groupBy("size").agg(F.count(F.lit(1)).alias("sets"))
    nulls = materialized(_null_scores(ranked, materialized(sizes), permutations, seed))
    same = F.filter("null", lambda x: F.when(F.col("es") >= 0, x >= 0).otherwise(x < 0))
    mean = F.try_divide(F.aggregate(same, F.lit(0.0), lambda a, x: a + x), F.size(same))
    beyond = F.size(F.filter(same, lambda x: F.abs(x) >= F.abs("es")))
    scored = found.join(nulls.drop("sets"), "size").withColumn("nes", F.try_divide("es", F.abs(mean))).withColumn("p", F.try_divide(beyond, F.size(same))).drop("null")
    pooled = _null_shares(nulls.toPandas())

    @F.pandas_udf("double")
    def null_share(nes: pd.Series) -> pd.Series:
        return pd.Series(_share_beyond(pooled, nes.to_numpy(float)))

    up = F.col("nes") >= 0
    side = Window.partitionBy(up)  # one row per set
    own = F.count("nes").over(side.orderBy(F.abs("nes").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)) / F.count("nes").over(side)
    q = F.least(F.lit(1.0), F.try_divide(F.nanvl(null_share("nes"), F.lit(None).cast("double")), own))
    return scored.withColumn("q", F.when(F.col("nes").isNotNull(), q)).select("set_id", "set_name", "size", "es", "nes", "p", "q", "lead")


def _null_shares(nulls: pd.DataFrame) -> dict[bool, tuple[np.ndarray, np.ndarray]]:
    """By sign (True: not negative): the normalised null scores' sizes in ascending order, and the weight from each on."""
    out = {}
    for up in (True, False):
        sizes, weights = [], []
        for sets, null in zip(nulls["sets"], nulls["null"], strict=True):
            null = np.asarray(null)
            own = np.abs(null[(null >= 0) == up])
            if len(own) and own.mean() > 0:
                sizes.append(own / own.mean())
                weights.append(np.full(len(own), float(sets)))
        flat, weight = (np.concatenate(x) if x else np.zeros(0) for x in (sizes, weights))
        order = np.argsort(flat)
        out[up] = (flat[order], np.cumsum(weight[order][::-1])[::-1])
    return out


def _share_beyond(pooled: dict[bool, tuple[np.ndarray, np.ndarray]], nes: np.ndarray) -> np.ndarray:
    out = np.full(len(nes), np.nan)
    for up, (flat, weight) in pooled.items():
        own = (nes >= 0) == up if up else nes < 0
        if len(flat):
            at = np.searchsorted(flat, np.abs(nes[own]) - 1e-12)
            out[own] = np.append(weight, 0.0)[at] / weight[0]
    return out
