"""Hard negatives of anchors: rows of another label whose score lies in a band below a positive's.

A score is the integer inner product of two quantised vectors; for each anchor all rows are sorted by
falling score and, among equals, by identifier. Its positives are the first rows of its label. For each
positive, binary search finds the place of the band's upper limit in that order, and from there rows of
other labels are read until there are enough or the lower limit is passed.

Scale: rows against anchors is n times m scores, whatever the plan. Both are dealt by hash into blocks,
and each pair of blocks is one group of bounded size: it holds one sorted run of every anchor of its
block, does the search there, and gives at most the wanted number of rows for each positive. The first
rows of the runs are merged by a window per anchor (positives) and per anchor and positive (negatives)
that limits groups before the shuffle. Positives need only scores within a label. Nothing is broadcast
or collected but two counts, from which the number of blocks follows; identifiers are unique by then, so
no block is hot, whatever label or vector is frequent.

Cases: rows with a null identifier, label or vector, or with a null or non-finite component, take no
part; of rows that share an identifier, the one with the smallest (label, vector) counts; equal vectors
tie and follow their identifiers; a shorter vector has zeros in the components that it lacks, an empty
one scores 0; an anchor without positives has no rows; a negative positive score has an empty band; a
table without rows or anchors gives an empty result; columns other than the three named are not used.
A component of 2**63 or more when quantised, and a score beyond 64 bits, are errors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairweave.llm.common import materialize, table

#: Rows in a block: a 64th of the table, within these bounds; anchors in a block; scores held at a time.
BLOCK_ROWS, BLOCKS, BLOCK_ANCHORS, SCORES = (512, 32_768), 64, 1024, 1 << 21


def quantized(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as a long; null where a component is null or not finite."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    large = F.exists(wide, lambda x: F.abs(x) >= 2.0**63 / scale)
    return F.when(finite, F.when(large, F.raise_error(F.lit("a component has no 64-bit value")).cast("array<bigint>")).otherwise(F.transform(wide, lambda x: F.floor(x * scale))))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as rows of longs, shorter ones filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a with those of b."""
    most = [int(np.abs(x).max(initial=0)) for x in (a, b)]
    bound = most[0] * most[1] * a.shape[1]
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if bound < 1 << 62:
        return a @ b.T
    return (a.astype(object) @ b.T.astype(object)).astype(np.int64)  # Python's integers; an OverflowError beyond 64 bits


class _Cell:
    """One block of rows and one of anchors."""

    def __init__(self, group: pa.Table) -> None:
        is_anchor = np.asarray(group.column("anchor").to_numpy())
        labels = group.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        vectors = group.column("vector").combine_chunks()
        width = int(np.diff(vectors.offsets.to_numpy()).max(initial=0))
        every, ids = _matrix(vectors, width), group.column("id").to_numpy()
        self.ids, self.labels, self.rows = ids[~is_anchor], labels[~is_anchor], every[~is_anchor]
        self.anchor_ids, self.anchor_labels, self.anchors = ids[is_anchor], labels[is_anchor], every[is_anchor]
        self.places = np.flatnonzero(is_anchor)

    def runs(self, anchors: np.ndarray, rows: np.ndarray):
        """For each of these anchors: its place, and these rows' places and scores in its order."""
        ids = self.ids[rows]
        step = max(1, SCORES // max(1, len(rows)))
        for start in range(0, len(anchors), step):
            some = anchors[start : start + step]
            for k, scores in zip(some, _scores(self.anchors[some], self.rows[rows]), strict=True):
                order = np.lexsort((ids, -scores))
                yield k, rows[order], scores[order]


_POSITIVE = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])
_NEGATIVE = pa.schema([*_POSITIVE, ("negative_id", pa.int64()), ("negative_score", pa.int64())])
_DDL = {"anchor_id": "long", "positive_id": "long", "positive_score": "long", "negative_id": "long", "negative_score": "long"}


def _table(parts: list[tuple], schema: pa.Schema) -> pa.Table:
    """Parts hold, per column, numbers or arrays of one length, the last column an array."""
    sizes = [len(p[-1]) for p in parts]
    columns = [np.concatenate([np.zeros(0, np.int64), *(np.broadcast_to(p[c], n) for p, n in zip(parts, sizes, strict=True))]) for c in range(len(schema))]
    return pa.table([pa.array(c.astype(np.int64)) for c in columns], schema=schema)


def _first_positives(count: int):
    def run(group: pa.Table) -> pa.Table:
        cell, out = _Cell(group), []
        for label in np.unique(cell.anchor_labels):
            rows = np.flatnonzero(cell.labels == label)
            for k, order, scores in cell.runs(np.flatnonzero(cell.anchor_labels == label), rows):
                ids = cell.ids[order[: count + 1]]
                other = ids != cell.anchor_ids[k]
                out.append((cell.anchor_ids[k], ids[other][:count], scores[: count + 1][other][:count]))
        return _table(out, _POSITIVE)

    return run


def _first_negatives(count: int, low: int, high: int):
    def run(group: pa.Table) -> pa.Table:
        cell, out = _Cell(group), []
        positives = group.column("positives").combine_chunks()
        for k, order, scores in cell.runs(np.arange(len(cell.anchors)), np.arange(len(cell.rows))):
            different = cell.labels[order] != cell.anchor_labels[k]
            ids, falling = cell.ids[order[different]], -scores[different]
            for positive in positives[cell.places[k]].as_py() or ():
                most, least = high * positive["score"] // 100, -(-low * positive["score"] // 100)
                start = int(np.searchsorted(falling, -most))
                end = min(start + count, int(np.searchsorted(falling, -least, "right")))
                if start < end:
                    out.append((cell.anchor_ids[k], positive["id"], positive["score"], ids[start:end], -falling[start:end]))
        return _table(out, _NEGATIVE)

    return run


def _cells(rows: DataFrame, anchors: DataFrame, blocks: tuple[int, int], step, schema: pa.Schema) -> DataFrame:
    """``step`` on every pair of a block of rows and a block of anchors."""
    r, s = blocks
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = rows.withColumns({"anchor": F.lit(False), "r": own(r)}).withColumn("s", every(s))
    dealt = dealt.unionByName(anchors.withColumns({"anchor": F.lit(True), "s": own(s)}).withColumn("r", every(r)), allowMissingColumns=True)
    return dealt.repartition(min(r * s, 20_000), "r", "s").groupBy("r", "s").applyInArrow(step, ", ".join(f"{n} {_DDL[n]}" for n in schema.names))


def _first(found: DataFrame, by: list[str], name: str, count: int) -> DataFrame:
    """The first rows of each group by falling score and identifier, with their rank."""
    order = Window.partitionBy(*by).orderBy(F.desc(f"{name}_score"), f"{name}_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``rows`` has id (an integer), label (of any type with equality) and vector (array of long, see
    ``quantized``); ``anchor`` is a condition on id. The band is low * positive <= 100 * negative <=
    high * positive.
    """
    if dict(rows.dtypes)["id"] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("id must be an integer")
    whole = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), "vector").dropna()
    one = whole.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("x")).select("id", "x.label", "x.vector")
    base = materialize(one)
    n, m = base.agg(F.count(F.lit(1)), F.count_if(anchor)).first()
    block = min(max(n // BLOCKS, BLOCK_ROWS[0]), BLOCK_ROWS[1])
    blocks = max(1, -(-n // block)), max(1, -(-m // BLOCK_ANCHORS))
    anchors = base.filter(anchor)
    best = _first(_cells(base, anchors, blocks, _first_positives(positives), _POSITIVE), ["anchor_id"], "positive", positives)
    kept = materialize(best.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("positives")))
    found = _cells(base, anchors.join(kept, "id"), blocks, _first_negatives(negatives, low, high), _NEGATIVE)
    return _first(found, ["anchor_id", "positive_id"], "negative", negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    own = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), own.alias("label"), quantized(F.col("embedding")).alias("vector"))
    return hard_negatives(rows, F.col("id") % 100 == 0)


OP12_SQL = """
WITH whole AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM whole a, whole b WHERE a.id % 100 = 0 AND a.id <> b.id),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
banded AS (
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank,
    id AS negative_id, positive_score, score AS negative_score
  FROM positives JOIN scored USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT * FROM banded WHERE rank <= 10"""
