"""Mix sources to target weights by weighted fair queueing.

Documents of a source are shuffled (by a hash of the identifier) and each copy of a document gets
a virtual finish time: the source's tokens up to its end, over the source's target. The copies of
all sources are put in the order of their finish times and the order is cut where the total budget
is used up. A second and third copy follow when a source's target exceeds its size. ``mix`` says how
often each document is taken and when its first copy finishes; ``mixed_documents`` writes the copies
in the global order, range-sorted by finish time.

Targets: the total of all sizes is shared by weight (1, 2, 3 repeating over the sources in code
point order, null last); no target exceeds ``epochs`` times its source's size, and what is above
is shared again by weight among the others.

Scale: within a source, documents fall into 4096 buckets by the shuffle key, so that a source
with a third of all rows is dealt as evenly as the rest. Running sums are taken in two levels: one
task per source adds up its buckets' sums, one per bucket its documents' sizes (three narrow columns,
sorted with spilling). To find the cut, copies are counted in 4096 ranges of finish times, in each of
which the tokens are about the same by construction; the range that holds the cut is divided again
until few copies are left, and only these are sorted. Windows over all sources have one row per
source. Joined to the documents are tables of sources and buckets, which don't grow with the rows;
the driver receives one row per range, and the last copy taken.

Cases: null text has size 0; null source is a source of its own; texts of size 0 are taken 0 words;
very long texts are one document; a document taken twice has its words counted twice; ties of finish
times are broken by source, shuffle key, identifier and copy; repeated rows are separate documents;
an identifier must be an integer or null, as text that is no number fails in the cut;
an empty table gives an empty result; columns of the input with the names added here are replaced by
``mix`` and kept by ``mixed_documents``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from pairweave.llm.common import WORD, materialize, set_aside, table

SEED = "7"
_ADDED = ("size", "source_size", "target", "copies", "taken", "finish")
_WITHIN = ("_absent", "_source", "_key", "_bucket", "_upto", "_offset", "_place")
#: Digits of the shuffle key that make a bucket; ranges of finish times in which copies are counted.
DIGITS, RANGES = 3, 4096
_KEY = ["_absent", "_source"]


def word_count(text: str = "text") -> Column:
    trimmed = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WORD, "x")
    return F.char_length(F.regexp_replace(trimmed, r"[\x20\x09-\x0D]+", "")).cast("long")


def _keyed(docs: DataFrame, size: Column, digits: int) -> DataFrame:
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{SEED}")))
    docs = docs.drop(*_ADDED[1:]).withColumn("size", size)
    docs = docs.withColumn("_absent", F.col("source").isNull()).withColumn("_source", F.coalesce("source", F.lit("")))
    return docs.withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, digits))


def share_targets(sizes: DataFrame, epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row per source with its size to the same with its target (sizes: _absent, _source, source_size)."""
    order = Window.orderBy(*_KEY)
    cycle = F.array(*map(F.lit, weights))
    weighed = sizes.withColumn("_w", F.get(cycle, (F.row_number().over(order) - 1) % len(weights)).cast("long"))
    weighed = weighed.withColumn("_cap", epochs * F.col("source_size"))
    level = Window.orderBy(F.col("_cap") / F.col("_w"), *_KEY)
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    rest = level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = weighed.withColumn("_left", F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
    filled = filled.withColumn("_rate", F.col("_left").cast("double") / F.sum("_w").over(rest).cast("double"))
    # the first source, by level, whose share is within its cap sets the rate for all after it
    fits = F.when(F.col("_rate") * F.col("_w") <= F.col("_cap"), F.col("_rate"))
    rate = F.first(fits, ignorenulls=True).over(level.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    target = F.coalesce(F.least(F.col("_cap").cast("double"), rate * F.col("_w")), F.col("_cap").cast("double"))
    return filled.select(*_KEY, "source_size", target.alias("target"))


def _timed(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    """With _upto, the source's tokens up to a document's end, and the columns of ``offsets``."""
    upto = Window.partitionBy(*_KEY, "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = rows.withColumn("_upto", F.sum("size").over(upto)).join(offsets.hint("merge"), [*_KEY, "_bucket"])  # both sides are dealt by these keys
    return held.withColumn("_upto", F.col("_upto") + F.col("_offset"))


def _finish(epoch: int) -> Column:
    end = (F.lit(epoch) * F.col("source_size") + F.col("_upto")).cast("double")
    return F.when(F.col("target") > 0, F.try_divide(end, F.col("target"))).otherwise(0.0)


def _place(epoch: int) -> Column:
    return F.struct(_finish(epoch).alias("f"), *(F.col(c).alias(c) for c in (*_KEY, "_key", "doc_id")), F.lit(epoch).alias("epoch"))


def _cut(placed: DataFrame, budget: int, few: int) -> Row | None:
    """The first copy (its place) with which the sizes in order exceed ``budget``; None if there is none.

    placed: f, p (the place) and size. Sums per range narrow down where it is.
    """
    low, high, before = 0.0, 4.0, 0
    while True:
        width = (high - low) / RANGES
        here = placed.filter((F.col("f") >= low) & (F.col("f") < high)).withColumn("_range", F.least(F.lit(RANGES - 1), F.floor((F.col("f") - low) / width)))
        total = before
        for r in sorted(here.groupBy("_range").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()):  # at most RANGES rows
            if total + r["size"] > budget:
                break
            total += r["size"]
        else:
            return None
        inside = here.filter(F.col("_range") == r["_range"])
        before, start = total, low + r["_range"] * width
        if r["n"] <= few or not low < start + width < high:
            order = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            over = inside.withColumn("_upto", F.lit(before) + F.sum("size").over(order)).filter(F.col("_upto") > budget)
            return over.agg(F.min("p").alias("p")).first()["p"]
        ends = inside.agg(F.min("f").alias("lo"), F.max("f").alias("hi")).first()  # the copies' own limits: no rounding loses one
        low, high = ends["lo"], float(np.nextafter(ends["hi"], np.inf))


def _mixed(docs: DataFrame, epochs: int, digits: int, size: Column | None, few: int) -> tuple[DataFrame, list[Column]]:
    """``docs`` with sizes, keys and times; and for each copy of a document whether it is taken."""
    size = word_count() if size is None else size
    narrow = materialize(docs.select("doc_id", "source", size.alias("size")))
    keyed = _keyed(narrow, F.col("size"), digits)
    sums = materialize(keyed.groupBy(*_KEY, "_bucket").agg(F.sum("size").alias("_sum")))
    targets = share_targets(sums.groupBy(*_KEY).agg(F.sum("_sum").alias("source_size")), epochs)
    earlier = Window.partitionBy(*_KEY).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum").join(targets, _KEY))
    copies = F.explode(F.array(*map(_place, range(epochs)))).alias("p")
    placed = materialize(_timed(keyed, offsets).filter(F.col("size") > 0).select(copies, "size").select(F.col("p.f").alias("f"), "p", "size").filter("f <= 2"))
    budget = sums.agg(F.coalesce(F.sum("_sum"), F.lit(0))).first()[0]
    last = _cut(placed, budget, few)
    wide = _keyed(docs, size, digits) if set(docs.columns) - {"doc_id", "source", "text", "size"} or "text" in docs.columns else keyed
    if last is None:  # every copy up to the time of the last range fits the budget
        taken = [_finish(e) <= 2 for e in range(epochs)]
    else:
        end = F.struct(*(F.lit(last[c]).cast(t).alias(c) for c, t in (("f", "double"), ("_absent", "boolean"), ("_source", "string"), ("_key", "string"), ("doc_id", "long"), ("epoch", "int"))))
        taken = [_place(e) < end for e in range(epochs)]
    return _timed(wide, offsets), [(F.col("size") > 0) & t for t in taken]


def mix(docs: DataFrame, epochs: int = 3, digits: int = DIGITS, size: Column | None = None, few: int = 100_000) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with size, source_size, target, copies, taken, and finish of the first copy.

    ``size``: the tokens of a document, words if not given. All columns are kept.
    """
    own = [c for c in docs.columns if c not in _ADDED]
    docs, back = set_aside(docs, _WITHIN)
    rows, taken = _mixed(docs, epochs, digits, size, few)
    rows = rows.withColumn("copies", sum(t.cast("int") for t in taken)).withColumn("taken", F.col("size") * F.col("copies")).withColumn("finish", _finish(0))
    return rows.select(*(b for c, b in zip(docs.columns, back, strict=True) if c not in _ADDED), *_ADDED).toDF(*own, *_ADDED)


def mixed_documents(docs: DataFrame, epochs: int = 3, few: int = 100_000) -> DataFrame:
    """The mix itself: each document as often as it is taken, in the global order of finish times."""
    docs, own = set_aside(docs, (*_ADDED, *_WITHIN))
    rows, taken = _mixed(docs, epochs, DIGITS, None, few)
    copies = F.array_compact(F.array(*(F.when(t, _place(e)) for e, t in enumerate(taken))))
    placed = rows.withColumn("_place", F.explode(copies)).select(*docs.columns, "_place")
    order = ["_place.f", *(f"_place.{c}" for c in (*_KEY, "_key", "doc_id", "epoch"))]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).select(*own)


def op3_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("size"))
    return mix(docs, size=F.col("size")).select("doc_id", "size", "source_size", "target", "taken", "finish")


OP3_SQL = rf"""
WITH d AS (
  SELECT doc_id, source IS NULL AS absent, coalesce(source, '') AS src,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':{SEED}') AS key
  FROM documents),
s AS (SELECT absent, src, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY absent, src) - 1) % 3 AS w, 3 * source_size AS cap FROM s),
r AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, absent, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(w) OVER (ORDER BY cap / w, absent, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS rate
  FROM w),
t AS (
  SELECT absent, src, source_size,
         coalesce(least(cap::DOUBLE, w * first(CASE WHEN rate * w <= cap THEN rate END IGNORE NULLS)
           OVER (ORDER BY cap / w, absent, src ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), cap::DOUBLE) AS target
  FROM r),
p AS (
  SELECT d.*, source_size, target,
         sum(size) OVER (PARTITION BY d.absent, d.src ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.absent = t.absent AND d.src = t.src),
c AS (
  SELECT p.*, e, (e * source_size + upto)::DOUBLE / target AS f FROM p, range(3) x(e) WHERE size > 0),
o AS (
  SELECT *, sum(size) OVER (ORDER BY f, absent, src, key, doc_id, e ROWS UNBOUNDED PRECEDING) AS total,
         (SELECT sum(size) FROM d) AS budget
  FROM c),
k AS (SELECT doc_id, absent, src, size, count(*) AS copies FROM o WHERE total <= budget GROUP BY ALL)
SELECT p.doc_id, p.size, p.source_size::BIGINT AS source_size, p.target, (p.size * coalesce(k.copies, 0))::BIGINT AS taken,
       CASE WHEN target > 0 THEN upto::DOUBLE / target ELSE 0 END AS finish
FROM p LEFT JOIN k ON p.doc_id = k.doc_id AND p.absent = k.absent AND p.src = k.src AND p.size = k.size
"""
