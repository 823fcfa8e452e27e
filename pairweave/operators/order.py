"""Places in an order of all rows, and medians and running totals of groups of any size, by range partitions and their offsets.

Rows are sorted by range partitioning, so that no task sees more than its share; a row's place is its
place in the partition plus the rows of the partitions before. Equal keys are dealt over partitions by a
hash of the whole row, so that one frequent value is no hot partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairweave.plans.scratch import materialized

#: monotonically_increasing_id holds the row's number within its partition in these bits.
_IN_PARTITION = (1 << 33) - 1


def numbered(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """``df`` with ``name``: 1, 2, ... in ``order``; rows that it leaves equal follow a hash of all columns.

    Columns must not have maps. The result is a written table: range bounds are sampled, so that a
    second computation could number equal rows in another way.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    tie = F.xxhash64(*df.columns)
    dealt = df.repartitionByRange(*keys, tie).sortWithinPartitions(*keys, tie)
    held = materialized(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION))}))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    starts = held.groupBy("_part").agg(F.count(F.lit(1)).alias("k")).select("_part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("_start"))
    return held.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at") + 1).drop("_part", "_at", "_start")


def totals_before(df: DataFrame, by: list[str], order: str, amount: str | list[str], name: str | list[str], total: str | list[str]) -> DataFrame:
    """``df`` with ``name``: the sum of ``amount`` over the group's rows of smaller ``order``, and ``total``: that over the whole group.

    A group's values of ``order`` must be distinct. Sums run within range partitions; those of the partitions
    before, a row per group and partition, are added. Of several amounts, the three are lists.
    """
    amounts, names, totals = ([c] if isinstance(c, str) else c for c in (amount, name, total))
    sums, offsets = ([f"_{c}_{k}" for k in range(len(amounts))] for c in ("sum", "start"))
    held = materialized(df.repartitionByRange(*by, order).withColumn("_part", F.spark_partition_id()))
    group, keys = Window.partitionBy(*by), [*by, "_part"]
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = held.groupBy(*keys).agg(*(F.sum(a).alias(s) for a, s in zip(amounts, sums, strict=True)))
    starts = starts.select(*keys, *(before(group.orderBy("_part"), s).alias(o) for s, o in zip(sums, offsets, strict=True)), *(F.sum(s).over(group).alias(t) for s, t in zip(sums, totals, strict=True)))
    within = held.withColumns({n: before(Window.partitionBy(*keys).orderBy(order), a) for n, a in zip(names, amounts, strict=True)})
    return within.join(starts, keys).withColumns({n: F.col(n) + F.col(o) for n, o in zip(names, offsets, strict=True)}).drop("_part", *offsets)


def exact_medians(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """The median of ``value`` in each group, the mean of the middle two if their number is even; nulls don't count.

    All groups are sorted at once and number their rows through; a group is then a range of places,
    and its middle ones are picked. A group may hold most of the rows. Groups with nulls only have no row.
    """
    rows = numbered(df.filter(F.col(value).isNotNull()).select(*by, value), *by, value, name="_place")
    groups = rows.groupBy(*by).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    low = F.col("_first") + F.floor((F.col("_n") - 1) / 2)
    middle = groups.select(F.explode(F.array_distinct(F.array(low, F.col("_first") + F.floor(F.col("_n") / 2)))).alias("_place"))
    return rows.join(middle, "_place").groupBy(*by).agg(F.avg(value).alias(name))
