"""Studies that arrive over time: correlations of new studies as files land.

The engine's steps are batches; this applies the same plan to each micro-batch of a stream of
observation files in which every study arrives whole, and skips what is there already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pairweave.plans.steps import correlate_missing
from pairweave.schemas import OBSERVATIONS


def follow_studies(spark: SparkSession, inbox: str, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Correlate the studies of every Parquet file that lands in ``inbox`` until none is left."""

    def one(batch: DataFrame, _: int) -> None:
        correlate_missing(batch, out, **options)

    arrivals = spark.readStream.schema(OBSERVATIONS).parquet(inbox)
    return arrivals.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
