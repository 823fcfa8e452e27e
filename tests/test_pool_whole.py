"""Refreshes of a state compute their correlations once."""

from pyspark.sql import functions as F

from pairweave.operators import pooling
from pairweave.sources.writers import refresh_pool_state


def test_refresh_computes_correlations_once(spark, tmp_path):
    frame = lambda studies: spark.createDataFrame([(f"f{a}", "g", s, 0.1 * a, 12.0) for s in studies for a in range(5)], "feature_1 string, feature_2 string, study_id string, corr double, n double")
    path, computed = f"file://{tmp_path}/state", spark.sparkContext.accumulator(0)
    refresh_pool_state(frame("ab"), path, 4)

    def counted(s):
        computed.add(1)
        return s

    refresh_pool_state(frame("bc").withColumn("study_id", F.udf(counted)("study_id")), path, 4)
    assert computed.value == 10
    got, want = (sorted(map(tuple, x.collect())) for x in (pooling.pool_from_state(spark.read.parquet(path)), pooling.pool(frame("abc"))))
    assert got == want
