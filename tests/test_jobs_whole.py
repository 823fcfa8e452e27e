"""What the term network moves."""

from test_jobs import KIND

from jobs import term_network
from jobs.common import settings


def test_terms_are_counted_without_a_shuffle(spark):
    docs = spark.createDataFrame([(1, "b a b c a b", "s", 0, ""), (1, "b", "s", 0, ""), (2, "1 2", "t", 0, ""), (3, None, "t", 0, "")], KIND).repartition(2)
    counted = term_network.term_counts(docs.localCheckpoint(), settings("term_network"))
    assert "Exchange" not in counted._jdf.queryExecution().toString()
    assert sorted((r["feature"], r["k"], r["words"]) for r in counted.collect()) == [("a", 2, 6), ("b", 1, 1), ("b", 3, 6), ("c", 1, 6)]
    found = term_network.document_counts(docs, settings("term_network")).collect()
    assert sorted((r["feature"], r["documents"]) for r in found) == [("a", 1), ("b", 2), ("c", 1)]
