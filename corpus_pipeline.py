"""A corpus pipeline of five stages, each one operator of ``pairweave.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairweave.llm.common import bounded_batches, set_aside, settle, table
from pairweave.llm.compaction import shard_corpus, sharded_rows
from pairweave.llm.decontam import remove_contaminated
from pairweave.llm.langid import held_out, identify, train
from pairweave.llm.mixing import mixed_documents
from pairweave.llm.neardup import drop_near_duplicates

#: Texts whose words' languages are less sure than this on average are rejected.
LEAST_LANGUAGE_SCORE = 0.35


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a language that can be told, or in several; texts without letters, or with words that could be in any, go."""
    bounded_batches(spark)
    model = train(docs.filter(~held_out()))
    docs, own = set_aside(docs, ("lang_pred", "score", "confidence"))
    found = identify(docs, model, with_confidence=True)
    return found.filter((F.col("lang_pred") != "und") & (F.col("confidence") >= LEAST_LANGUAGE_SCORE)).select(*own)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text, with the smallest identifier, of each group of near-duplicates (5 words, 0.8); one row per identifier."""
    bounded_batches(spark)
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in which no benchmark window occurs."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text as often as the mix takes it, in the mix's order."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, shard, n_bytes and text_sha256 of every row of the committed shards."""
    return sharded_rows(shard_corpus(docs))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; tables that a stage has written on the way go once its output is written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return docs


#: SQL can't express the language model; ``tests/llm`` holds a brute-force version of each stage.
ORACLE_SQL = None
