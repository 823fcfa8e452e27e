"""The first stage keeps texts that mix languages, and still rejects those that are in none."""

import corpus_pipeline
from pyspark.sql import functions as F

PARTS = {
    "en": "the house and the garden with water",
    "ru": "дом и сад с водой",
    "el": "το σπίτι και ο κήπος με νερό",
    "ar": "البيت و الحديقة مع الماء",
}


def test_mixtures_stay(spark):
    learn = [(i, text, lang) for k, (lang, text) in enumerate(PARTS.items()) for i in range(100 * k, 100 * k + 30)]
    mixed = [
        (1001, " ".join(10 * (PARTS["en"] + " ").split()[:30] + 6 * PARTS["ru"].split()), None),  # two languages
        (1002, " ".join(" ".join([PARTS[lang]] * n) for lang, n in (("en", 4), ("ru", 8), ("el", 5))), None),  # three of about equal length
        (1003, " ".join(" ".join([PARTS[lang]] * n) for lang, n in (("en", 4), ("ru", 8), ("el", 5), ("ar", 6))), None),  # four
        (1004, "12 34 ... 56", None),
        (1005, None, None),
    ]
    docs = spark.createDataFrame(learn + mixed, "doc_id long, text string, lang string").withColumn("confidence", F.lit("x"))
    kept = corpus_pipeline.language_id(spark, docs, "")
    assert kept.columns == docs.columns and kept.filter("confidence != 'x'").count() == 0
    assert {r["doc_id"] for r in kept.filter("doc_id > 1000").collect()} == {1001, 1002, 1003}
    assert kept.filter("doc_id < 1000").count() == len(learn)
