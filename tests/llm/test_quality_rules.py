import re
from collections import Counter

import pytest

from pairweave.llm.quality_rules import judge, op1_quality_rules, text_counts

SPACE = "[\x20\x09-\x0d]+"


def counts(text):
    text = text or ""
    words = [w for w in re.split(SPACE, text) if w]
    seen = Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k, g in enumerate(zip(words, words[1:], words[2:])) if seen[g] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \n\t ", "a", "a b", "a b c", "a b c a b c", "x x x x", "é É #$ |<>\n\n é É #$ |<>", "l\nl\n l\nl", "a b c d a b c e a b c", "    w", "q " * 5000, "one\x0btwo\x0cthree\rfour"]


@pytest.mark.parametrize("k", range(len(TEXTS)))
def test_counts(spark, k):
    row = text_counts(spark.createDataFrame([(1, TEXTS[k], "n")], "doc_id long, text string, n_words string")).first()
    assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == counts(TEXTS[k])


def test_very_long_text(spark):
    text = " ".join(f"word{i % 50_000} and\n" for i in range(150_000))
    row = text_counts(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == counts(text)


def test_verdicts(spark):
    folder = "/root/testdata/sf0.01"
    judged = op1_quality_rules(spark, folder)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = judged.collect()
    assert len(rows) == len(texts)
    for r in rows[:200]:
        n, chars, symbols, lines, repeats = counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeats)
        assert r["base_failed"] == (n < 50 or 100 * repeats > 50 * n) and not (r["base_failed"] and r["kept"])
    good = judged.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("NOT base_failed")
    assert good.filter("quality = 1 AND kept").count() / good.filter("quality = 1").count() > 0.97
    assert good.filter("quality = 0 AND kept").count() / good.filter("quality = 0").count() < 0.1


def test_no_python_in_the_plan(spark):
    plan = op1_quality_rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert judge(text_counts(empty)).count() == 0
    twice = spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string")
    assert judge(text_counts(twice)).count() == 2
