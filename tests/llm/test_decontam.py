import hypothesis.strategies as st
from hypothesis import given, settings

from pairweave.llm.decontam import brute_force, digest, find_contamination, remove_contaminated

TEXT = st.lists(st.sampled_from(["a", "B", "c", "é", "1", "x-y", "\n", "  ", ".", "A b"]), max_size=12).map(" ".join)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string")  # the last one clashes


def run(spark, texts, items, **options):
    docs = docs_of(spark, [(i, t, "x") for i, t in enumerate(texts)])
    found = find_contamination(docs, items_of(spark, list(items.items())), **options).orderBy("doc_id").collect()
    return [(r["n_words"], r["n_hit"], sorted(r["items"])) for r in found]


def same(spark, texts, items, **options):
    got = run(spark, texts, items, **options)
    assert got == brute_force(texts, {str(k): v for k, v in items.items()}, options.get("window", 10))


def test_cases(spark):
    items = {1: "The quick, brown fox", 2: None, 3: "", 4: "...", 5: "b c d e f g h i j k l", 60: "one", 7: "one"}
    texts = [None, "", "the QUICK brown-fox jumps", "a b c d e f g h i j k", "One", "quick brown", "b c d e f g h i j k l " * 3, "oneone", "thé quick brown fox"]
    same(spark, texts, items)
    same(spark, texts, items, window=3)
    same(spark, texts, items, window=3, max_bytes=8)  # several automata
    same(spark, texts, items, window=3, max_bytes=60, max_hashes=4)  # windows looked up first, in several ranges


def test_long_text_and_clashing_columns(spark):
    text = "x y z " * 30_000 + "the quick brown fox " + "x y z " * 30_000
    docs = docs_of(spark, [(1, text, "own")])
    row = find_contamination(docs, items_of(spark, [(1, "the quick brown fox")])).first()
    assert row["n_words"] == 180_004 and row["n_hit"] == 4 and [text[s["start"] : s["end"]] for s in row["spans"]] == ["the quick brown fox"]
    assert remove_contaminated(docs, items_of(spark, [(1, "nowhere")])).first()["n_words"] == "own"


def test_spans_map_back(spark):
    text = "Éa  THE,quick\nbrown fox; end"
    row = find_contamination(docs_of(spark, [(1, text, "")]), items_of(spark, [(1, "the quick brown fox")])).first()
    assert [text[s["start"] : s["end"]] for s in row["spans"]] == ["THE,quick\nbrown fox"]


def test_removal_keeps_columns(spark):
    docs = docs_of(spark, [(1, "a b", "k"), (1, "a b", "k"), (2, "zz", None), (None, None, None)])
    left = remove_contaminated(docs, items_of(spark, [(1, "zz")]))
    assert left.columns == docs.columns and sorted(str(r["n_words"]) for r in left.collect()) == ["None", "k", "k"]


def test_empty(spark):
    assert find_contamination(docs_of(spark, []), items_of(spark, [])).count() == 0
    assert run(spark, ["a b"], {}) == [(2, 0, [])]


def test_digest():
    assert digest(["10", "9"]) == digest(["9", "10"]) != digest([])


@settings(max_examples=15, deadline=None)
@given(texts=st.lists(TEXT, min_size=1, max_size=4), items=st.lists(TEXT, max_size=3))
def test_random(spark, texts, items):
    same(spark, texts, dict(enumerate(items)), window=2)
