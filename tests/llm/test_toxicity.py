import itertools
import math

import numpy as np
import pytest

from pairweave.llm.langid import held_out
from pairweave.llm.toxicity import COST_LETTER, SHORT, CharModel, Model, decode, disguised, lattice, learn_letters, op2_toxicity, pieces_of, respace, restore, score_toxicity, spaced, train, trim

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def chars():
    model = CharModel()
    for word, n in [("idiot", 50), ("moron", 50), ("loser", 50), ("stupid", 50), ("the", 500), ("this", 300), ("house", 100), ("water", 100), ("seen", 50), ("all", 80)]:
        model.add(word, n)
    return model


@pytest.mark.parametrize(
    ("token", "word"),
    [("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("id*ot", "idiot"), ("idiooooot", "idiot"), ("M0R0N!!!", "moron"), ("l0s3r,", "loser"), ("$tup1d", "stupid"), ("house", "house"), ("all.", "all"), ("seen&&&", "seen"), ("(the)", "the"),
     ("\u0456di\u043et", "idiot"), ("id\u200bi\u00adot", "idiot"), ("st\u03c5pid", "stupid"), ("11diiot", "idiot")],
)
def test_restore(chars, token, word):
    assert restore(token, chars) == word


def test_plain_words_are_left(chars):
    assert not disguised("house") and not disguised("l'eau") and not disguised("2024")
    assert decode("house", chars) == "house"
    assert spaced(["a", "i", "d", "i", "o", "t", "the", "x", "y"]) == ["aidiot"]


def test_held_out(spark):
    rows = op2_toxicity(spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    toxic, clean = ([r for r in rows if r["toxic"] == k] for k in (1, 0))
    assert sum(r["predicted"] for r in clean) / len(clean) < 0.03
    assert sum(r["predicted"] for r in toxic) / len(toxic) > 0.6


def test_cases(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter(~held_out())
    model = train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    texts = [None, "", "Thing on the house", "the 1d10t and the l0s3r are w0rthless", "i d i o t", "of the " * 50_000]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "a", "x")] * 2, "doc_id long, text string, score string")
    got = {r["doc_id"]: r for r in score_toxicity(rows, model, with_restored=True).collect()}
    assert got[0]["score"] == got[1]["score"] < 0.7 and got[2]["score"] < 0.7 < got[3]["score"]
    assert {x["word"] for x in got[3]["restored"]} >= {"idiot", "loser", "worthless"} and got[4]["restored"][0]["word"] == "idiot"


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (2, 1), (None, 0)], "doc_id long, toxic int")
    model = train(docs, labels)
    assert isinstance(model, Model) and [r["score"] for r in score_toxicity(docs, model).collect()] == [0.0, 0.0]
    assert score_toxicity(docs.limit(0), model).count() == 0


def test_decoding_is_best(chars):
    """Every path of the lattice, at what the trigrams or the word's frequency say."""
    total = math.log(chars.words.total())
    known = {c: COST_LETTER for c in {g[2] for g in chars.counts} if c != " "} | {w: total - math.log(n) for w, n in chars.words.items()}

    def cost(word):
        padded = f"  {word} "
        return min(sum(chars.cost(padded[i - 2 : i], padded[i]) for i in range(2, len(padded))), known.get(word, math.inf))

    rng = np.random.default_rng(5)
    for _ in range(60):
        word = "".join(rng.choice(list("1d0*stupi$3.e\u0456a"), rng.integers(1, 6)))
        paths = [("".join(t for t, _ in p), sum(c for _, c in p)) for p in itertools.product(*lattice(word))]
        best = min(c + cost(w) for w, c in paths)
        got = decode(word, chars)
        assert min(c + cost(w) for w, c in paths if w == got) == pytest.approx(best), word


def brute_signals(text, model):
    """Evidence of a text, word by word."""
    words = [trim(w) for w in (text or "").lower().split()]
    doubled = lambda w: "".join(c for c, _ in itertools.groupby(w))
    found, places = {}, 0
    for w in words:
        p = model.word(decode(w, model.chars) if disguised(w) or (doubled(w) != w and doubled(w) + " " in model.evidence) else w)
        if p:
            found[w] = max(p, found.get(w, 0))
        places += p > 0.6
    for run in (list(g) for k, g in itertools.groupby(words, lambda w: 0 < len(w) <= SHORT) if k):
        if len(run) > 1 and any(c.isalpha() for w in run for c in w):
            for n, w in respace(run, model.chars):
                if n > 1 and (p := model.word(w)):
                    found[w] = max(p, found.get(w, 0))
                    places += p > 0.6
    top = sorted(found.values(), reverse=True)[:3] + [None] * 3
    strong = [0.0 if p is None else -math.log(1 - p + 0.01) for p in top[:3]]
    return [1, *strong, math.log1p(places), math.log1p(len(words)), strong[0] ** 2]


def test_signals_against_brute_force(chars):
    model = Model(chars, {"idiot ": 0.9, "moron ": 0.7, "stup": 0.8, "loser ": 0.5}, np.arange(7.0), 0.1)
    pool = ["the", "house", "1d10t", "m0ron!", "st", "up", "id", "s", "t", "\u0456diot", "idiiot", "this", "all", "l0s3r", "2024", "...", "water,"]
    rng = np.random.default_rng(7)
    texts = [None, ""] + [" ".join(rng.choice(pool, rng.integers(1, 9))) for _ in range(150)]
    got = model.signals([None if t is None else t.encode() for t in texts])
    for t, x in zip(texts, got, strict=True):
        assert np.allclose(x, brute_signals(t, model)), t


def test_letters_of_all_texts(spark):
    docs = spark.createDataFrame([(1, "Aba, aba x"), (2, "\u00e9t\u00e9 \u0434\u043e\u043c a-b"), (3, None)], "doc_id long, text string").repartition(3)
    model = learn_letters(docs)
    want = CharModel()
    for w in ("aba", "aba", "\u00e9t\u00e9"):
        want.add(w)
    assert model.counts == want.counts and model.context == want.context


def test_thinned_labels_keep_their_weight(spark):
    rows = [(i, ("the idiot " if i % 10 == 0 else "the house ") + "water this " * (i % 7)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 10 = 0 AS INT) AS toxic")
    whole, part = train(docs, labels), train(docs, labels, max_rows=400)
    assert whole.share == pytest.approx(0.1) and part.share == pytest.approx(0.1, abs=0.03)
    assert "idiot " in whole.evidence and "idiot " in part.evidence and "the " not in part.evidence
    scored = {r["doc_id"]: r["score"] for r in score_toxicity(docs.filter("doc_id < 40"), part).collect()}
    assert all((scored[i] >= 0.7) == (i % 10 == 0) for i in scored)
