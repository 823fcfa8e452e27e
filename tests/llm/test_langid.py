import functools
import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from pairweave.llm.common import mix64
from pairweave.llm.langid import BUCKETS, SCRIPTS, identify, op4_language_id, quota, train, viterbi, words_of


def test_viterbi_is_best():
    rng = np.random.default_rng(0)
    for _ in range(400):
        n, k = rng.integers(1, 7), rng.integers(1, 4)
        scores, penalty = rng.normal(size=(n, k)).astype(np.float32) * rng.choice([0.3, 2]), float(rng.choice([0.5, 2.0]))
        value = lambda path: sum(scores[i, x] for i, x in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))  # noqa: B023, E731
        assert abs(max(map(value, itertools.product(range(k), repeat=n))) - value(viterbi(scores, penalty))) < 1e-4


def test_held_out_accuracy(spark):
    found = op4_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").filter("held_out")
    right, rows = found.filter("lang = lang_pred").count(), found.count()
    assert rows > 200 and right / rows > 0.98
    assert found.filter("score < 0 OR score > 1").count() == 0


def test_cases(spark):
    learn = spark.createDataFrame(
        [(i, "the house and the garden with water", "en") for i in range(20)] + [(i, "дом и сад с водой", "ru") for i in range(20)] + [(99, None, "en"), (98, "x", None)],
        "doc_id long, text string, lang string",
    )
    model = train(learn)
    assert model.langs == ["en", "ru"]
    texts = [None, "", "123 ... 日", "— …", "Дом и сад", "the house", "the garden the water the house " * 5 + "дом и сад с водой " * 20, "house " * 30_000]
    docs = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)] + [(4, "дом", "q"), (4, "дом", "q")], "doc_id long, text string, score string")
    rows = identify(docs, model, with_spans=True).orderBy("doc_id").collect()
    got = [r["lang_pred"] for r in rows]
    assert got[:2] == ["und", "und"] and got[3] == "und" and got[4:7] == ["ru"] * 3 and got[7] == "en" and got[8] == "ru" and got[9] == "en"
    assert rows[0]["score"] == 0.0 and {s["lang"] for s in rows[8]["spans"]} == {"en", "ru"}
    assert rows[2]["lang_pred"] in ("und", "en", "ru")


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    docs = spark.createDataFrame([(1, "word")], "doc_id long, text string")
    assert identify(docs, train(empty)).first()["lang_pred"] == "und"
    assert identify(empty, train(empty)).count() == 0


def test_learns_the_same_from_any_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a, b = train(docs, 50), train(docs.orderBy(F.desc("doc_id")), 50)
    assert np.array_equal(a.log_prob, b.log_prob)


def brute_words(text):
    """Runs of letters (any non-ASCII character joins one), cut where the script changes."""
    out, held, last = [], "", None
    for c in (text or "") + " ":
        if c.isascii() and not c.isalpha():
            out += [held] if held else []
            held, last = "", None
            continue
        own = None if not c.isalpha() else "latin" if c.isascii() else next(n for s, n in reversed(SCRIPTS) if s <= ord(c))
        if held and own and last and (own != last or own in ("han", "kana", "thai") and len(held) >= 6):
            out.append(held)
            held = ""
        held += c.lower() if c.isascii() else c
        last = own or last
    return [(w, next((n for c in w if c.isalpha() for n in ["latin" if c.isascii() else next(n for s, n in reversed(SCRIPTS) if s <= ord(c))]), None)) for w in out]


@functools.cache
def brute_grams(word):
    raw, out = b"\x01" + word.encode() + b"\x01", []
    for n in range(1, 6):
        for i in range(len(raw) - n + 1):
            gram = raw[i : i + n]
            if gram.strip(b"\x01"):
                out.append(int(mix64(np.array([int.from_bytes(gram, "big") * 8 + n], np.uint64))[0]) % BUCKETS)
    return out


def brute_model(learn):
    counts, scripts = {}, {}
    for text, lang in learn:
        for w, script in brute_words(text):
            for g in brute_grams(w):
                counts.setdefault(lang, {}).setdefault(g, 0)
                counts[lang][g] += 1
            if script:
                scripts.setdefault(lang, {}).setdefault(script, 0)
                scripts[lang][script] += 1
    return counts, scripts


def brute_scores(counts, scripts):
    """A function of a word and its script: each language's log posterior."""
    langs = sorted(counts)
    sizes, known = {lang: sum(counts[lang].values()) for lang in langs}, {lang: sum(scripts[lang].values()) for lang in langs}

    @functools.cache
    def score(w, script):
        some = [lang for lang in langs if scripts[lang].get(script, 0) / known[lang] >= 0.005]
        if not some:
            return [-np.log(len(langs))] * len(langs)
        total = {lang: sum(math.log((counts[lang].get(g, 0) + 0.5) / (sizes[lang] + 0.5 * BUCKETS)) for g in brute_grams(w)) / 2.5 for lang in some}
        top = max(total.values())
        norm = top + np.log(sum(np.exp(v - top) for v in total.values()))
        return [max(total[lang] - norm, -8) if lang in total else -1e6 for lang in langs]

    return score


def brute_path(text, counts, scripts, penalty=6.0, score=None):
    """Words with letters, their scores, and the best language of each."""
    langs, score = sorted(counts), score or brute_scores(counts, scripts)
    words = [(w, s) for w, s in brute_words(text) if s]
    rows = [score(w, s) for w, s in words]
    if not words:
        return [], [], []
    value, back = rows[0], []
    for row in rows[1:]:
        come = [max(range(len(langs)), key=lambda p: value[p] - penalty * (p != i)) for i in range(len(langs))]  # noqa: B023
        value = [value[p] - penalty * (p != i) + x for i, (p, x) in enumerate(zip(come, row, strict=True))]
        back.append(come)
    path = [max(range(len(langs)), key=value.__getitem__)]
    for come in reversed(back):
        path.append(come[path[-1]])
    return words, rows, path[::-1]


def brute_identify(text, counts, scripts, penalty=6.0):
    langs = sorted(counts)
    words, rows, path = brute_path(text, counts, scripts, penalty)
    if not words:
        return "und", 0.0
    letters = [sum(len(w.encode()) for (w, _), p in zip(words, path, strict=True) if p == i) for i in range(len(langs))]
    j = letters.index(max(letters))
    return langs[j], letters[j] / sum(letters) * np.mean([np.exp(r[j]) for r, p in zip(rows, path, strict=True) if p == j])


def test_against_brute_force(spark):
    rng = np.random.default_rng(9)
    alphabets = {"en": "abcdeghilmnorstu", "xx": "abefiklopuvwyz", "ru": "абвгдежзик", "el": "αβγδεζηθ", "ja": "のはをに日本語人", "zh": "的一是不日本人"}
    make = lambda lang, n: " ".join("".join(rng.choice(list(alphabets[lang]), rng.integers(1, 7))) for _ in range(n))
    learn = [(make(lang, 30), lang) for lang in alphabets for _ in range(4)]
    texts = [make(rng.choice(list(alphabets)), rng.integers(1, 8)) + rng.choice([" ", "", " 12. "]) + make(rng.choice(list(alphabets)), rng.integers(1, 8)) for _ in range(60)]
    texts += [None, "", "12", "the дом house", "日本語English日本語", "ÀÉ — ՀԱՅ", "a" * 3000, "日" * 500]
    model = train(spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(learn)], "doc_id long, text string, lang string"))
    plain = brute_model(learn)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in identify(docs, model).collect():
        assert [w.decode() for w in words_of(None if r["text"] is None else r["text"].encode())] == [w for w, _ in brute_words(r["text"])]
        lang, score = brute_identify(r["text"], *plain)
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-3, r["text"]


def test_scripts_exclude(spark):
    learn = [(i, "the house and the garden", "en") for i in range(9)] + [(i, "дом и сад с водой", "ru") for i in range(20, 29)]
    model = train(spark.createDataFrame(learn, "doc_id long, text string, lang string"))
    docs = spark.createDataFrame([(1, "the house and дом the garden")], "doc_id long, text string")
    assert [(s["lang"], s["start"], s["end"]) for s in identify(docs, model, with_spans=True).first()["spans"]] == [("en", 0, 3), ("ru", 3, 4), ("en", 4, 6)]


def test_rare_languages_are_learned(spark):
    rows = [(i, "the house and the garden", "en") for i in range(3000)] + [(5000, "το σπίτι και ο κήπος", "el")]
    many = [(6000 + i, "word" + chr(97 + i % 26) * 3, f"l{i:03d}") for i in range(300) for _ in range(2)]
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_rows=50)
    assert model.langs == ["el", "en"] and model.allowed.any(0).all()
    model = train(spark.createDataFrame(rows + many, "doc_id long, text string, lang string"), max_rows=900)
    assert len(model.langs) == 256 and "en" in model.langs and "el" not in model.langs  # too many: the ones with most rows
    assert model.log_prob.nbytes <= 64 << 20
    assert quota([1, 5, 100], 30) == 24 and quota([3, 3], 100) == 3 and quota([], 5) == 1 and quota([10, 10], 1) == 1


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "word", "en", "a", "b")], "doc_id long, text string, lang string, lang_pred string, confidence string")
    found = identify(docs, train(docs), with_confidence=True)
    assert found.columns == ["doc_id", "text", "lang", "lang_pred", "score", "confidence"] and found.first()["lang_pred"] == "en"
