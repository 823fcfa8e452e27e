"""Language of texts that may mix languages.

Texts are cut into words where letters end and where the script changes (runs of scripts without
spaces also every ``PIECE`` letters). Each distinct word of a batch is scored once: the range of its
letters (Latin, Greek, Cyrillic, ...) leaves only languages that use that script, and hashed
character n-grams give each of these a log probability. A Viterbi pass over the words, with a penalty
for each switch, labels spans, and no span has a language whose script a word excludes; the text's
language is the one that labels most letters.

A path without a switch is proven best, when it is, without the step-by-step pass. Let j be the
language of the largest total, and a run's gain what its language gains on j there. No path beats j
if no run gains more than the penalty, and no first and last run together do: of a path that meets j
each run outside j has a switch of its own, and of one that doesn't each run but the first or last.
The gains are vectorised running maxima; only the other texts are decoded word by word.

Scale: one pass over the texts and no shuffle of them. The model is a table of buckets per language,
32 MB at most, which is shipped. It is learned on at most about ``max_rows`` rows, chosen by hash and
dealt to the languages so that rare ones give all they have. The ``max_langs`` languages with most
rows are told apart (a dirty label column doesn't stop the corpus); others are never predicted.

Cases: null text, and text without any letter, is ``und`` with score 0; words without letters are
neutral; a word in a script that no language uses may be in any; without any row to learn from,
everything is ``und``; ties go to the language first in order; very long texts are read whole, in the
pass as in the model; repeated rows are kept as they come, an empty table gives an empty result, and
columns of the input with the names added here are replaced.
"""

from __future__ import annotations

import bisect
import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairweave.llm.common import Vocabulary, bytes_of, mix64, remainder, slices, table

#: First code points of scripts, in order; a letter belongs to the last range that begins at or before it.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "other"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB13, "other"), (0x20000, "han"), (0x323B0, "other"),
]
_START_LIST = [s for s, _ in SCRIPTS]
_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT_OF = np.array([_NAMES.index(n) for _, n in SCRIPTS])
_LATIN = _NAMES.index("latin")
#: Lower-cases A-Z and blanks what is no letter in ASCII.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
#: Bytes of characters before the first letter that isn't Latin (U+0370), and those that continue one.
_ONLY_LATIN = bytes(range(0xCD))
#: Buckets of a language's n-grams, and as many where there are over 32 languages.
BUCKETS, FEWER_BUCKETS = 1 << 17, 1 << 15
#: Scripts that don't part words by spaces, and the letters of a piece of them.
_SPACELESS = frozenset(_NAMES.index(n) for n in ("han", "kana", "thai"))
PIECE = 6
#: What excludes a language from a word: more than any gain of keeping it over a whole text's switches.
_NEVER = np.float32(-1e6)
ORDERS = (1, 2, 3, 4, 5)


def words_of(text: bytes | None) -> list[bytes]:
    if text is None:
        return []
    words = text.translate(_LETTERS).split()
    return list(itertools.chain.from_iterable(map(_parts, words))) if text.translate(None, _ONLY_LATIN) else words


def _parts(word: bytes) -> tuple[bytes, ...]:
    """A word cut where its script changes, and into pieces where its script has no spaces."""
    return _cached_parts(word) if len(word) < 64 else _cut(word)


def _cut(word: bytes) -> tuple[bytes, ...]:
    if word.isascii():
        return (word,)
    out, held, script = [], [], -1
    for c in word.decode("utf-8", "replace"):
        own = script_of(c)
        if held and (own >= 0 and script >= 0 and own != script or own in _SPACELESS and len(held) >= PIECE):
            out.append("".join(held))
            held = []
        held.append(c)
        script = own if own >= 0 else script
    out.append("".join(held))
    return tuple(x.encode() for x in out)


_cached_parts = functools.lru_cache(1 << 16)(_cut)


def script_of(letter: str) -> int:
    """The number of a letter's script; -1 for what is no letter."""
    if letter.isascii():
        return _LATIN
    return int(_SCRIPT_OF[bisect.bisect_right(_START_LIST, ord(letter)) - 1]) if letter.isalpha() else -1


def features(words: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words (with a mark at both ends), and the word of each."""
    raw = np.frombuffer(b"\x01" + b"\x01".join(words) + b"\x01", np.uint8).astype(np.uint64)
    word = np.cumsum(raw == 1) - 1
    inside = raw != 1
    value, found, owner = np.zeros(len(raw), np.uint64), [], []
    for n in range(1, max(ORDERS) + 1):
        # value[i]: the n bytes that end at i; they lie in one word, with marks, if no mark is strictly inside
        value = np.concatenate(([np.uint64(0)], value[:-1])) << np.uint64(8) | raw if n > 1 else raw.copy()
        value &= np.uint64((1 << 8 * n) - 1) if n < 8 else np.uint64(0xFFFFFFFFFFFFFFFF)
        if n not in ORDERS:
            continue
        ok = np.ones(len(raw), bool)
        ok[: n - 1] = False
        for k in range(1, n - 1):
            ok[k:] &= inside[: len(raw) - k] if k else True
        if n == 1:
            ok &= inside
        if n == 2:
            ok &= inside | np.concatenate(([False], inside[:-1]))
        at = np.flatnonzero(ok)
        found.append((mix64(value[at] * np.uint64(8) + np.uint64(n)) & np.uint64(buckets - 1)).astype(np.int64))
        owner.append(np.where(inside[at], word[at], word[at] - 1))
    return np.concatenate(found), np.concatenate(owner)


def scripts_of(words: list[bytes]) -> np.ndarray:
    """Script of each word's first letter; -1 for a word without a letter. (A word has one script, see ``words_of``.)"""
    out = np.full(len(words), _LATIN)
    for i, w in enumerate(words):
        if not w.isascii():
            out[i] = next((k for c in w.decode("utf-8", "replace") if (k := script_of(c)) >= 0), -1)
    return out


class Model:
    """log_prob: bucket x language; allowed: script x language."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray, smooth: float = 0.5) -> None:
        self.langs = langs
        total = counts.sum(0, keepdims=True)
        self.log_prob = np.log((counts + smooth) / (total + smooth * len(counts))).astype(np.float32)
        share = scripts / np.maximum(1, scripts.sum(0, keepdims=True))
        self.allowed = share >= 0.005

    def score(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Log posterior of each language for each word under a uniform prior, and whether it has a letter."""
        parts = [self._score(words[a : a + 10_000]) for a in range(0, max(1, len(words)), 10_000)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _score(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n, k = len(words), len(self.langs)
        script = scripts_of(words)
        out = np.zeros((n, k), np.float32)
        if n and k:
            bucket, owner = features(words, len(self.log_prob))
            order = np.argsort(owner, kind="stable")
            owner, bucket = owner[order], bucket[order]
            starts = np.searchsorted(owner, np.arange(n))
            for j in range(k):
                out[:, j] = np.add.reduceat(self.log_prob[bucket, j], starts)
            out /= len(ORDERS) * 0.5
            some = self.allowed[script] & (script >= 0)[:, None]
            out = np.where(some | ~some.any(1, keepdims=True), out, _NEVER)
            out -= out.max(1, keepdims=True)
            out -= np.log(np.exp(out).sum(1, keepdims=True))
            out = np.where(some, np.maximum(out, -8), _NEVER).astype(np.float32)
            out[(script < 0) | ~some.any(1)] = -np.log(k)
        return out, script >= 0


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word: sum of scores less ``penalty`` per switch; ties to the smaller number."""
    n, k = scores.shape
    best = int(scores.sum(0, dtype=np.float64).argmax())
    if k == 1 or n == 0:
        return np.zeros(n, np.int64)
    gain = np.cumsum(scores - scores[:, best : best + 1], 0, dtype=np.float64)
    low = np.minimum.accumulate(np.vstack((np.zeros(k), gain[:-1])), 0)
    ends = max(0.0, gain.max()) + max(0.0, (gain[-1] - low[-1]).max())
    if (gain - low).max() <= penalty and ends <= penalty:
        return np.full(n, best)
    rows = scores.astype(np.float64).tolist()
    back: list[tuple[int, list[bool]] | None] = [None] * n
    value = rows[0]
    for t in range(1, n):  # plain floats: k is small, and numpy's calls would cost more than the work
        top = max(value)
        least = top - penalty
        if min(value) < least:
            back[t] = (value.index(top), [x < least for x in value])
            value = [(least if x < least else x) + y for x, y in zip(value, rows[t], strict=True)]
        else:
            value = [x + y for x, y in zip(value, rows[t], strict=True)]
    path = np.empty(n, np.int64)
    at = value.index(max(value))
    for t in range(n - 1, -1, -1):
        path[t] = at
        if (step := back[t]) is not None and step[1][at]:
            at = step[0]
    return path


def quota(rows: list[int], most: int) -> int:
    """The largest q for which min(n, q) over the groups of ``rows`` add up to ``most`` at most; at least 1."""
    left = sorted(rows)
    for k, n in enumerate(left):
        if n * (len(left) - k) > most:
            return max(1, most // (len(left) - k))
        most -= n
    return max(left, default=1)


def sampled(key: str, share) -> Column:
    """Whether a row is in the sample of a ``share`` of all, by a hash of ``key``; at least 2 ** -62 is told apart."""
    return F.xxhash64(key).bitwiseAND(F.lit((1 << 62) - 1)) < (share * float(1 << 62)).cast("long")


def train(docs: DataFrame, max_rows: int = 8000, max_langs: int = 256) -> Model:
    """Learn from ``docs`` (doc_id, text, lang); rows with null text or lang are passed over.

    If there are more than ``max_rows`` rows, each language gives the same number, or all it has, chosen
    by a hash of the identifier. N-grams are counted on the executors; only counts per bucket return.
    """
    docs = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()
    counted = {r["lang"]: r["count"] for r in sizes}
    langs = sorted(counted)
    buckets = BUCKETS if len(langs) <= 32 else FEWER_BUCKETS
    if langs:
        q = quota(list(counted.values()), max_rows)
        share = F.create_map(*(F.lit(x) for lang, n in counted.items() for x in (lang, min(1.0, q / n))))[F.col("lang")]
        docs = docs.filter(F.col("lang").isin(langs)).filter((share >= 1) | sampled("doc_id", share))
    out = pa.schema([("lang", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for part in parts:
            for text, lang in zip(bytes_of(part.column("text")), part.column("lang").to_pylist(), strict=True):
                if words := words_of(text):
                    own = counts.setdefault(lang, np.zeros(buckets + len(_NAMES), np.int32))
                    np.add.at(own, features(words, buckets)[0], 1)
                    script = scripts_of(words)
                    np.add.at(own, buckets + script[script >= 0], 1)
        for lang, own in counts.items():
            bucket = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), langs.index(lang)), pa.int32()), pa.array(bucket, pa.int32()), pa.array(own[bucket], pa.int64())], schema=out)

    summed = docs.mapInArrow(run, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros((buckets + len(_NAMES), len(langs)), np.float32)
    if langs:
        held = summed.toArrow()  # at most a row for each bucket and language
        counts[held["bucket"].to_numpy(), held["lang"].to_numpy()] = held["n"].to_numpy()
    return Model(langs, counts[:buckets], counts[buckets:])


def identify(docs: DataFrame, model: Model, penalty: float = 6.0, with_spans: bool = False, with_confidence: bool = False) -> DataFrame:
    """``docs`` with lang_pred, score (share of letters so labelled, times the words' mean probability of it).

    ``with_spans`` adds spans: language, first and last word of each run; ``with_confidence`` adds confidence:
    the words' mean probability of the languages of their spans, which no mixing lowers. Columns of ``docs``
    with these names are replaced.
    """
    names = ["lang_pred", "score"] + ["spans"] * with_spans + ["confidence"] * with_confidence
    docs = docs.drop(*names)
    own = docs.columns
    ddl = "lang_pred string, score double" + ", spans array<struct<lang:string,start:int,end:int>>" * with_spans + ", confidence double" * with_confidence
    schema = T.StructType(docs.schema.fields + T.StructType.fromDDL(ddl).fields)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for part in parts:
            for piece in slices(part, 1000, 4 << 20):
                vocabulary = Vocabulary()
                ids = [vocabulary.encode(words_of(t)) for t in bytes_of(piece.column("text"))]
                words = vocabulary.words()
                scores, lettered = m.score(words)
                lengths = np.array([len(w) for w in words], np.int64)
                lang, score, runs, sure = [], [], [], []
                for own_ids in ids:
                    own_ids = own_ids[lettered[own_ids]] if len(own_ids) and len(m.langs) else own_ids[:0]
                    if not len(own_ids):
                        lang.append("und")
                        score.append(0.0)
                        runs.append([])
                        sure.append(0.0)
                        continue
                    s = scores[own_ids]
                    path = viterbi(s, penalty)
                    weight = np.bincount(path, lengths[own_ids], len(m.langs))
                    j = int(weight.argmax())
                    lang.append(m.langs[j])
                    score.append(float(weight[j] / weight.sum() * np.exp(s[path == j, j]).mean()))
                    sure.append(float(np.exp(s[np.arange(len(path)), path]).mean()) if with_confidence else 0.0)
                    cuts = np.concatenate(([0], np.flatnonzero(np.diff(path)) + 1, [len(path)])) if with_spans else []
                    runs.append([{"lang": m.langs[path[a]], "start": int(a), "end": int(b)} for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
                columns = [piece.column(c) for c in own] + [pa.array(lang, pa.string()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(runs, span)] * with_spans + [pa.array(sure, pa.float64())] * with_confidence, names=[*own, *names])

    return docs.mapInArrow(run, schema)


def held_out():
    """Rows that nothing is learned from: crc32 of the identifier leaves 1 when divided by 3."""
    return F.coalesce(remainder(3) == 1, F.lit(False))


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out()))
    found = identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")
