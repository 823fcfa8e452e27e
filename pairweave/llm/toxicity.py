"""Toxicity of texts whose words may be disguised.

A disguised word is seen as the output of a noisy channel: letters replaced by look-alike digits,
signs and letters of other scripts, masked by a star, repeated, or set apart by separators, spaces or
invisible characters. Its lattice of possible letters is decoded by Viterbi under a character trigram
model and a list of known words (a word costs what the trigrams or its frequency say, whichever is
less), with a cost for each thing the channel did, and the restored word is scored in place of what
stands there. Over a run of short pieces (up to three characters) the lattice also says which spaces
were put in and which part words, each at a cost; every word restored from several pieces is scored.
A word whose lattice has one path (letters of one script, none three times in a row) is its own
restoration, so that only disguised words are decoded, each distinct one of a batch once; a letter
written twice is undone if that makes a word with evidence.

The trigrams are counted over the Latin words of all texts to learn from. A word's evidence is the
chance of toxicity of texts with that restored word or one of its prefixes, learned from labelled
texts; a text's score is a logistic function of the evidence of its three strongest words, of how many
places hold strong ones, and of its length.

Scale: two passes over the texts without any shuffle of them, one to count trigrams (an aggregate of
the size of the alphabet) and one to score. Labels are learned from at most about ``max_rows`` labelled
rows chosen by hash (where there are more, toxic ones are kept up to a half of it), joined as a broadcast of that
bounded size.

Cases: null and empty texts have no evidence and get the score of that; null labels teach nothing, of
several labels of a document the toxic one counts; without a toxic and a harmless text to learn from
the score is the share of toxic labels (0 if none); very long texts are read whole; ties between
readings go to the first in order of letters; repeated rows are kept, an empty table gives an empty
result; columns of the input named score and restored are replaced.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairweave.llm.common import Vocabulary, bytes_of, materialize, slices, table
from pairweave.llm.langid import _LETTERS, held_out, sampled

#: Letters that digits and signs may stand for.
LOOKS_LIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i"}
#: Latin letters that letters of other scripts may stand for, in words that mix scripts: Cyrillic, Greek.
FOREIGN = dict(zip("аеорсхукмтвніѕј", "aeopcxykmtbhisj", strict=True)) | dict(zip("αοεικνρτυχ", "aoeikvptux", strict=True))
#: Characters that can't be seen.
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
MASKS, VOWELS = "*#%", "aeiou"
SEPARATORS = ".-_~'`,:;/\\=^&"
#: Costs (negative log probabilities) of what the channel did: look-alike, mask, dropped separator, repetition.
COST_LOOK, COST_MASK, COST_DROP, COST_REPEAT = 1.0, 2.0, 0.3, 0.3
#: What a letter of another script costs, and a letter written twice that should stand once.
COST_FOREIGN, COST_TWICE = 0.3, 1.0
#: What a space costs that is as expected, and one that isn't: between single characters it is dropped, else kept.
COST_SPACE = (0.3, 1.0)
#: What any letter costs at most as a word of its own.
COST_LETTER = 4.0
#: Characters of a piece at most.
SHORT = 3
_SIGN_RUN = re.compile(r"([^\w\s])\1{2,}")
_DISGUISED = re.compile(r"([^\W\d_])\1\1|[\d@$!|+(<€£¡*#%]|(?:^|[._\-~*])\w[._\-~*]+\w(?:[._\-~*]|$)")
_LETTER = re.compile(r"[^\W\d_]")
_ODD = re.compile(f"[{INVISIBLE}{''.join(FOREIGN)}]")
_UNSEEN = re.compile(f"[{INVISIBLE}]")
_TWICE = re.compile(r"([^\W\d_])\1")
_LATIN = re.compile(r"[a-z]")
PREFIXES = range(4, 9)
#: How much likelier a disguised word is one that tells than its share of the words written in letters.
DISGUISED_MORE = 20


@dataclass
class CharModel:
    """Trigram log probabilities of the characters of words, padded with spaces."""

    counts: Counter = field(default_factory=Counter)
    context: Counter = field(default_factory=Counter)
    words: Counter = field(default_factory=Counter)
    letters: int = 40

    def add(self, word: str, n: int = 1) -> None:
        self.words[word] += n
        self.__dict__.pop("beginnings", None)
        padded = f"  {word} "
        for i in range(2, len(padded)):
            self.counts[padded[i - 2 : i + 1]] += n
            self.context[padded[i - 2 : i]] += n

    def cost(self, before: str, letter: str) -> float:
        return -math.log((self.counts[before + letter] + 0.05) / (self.context[before] + 0.05 * self.letters))

    @functools.cached_property
    def beginnings(self) -> dict[str, float]:
        """Beginnings of the words, with what a whole word costs by its frequency."""
        total = math.log(max(1, self.words.total()))
        whole = {c: COST_LETTER for c in {g[2] for g in self.counts} if c != " "}
        for w, n in self.words.items():
            whole[w] = min(total - math.log(n), whole.get(w, math.inf))
        return dict.fromkeys((w[:k] for w in self.words for k in range(len(w))), math.inf) | whole


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each run of equal characters, the strings it may stand for and what the channel charges."""
    out = []
    for c, run in itertools.groupby(word):
        n = len(list(run))
        if c in MASKS:
            out.append([(v, COST_MASK) for v in VOWELS] + [("", COST_MASK)])
        elif c in SEPARATORS or c.isspace():
            out.append([("", COST_DROP * min(n, 3))])
        elif c in INVISIBLE:
            out.append([("", 0.0)])
        elif plain := FOREIGN.get(c):
            out.append([(plain * k, COST_FOREIGN * k + COST_REPEAT * (n - k)) for k in sorted({1, min(n, 2)})])
        elif looks := LOOKS_LIKE.get(c):
            out.append([(v * k, COST_LOOK * k + COST_REPEAT * (n - k)) for v in looks for k in sorted({1, min(n, 2)})] + [("", 2 * COST_LOOK)])
        elif n > 2:
            out.append([(c, COST_REPEAT * (n - 1)), (c + c, COST_REPEAT * (n - 2))])
        elif n == 2 and c.isalpha():
            out.append([(c + c, 0.0), (c, COST_TWICE)])
        else:
            out.append([(c * n, 0.0)])
    return out


def decode(word: str, model: CharModel) -> str:
    """The likeliest plain word."""
    return respace([word], model)[0][1]


def _again(pieces: list[str]) -> list[int]:
    """How many equal pieces are in front of each, in rows of three or more."""
    return [k for _, run in itertools.groupby(pieces) for n in [len(list(run))] for k in (range(n) if n > 2 else [0] * n)]


def _edges(piece: str, again: int) -> list[list[tuple[str, float]]]:
    """The lattice of a piece of a run; a letter set apart that repeats the one before may stand for nothing."""
    out = lattice(piece)
    return [[*edges, ("", COST_REPEAT)] for edges in out] if again and len(piece) == 1 else out


def respace(pieces: list[str], model: CharModel) -> list[tuple[int, str]]:
    """The likeliest words of a run of pieces, each with the number of pieces that it is made of; by Viterbi
    over the last two letters and, as long as it begins a known word, all that there is of the word."""
    known, cost, again = model.beginnings, functools.cache(model.cost), _again(pieces)

    def put(states: dict, key: tuple, value: tuple) -> None:
        if key not in states or value[0] < states[key][0]:
            states[key] = value

    def ended(last: str, word: str | None, spent: float, bare: float) -> float:
        return min(spent + cost(last, " "), bare + known.get(word, math.inf))

    # (last two letters, beginning of a known word or None): cost, cost without the letters of this word, path
    best: dict[tuple, tuple] = {("  ", ""): (0.0, 0.0, None)}
    for i, piece in enumerate(pieces):
        if i:
            after: dict[tuple, tuple] = {}
            drop, keep = COST_SPACE if len(piece) == len(pieces[i - 1]) == 1 else COST_SPACE[::-1]
            for (last, word), (spent, bare, path) in best.items():
                put(after, (last, word), (spent + drop, bare + drop, path))
                end = ended(last, word, spent, bare) + keep
                put(after, ("  ", ""), (end, end, (path, " ")))
            best = after
        for edges in _edges(piece, again[i]):
            after = {}
            for (last, word), (spent, bare, path) in best.items():
                for text, charge in edges:
                    total, end = spent + charge, last
                    for c in text:
                        total += cost(end, c)
                        end = end[1] + c
                    whole = None if word is None or word + text not in known else word + text
                    put(after, (end, whole), (total, bare + charge, (path, text)))
            best = after
        best = {k: (spent, bare, (path, "\n")) for k, (spent, bare, path) in best.items()}  # the piece ends
    path = min(((ended(*k, *v[:2]), v[2]) for k, v in best.items()), key=lambda x: x[0])[1]
    texts = []
    while path is not None:
        path, text = path
        texts.append(text)
    return [(w.count("\n"), w.replace("\n", "")) for w in "".join(reversed(texts)).split(" ")]


def disguised(word: str) -> bool:
    if word.isascii():
        return _DISGUISED.search(word) is not None and _LETTER.search(word) is not None
    if _ODD.search(word) and (_UNSEEN.search(word) or _LATIN.search(word)):
        return True
    return _DISGUISED.search(word) is not None and _LETTER.search(word) is not None


def trim(token: str) -> str:
    """A lower-case token without runs of signs and without punctuation around it."""
    return _SIGN_RUN.sub("", token.lower()).strip(".,;:?\"'()[]{}-_~`&=/\\^")


def restore(token: str, model: CharModel | None) -> str:
    word = trim(token)
    return decode(word, model) if model is not None and disguised(word) else word


def features(word: str) -> list[str]:
    return [word + " ", *(word[:n] for n in PREFIXES if len(word) >= n)]


def spaced(words: list[str]) -> list[str]:
    """Runs of at least three single characters, joined."""
    out = []
    for single, run in itertools.groupby(words, lambda w: len(w) == 1):
        if single and len(run := list(run)) >= 3:
            out.append("".join(run))
    return out


def pieces_of(words: list[str]) -> list[list[str]]:
    """Runs of at least two short words, with a letter."""
    runs = (list(run) for short, run in itertools.groupby(words, lambda w: 0 < len(w) <= SHORT) if short)
    return [run for run in runs if len(run) > 1 and any(map(_LETTER.search, run))]


@dataclass
class Model:
    chars: CharModel
    evidence: dict[str, float]
    weights: np.ndarray
    share: float

    def word(self, word: str) -> float:
        if word[:4] not in self.heads:
            return 0.0
        return max((self.evidence.get(f, 0.0) for f in features(word)), default=0.0)

    @functools.cached_property
    def heads(self) -> set[str]:
        """What a word with evidence begins with: four letters, or all of a shorter word."""
        return {f.strip()[:4] for f in self.evidence}

    @functools.cached_property
    def stems(self) -> set[str]:
        """What the features with evidence begin with."""
        return {f[:k] for f in self.evidence for k in range(len(f))}

    def may_tell(self, pieces: list[str]) -> bool:
        """Whether any reading of a run of pieces has a word with evidence, from the beginning of a piece on."""
        edges, known, stems = [_edges(p, again) for p, again in zip(pieces, _again(pieces), strict=True)], self.evidence, self.stems
        for i in range(len(pieces)):
            states = {""}
            for piece in edges[i:]:
                for choices in piece:
                    after = set()
                    for state in states:
                        for text, _ in choices:
                            read = state + text
                            if read in known or len(text) > 1 and read[:-1] in known:
                                return True
                            if read in stems:
                                after.add(read)
                    states = after
                    if not states:
                        break
                if not states:
                    break
                if any(state + " " in known for state in states):
                    return True
        return False

    def restored(self, pieces: list[str]) -> list[tuple[str, float]]:
        """Words with evidence that pieces of a run make together. Runs that can't have any aren't decoded."""
        if not any(map(_LETTER.search, pieces)) or not self.may_tell(pieces):
            return []
        return [(w, p) for n, w in respace(pieces, self.chars) if n > 1 and (p := self.word(w))]

    def tokens(self, tokens: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Trimmed tokens, and the evidence of each token as restored."""
        words = [trim(t.decode("utf-8", "replace")) for t in tokens]
        found = np.zeros(len(words))
        for i, w in enumerate(words):
            if disguised(w):
                w = decode(w, self.chars) if self.may_tell([w]) else ""
            elif _TWICE.search(w) and _TWICE.sub(r"\1", w) + " " in self.evidence:
                w = decode(w, self.chars)
            found[i] = self.word(w)
        return words, found

    def signals(self, texts: list[bytes | None]) -> np.ndarray:
        """Text x (1, evidence of the three strongest distinct words, log of the number of strong words' places,
        log of the length, square of the strongest).

        Evidence counts as in a noisy or: the logarithm of how much rarer harmless texts with the word are.
        """
        vocabulary = Vocabulary()
        ids = [vocabulary.encode([] if t is None else t.lower().split()) for t in texts]
        words, evidence = self.tokens(vocabulary.words())
        short = np.array([0 < len(w) <= SHORT for w in words], bool)
        runs: dict[bytes, list[tuple[str, float]]] = {}
        out = np.zeros((len(texts), 7))
        out[:, 0] = 1
        for i, own in enumerate(ids):
            strong = sorted({int(k) for k in own[evidence[own] > 0]}, key=lambda k: (-evidence[k], k))
            found = {words[k]: evidence[k] for k in strong}
            places = int((evidence[own] > 0.6).sum())
            edges = np.flatnonzero(np.diff(short[own], prepend=False, append=False))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if b - a < 2:
                    continue
                if (key := own[a:b].tobytes()) not in runs:
                    runs[key] = self.restored([words[k] for k in own[a:b]])
                for word, p in runs[key]:
                    found[word] = max(p, found.get(word, 0.0))
                    places += p > 0.6
            top = sorted(found.values(), reverse=True)[:3]
            out[i, 1 : 1 + len(top)] = [-math.log(1 - p + 0.01) for p in top]
            out[i, 4] = math.log1p(places)
            out[i, 5] = math.log1p(len(own))
            out[i, 6] = out[i, 1] ** 2
        return out

    def score(self, signals: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(signals), self.share)
        return 1 / (1 + np.exp(-np.clip(signals @ self.weights, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, each: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = x.T @ (x * (each * p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        w = w - np.linalg.solve(hessian, x.T @ (each * (p - y)) + ridge * w)
    return w


def _lower_bound(hits: float, n: float, z: float = 1.28) -> float:
    """Wilson's lower bound of a share."""
    p = hits / n
    return (p + z * z / 2 / n - z * math.sqrt(p * (1 - p) / n + z * z / 4 / n / n)) / (1 + z * z / n)


def _count(docs: DataFrame, only: set[str] | None, model: CharModel | None) -> DataFrame:
    """(toxic, feature, n): in how many texts each feature is; with ``only``, of these features."""
    shipped = docs.sparkSession.sparkContext.broadcast((only, model))
    out = pa.schema([("toxic", pa.int32()), ("feature", pa.string()), ("n", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only, model = shipped.value
        held = (Counter(), Counter())
        for part in parts:
            for t, toxic in zip(bytes_of(part.column("text")), part.column("toxic").to_pylist(), strict=True):
                words = {restore(w.decode("utf-8", "replace"), model) for w in set((t or b"").lower().split())}
                found = {f for w in words if w for f in features(w)}
                held[toxic].update(found if only is None else found & only)
        rows = [{"toxic": k, "feature": f, "n": n} for k in (0, 1) for f, n in held[k].items()]
        for i in range(0, len(rows), 20000):
            yield pa.RecordBatch.from_pylist(rows[i : i + 20000], out)

    return docs.mapInArrow(run, "toxic int, feature string, n long").groupBy("toxic", "feature").agg(F.sum("n").alias("n"))


def learn_letters(docs: DataFrame) -> CharModel:
    """Trigrams of the Latin words (two letters or more) of all ``docs`` (text); only counts per trigram return."""
    out = pa.schema([("gram", pa.int64()), ("n", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for piece in slices(part, 5000, 8 << 20):
                words = Counter(itertools.chain.from_iterable(t.translate(_LETTERS).split() for t in bytes_of(piece.column("text")) if t))
                kept = [(w.decode("utf-8", "replace"), n) for w, n in words.items() if len(w) > 1]
                kept = [(w, n) for w, n in kept if w.isascii() or (w.isalpha() and max(w) < "\u0250")]
                if not kept:
                    continue
                codes = np.frombuffer("".join(f"  {w} " for w, _ in kept).encode("utf-32-le"), np.uint32).astype(np.int64)
                sizes = np.array([len(w) for w, _ in kept])
                starts = np.cumsum(sizes + 3) - sizes - 3
                at = np.arange(int((sizes + 1).sum())) + np.repeat(starts - np.cumsum(sizes + 1) + sizes + 1, sizes + 1)
                grams, which = np.unique(codes[at] << 42 | codes[at + 1] << 21 | codes[at + 2], return_inverse=True)
                n = np.bincount(which, np.repeat([n for _, n in kept], sizes + 1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n)], schema=out)

    summed = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).orderBy("gram").toArrow()
    model = CharModel()
    for gram, n in zip(summed["gram"].to_pylist(), summed["n"].to_pylist(), strict=True):
        text = "".join(chr(gram >> k & (1 << 21) - 1) for k in (42, 21, 0))
        model.counts[text] += n
        model.context[text[:2]] += n
    return model


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 12000) -> Model:
    """Learn letters from all ``docs`` (doc_id, text), the rest from labelled ones: labels (doc_id, toxic 0 or 1)."""
    labels = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    of_toxic, of_harmless = 1.0, 1.0
    if sum(rows.values()) > max_rows:
        of_toxic = min(1.0, max_rows / 2 / max(1, rows.get(1, 0)))
        of_harmless = min(1.0, max(max_rows / 2, max_rows - rows.get(1, 0)) / max(1, rows.get(0, 0)))
        share = F.when(F.col("toxic") == 1, of_toxic).otherwise(of_harmless)
        labels = labels.filter((share >= 1) | sampled("doc_id", share))
    each = of_toxic / of_harmless  # harmless texts that one in the sample stands for, where a toxic one stands for itself
    labelled = materialize(docs.filter("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(labels), "doc_id"))
    texts = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    toxic, harmless = texts.get(1, 0), texts.get(0, 0)
    share = toxic / max(1, toxic + harmless * each)
    if not toxic or not harmless:
        return Model(CharModel(), {}, np.zeros(0), share)
    chars = learn_letters(docs)
    least = max(2, toxic // 400)

    def counted(model: CharModel | None) -> tuple[dict[str, int], dict[str, float]]:
        """Features of at least ``least`` toxic texts, and in how many toxic and harmless texts they are."""
        common = {r["feature"]: r["n"] for r in _count(labelled.filter("toxic = 1"), None, model).filter(F.col("n") >= least).toLocalIterator()}
        return common, {r["feature"]: r["n"] * each for r in _count(labelled.filter("toxic = 0"), set(common), model).toLocalIterator()}

    def strength(n: int, against: float) -> float:
        low = _lower_bound(n, n + against)
        return low if low > min(0.9, 2.5 * share) and low > 0.3 else 0.0

    common, against = counted(None)
    for f, n in sorted(common.items()):  # known words are those written in letters; a disguise goes for words that tell
        if f.endswith(" ") and f[:-1].isalpha():
            chars.words[f[:-1]] = n + against.get(f, 0) + DISGUISED_MORE * n * (strength(n, against.get(f, 0)) > 0)
    common, against = counted(chars)
    evidence = {f: p for f, n in sorted(common.items()) if (p := strength(n, against.get(f, 0)))}
    model = Model(chars, evidence, np.zeros(0), share)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    out = pa.schema([("x", pa.list_(pa.float64())), ("toxic", pa.int32())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = shipped.value.signals(bytes_of(part.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), out.field("x").type), part.column("toxic")], schema=out)

    seen = labelled.mapInArrow(run, "x array<double>, toxic int").toPandas()  # at most about max_rows rows
    order = np.lexsort((seen["toxic"], *np.array(seen["x"].tolist()).T))
    y = seen["toxic"].to_numpy(float)[order]
    model.weights = _logistic(np.array(seen["x"].tolist())[order], y, np.where(y > 0, 1.0, each))
    return model


def score_toxicity(docs: DataFrame, model: Model, with_restored: bool = False) -> DataFrame:
    """``docs`` with score; ``with_restored`` adds the disguised words and what they were read as."""
    own = [c for c in docs.columns if c not in ("score", "restored")]
    ddl = "score double" + ", restored array<struct<token:string,word:string>>" * with_restored
    schema = T.StructType(docs.select(*own).schema.fields + T.StructType.fromDDL(ddl).fields)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    pair = pa.list_(pa.struct([("token", pa.string()), ("word", pa.string())]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for part in parts:
            for piece in slices(part, 5000, 8 << 20):
                texts = bytes_of(piece.column("text"))
                columns = [piece.column(c) for c in own] + [pa.array(m.score(m.signals(texts)))]
                if with_restored:
                    listed = []
                    for t in texts:
                        tokens = (t or b"").decode("utf-8", "replace").split()
                        found = [{"token": x, "word": restore(x, m.chars)} for x in tokens if disguised(trim(x))]
                        for run in pieces_of([trim(x) for x in tokens]):
                            at = iter(run)
                            split = [(list(itertools.islice(at, n)), w) for n, w in respace(run, m.chars)]
                            found += [{"token": " ".join(own), "word": w} for own, w in split if len(own) > 1]
                        listed.append(found)
                    columns.append(pa.array(listed, pair))
                yield pa.RecordBatch.from_arrays(columns, names=[*own, "score", *["restored"] * with_restored])

    return docs.select(*own).mapInArrow(run, schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out().alias("held_out"))
    model = train(docs.filter(~F.col("held_out")), table(spark, sf_dir, "labels").filter(~held_out()))
    return score_toxicity(docs, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
