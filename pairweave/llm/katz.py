"""Katz backoff language model of order two, counted and evaluated over the whole corpus.

    P(w | v) = d(c(v, w)) c(v, w) / c(v)      if (v, w) was seen in training
             = alpha(v) P(w)                  otherwise, and P(w) likewise backs off to the unseen word
    P(w)     = d(c(w)) c(w) / N               if w was seen, else the mass left over

d are Good-Turing discounts of counts up to ``cut``; alpha(v) = (1 - sum of the discounted
P(. | v)) / (1 - sum of P(w) over the same w), so that each distribution sums to one over the seen
words and one unseen word. Where discounting leaves a context no mass (all its counts are large),
its denominator grows by one. Text begins in a context of its own and ends with an end token.

Scale: tokens are not shuffled one by one. Texts are packed into chunks of about ``chunk_tokens``
tokens. Each chunk asks for its distinct words and then for its distinct pairs; requests go to
shards of the tables by hash, packed as byte planes, and the answers come back in the order of the
request. A context with more than a share of a shard (``the`` may hold a twentieth of all pairs) is
dealt over several shards by the second word; its sums are put together from all of them. The
number of shards grows with the input, the size of a shard doesn't. Chunks times shards is the number
of requests: it grows with the square of the tokens until a request holds one key, and from there (at
some terabytes) with the tokens, so that for much larger corpora ``chunk_tokens`` and
``shard_tokens`` should grow with the memory of an executor. Both tables (words, pairs) are
written, partitioned by kind and shard; the driver receives counts of counts only.

Words are told apart by 64-bit hashes. Cases: null text is empty and consists of its end token; a
null identifier belongs to the training texts; with nothing to learn from, every token has
probability one; repeated rows count as often as they come; a very long text is part of one chunk,
which it may make longer; words of one count share their discount (there are no other ties); an empty
table gives an empty result; other columns are not used, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairweave.llm.common import Vocabulary, bytes_of, materialize, pack, release, remainder, table, unpack

#: Numbers of the end token and of the context that texts begin in, in every chunk, and their hashes.
END, BEGIN = 0, 1
_SPECIAL = np.array([1, 2], np.uint64)

_CHUNK = pa.schema(
    [("chunk", pa.int64()), ("shard", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.binary())]
    + [("tokens", pa.binary()), ("hashes", pa.binary()), ("spots", pa.binary()), ("counts", pa.binary())]
)
_CHUNK_DDL = "chunk long, shard int, doc_ids array<long>, held array<boolean>, lengths binary, tokens binary, hashes binary, spots binary, counts binary"


def good_turing(seen: list[float], cut: int) -> np.ndarray:
    """Discounts d[0..cut] from counts of counts seen[0..cut + 1]; 1 where the estimate isn't usable."""
    d = np.ones(cut + 1)
    if seen[1] > 0:
        common = (cut + 1) * seen[cut + 1] / seen[1]
        for r in range(1, cut + 1):
            if seen[r] > 0 and seen[r + 1] > 0 and common < 1:
                x = ((r + 1) * seen[r + 1] / seen[r] / r - common) / (1 - common)
                d[r] = x if 0 < x < 1 else 1
    return d


@dataclass
class Unigrams:
    """Counts of counts and what follows from them."""

    total: int
    distinct: int
    seen: list[float]
    cut: int
    d: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.d = good_turing(self.seen, self.cut)
        small = np.arange(self.cut + 1)
        held = self.total - float(((1 - self.d) * small * np.array(self.seen[: self.cut + 1])).sum())
        left = self.total - held
        self.over = self.total if left > 1e-9 else self.total + 1
        self.unseen = (left if left > 1e-9 else 1) / self.over

    def prob(self, counts: np.ndarray) -> np.ndarray:
        c = counts.astype(np.int64)
        return np.where(c > 0, c * self.d[np.where(c <= self.cut, c, 0)] / self.over, self.unseen)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts.astype(np.float64) + 1) / (self.total + self.distinct + 1))


def _chunks(docs: DataFrame, chunk_tokens: int) -> DataFrame:
    """docs: doc_id, text, held."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        vocabulary, held = Vocabulary(), []

        def flush() -> pa.RecordBatch:
            nonlocal vocabulary, held, number
            words = vocabulary.words()
            hashes = np.concatenate((_SPECIAL, np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))))
            tokens = [x for _, _, ids in held for x in (ids + 2, np.array([END]))]
            lengths = np.array([len(ids) + 1 for _, _, ids in held])
            joined = np.concatenate(tokens)
            train = np.repeat(~np.array([h for _, h, _ in held]), lengths)
            row = {"chunk": number, "shard": -1, "doc_ids": [d for d, _, _ in held], "held": [h for _, h, _ in held], "lengths": pack(lengths)}
            row |= {"tokens": pack(joined), "hashes": hashes.tobytes(), "spots": spots_of(hashes).tobytes(), "counts": pack(np.bincount(joined[train], minlength=len(hashes)))}
            vocabulary, held, number = Vocabulary(), [], number + 1
            return pa.RecordBatch.from_pylist([row], _CHUNK)

        size = 0
        for part in parts:
            for d, h, t in zip(part.column("doc_id").to_pylist(), part.column("held").to_pylist(), bytes_of(part.column("text")), strict=True):
                ids = vocabulary.encode([] if t is None else t.lower().split())
                held.append((d, h, ids))
                size += len(ids) + 1
                if size >= chunk_tokens:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return materialize(docs.mapInArrow(run, _CHUNK_DDL))


def spots_of(hashes: np.ndarray) -> np.ndarray:
    """What decides a word's shard: the low half of its hash, as later steps need no more of it."""
    return (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)


_ASK = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def _ask_words(chunks: DataFrame, shards: int) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                hashes, counts = np.frombuffer(row["hashes"], np.uint64), unpack(row["counts"])
                order, cuts = _deal(spots_of(hashes) % np.uint32(shards), shards)
                yield pa.RecordBatch.from_pylist(
                    [{"shard": s, "chunk": row["chunk"], "keys": hashes[order[a:b]].tobytes(), "counts": pack(counts[order[a:b]])} for s, (a, b) in enumerate(cuts) if a < b], _ASK
                )

    return chunks.select("chunk", "hashes", "counts").mapInArrow(run, "shard int, chunk long, keys binary, counts binary")


def _deal(shard: np.ndarray, shards: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """A stable order by shard, and each shard's part of it."""
    order = np.argsort(shard.astype(np.int32), kind="stable")
    ends = np.cumsum(np.bincount(shard.astype(np.int64), minlength=shards))
    return order, list(zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist(), strict=True))


_WORDS = pa.schema(
    [("kind", pa.string()), ("shard", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("total", pa.int64()), ("seen", pa.list_(pa.int64()))]
)
_WORDS_DDL = "kind string, shard int, chunk long, keys binary, counts binary, total long, seen array<long>"


def _counts_of_counts(counts: np.ndarray, cut: int) -> list[int]:
    """Number of distinct keys, then of keys seen 1 .. cut + 1 times."""
    small = np.bincount(counts[counts <= cut + 1].astype(np.int64), minlength=cut + 2)
    return [int((counts > 0).sum()), *small[1:].tolist()]


def _word_shard(cut: int, shards: int):
    """Answers: a number for each word (unique over all shards) and its count in training."""

    def run(rows: pa.Table) -> pa.Table:
        shard = rows.column("shard")[0].as_py()
        keys = [np.frombuffer(x, np.uint64) for x in rows.column("keys").to_pylist()]
        words, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        asked = np.concatenate([unpack(x) for x in rows.column("counts").to_pylist()])
        counts = np.bincount(inverse, asked, len(words)).astype(np.int64)
        listed = counts * (words != _SPECIAL[BEGIN])
        out = [{"kind": "table", "shard": shard, "chunk": -1, "keys": words.tobytes(), "counts": pack(listed), "total": int(listed.sum()), "seen": _counts_of_counts(listed, cut)}]
        at = 0
        for chunk, own in zip(rows.column("chunk").to_pylist(), keys, strict=True):
            mine = inverse[at : at + len(own)]
            at += len(own)
            out.append({"kind": "answer", "shard": shard, "chunk": chunk, "keys": pack(mine * shards + shard), "counts": pack(counts[mine])})
        return pa.Table.from_pylist(out, _WORDS)

    return run


@dataclass
class Chunk:
    """A chunk with numbers and counts of its words, and its distinct pairs in the order of requests."""

    doc_ids: list
    held: np.ndarray
    lengths: np.ndarray
    tokens: np.ndarray
    words: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, rows: list[dict], shards: int) -> Chunk:
        row = next(r for r in rows if r["shard"] < 0)
        spots = np.frombuffer(row["spots"], np.uint32)
        order, cuts = _deal(spots % np.uint32(shards), shards)
        words, counts = np.zeros(len(spots), np.uint64), np.zeros(len(spots), np.int64)
        for r in rows:
            if r["shard"] >= 0 and r["keys"] is not None:
                a, b = cuts[r["shard"]]
                words[order[a:b]], counts[order[a:b]] = unpack(r["keys"]), unpack(r["counts"])
        return cls(row["doc_ids"], np.array(row["held"], bool), unpack(row["lengths"]).astype(np.int64), unpack(row["tokens"]).astype(np.int64), words, counts)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and second word of each distinct pair, its count in training, and the pair of each token."""
        ends = np.cumsum(self.lengths)
        before = np.concatenate(([BEGIN], self.tokens[:-1]))
        before[ends[:-1]] = BEGIN
        n = len(self.words)
        pairs, which = np.unique(before * n + self.tokens, return_inverse=True)
        train = np.repeat(~self.held, self.lengths)
        return pairs // n, pairs % n, np.bincount(which[train], minlength=len(pairs)), which

    def context_counts(self) -> np.ndarray:
        """How often each word precedes a token in training; the begin counts once per text, as the end does."""
        out = self.counts.copy()
        out[BEGIN], out[END] = self.counts[END], 0
        return out

    def requests(self, first: np.ndarray, second: np.ndarray, shards: int, hot: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each shard: the contexts it is asked about, and the pairs (by their number), ordered by context.

        A context with more than ``hot`` occurrences is dealt over several shards.
        """
        context = self.context_counts()
        asked = np.unique(first[context[first] > 0])
        salts = np.minimum(shards, np.ceil(context / hot)).astype(np.int64).clip(1)
        home = (self.words % np.uint64(shards)).astype(np.int64)
        spread = (self.words // np.uint64(shards) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
        copies = salts[asked]
        header = np.repeat(asked, copies)
        salt = np.arange(len(header)) - np.repeat(np.cumsum(copies) - copies, copies)
        known = np.flatnonzero((context[first] > 0) & (self.counts[second] > 0))
        v, w = first[known], second[known]
        order_v, cuts_v = _deal((home[header] + salt) % shards, shards)
        order_p, cuts_p = _deal((home[v] + spread[w] % salts[v]) % shards, shards)
        return [(header[order_v[a:b]], known[order_p[c:d]]) for (a, b), (c, d) in zip(cuts_v, cuts_p, strict=True)]


_PAIRS = pa.schema([("shard", pa.int32()), ("chunk", pa.int64())] + [(x, pa.binary()) for x in ("contexts", "lengths", "seconds", "counts", "second_counts")])
_PAIRS_DDL = "shard int, chunk long, contexts binary, lengths binary, seconds binary, counts binary, second_counts binary"


def _ask_pairs(shards: int, hot: float):
    def run(rows: pa.Table) -> pa.Table:
        listed = rows.to_pylist()
        chunk = Chunk.of(listed, shards)
        first, second, counts, _ = chunk.pairs()
        out = []
        for shard, (contexts, pairs) in enumerate(chunk.requests(first, second, shards, hot)):
            if len(contexts):
                lengths = np.bincount(np.searchsorted(contexts, first[pairs]), minlength=len(contexts))
                row = {"shard": shard, "chunk": listed[0]["chunk"], "contexts": pack(chunk.words[contexts]), "lengths": pack(lengths)}
                out.append(row | {"seconds": pack(chunk.words[second[pairs]]), "counts": pack(counts[pairs]), "second_counts": pack(chunk.counts[second[pairs]])})
        return pa.Table.from_pylist(out, _PAIRS)

    return run


_FOUND = pa.schema(
    [("kind", pa.string()), ("shard", pa.int32()), ("chunk", pa.int64()), ("counts", pa.binary()), ("small", pa.binary()), ("large", pa.binary()), ("mass", pa.binary())]
    + [("contexts", pa.binary()), ("seconds", pa.binary()), ("seen", pa.list_(pa.int64()))]
)
_FOUND_DDL = "kind string, shard int, chunk long, counts binary, small binary, large binary, mass binary, contexts binary, seconds binary, seen array<long>"


def _pair_shard(unigrams: Unigrams):
    """Answers: the count of each pair; of each context, how many pairs it has by count, and their P(w)."""
    cut = unigrams.cut

    def run(rows: pa.Table) -> pa.Table:
        shard = rows.column("shard")[0].as_py()
        take = lambda name: [unpack(x) for x in rows.column(name).to_pylist()]
        contexts, lengths, seconds, asked, second_counts = map(take, ("contexts", "lengths", "seconds", "counts", "second_counts"))
        # numbers within the shard, so that a pair is one 64-bit key however many words there are
        vs, v_all = np.unique(np.concatenate(contexts), return_inverse=True)
        ws, w_at, w_all = np.unique(np.concatenate(seconds), return_index=True, return_inverse=True)
        n = max(1, len(ws))
        keys = np.repeat(v_all, np.concatenate(lengths).astype(np.int64)) * n + w_all
        pairs, inverse = np.unique(keys, return_inverse=True)
        counts = np.bincount(inverse, np.concatenate(asked), len(pairs)).astype(np.int64)
        owner, mate = pairs // n, pairs % n
        prob = unigrams.prob(np.concatenate(second_counts)[w_at]) if len(ws) else np.zeros(0)
        small = np.array([np.bincount(owner[counts == r], minlength=len(vs)) for r in range(1, cut + 1)]).reshape(cut, len(vs))
        large = np.bincount(owner, counts * (counts > cut), len(vs))
        mass = np.bincount(owner, prob[mate] * (counts > 0), len(vs))
        kept = counts > 0
        out = [{"kind": "table", "shard": shard, "chunk": -1, "contexts": pack(vs[owner[kept]]), "seconds": pack(ws[mate[kept]]), "counts": pack(counts[kept]), "seen": _counts_of_counts(counts, cut)}]
        a = b = 0
        for chunk, v, w in zip(rows.column("chunk").to_pylist(), contexts, seconds, strict=True):
            mine = v_all[a : a + len(v)]
            row = {"kind": "answer", "shard": shard, "chunk": chunk, "counts": pack(counts[inverse[b : b + len(w)]]), "small": pack(small[:, mine].ravel())}
            out.append(row | {"large": pack(large[mine]), "mass": mass[mine].tobytes()})
            a, b = a + len(v), b + len(w)
        return pa.Table.from_pylist(out, _FOUND)

    return run


_SCORED = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
)
_SCORED_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(unigrams: Unigrams, d: np.ndarray, shards: int, hot: float):
    cut = unigrams.cut

    def run(rows: pa.Table) -> pa.Table:
        listed = rows.to_pylist()
        chunk = Chunk.of([r for r in listed if r["pair_counts"] is None], shards)
        first, second, _, which = chunk.pairs()
        n = len(chunk.words)
        found = np.zeros(len(first), np.int64)
        small, large, mass = np.zeros((cut, n)), np.zeros(n), np.zeros(n)
        asked = chunk.requests(first, second, shards, hot)
        for r in listed:
            if r["pair_counts"] is not None:
                contexts, pairs = asked[r["shard"]]
                found[pairs] = unpack(r["pair_counts"])
                small[:, contexts] += unpack(r["small"]).reshape(cut, len(contexts))
                large[contexts] += unpack(r["large"])
                mass[contexts] += np.frombuffer(r["mass"])
        times = np.arange(1, cut + 1)[:, None]
        total = (small * times).sum(0) + large
        kept = (small * times * d[1:, None]).sum(0) + large
        bare = total - kept <= 1e-9  # discounts leave nothing: one more in the denominator
        over = total + bare
        left = np.where(total > 0, 1 - kept / np.maximum(over, 1), 1)
        alpha = left / (1 - mass)
        prob = unigrams.prob(chunk.counts)
        seen = found * d[np.where(found <= cut, found, 0)] / np.maximum(over, 1)[first]
        log = np.log10(np.where(found > 0, seen, alpha[first] * prob[second]))
        starts = np.cumsum(chunk.lengths) - chunk.lengths
        sums = lambda x: np.add.reduceat(x, starts)
        known, base = (chunk.counts > 0).astype(np.int64), unigrams.base(chunk.counts)
        columns = [pa.array(chunk.doc_ids, pa.int64()), pa.array(chunk.held), pa.array(chunk.lengths), pa.array(sums(known[chunk.tokens]))]
        columns += [pa.array(np.full(len(starts), unigrams.total)), pa.array(sums(base[chunk.tokens])), pa.array(sums(log[which]))]
        return pa.Table.from_arrays(columns, schema=_SCORED)

    return run


def katz_scores(docs: DataFrame, cut: int = 5, chunk_tokens: int = 1_500_000, shard_tokens: int = 1_500_000) -> DataFrame:
    """Learn from the rows of ``docs`` (doc_id, text, held) that aren't held and score all of them."""
    spark = docs.sparkSession
    chunks = _chunks(docs.select("doc_id", "text", F.coalesce("held", F.lit(False)).alias("held")), chunk_tokens)
    size = chunks.agg(F.coalesce(F.sum(F.octet_length("tokens")), F.lit(0))).first()[0] // 2  # about the number of tokens
    shards = int(max(64, size // shard_tokens))
    by_shard = _ask_words(chunks, shards).groupBy("shard")
    words = materialize(by_shard.applyInArrow(_word_shard(cut, shards), _WORDS_DDL), partition_by=["kind"]).select(*_WORDS.names)
    seen = [F.sum(F.get("seen", F.lit(r))).alias(f"n{r}") for r in range(cut + 2)]
    found = words.filter("kind = 'table'").agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), *seen).first()
    unigrams = Unigrams(found["total"], found["n0"] or 0, [0, *((found[f"n{r}"] or 0) for r in range(1, cut + 2))], cut)
    hot = max(1.0, unigrams.total / shards / 4)
    release(spark)

    answers = words.filter("kind = 'answer'").select("chunk", "shard", "keys", "counts")
    payload = chunks.select("chunk", "shard", "doc_ids", "held", "lengths", "tokens", "spots")
    known = payload.unionByName(answers, allowMissingColumns=True)
    requests = known.groupBy("chunk").applyInArrow(_ask_pairs(shards, hot), _PAIRS_DDL)
    pairs = materialize(requests.groupBy("shard").applyInArrow(_pair_shard(unigrams), _FOUND_DDL), partition_by=["kind"]).select(*_FOUND.names)
    counted = pairs.filter("kind = 'table'").agg(*seen).first()
    d = good_turing([0, *((counted[f"n{r}"] or 0) for r in range(1, cut + 2))], cut)
    del requests
    release(spark)

    replies = pairs.filter("kind = 'answer'").select("chunk", "shard", F.col("counts").alias("pair_counts"), "small", "large", "mass")
    both = known.unionByName(replies, allowMissingColumns=True)
    return both.groupBy("chunk").applyInArrow(_score(unigrams, d, shards, hot), _SCORED_DDL)


def op5_katz_scores(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return katz_scores(docs.select("doc_id", "text", F.coalesce(remainder(7) == 2, F.lit(False)).alias("held")))
