"""Benchmark decontamination with one Aho-Corasick automaton.

The automaton holds every window of ``window`` consecutive normalised words of every benchmark
item (an item of fewer words is one window). Each text is normalised once, scanned once, and the
offsets of the hits are mapped back to the original text.

Normal form: ASCII upper case is lowered; a word is a maximal run of ASCII letters, ASCII digits
and non-ASCII characters. Words are joined by single spaces, with a space at both ends, so that a
window can only match whole words.

Scale: documents are never shuffled. The automaton is shipped to the executors, where 1 MB of windows
takes about 50 MB of each Python worker, so the size of the benchmark is checked first. Where its
windows are more than ``max_bytes`` of text, a first pass over the documents looks their 64-bit hashes
up (8 bytes a window, in ranges of ``max_hashes``) and only windows that some document has by their
hash enter the automaton, which then decides. Should these still be more than ``max_bytes``, they are
dealt to several automata, applied one after the other, each pass reading the table of the one before.

Cases: null text has no words; null benchmark text and items without words match nothing; an item
with a null identifier counts in ``n_items`` but has no name to list; rows of the benchmark with
the same identifier count as one item; windows of several items are one pattern of all of them;
repeated document rows are kept as they are; very long texts are scanned whole; an empty table on
either side is no error; columns of the input with the names added here are replaced by
``find_contamination`` and kept by ``remove_contaminated``.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairweave.llm.common import SQL_LOWER, bytes_of, materialize, mix64, set_aside, table

_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_RUN = re.compile(rb"[^ ]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPANS = "array<struct<start:int,end:int>>"


def normal_words(text: bytes | None) -> list[bytes]:
    return [] if text is None else text.translate(_NORMAL).split()


def windows(text: bytes | None, size: int) -> set[bytes]:
    words = normal_words(text)
    last = max(1, len(words) - size + 1) if words else 0
    return {b" " + b" ".join(words[i : i + size]) + b" " for i in range(last)}


_BUILT: dict[str, ahocorasick.Automaton] = {}


def _automaton(shipped, name: str) -> ahocorasick.Automaton:
    """Built once in each Python worker."""
    if name not in _BUILT:
        _BUILT.clear()
        found = ahocorasick.Automaton()
        for pattern, items in shipped.value:
            found.add_word(pattern.decode("latin-1"), (len(pattern), items))
        if len(found):
            found.make_automaton()
        _BUILT[name] = found
    return _BUILT[name]


def scan(text: bytes | None, automaton) -> tuple[int, np.ndarray, set]:
    """Number of words, a flag for each word that is hit, and the items found."""
    if text is None:
        return 0, np.zeros(0, bool), set()
    words = text.translate(_NORMAL).split()
    hit, items = np.zeros(len(words), bool), set()
    if not words or not len(automaton):
        return len(words), hit, items
    joined = b" " + b" ".join(words) + b" "
    gaps = None
    for end, (length, own) in automaton.iter(joined.decode("latin-1")):
        if gaps is None:
            gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        first, last = np.searchsorted(gaps, (end - length + 1, end))
        hit[first:last] = True
        items.update(own)
    return len(words), hit, items


def spans(text: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words as code-point offsets into the original text."""
    places = [m.span() for m in _RUN.finditer(text.translate(_NORMAL))]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    starts = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [(int(starts[places[a][0]]), int(starts[places[b - 1][1]])) for a, b in edges.reshape(-1, 2)]


def _hashed(words: list[bytes], sizes: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each of ``sizes``, hashes of all runs of that many words."""
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    for n in sizes:
        rolled = np.full(max(0, len(own) - n + 1), np.uint64(n))
        for k in range(n if len(rolled) else 0):
            rolled = mix64(rolled * _MIX + own[k : len(own) - n + 1 + k])
        yield n, rolled


def _present(docs: DataFrame, benchmark: DataFrame, window: int, max_hashes: int) -> set[int]:
    """Hashes of the benchmark's windows that occur in ``docs``."""
    out = pa.schema([("n", pa.int32()), ("h", pa.int64())])

    def listed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for text in bytes_of(part.column("text")):
                words = normal_words(text)
                for n, h in _hashed(words, (min(window, len(words)),) if words else ()):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), n), pa.int32()), pa.array(h.view(np.int64))], schema=out)

    wanted = materialize(benchmark.select("text").mapInArrow(listed, "n int, h long").distinct())
    sizes = sorted(r["n"] for r in wanted.select("n").distinct().collect())
    ranges = -(-wanted.count() // max_hashes)
    found: set[int] = set()
    for k in range(ranges):
        part = wanted.filter(F.pmod(F.col("h"), F.lit(ranges)) == k).select("h").toArrow().column("h").to_numpy()
        shipped = docs.sparkSession.sparkContext.broadcast(np.sort(part.view(np.uint64)))

        def seen(parts: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            held = shipped.value
            for part in parts:
                own: set[int] = set()
                for text in bytes_of(part.column("text")):
                    for _, h in _hashed(normal_words(text), sizes):
                        at = np.searchsorted(held, h).clip(max=len(held) - 1)
                        own.update(h[held[at] == h].view(np.int64).tolist())
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64())], names=["h"])

        met = docs.select("text").mapInArrow(seen, "h long").distinct()
        found.update(met.toArrow().column("h").to_pylist())  # at most the benchmark's own windows
    return found


def _blocks(benchmark: DataFrame, window: int, max_bytes: int, present: set[int] | None = None) -> Iterator[list[tuple[bytes, tuple]]]:
    """Windows (of those with a hash in ``present``) with the items they come from, in blocks of a bounded size."""
    held, size = defaultdict(set), 0
    for row in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).toLocalIterator():
        for w in windows(None if row[1] is None else bytes(row[1]), window):
            if present is not None:
                words = w.split()
                if next(_hashed(words, (len(words),)))[1].view(np.int64)[0] not in present:
                    continue
            size += 0 if w in held else len(w)
            held[w].add(row[0])
        if size > max_bytes:
            yield [(w, tuple(x)) for w, x in held.items()]
            held, size = defaultdict(set), 0
    yield [(w, tuple(x)) for w, x in held.items()]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_bytes: int = 4 << 20, max_hashes: int = 4 << 20) -> DataFrame:
    """``docs`` with n_words, n_hit (words inside any window's occurrence), items, n_items and spans.

    Columns of ``docs`` with these names are replaced.
    """
    spark = docs.sparkSession
    names = {"n_words", "n_hit", "items", "n_items", "spans"}
    docs = docs.drop(*(c for c in docs.columns if c in names))
    own = docs.columns
    schema = T.StructType(docs.schema.fields + T.StructType.fromDDL(", ".join(f"{k} {v}" for k, v in _FOUND_FIELDS.items())).fields)
    found = docs
    if benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] * window > max_bytes:
        kept = _present(docs, benchmark, window, max_hashes)
        blocks = _blocks(benchmark, window, max_bytes, kept)
    else:
        blocks = _blocks(benchmark, window, max_bytes)
    for k, block in enumerate(blocks):
        if k:
            found = materialize(found)
        found = found.mapInArrow(_scanner(spark.sparkContext.broadcast(block), own, bool(k)), schema)
    return found


_FOUND_FIELDS = {"n_words": "long", "n_hit": "long", "items": "array<string>", "n_items": "long", "spans": _SPANS}


def _scanner(shipped, own: list[str], again: bool):
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    name = uuid.uuid4().hex

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shipped, name)
        for part in parts:
            texts = bytes_of(part.column("text"))
            n_words, n_hit, items, places = [], [], [], []
            for i, text in enumerate(texts):
                n, hit, found = scan(text, automaton)
                if again:
                    found |= set(part.column("items")[i].as_py())
                    for x in part.column("spans")[i].as_py():
                        starts = [m.span() for m in _RUN.finditer(text.translate(_NORMAL))]
                        chars = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
                        for j, (a, _) in enumerate(starts):
                            hit[j] |= x["start"] <= chars[a] < x["end"]
                n_words.append(n)
                n_hit.append(int(hit.sum()))
                items.append(sorted(found, key=lambda x: (x is None, x)))
                places.append([{"start": a, "end": b} for a, b in spans(text, hit)] if n_hit[-1] else [])
            columns = [part.column(c) for c in own]
            columns += [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string()))]
            columns += [pa.array([len(x) for x in items], pa.int64()), pa.array(places, span)]
            yield pa.RecordBatch.from_arrays(columns, names=[*own, *_FOUND_FIELDS])

    return run


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_share: float = 0.0) -> DataFrame:
    """Rows of ``docs`` of which no larger share of words than ``max_share`` is hit."""
    docs, own = set_aside(docs, _FOUND_FIELDS)
    found = find_contamination(docs, benchmark, window)
    return found.filter(F.col("n_hit") <= max_share * F.col("n_words")).select(*own)


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    named = F.array_sort(F.filter("items", lambda x: x.isNotNull()))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join(named, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP10_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce({SQL_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(coalesce({SQL_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
grams AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM sized, unnest(range(1, len(w) - k + 2)) u(i)),
places AS (SELECT r, i, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM d, (SELECT DISTINCT k FROM grams), unnest(range(1, len(w) - k + 2)) u(i)),
hits AS (SELECT r, i, k, item_id FROM places JOIN grams USING (k, g)),
words AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT r, i, k FROM hits), unnest(range(i, i + k)) u(j) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


def brute_force(texts: list[str | None], items: dict[str, str | None], window: int = 10) -> list[tuple[int, int, list[str]]]:
    """For tests: (n_words, n_hit, items) by comparing every window with every place."""
    out = []
    for text in texts:
        words = [] if text is None else text.encode().translate(_NORMAL).split()
        hit, found = set(), []
        for name, item in items.items():
            own = [] if item is None else item.encode().translate(_NORMAL).split()
            size = min(window, len(own))
            grams = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if size else set()
            at = [i for i in range(len(words) - size + 1) if tuple(words[i : i + size]) in grams] if size else []
            found += [name] * bool(at)
            hit |= {j for i in at for j in range(i, i + size)}
        out.append((len(words), len(hit), sorted(found)))
    return out


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
