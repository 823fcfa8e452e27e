"""Repeated byte strings by a column-wise transform of many documents at once.

Removed is every byte covered by a string of ``length`` bytes that also starts anywhere else.

A collection of strings is sorted column by column from the right: each round inserts one symbol
of every string in front of its suffix, which re-sorts the suffixes stably by that symbol (the
symbols in sorted order are the round's part of the Burrows-Wheeler transform) and updates the
common prefixes of neighbours: zero where symbols differ, else one more than the minimum between
the two in the round before. A string is repeated where a neighbour shares ``length`` symbols.

Inserting whole documents would take as many rounds as the longest has bytes, each over all that
is there. So documents are first cut so that strings can be aligned. In any window of ``length``
bytes, the ``gram``-byte substring with the smallest hash (the leftmost, on ties) is its anchor;
equal windows have equal anchors at equal offsets. Runs of windows with one anchor form a strip of
at most 2 * length bytes. Only strips of one anchor can share a window, and only at one alignment:
the columns of a collection are offsets from the anchor, and there are at most 2 * length rounds.

Strips that are equal as wholes are settled by a digest and enter collections once. An anchor that
occurs once is done. Groups of more than ``limit`` different strips (a passage in very many
documents) are cut into sub-runs of windows keyed by the bytes that all windows of the sub-run
share, in steps down to single windows, which are equal as wholes: no group grows with the input.

Scale: shuffled are the anchors (about 2 / (length - gram) rows a byte), the text once to fetch the
candidates' bytes, and once to remove spans. Counts are combined before shuffles, hot keys in joins
are salted or split by adaptive execution, and every step is written to shared space.

Cases: null text is empty; texts shorter than ``length`` keep all; very long texts are read in pieces
that overlap, so that no window is lost; equal hashes of grams go to the leftmost; repeated rows
repeat each other's bytes; null and repeated identifiers are kept apart by row keys from identifier
and text; an empty table gives an empty result; other columns are not used, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairweave.llm.common import bytes_of, materialize, mix64, release, table

_BITS = 20
#: Parts of a key in a join.
_SALTS = 8
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2 ** 64 and of its inverse."""
    if not _POWERS:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full((1 << _BITS) + 1, np.uint64(base))
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0], _POWERS[1]


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each full window, from running minima to both sides of block borders."""
    n = len(a) - width + 1
    padded = np.full(-(-len(a) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(a)] = a
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def strips(raw: np.ndarray, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Strips of texts that lie one after the other in ``raw`` (at most 2 ** 20 bytes).

    starts: where each text begins, and the end. Returns per strip: its text, first window (from
    the text's start), number of windows, offset of the anchor from the first window, hash of the
    anchor, and digest of the strip.
    """
    power, inverse = _powers()
    n = len(raw)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    grams = mix64((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
    low = np.uint64((1 << _BITS) - 1)
    at = (_sliding_min(grams & ~low | np.arange(len(grams), dtype=np.uint64), length - gram + 1) & low).astype(np.int64)
    sizes = np.diff(starts)
    text = np.repeat(np.arange(len(sizes)), sizes)[: len(at)]
    valid = np.arange(len(at)) + length <= starts[text + 1]
    p = np.flatnonzero(valid)
    if not len(p):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    fresh = np.concatenate(([True], (np.diff(p) > 1) | (np.diff(at[p]) != 0) | (np.diff(text[p]) != 0)))
    first = p[fresh]
    count = np.diff(np.concatenate((np.flatnonzero(fresh), [len(p)])))
    end = first + count - 1 + length
    digest = mix64((sums[end] - sums[first]) * inverse[first] * _ODD + (count << 16 | (at[first] - first)).astype(np.uint64))
    own = text[first]
    return own, first - starts[own], count, at[first] - first, grams[at[first]].view(np.int64), digest.view(np.int64)


_PIECE = (1 << _BITS) - 1


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts in groups of bounded size; a longer text is cut with an overlap that loses no window."""
    rows, offsets, held, size = [], [], [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - length + 1), _PIECE - length + 1):
            part = t[a : a + _PIECE]
            if size + len(part) > _PIECE:
                yield rows, offsets, held
                rows, offsets, held, size = [], [], [], 0
            rows.append(i)
            offsets.append(a)
            held.append(part)
            size += len(part)
    if held:
        yield rows, offsets, held


_STRIP = pa.schema([("h", pa.int64()), ("g", pa.int64()), ("lo", pa.int64()), ("m", pa.int32()), ("off", pa.int32()), ("anchor", pa.int64()), ("d", pa.int64()), ("n", pa.int64())])
_STRIP_DDL = "h long, g long, lo long, m int, off int, anchor long, d long, n long"


def _all_strips(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Strips, one row for each kind in a batch with its number there (n).

    Strips that a batch holds more than once are settled there: their windows also come as rows
    with a null anchor, runs that follow each other joined.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = bytes_of(part.column("text"))
            found = []
            for own, offsets, held in _pieces(texts, length):
                raw = np.frombuffer(b"".join(held), np.uint8)
                if len(raw) >= length:
                    k, lo, *rest = strips(raw, np.concatenate(([0], np.cumsum([len(x) for x in held]))), length, gram)
                    if len(k):
                        found.append((np.array(own)[k], lo + np.array(offsets)[k], *rest))
            del texts
            if not found:
                continue
            row, lo, m, off, anchor, d = (np.concatenate(x) for x in zip(*found, strict=True))
            h, g = part.column("h").to_numpy(), part.column("g").to_numpy()
            order = np.lexsort((d, anchor))
            fresh = np.concatenate(([True], (np.diff(anchor[order]) != 0) | (np.diff(d[order]) != 0)))
            first = np.flatnonzero(fresh)
            count = np.diff(np.concatenate((first, [len(order)])))
            one = order[first]
            yield _strip_rows(h[row[one]], g[row[one]], lo[one], m[one], off[one], anchor[one], d[one], count)
            again = order[np.repeat(count > 1, count)]
            if len(again):
                again = again[np.lexsort((lo[again], row[again]))]
                starts = np.flatnonzero(np.concatenate(([True], (np.diff(row[again]) != 0) | (lo[again][1:] != (lo + m)[again][:-1]))))
                total, one = np.add.reduceat(m[again], starts), again[starts]
                yield _strip_rows(h[row[one]], g[row[one]], lo[one], total, None, None, None, None)

    return rows.mapInArrow(run, _STRIP_DDL)


def _strip_rows(*columns: np.ndarray | None) -> pa.RecordBatch:
    rows = len(columns[0])
    return pa.RecordBatch.from_arrays([pa.nulls(rows, f.type) if c is None else pa.array(c.astype(f.type.to_pandas_dtype())) for c, f in zip(columns, _STRIP, strict=True)], schema=_STRIP)


_CUT = pa.schema([("key", pa.int64()), ("d", pa.int64()), ("h", pa.int64()), ("g", pa.int64()), ("lo", pa.int64()), ("m", pa.int32()), ("off", pa.int32()), ("s", pa.binary())])
_CUT_DDL = "key long, d long, h long, g long, lo long, m int, off int, s binary"


def _hash(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"|".join(parts), digest_size=8).digest(), "little", signed=True)


def _fetch(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of strips (wanted: key, h, g, lo, m, off)."""
    listed = wanted.groupBy("h", "g").agg(F.collect_list(F.struct("key", "lo", "m", "off")).alias("w"))
    joined = rows.join(listed, ["h", "g"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for h, g, t, w in zip(part.column("h").to_pylist(), part.column("g").to_pylist(), bytes_of(part.column("text")), part.column("w").to_pylist(), strict=True):
                out += [{"key": x["key"], "d": 0, "h": h, "g": g, "lo": x["lo"], "m": x["m"], "off": x["off"], "s": t[x["lo"] : x["lo"] + x["m"] - 1 + length]} for x in w]
                if len(out) > 5000:
                    yield pa.RecordBatch.from_pylist(out, _CUT)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, _CUT)

    return materialize(joined.mapInArrow(run, _CUT_DDL))


def _finer(held: DataFrame, block: int, length: int) -> DataFrame:
    """Strips cut into sub-runs of at most ``block`` windows, aligned at the anchor."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for x in part.to_pylist():
                s, off, m = x["s"], x["off"], x["m"]
                for q in range((off - m + 1) // block, off // block + 1):
                    # windows whose distance to the anchor is in [q * block, (q + 1) * block)
                    a, b = max(0, off - q * block - block + 1), min(m - 1, off - q * block)
                    core = s[off - q * block : max(0, off - q * block - block + 1 + length)]
                    own = s[a : b + length]
                    key = _hash(str((x["key"], q, block)).encode(), core)
                    out.append({"key": key, "d": _hash(str((off - a, b - a)).encode(), own), "h": x["h"], "g": x["g"], "lo": x["lo"] + a, "m": b - a + 1, "off": off - a, "s": own})
            yield pa.RecordBatch.from_pylist(out, _CUT)

    return materialize(held.mapInArrow(run, _CUT_DDL))


def repeated_windows(strings: list[bytes], offs: list[int], counts: list[int], length: int) -> list[np.ndarray]:
    """Which windows of each string occur in another string at the same distance from the anchor.

    strings: strips; offs: where the anchor is; counts: number of windows, at their start.
    """
    n = len(strings)
    flat = np.frombuffer(b"".join(strings), np.uint8)
    sizes = np.array([len(s) for s in strings])
    base = np.cumsum(sizes) - sizes
    offs, counts = np.array(offs), np.array(counts)
    first, last = -offs, sizes - offs - 1  # columns of each string
    zero = base + offs
    found = np.zeros(int(counts.sum()), bool)
    where = np.cumsum(counts) - counts
    enter = {}
    for i in np.argsort(last, kind="stable"):
        enter.setdefault(int(last[i]), []).append(i)
    leave = np.bincount(first - first.min(), minlength=int(last.max() - first.min()) + 1)
    order, common = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for column in range(int(last.max()), int(first.min()) - 1, -1):
        if column in enter:  # a suffix that begins here is empty so far: smallest, and shares nothing
            new = np.array(enter[column])
            order = np.concatenate((new, order))
            common = np.concatenate((np.zeros(len(new), np.int64), common))
            common[0] = 0
        symbols = flat[zero[order] + column]
        perm = np.argsort(symbols, kind="stable")
        sorted_symbols = symbols[perm]
        same = np.flatnonzero(sorted_symbols[1:] == sorted_symbols[:-1]) + 1
        fresh = np.zeros(len(order), np.int64)
        fresh[same] = 1 + _range_min(common, perm[same - 1] + 1, perm[same])
        order, common = order[perm], fresh
        start = (column >= first[order]) & (column < first[order] + counts[order])
        hit = start & ((common >= length) | (np.concatenate((common[1:], [0])) >= length))
        own = order[hit]
        found[where[own] + column - first[own]] = True
        if leave[column - first.min()]:
            stay = np.flatnonzero(first[order] < column)
            if not len(stay):
                order, common = np.zeros(0, np.int64), np.zeros(0, np.int64)
                continue
            # a neighbour that leaves hands its common prefix on: the minimum up to each that stays
            low = np.minimum.reduceat(common[: stay[-1] + 1], np.concatenate(([0], stay[:-1] + 1)))
            order, common = order[stay], low
            common[0] = 0
    return [found[a : a + c] for a, c in zip(where, counts, strict=True)] if n else []


def _range_min(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of a[lo .. hi] for each pair, from a table of minima over powers of two."""
    if not len(lo):
        return lo
    span = hi - lo + 1
    level = np.int64(np.floor(np.log2(span)))
    out, held = np.empty(len(lo), np.int64), a
    for k in range(int(level.max()) + 1):
        if k:
            held = np.minimum(held[: -(1 << (k - 1))], held[1 << (k - 1) :])
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(held[lo[at]], held[hi[at] - (1 << k) + 1])
    return out


_HIT = pa.schema([("h", pa.int64()), ("g", pa.int64()), ("lo", pa.int64()), ("m", pa.int32())])
_HIT_DDL = "h long, g long, lo long, m int"


def _sort_columns(held: DataFrame, rows: int, limit: int, length: int) -> DataFrame:
    """Windows found in collections of whole groups (held: keys of at most ``limit`` strings)."""

    def run(group: pa.Table) -> pa.Table:
        x = {c: group.column(c).to_pylist() for c in ("h", "g", "lo", "m", "off", "s")}
        out = []
        for i, found in enumerate(repeated_windows(x["s"], x["off"], x["m"], length)):
            edges = np.flatnonzero(np.diff(np.concatenate(([0], found.view(np.int8), [0]))))
            out += [{"h": x["h"][i], "g": x["g"][i], "lo": x["lo"][i] + int(a), "m": int(b - a)} for a, b in edges.reshape(-1, 2)]
        return pa.Table.from_pylist(out, _HIT)

    buckets = max(1, rows // limit)
    return held.withColumn("b", F.pmod(F.hash("key"), F.lit(buckets))).groupBy("b").applyInArrow(run, _HIT_DDL)


def _settle(strings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Windows of strings that are equal as wholes; and one string of each kind where a key has several kinds."""
    kinds = materialize(strings.groupBy("key", "d").agg(F.sum("n").alias("n"), F.min(F.struct("h", "g", "lo", "m", "off")).alias("r")))
    equal = strings.join(kinds.filter("n > 1").select("key", "d"), ["key", "d"]).select("h", "g", "lo", "m")
    several = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    salted = several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))  # a key's kinds go to several tasks
    dealt = kinds.withColumn("salt", F.pmod(F.xxhash64("d"), F.lit(_SALTS)).cast("int"))
    return equal, dealt.join(salted, ["key", "salt"]).select("key", "d", "r.*", "kinds")


def repeated_spans(rows: DataFrame, length: int = 200, gram: int = 80, limit: int = 500) -> DataFrame:
    """(h, g, lo, m): runs of m windows from lo on that also occur elsewhere. rows: h, g, text."""
    spark = rows.sparkSession
    made = materialize(_all_strips(rows, length, gram))
    kinds = made.filter("anchor IS NOT NULL")
    shared = kinds.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor")
    strings = materialize(kinds.join(shared, "anchor").withColumnRenamed("anchor", "key"))
    release(spark)
    equal, several = _settle(strings)
    found = [made.filter("anchor IS NULL").select("h", "g", "lo", "m"), materialize(equal)]
    several = materialize(several)
    release(spark)
    if several.isEmpty():
        return found[0].unionByName(found[1])
    held = _fetch(rows, several.drop("d", "kinds"), length)
    sizes = several.select("key", "kinds").distinct()
    for block in (32, 8, 2, 1):
        large = materialize(sizes.filter(F.col("kinds") > limit).select("key"))
        if large.isEmpty():
            break
        cut = _finer(held.join(large, "key", "left_semi"), block, length).withColumn("n", F.lit(1))
        equal, several = _settle(cut)
        found.append(materialize(equal))
        several = materialize(several)
        kept = cut.drop("n").join(several.select("key", "d", "h", "g", "lo"), ["key", "d", "h", "g", "lo"], "left_semi").dropDuplicates(["key", "d", "h", "g", "lo"])
        held = materialize(held.join(large, "key", "left_anti").unionByName(kept))
        sizes = sizes.join(large, "key", "left_anti").unionByName(several.select("key", "kinds").distinct())
    count = held.count()
    found.append(_sort_columns(held, count, limit, length))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return materialize(out)


_DONE = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
_DONE_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_repeats(docs: DataFrame, length: int = 200, gram: int = 80, limit: int = 500, with_bytes: bool = True) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("h"), F.xxhash64(text, "doc_id", F.lit(1)).alias("g"))
    spans = repeated_spans(rows.select("h", "g", "text"), length, gram, limit)
    listed = spans.groupBy("h", "g").agg(F.collect_set(F.struct("lo", "m")).alias("w"))
    schema = pa.schema(list(_DONE)[: len(_DONE) - (not with_bytes)])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for doc_id, t, w in zip(part.column("doc_id").to_pylist(), bytes_of(part.column("text")), part.column("w").to_pylist(), strict=True):
                kept, at, removed, runs, end = [], 0, 0, 0, -1
                for x in sorted(w or [], key=lambda x: x["lo"]):
                    a, b = x["lo"], x["lo"] + x["m"] - 1 + length
                    runs += a > end
                    if b > at:
                        kept.append(t[at:a] if a > at else b"")
                        removed += b - max(a, at)
                        at = end = b
                kept = b"".join([*kept, t[at:]])
                out.append((doc_id, len(t), removed, runs, hashlib.sha256(kept).hexdigest(), kept)[: len(schema)])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema) if out else pa.RecordBatch.from_pylist([], schema)

    ddl = _DONE_DDL if with_bytes else _DONE_DDL.rpartition(",")[0]
    return rows.join(listed, ["h", "g"], "left").select("doc_id", "text", "w").mapInArrow(run, ddl)


def op9_repeated_bytes(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_bytes=False)
