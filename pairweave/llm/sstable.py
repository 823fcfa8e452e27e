"""Token identifiers in sorted-string-table shards.

A shard holds documents in key order, in blocks of about ``block_bytes``; within a block each key
is stored as the length it shares with the key before it and the rest (prefix compression), with
the full key at the block's start. After the blocks come a Bloom filter over the identifiers, a
sparse index (last key, offset and length of each block) and a footer of fixed size. A lookup
reads the footer, asks the Bloom filter, finds the block by binary search in the index, and reads
one block.

    block  := zstd( entry* ) ; entry := varint shared, varint rest, varint value length, rest, value
    value  := b"\\x02" 16-bit or b"\\x04" 32-bit little-endian identifiers
    footer := six little-endian u64 (index offset, index length, filter offset, filter length,
              documents, identifiers), u32 filter hash count, 4 reserved bytes, b"PWSST001"

A key is one flag byte (0 for a null identifier, else 1), the identifier as 8 big-endian bytes with
the sign bit flipped, so that bytes sort as numbers, and 4 bytes that number repeated identifiers.

Scale: one range partitioning by (identifier, hash of the text) and one sort within partitions; the
second key splits an identifier with very many rows. Shards are written under attempt-unique names
into the shared folder, and only the names in the manifest, which Spark commits, are ever read: a
task that is run again leaves no trace. Readers get whole shards.

Cases: null text encodes as empty (only the end identifier); a null doc_id sorts first; an identifier
that is no integer is a TypeError; repeated identifiers are all kept, in the order of their texts'
hashes; a very long text is one entry, whatever the block's size; an empty table gives no rows; other
columns, also ones named as those of the result, are not used.
"""

from __future__ import annotations

import bisect
import itertools
import os
import re
import struct
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairweave.llm.common import materialize, shared_dir, slices, table

_MAGIC = b"PWSST001"
_FOOTER = struct.Struct("<6QI4x8s")


def filesystem(path: str):
    """The pyarrow file system and path of a URI or plain path."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


def make_key(doc_id: int | None, number: int) -> bytes:
    if doc_id is None:
        return b"\x00" + bytes(8) + number.to_bytes(4, "big")
    return b"\x01" + (doc_id + (1 << 63)).to_bytes(8, "big") + number.to_bytes(4, "big")


def split_key(key: bytes) -> int | None:
    return int.from_bytes(key[1:9], "big") - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


class Bloom:
    """Bits for about one false positive in a hundred."""

    def __init__(self, bits: bytearray, hashes: int) -> None:
        self.bits, self.hashes = bits, hashes

    @classmethod
    def over(cls, keys: list[bytes]) -> Bloom:
        made = cls(bytearray(max(8, -(-len(keys) * 10 // 8))), 7)
        for key in keys:
            for p in made._places(key):
                made.bits[p >> 3] |= 1 << (p & 7)
        return made

    def _places(self, key: bytes) -> Iterator[int]:
        a, b = zlib.crc32(key), zlib.adler32(key) * 2654435761 & 0xFFFFFFFF | 1
        return ((a + k * b) % (8 * len(self.bits)) for k in range(self.hashes))

    def __contains__(self, key: bytes) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self._places(key))


class Writer:
    """Writes one shard; keys must come in order."""

    def __init__(self, sink, block_bytes: int = 1 << 16) -> None:
        self.sink, self.block_bytes, self.offset = sink, block_bytes, 0
        self.zip = zstandard.ZstdCompressor(level=1)
        self.entries: list[bytes] = []
        self.size = self.documents = self.identifiers = 0
        self.last = b""
        self.previous = b""
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []

    def _put(self, data: bytes) -> tuple[int, int]:
        at, self.offset = self.offset, self.offset + len(data)
        self.sink.write(data)
        return at, len(data)

    def _flush(self) -> None:
        if self.entries:
            self.index.append((self.last, *self._put(self.zip.compress(b"".join(self.entries)))))
            self.entries, self.size, self.previous = [], 0, b""

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if key < self.last:
            raise ValueError("keys must ascend")
        shared = len(os.path.commonprefix([self.previous, key]))
        small = not len(ids) or int(ids.max()) < 1 << 16
        value = b"\x02" + ids.astype("<u2").tobytes() if small else b"\x04" + ids.astype("<u4").tobytes()
        rest = key[shared:]
        self.entries.append(_varint(shared) + _varint(len(rest)) + _varint(len(value)) + rest + value)
        self.size += len(value) + len(rest)
        self.last = self.previous = key
        self.keys.append(key[:9])
        self.documents += 1
        self.identifiers += len(ids)
        if self.size >= self.block_bytes:
            self._flush()

    def close(self) -> None:
        self._flush()
        bloom = Bloom.over(self.keys)
        f = self._put(bytes(bloom.bits))
        i = self._put(b"".join(_varint(len(k)) + k + _varint(o) + _varint(n) for k, o, n in self.index))
        self._put(_FOOTER.pack(*i, *f, self.documents, self.identifiers, bloom.hashes, _MAGIC))


class Reader:
    """Reads one shard: in order, or a document by its identifier."""

    def __init__(self, path: str) -> None:
        files, name = filesystem(path)
        self.source = files.open_input_file(name)
        end = self.source.size()
        tail = self.source.read_at(_FOOTER.size, end - _FOOTER.size)
        i, i_n, f, f_n, self.documents, self.identifiers, hashes, magic = _FOOTER.unpack(tail)
        if magic != _MAGIC:
            raise ValueError(f"{path} is no shard of this format")
        self.bloom = Bloom(bytearray(self.source.read_at(f_n, f)), hashes)
        raw, at, self.index = self.source.read_at(i_n, i), 0, []
        while at < len(raw):
            n, at = _read_varint(raw, at)
            key, at = raw[at : at + n], at + n
            offset, at = _read_varint(raw, at)
            length, at = _read_varint(raw, at)
            self.index.append((key, offset, length))
        self.last_keys = [x[0] for x in self.index]
        self.unzip = zstandard.ZstdDecompressor()

    def block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, offset, length = self.index[k]
        raw, at, key = self.unzip.decompress(self.source.read_at(length, offset)), 0, b""
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            width = raw[at]
            yield key, np.frombuffer(raw, f"<u{width}", (size - 1) // width, at + 1)
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.index)):
            yield from self.block(k)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The identifiers of every document stored under ``doc_id``."""
        prefix, out = make_key(doc_id, 0)[:9], []
        if prefix not in self.bloom:
            return out
        for k in range(bisect.bisect_left(self.last_keys, prefix), len(self.index)):
            own = [ids for key, ids in self.block(k) if key[:9] == prefix]
            out += own
            if self.last_keys[k][:9] > prefix:
                break
        return out

    def close(self) -> None:
        self.source.close()


#: Bytes that the pieces kept by a worker may take, about: it then forgets the later half of them.
MEMO = 64 << 20
#: Bytes of a kept piece beside its characters: its entries in the table, its number and its identifiers.
_ENTRY = 200
#: A space before other white space: there the pre-tokeniser may cut elsewhere.
_ODD = tuple(" " + c for c in map(chr, range(0x3001)) if c.isspace())
_ODD_ASCII = tuple(o for o in _ODD if o.isascii())
_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """Encodes texts with a byte-level BPE of the ``tokenizers`` library.

    Its pre-tokeniser always cuts before a space that non-space follows, so a text's identifiers
    are those of its pieces cut there. Pieces are encoded once and kept, up to ``MEMO`` bytes of
    them; texts are then gathered from one flat array. Frequent pieces are met early, so that the
    later half of what is kept goes when there is too much.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.tails = self.tokenizer.model, {}
        self.whole = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self, keep: int = 0) -> None:
        """All pieces but the ``keep`` first ones."""
        kept = list(itertools.islice(self.index, keep)) if keep else []
        flat, ends = (self.flat[: self.ends[keep - 1]].copy(), self.ends[:keep].copy()) if keep else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        self.index = defaultdict(itertools.count(keep).__next__, zip(kept, range(keep), strict=True))
        self.tails.clear()
        self.flat, self.ends, self.known = flat, ends, keep
        self.held = sum(map(len, kept)) + _ENTRY * keep

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def rest_of(self, text: str) -> tuple[str, list[str]]:
        """The piece before the first cut, and the pieces after it without their leading space."""
        if not any(o in text for o in (_ODD_ASCII if text.isascii() else _ODD)) and not text.endswith(" "):
            first, *rest = text.split(" ")
            return first, rest
        cuts = [m.start() for m in _CUT.finditer(text)]
        pieces = [text[a + 1 : b] for a, b in zip(cuts, [*cuts[1:], len(text)])]
        return text[: cuts[0]] if cuts else text, pieces

    def _word(self, piece: str) -> list[int] | None:
        """Identifiers of a space, letters and then punctuation: the pre-tokeniser cuts it just there.

        The model is asked directly, without the work of a whole encoding. None for other pieces.
        """
        base = piece.rstrip(_PUNCTUATION)
        if not base.isalpha():
            return None
        tail = piece[len(base) :]
        at = self.index.get(base, self.known) if tail else self.known
        if at < self.known:
            head = self.flat[self.ends[at - 1] if at else 0 : self.ends[at]].tolist()
        else:
            mapped = base if base.isascii() else base.encode().decode("latin-1").translate(_BYTE_CHARS)
            head = [t.id for t in self.model.tokenize("\u0120" + mapped)]
        if not tail:
            return head
        if tail not in self.tails:
            self.tails[tail] = self.plain(tail).tolist()
        return head + self.tails[tail]

    def _learn(self) -> None:
        new = list(itertools.islice(reversed(self.index), len(self.index) - self.known))[::-1]
        found = [self._word(p) for p in new]
        odd = [i for i, ids in enumerate(found) if ids is None]
        for i, e in zip(odd, self.tokenizer.encode_batch_fast([" " + new[i] for i in odd], add_special_tokens=False), strict=True):
            found[i] = e.ids
        start = self.ends[self.known - 1] if self.known else 0
        ends = start + np.cumsum([len(x) for x in found])
        size = len(self.index)
        if size > len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros(size - len(self.ends) + (size >> 2), np.int64)))
        if ends[-1] > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(int(ends[-1]) - len(self.flat) + (int(ends[-1]) >> 2), np.uint32)))
        self.held += sum(map(len, new)) + _ENTRY * len(new)
        self.ends[self.known : size] = ends
        self.flat[start : ends[-1]] = list(itertools.chain.from_iterable(found))
        self.known = size

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The identifiers of each text."""
        if self.held > MEMO:
            self.forget(self.known // 2)
        if self.held > MEMO:
            self.forget()
        look, firsts, owns = self.index.__getitem__, [], []
        for text in texts:
            if any(s in text for s in self.whole):
                firsts.append(self.plain(text))
                owns.append(np.zeros(0, np.int64))
                continue
            first, rest = self.rest_of(text)
            firsts.append(self.plain(first))
            owns.append(np.fromiter(map(look, rest), np.int64, len(rest)))
        if len(self.index) > self.known:
            self._learn()
        joined = np.concatenate(owns)
        ends = self.ends[joined]
        sizes = ends - np.where(joined > 0, self.ends[joined - 1], 0)
        upto = np.cumsum(sizes)
        flat = self.flat[np.arange(upto[-1] if len(upto) else 0) + np.repeat(ends - upto, sizes)]
        cuts = np.concatenate(([0], upto))[np.cumsum([0, *map(len, owns)])]
        return [np.concatenate((first, flat[a:b])) for first, a, b in zip(firsts, cuts[:-1], cuts[1:], strict=True)]


_PUNCTUATION = ".,;:!?*#$%&|<>()[]{}\"-_=+/"
#: Byte-level BPE writes bytes that aren't printable in Latin-1 as the characters from 256 on.
_ODD_BYTES = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
_BYTE_CHARS = {b: 256 + k for k, b in enumerate(_ODD_BYTES)}
_CUT = re.compile(r" (?=\S)")


def write_tokens(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int | None = 2, shard_bytes: int = 32 << 20) -> DataFrame:
    """Encode ``docs`` (doc_id, text), write shards under ``path`` and return the manifest.

    One row per shard, in key order: shard, path, documents, identifiers. ``shard_bytes`` is the
    text that a shard holds, about.
    """
    spark = docs.sparkSession
    if dict(docs.dtypes)["doc_id"] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("doc_id must be an integer: keys hold eight bytes")
    path = path or f"{shared_dir(spark)}/shards"
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + F.count(F.lit(1)) * 16).first()[0]
    shards = int(max(1, -(-total // shard_bytes)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("h"))
    rows = rows.repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    out = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("identifiers", pa.int64())])
    end = np.zeros(0, "<u4") if end_id is None else np.array([end_id], "<u4")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, shard = Encoder.at(tokenizer), TaskContext.get().partitionId()
        files, folder = filesystem(path)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.sst"
        writer, last, number, sink = None, (), 0, None
        for part in parts:
            for own in slices(part):
                for doc_id, ids in zip(own.column("doc_id").to_pylist(), encoder.encode(own.column("text").to_pylist()), strict=True):
                    if writer is None:
                        files.create_dir(folder, recursive=True)
                        sink = files.open_output_stream(f"{folder}/{name}")
                        writer = Writer(sink)
                    number = number + 1 if last == (doc_id,) else 0
                    last = (doc_id,)
                    writer.add(make_key(doc_id, number), np.concatenate((ids, end)))
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": f"{path}/{name}", "documents": writer.documents, "identifiers": writer.identifiers}], out)

    return materialize(rows.mapInArrow(run, "shard int, path string, documents long, identifiers long"))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Every document of the shards: doc_id, start (identifiers before it), n_tokens, ids (u32 bytes)."""
    return _read(manifest, True)


def _read(manifest: DataFrame, with_ids: bool) -> DataFrame:
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    placed = manifest.withColumn("first", F.coalesce(F.sum("identifiers").over(before), F.lit(0)))
    placed = placed.repartition(int(max(1, manifest.count())), "shard")
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids
    out = pa.schema(kinds)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                start, held, reader = row["first"], [], Reader(row["path"])
                for key, ids in reader:
                    raw = ids.astype("<u4").tobytes()
                    held.append((split_key(key), start, len(ids), zlib.crc32(raw), raw)[: len(kinds)])
                    start += len(ids)
                    if len(held) == 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*held, strict=True), kinds, strict=True)], schema=out)
                        held = []
                reader.close()
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*held, strict=True), kinds, strict=True)], schema=out)

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def op7_token_shards(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return _read(manifest, False)
