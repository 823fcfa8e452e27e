"""Byte-level BPE with a sentencepiece model written straight from a table of ranks.

Each byte is written as one visible character, so that every token is a piece of text; a piece's score
is its negated rank. Sentencepiece merges the neighbours whose piece scores highest, the leftmost of
equals first, which are the merges in order of rank. Normalisation is the identity and no prefix is
added. A text is cut into pre-tokens by a pattern; a pre-token that is a token as a whole is that token,
all others go through the model. Decoding maps the model's pieces back to bytes.

Scale: one pass without a shuffle; workers hold the model, and identifiers of pre-tokens met before up
to ``MEMO`` bytes. A very long text is cut into pre-tokens some at a time.

Cases: null and empty texts have no identifiers and decode to nothing; bytes that aren't UTF-8 are read
as U+FFFD; repeated rows give equal rows; an empty table gives an empty one. Columns are made by
expressions, so that other columns stay as they are. Null identifiers decode to null; an identifier that
the ranks don't have, or a length that is no multiple of four bytes, is a ValueError; a rank table
without all 256 bytes is one too.
"""

from __future__ import annotations

import base64
import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairweave.llm.common import bytes_of, table

#: Bytes that a worker's memo may take, about; it then forgets the later half (frequent pre-tokens are met early).
MEMO = 48 << 20
#: Pre-tokens of a text that are looked up at a time.
AT_ONCE = 100_000

#: Visible Latin-1 characters stand for their own byte, the characters from U+0100 on for the other bytes in order.
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_HIDDEN = sorted({*range(256)} - {*_VISIBLE})
CHAR_OF = {b: chr(b) for b in _VISIBLE} | {b: chr(256 + k) for k, b in enumerate(_HIDDEN)}
_WRITE = {b: ord(c) for b, c in CHAR_OF.items()}
_READ = {ord(c): b for b, c in CHAR_OF.items()}


def as_piece(raw: bytes) -> str:
    return raw.decode("latin-1").translate(_WRITE)


def as_bytes(piece: str) -> bytes:
    return piece.translate(_READ).encode("latin-1")


def read_ranks(path: str) -> dict[bytes, int]:
    """A file of lines "base64 rank"."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol buffer: bytes with their length, an integer as a varint, a float in four bytes."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


#: Types of pieces and of models in sentencepiece's format.
_NORMAL, _UNKNOWN, _BPE = 1, 2, 2


def model_file(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model; a piece's number is its place in the order of ranks, the last one is the unknown piece."""
    if lacking := 256 - sum(bytes([b]) in ranks for b in range(256)):
        raise ValueError(f"{lacking} single bytes have no rank")
    order = sorted(ranks, key=ranks.get)
    if len(set(ranks.values())) < len(order) or ranks[order[0]] < 0 or ranks[order[-1]] >= 1 << 24:
        raise ValueError("ranks must be distinct, from 0 to 2**24 - 1: scores are 32-bit floats")
    piece = lambda text, score, kind: _field(1, _field(1, text.encode()) + _field(2, score) + _field(3, kind))
    pieces = [piece(as_piece(token), -float(ranks[token]), _NORMAL) for token in order]
    trainer = _field(3, _BPE) + _field(4, len(order) + 1)
    identity = _field(1, b"identity") + _field(2, b"") + b"".join(_field(k, 0) for k in (3, 4, 5))
    return b"".join(pieces) + piece("<unk>", 0.0, _UNKNOWN) + _field(2, trainer) + _field(3, identity)


class Codec(dict):
    """Identifiers of pre-tokens, found when first asked for; texts to identifiers and back."""

    _MADE: dict[tuple[str, str], Codec] = {}

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex
        import sentencepiece

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_file(ranks))
        self.cut, self.whole, self.held = regex.compile(pattern), ranks, 0
        self.ranks = sorted(ranks.values())
        pieces = map(self.model.id_to_piece, range(len(ranks)))
        self.tokens = {rank: as_bytes(piece) for rank, piece in zip(self.ranks, pieces, strict=True)}

    @classmethod
    def at(cls, path: str, pattern: str) -> Codec:
        """A worker's codec of a file of ranks."""
        if (path, pattern) not in cls._MADE:
            cls._MADE[path, pattern] = cls(read_ranks(path), pattern)
        return cls._MADE[path, pattern]

    def __missing__(self, word: str) -> list[int]:
        raw = word.encode()
        known = self.whole.get(raw)
        ids = [known] if known is not None else [self.ranks[i] for i in self.model.encode(as_piece(raw))]
        if self.held > MEMO:
            for late in [*itertools.islice(self, len(self) >> 1, None)]:
                del self[late]
            self.held >>= 1
        if len(word) < 1000:
            self[word] = ids
            self.held += 200 + 2 * len(word) + 40 * len(ids)
        return ids

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit identifiers of a text."""
        if len(text) <= AT_ONCE:
            return self._numbers(self.cut.findall(text))
        found = (m.group() for m in self.cut.finditer(text))
        return b"".join(self._numbers(some) for some in iter(lambda: [*itertools.islice(found, AT_ONCE)], []))

    def _numbers(self, words: list[str]) -> bytes:
        return np.array([*itertools.chain.from_iterable(map(self.__getitem__, words))], "<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        try:
            return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        except KeyError as odd:
            raise ValueError(f"no token has the identifier {odd}") from None


def _per_value(column: Column, path: str, pattern: str, step) -> Column:
    @F.arrow_udf("binary")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec.at(path, pattern)
        for part in parts:
            yield pa.array([None if x is None else step(codec, x) for x in bytes_of(part)], pa.binary())

    return run(column)


def encoded(text: Column, path: str, pattern: str) -> Column:
    """Identifiers of a text, 32-bit little-endian, as one binary value; ``path`` is a file of ranks."""
    return _per_value(F.coalesce(text, F.lit("")), path, pattern, lambda codec, x: codec.encode(x.decode("utf-8", "replace")))


def decoded(ids: Column, path: str, pattern: str) -> Column:
    """The bytes of a text from its identifiers."""
    return _per_value(ids, path, pattern, lambda codec, x: codec.decode(x))


def op11_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    how = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ids = table(spark, sf_dir, "documents").select("doc_id", encoded(F.col("text"), *how).alias("ids"))
    both = ids.withColumn("decoded", decoded(F.col("ids"), *how))
    return both.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
