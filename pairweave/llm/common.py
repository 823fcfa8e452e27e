"""Helpers shared by the corpus operators: shared scratch space, byte-level words, packed arrays."""

from __future__ import annotations

import gc
import itertools
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairweave.plans.scratch import drop_folder, shared_folder

#: White space that separates words; ``bytes.split()`` splits at just these.
WORD = r"[^\x20\x09-\x0D]+"

#: DuckDB: the text with A-Z lowered.
SQL_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TABLES: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share; see ``shared_folder``."""
    return shared_folder(spark)


def drop_shared(spark: SparkSession, path: str) -> None:
    """Delete a folder made by ``shared_dir``."""
    drop_folder(spark, path)


def materialize(df: DataFrame, path: str | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into shared space and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    _TABLES.append((spark, path))
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(make: Callable[[], DataFrame]) -> DataFrame:
    """Write what ``make`` returns, and delete the tables that ``materialize`` wrote on the way."""
    before = len(_TABLES)
    made = make()
    own = _TABLES[before:]
    del _TABLES[before:]
    out = materialize(made)
    for spark, path in own:
        drop_shared(spark, path)
    return out


def set_aside(docs: DataFrame, names) -> tuple[DataFrame, list]:
    """``docs`` with columns named as in ``names`` renamed, and what to select to have all its columns back."""
    taken = {n.lower() for n in names}
    clash = {c: f"_own_{c}" for c in docs.columns if c.lower() in taken}
    return docs.withColumnsRenamed(clash), [F.col(clash.get(c, c)).alias(c) for c in docs.columns]


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


#: The bytes of an Arrow batch: Spark's default, and what is set in its place.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session, unless it has set a size: ten thousand texts take up to 64 MB at
    several places of an executor at once."""
    if spark.conf.get(_BATCH, "67108864b") == "67108864b":
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(modulus: int, doc_id: str = "doc_id"):
    """crc32 of the identifier's text, modulo ``modulus``; null for a null identifier."""
    return F.crc32(F.col(doc_id).cast("string")) % modulus


def bytes_of(column: pa.Array) -> list[bytes | None]:
    """A string or binary Arrow column as Python bytes."""
    return column.cast(pa.binary()).to_pylist()


class Vocabulary:
    """Numbers words in order of first appearance, at C speed."""

    def __init__(self) -> None:
        self.index: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)

    def encode(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def words(self) -> list[bytes]:
        return list(self.index)


def pack(a: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes, most significant first, without zero planes at the front."""
    planes = np.ascontiguousarray(a.astype("<u8")).view(np.uint8).reshape(-1, 8).T[::-1]
    used = int(a.max()).bit_length() + 7 >> 3 if len(a) else 0
    return bytes([used]) + len(a).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(planes[8 - used :].tobytes())


def unpack(b: bytes) -> np.ndarray:
    """What ``pack`` was given, as uint64."""
    used, n = b[0], int.from_bytes(b[1:9], "little")
    out = np.zeros((n, 8), np.uint8)
    if used:
        raw = zstandard.ZstdDecompressor().decompress(b[9:], max_output_size=used * n)
        out[:, :used] = np.frombuffer(raw, np.uint8).reshape(used, n)[::-1].T
    return out.view("<u8").ravel()


def mix64(a: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of SplitMix64)."""
    a = a.astype(np.uint64, copy=True)
    a ^= a >> np.uint64(30)
    a *= np.uint64(0xBF58476D1CE4E5B9)
    a ^= a >> np.uint64(27)
    a *= np.uint64(0x94D049BB133111EB)
    a ^= a >> np.uint64(31)
    return a


def slices(part: pa.RecordBatch, rows: int = 500, size: int = 2 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``rows`` rows and about ``size`` bytes of ``column``; a longer row is a part of its own."""
    lengths = pc.fill_null(pc.binary_length(part.column(column).cast(pa.binary())), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and (i - start >= rows or held + n > size):
            yield part.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < part.num_rows:
        yield part.slice(start)


def batches(rows: Iterator[dict], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Group dict rows into record batches."""
    while chunk := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_pylist(chunk, schema)
