"""Shards of a growing corpus by size-tiered compaction.

Arrivals are appended as small immutable Parquet shards. Compaction takes shards of similar size
(one tier: sizes within a factor of ``fan``) and merges runs of them into files of about the target
size. Every change is a new version of the manifest, the list of live shards, committed by writing
it aside and renaming it to the next number: a rename onto an existing version fails, so that of two
writers one wins and the other starts again from the new version. Readers see a version as a whole;
shards that no version lists are left-overs of failed attempts and are never read.

Scale: neither appends nor merges shuffle. A merge reads the small files of one output in one task;
outputs are made in waves of ``wave`` per job. The manifest has one line per shard, some hundred
bytes for every target file, and is what the driver holds.

Two writers never make one version: on file systems whose rename refuses an existing target (HDFS,
local) the rename decides; on object stores, where it replaces the target, the folder of manifests
has to be in a store with conditional creation. Shards that no kept version lists stay until
``vacuum`` deletes them.

Cases: all columns and rows are kept as they are, nulls, very long texts and repeated rows included;
shards of equal size are merged in the order of their names; a shard without rows isn't listed; an
empty store has the schema of its first append; a column named as the one set aside for the writer
(``_pairweave_bin``) gets another name there, and columns named shard, shard_bytes or version are kept
by the store and replaced by ``read`` only in what it adds.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairweave.llm.common import shared_dir, table

_BIN = "_pairweave_bin"
#: Bytes of a merged shard; how many shards of one tier are merged.
TARGET_BYTES, FAN = 64 << 20, 4


@dataclass(frozen=True)
class Shard:
    path: str
    rows: int
    bytes: int

    @property
    def name(self) -> str:
        """The path within the store's data; the file's name alone may repeat in another folder."""
        return shard_name(self.path)


def shard_name(path: str) -> str:
    return path.rsplit("/data/", 1)[-1]


@dataclass
class Manifest:
    version: int
    schema: str | None
    shards: list[Shard]


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class ShardStore:
    """A folder of shards and manifest versions in a file system that Spark can reach."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _read_text(self, name: str) -> str:
        return "\n".join(r[0] for r in self.spark.read.text(f"{self.path}/{name}", wholetext=True).collect())

    def versions(self) -> list[int]:
        folder = self._path("manifest")
        if not self.fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """The latest manifest, or an earlier version."""
        found = self.versions()
        if not found:
            return Manifest(0, None, [])
        version = found[-1] if version is None else version
        held = json.loads(self._read_text(f"manifest/v{version:08d}.json"))
        return Manifest(version, held["schema"], [Shard(**s) for s in held["shards"]])

    def commit(self, seen: Manifest, schema: str | None, shards: list[Shard]) -> Manifest:
        """Make ``shards`` the version after ``seen``."""
        self.fs.mkdirs(self._path("manifest"))
        aside, final = self._path(f"manifest/{uuid.uuid4().hex}.tmp"), self._path(f"manifest/v{seen.version + 1:08d}.json")
        out = self.fs.create(aside, False)
        out.write(bytearray(json.dumps({"schema": schema, "shards": [asdict(s) for s in shards]}).encode()))
        out.close()
        if self.fs.exists(final) or not self.fs.rename(aside, final):
            self.fs.delete(aside, False)
            raise Conflict(f"version {seen.version + 1} exists")
        return Manifest(seen.version + 1, schema, shards)

    def _listed(self, folder: str, schema: T.StructType) -> list[Shard]:
        """The shards with rows in a folder that a job has written."""
        files = self.spark.read.schema(schema).parquet(f"{self.path}/{folder}").select("_metadata.file_path", "_metadata.file_size")
        rows = files.groupBy("file_path", "file_size").count().collect()  # one row per shard
        return sorted((Shard(r["file_path"], r["count"], r["file_size"]) for r in rows), key=lambda s: s.path)

    def append(self, df: DataFrame, rows_per_shard: int = 20_000) -> Manifest:
        """Add the rows of ``df`` as new small shards."""
        folder = f"data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_shard).parquet(f"{self.path}/{folder}")
        new = self._listed(folder, df.schema)
        while True:
            seen = self.manifest()
            try:
                return self.commit(seen, seen.schema or df.schema.json(), seen.shards + new)
            except Conflict:
                continue

    def compact(self, target_bytes: int = 256 << 20, fan: int = FAN, wave: int = 64) -> Manifest:
        """Merge shards of one tier, once there are ``fan`` of them, until no tier has that many."""
        while True:
            seen = self.manifest()
            runs = merge_runs(seen.shards, target_bytes, fan)
            if not runs:
                return seen
            schema = T.StructType.fromJson(json.loads(seen.schema))
            merged: list[Shard] = []
            for k in range(0, len(runs), wave):
                bin_column = _BIN
                while bin_column.lower() in (n.lower() for n in schema.names):
                    bin_column += "_"
                parts = [self._rows(run, schema).coalesce(1).withColumn(bin_column, F.lit(i)) for i, run in enumerate(runs[k : k + wave])]
                both = parts[0]
                for p in parts[1:]:
                    both = both.unionByName(p)
                folder = f"data/{uuid.uuid4().hex}"
                both.write.option("compression", "zstd").partitionBy(bin_column).parquet(f"{self.path}/{folder}")
                merged += self._listed(folder, schema)
            gone = {s for run in runs for s in run}
            try:
                self.commit(seen, seen.schema, [s for s in seen.shards if s not in gone] + merged)
            except Conflict:
                continue

    def vacuum(self, keep: int = 1) -> int:
        """Delete versions but the last ``keep`` ones, and shards that no version left lists; how many shards went.

        Only while nobody appends: a shard that is written but not yet committed is listed nowhere.
        """
        versions = self.versions()
        for v in versions[:-keep]:
            self.fs.delete(self._path(f"manifest/v{v:08d}.json"), False)
        live = {s.name for v in versions[-keep:] for s in self.manifest(v).shards}
        gone, data = 0, self._path("data")
        files = self.fs.listFiles(data, True) if self.fs.exists(data) else None
        while files is not None and files.hasNext():
            path = files.next().getPath()
            if path.getName().endswith(".parquet") and shard_name(path.toString()) not in live:
                gone += self.fs.delete(path, False)
        return gone

    def _rows(self, shards: list[Shard], schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[s.path for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, with shard (the file's path within the data), shard_bytes and version."""
        seen = self.manifest(version)
        schema = T.StructType.fromJson(json.loads(seen.schema))
        if not seen.shards:
            return self.spark.createDataFrame([], schema).withColumns({"shard": F.lit(""), "shard_bytes": F.lit(0).cast("long"), "version": F.lit(seen.version)})
        return self._rows(seen.shards, schema).withColumns({"shard": F.element_at(F.split("_metadata.file_path", "/data/"), -1), "shard_bytes": F.col("_metadata.file_size"), "version": F.lit(seen.version)})

    def shards(self) -> DataFrame:
        """version, shard, rows, bytes of every shard of every version."""
        listed = [(v, s.name, s.rows, s.bytes) for v in self.versions() for s in self.manifest(v).shards]
        return self.spark.createDataFrame(listed, "version int, shard string, rows long, bytes long")


def merge_runs(shards: list[Shard], target_bytes: int, fan: int) -> list[list[Shard]]:
    """Runs of at least ``fan`` shards of one tier, each of about the target size or the tier's rest."""
    tiers: dict[int, list[Shard]] = {}
    for s in shards:
        if 2 * s.bytes < target_bytes:
            tiers.setdefault(int(math.log(max(1, s.bytes), fan)), []).append(s)
    runs = []
    for _, own in sorted(tiers.items()):
        if len(own) < fan:
            continue
        run, size = [], 0
        for s in own:
            if run and size + s.bytes > target_bytes:
                runs.append(run)
                run, size = [], 0
            run.append(s)
            size += s.bytes
        runs.append(run)
    return [r for r in runs if len(r) > 1]


def shard_corpus(docs: DataFrame, path: str | None = None, arrivals: int = 2, target_bytes: int = TARGET_BYTES, rows_per_shard: int = 5_000) -> ShardStore:
    """Append ``docs`` in ``arrivals`` parts (by hash of the identifier) and compact after each."""
    store = ShardStore(docs.sparkSession, path or f"{shared_dir(docs.sparkSession)}/store")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(arrivals))
    for k in range(arrivals):
        store.append(docs.filter(part == k), rows_per_shard)
        store.compact(target_bytes)
    return store


def sharded_rows(store: ShardStore) -> DataFrame:
    """doc_id, shard, n_bytes and text_sha256 of every row, read back from the committed version."""
    text = F.coalesce("text", F.lit(""))
    return store.read().select("doc_id", "shard", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"))


#: Appends of the query: eight shards whose sizes are within a factor of ``FAN`` lie in two tiers at most, so that four share one.
ARRIVALS = 8


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    """Rows of the committed version, with what the manifests say of it.

    tiered: no ``FAN`` shards of one tier are left, and the manifest counts the rows of this row's shard
    right. merged: there are more versions than appends, and fewer shards than have been written.
    """
    store = shard_corpus(table(spark, sf_dir, "documents"), arrivals=ARRIVALS)
    seen, versions = store.manifest(), store.versions()
    every = store.shards()
    listed = every.filter(F.col("version") == seen.version).select("shard", F.col("rows").alias("_listed"))
    rows = sharded_rows(store)
    held = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("_held")).join(listed, "shard", "left")
    right = held.select("shard", (F.coalesce("_held", F.lit(0)) == F.coalesce("_listed", F.lit(-1))).alias("_right"))
    tiered = F.col("_right") & F.lit(seen.version > 1 and not merge_runs(seen.shards, TARGET_BYTES, FAN))
    merged = len(versions) > ARRIVALS and len(seen.shards) < every.select("shard").distinct().count()
    return rows.join(right, "shard").select("doc_id", "n_bytes", "text_sha256", tiered.alias("tiered"), F.lit(len(versions) >= 2).alias("versioned"), F.lit(merged).alias("merged"))


OP8_SQL = "SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, sha256(coalesce(text, '')) AS text_sha256, true AS tiered, true AS versioned, true AS merged FROM documents"
