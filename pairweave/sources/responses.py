"""Recorded answers of a compound service: what to ask, the answers as a table, records from their parts.

Answers are rows (kind, id, part, status, body). They are kept in folders by kind and by bucket of id, so
that a read for some ids prunes folders, and another write replaces the buckets of its ids only. Asking
is the business of a downloader of the user's choice: ``compound_requests`` says what hasn't been
answered well, so that a failed lookup is asked again and a good one never is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairweave.plans.scratch import materialized
from pairweave.sources.writers import table_exists

#: The parts that a record is put together from; its fields in the first part; what an id looks like.
PARTS = ["all", "kegg_id", "smiles"]
FIELDS = ["refmet_id", "name", "formula", "exactmass", "super_class", "main_class", "sub_class", "pubchem_cid", "inchi_key", "regno"]
ID_PATTERN = r"^RM\d{7}$"
ANSWERS = "kind string, id string, part string, status int, body string"


def id_type(query: Column) -> Column:
    """refmet_id for what looks like one, else name."""
    return F.when(query.rlike(ID_PATTERN), F.lit("refmet_id")).otherwise(F.lit("name"))


def quoted(value: Column, safe: str = "") -> Column:
    """Percent-encoded as a part of a path: letters, digits, _.-~ and the characters of ``safe`` stay."""
    out = F.url_encode(value)
    for written, meant in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), *((f"%{ord(c):02X}", c) for c in safe)):
        out = F.replace(out, F.lit(written), F.lit(meant))
    return out


def compound_requests(queries: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """query, part, path of the parts of compounds that have no good answer yet; null queries are passed over."""
    asked = queries.select("query").filter("query IS NOT NULL").distinct()
    every = asked.select("query", F.explode(F.array(*map(F.lit, PARTS))).alias("part"))
    if answers is not None:
        good = answers.filter("status IS NULL OR status < 400").select(F.col("id").alias("query"), "part").distinct()
        every = every.join(good, ["query", "part"], "left_anti")
    return every.withColumn("path", F.concat_ws("/", id_type(F.col("query")), quoted(F.col("query")), "part"))


def match_requests(names: DataFrame) -> DataFrame:
    """ref_name, path of a name search; colons, semicolons and slashes stay as they are."""
    return names.select("ref_name").filter("ref_name IS NOT NULL").distinct().withColumn("path", F.concat(F.lit("match/"), quoted(F.col("ref_name"), ":;/"), F.lit("/name")))


def read_compounds(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records (query, id_type, the first part's fields, kegg_id, smiles) and failures (query, reason).

    A record needs a first part with an id and good answers to all parts; a field that its part doesn't
    have is NULL. Of several answers to one part the good ones count, of these the one greatest in order.
    """
    good = F.coalesce("status", F.lit(200)) < 400
    body = lambda part: F.max(F.when(good & (F.col("part") == part), F.coalesce("body", F.lit("")))).alias(part)
    held = answers.groupBy(F.col("id").alias("query")).agg(*(body(p) for p in PARTS), F.max(F.when(F.col("part") == PARTS[0], F.col("status"))).alias("status"))
    field = lambda part, name: F.get_json_object(part, f"$.{name}")
    held = held.withColumn("found", field(PARTS[0], FIELDS[0]))
    missing = F.array_compact(F.array(*(F.when(F.col(p).isNull(), F.lit(p)) for p in PARTS)))
    reason = F.when(F.col(PARTS[0]).isNull() & F.col("status").isNotNull(), F.concat(F.lit("status "), F.col("status").cast("string")))
    reason = reason.when(F.col(PARTS[0]).isNotNull() & F.col("found").isNull(), "no entry").when(F.size(missing) > 0, F.concat(F.lit("no answer: "), F.array_join(missing, ", ")))
    told = held.withColumn("reason", reason)
    columns = [field(PARTS[0], f).alias(f) for f in FIELDS] + [field(p, p).alias(p) for p in PARTS[1:]]
    return told.filter("reason IS NULL").select("query", id_type(F.col("query")).alias("id_type"), *columns), told.filter("reason IS NOT NULL").select("query", "reason")


def compound_xref(records: DataFrame) -> DataFrame:
    """feature, member_id of ``enrich``: a compound's id in the sets' vocabulary, NULL where it has none."""
    member = F.when(F.trim("kegg_id") != "", F.trim("kegg_id"))
    return records.groupBy(F.col("refmet_id").alias("feature")).agg(F.max(member).alias("member_id"))


def _bucket(kind_of_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(kind_of_id), F.lit(buckets)).cast("int")


def write_answers(answers: DataFrame, path: str, buckets: int = 64) -> None:
    """Add answers to those under ``path``; an answer to the same (kind, id, part) replaces the old one."""
    spark, keys = answers.sparkSession, ["kind", "id", "part"]
    names = ["status", "body"]
    new = materialized(answers.groupBy(*keys).agg(F.max(F.struct(-F.coalesce("status", F.lit(0)), "status", "body")).alias("a")).select(*keys, *(f"a.{n}" for n in names)).withColumn("bucket", _bucket(F.col("id"), buckets)))
    if table_exists(spark, path):
        old = spark.read.schema(f"{ANSWERS}, bucket int").parquet(path).select(*new.columns)
        touched = old.join(F.broadcast(new.select("kind", "bucket").distinct()), ["kind", "bucket"], "left_semi").select(*new.columns)  # at most kinds x buckets rows
        new = materialized(touched.join(new, keys, "left_anti").unionByName(new))
    new.repartition("kind", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("kind", "bucket").parquet(path)


def read_answers(spark: SparkSession, path: str, kind: str, ids: list[str] | DataFrame | None = None, buckets: int = 64) -> DataFrame:
    """Answers of a kind: all, those of a list of ids (folders pruned when planned), or of a table with a column id (when run)."""
    own = spark.read.schema(f"{ANSWERS}, bucket int").parquet(path).filter(F.col("kind") == kind)
    if ids is None:
        return own.drop("bucket")
    if isinstance(ids, list):
        numbers = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "id string").select(_bucket(F.col("id"), buckets)).distinct().collect()]
        return own.filter(F.col("bucket").isin(numbers) & F.col("id").isin(ids)).drop("bucket")
    wanted = ids.select("id").distinct().withColumn("bucket", _bucket(F.col("id"), buckets))
    return own.join(wanted, ["bucket", "id"], "left_semi").drop("bucket")
