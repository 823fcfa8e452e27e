"""Readers: files of studies, lookup tables, raw quantification blocks and results of earlier steps."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from pairweave.operators.clean import parse_cells
from pairweave.schemas import CORRELATIONS

#: Cells that a CSV of measurements means as missing.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
#: Where a raw document may hold its measurements, in order of preference.
BLOCKS = ["MS_METABOLITE_DATA", "NMR_METABOLITE_DATA"]


def read_study_list(spark: SparkSession, path: str) -> DataFrame:
    """study_id: the first column of a CSV with a header."""
    table = spark.read.csv(path, header=True)
    return table.select(F.col(f"`{table.columns[0]}`").alias("study_id")).filter("study_id IS NOT NULL")


#: A complete quoted cell at the start of a cell; the rest of a quoted cell up to its closing quote.
_QUOTED, _CLOSING = r'(?:^|(?<=,))"[^"]*+(?:""[^"]*+)*+"(?!")', r'^[^"]*+(?:""[^"]*+)*+"(?!")'


def _states(before: WindowSpec, upto: WindowSpec, plain: Column, quoted: Column, entry: Column) -> Column:
    """Whether what stands before each row leaves a quoted cell open.

    Each row maps the state it meets to one it leaves (``plain`` if it meets none, ``quoted`` if it
    meets an open cell): it sets it, keeps it or turns it round. The state is what the last row left
    that sets it (or ``entry``), turned round as often as rows since then do.
    """
    turns = (plain & ~quoted).cast("int")
    count = F.coalesce(F.sum(turns).over(before), F.lit(0))
    last = F.last(F.when(plain == quoted, F.struct(plain.cast("int").alias("left"), F.sum(turns).over(upto).alias("turns"))), ignorenulls=True).over(before)
    return F.when(last.isNotNull(), (last["left"] + count - last["turns"]) % 2 == 1).otherwise((entry.cast("int") + count) % 2 == 1)


def _records(lines: DataFrame) -> DataFrame:
    """path, block, line and value of records: lines, joined where a quoted cell holds line breaks.

    Files are cut into splits at any line, also within a quoted cell. Lines of files in which no line
    leaves a cell open are records as they are. In the others, each split's lines give the state at its
    end for both states at its start; a window over the splits of a file (a row each) settles these,
    and then the lines. Only lines of records of several lines are shuffled by record.
    """
    opens = lambda text: F.regexp_replace(text, _QUOTED, "").rlike('(^|,)"')
    has = F.contains("value", F.lit('"'))
    after = F.when(F.col("value").rlike(_CLOSING), opens(F.regexp_replace("value", _CLOSING, "x"))).otherwise(True)
    lines = lines.withColumns({"plain": has & opens(F.col("value")), "quoted": ~has | after})
    torn = lines.filter("plain").select("path").distinct()  # a row per file that has line breaks in cells
    whole = lines.join(torn, "path", "left_anti").select("path", "block", "line", "value")
    odd = lines.join(torn, "path", "left_semi")

    in_split = Window.partitionBy("path", "block").orderBy("line")
    split_rows = in_split.rowsBetween(Window.unboundedPreceding, -1), in_split.rowsBetween(Window.unboundedPreceding, 0)
    state = lambda w, entry: _states(*w, F.col("plain"), F.col("quoted"), entry)
    leave = lambda c: F.when(c, F.col("quoted")).otherwise(F.col("plain"))
    tried = odd.withColumns({"e0": state(split_rows, F.lit(False)), "e1": state(split_rows, F.lit(True))})
    ends = tried.groupBy("path", "block").agg(F.max_by(leave(F.col("e0")), "line").alias("plain"), F.max_by(leave(F.col("e1")), "line").alias("quoted"))
    in_file = Window.partitionBy("path").orderBy("block")
    file_rows = in_file.rowsBetween(Window.unboundedPreceding, -1), in_file.rowsBetween(Window.unboundedPreceding, 0)
    entry = ends.select("path", "block", state(file_rows, F.lit(False)).alias("entry"))
    told = tried.join(entry, ["path", "block"]).withColumn("inside", F.when(F.col("entry"), F.col("e1")).otherwise(F.col("e0")))
    told = told.withColumns({"starts": (~F.col("inside")).cast("long"), "alone": ~F.col("inside") & ~F.col("plain")})
    # records are numbered by the lines that start one: in the split, and in the splits before
    starts = told.groupBy("path", "block").agg(F.sum("starts").alias("k")).select("path", "block", F.coalesce(F.sum("k").over(file_rows[0]), F.lit(0)).alias("first"))
    numbered = told.withColumn("k", F.sum("starts").over(split_rows[1])).join(starts, ["path", "block"])
    pieces = numbered.filter(~F.col("alone")).groupBy("path", (F.col("first") + F.col("k")).alias("record")).agg(F.array_sort(F.collect_list(F.struct("block", "line", "value"))).alias("p"))
    joined = pieces.select("path", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["line"].alias("line"), F.array_join(F.col("p.value"), "\n").alias("value"))
    return whole.unionByName(told.filter("alone").select(*whole.columns)).unionByName(joined).filter("value != ''")


def _distinct_names(cells: list[str]) -> list[str]:
    """Names of columns after the first: one that is empty is "Unnamed: place", a repeated one gets .1, .2, ..."""
    names, taken = [], set(cells[1:])
    for place, name in enumerate(cells[1:], 1):
        own, k = name or f"Unnamed: {place}", 0
        while own in names or (k and own in taken):
            k += 1
            own = f"{name or f'Unnamed: {place}'}.{k}"
        names.append(own)
    return names


def read_study_matrices(spark: SparkSession, folder: str, suffix: str = "_combined.csv", parse: bool = True, below_limit: str = "zero", study: str | None = None) -> DataFrame:
    """Wide CSV files, one per study (samples x features, the sample's id first), as long observations.

    A study's id is its file's name without the suffix, or what the first group of the pattern ``study``
    finds in the file's path.

    Files have different columns, so records are split into cells (quotes are undone) and meet their
    file's names, which are its first record: one plan, however many studies there are, and a large file
    is read by many tasks, also where a quoted cell holds line breaks. Of equal names the second is
    another feature with .1 after its name, and so on. Each record is a row of its own, row_id, also
    where sample ids repeat. Cells beyond the names are passed over, missing ones are NULL.
    """
    lines = spark.read.option("pathGlobFilter", f"*{suffix}").text(folder)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")  # in order within a split
    records = _records(lines)
    text = F.min_by("value", F.struct("block", "line")).alias("value"), F.min(F.struct("block", "line")).alias("place")
    heads = records.filter("block = 0").groupBy("path").agg(*text)  # one row per study
    out = pa.schema([("path", pa.string()), ("names", pa.list_(pa.string())), ("block", pa.int64()), ("line", pa.int64())])

    def split_head(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            names = [_distinct_names(next(csv.reader([x.removeprefix("\ufeff")]), [])) for x in part.column("value").to_pylist()]
            place = part.column("place")
            yield pa.RecordBatch.from_arrays([part.column("path"), pa.array(names, out.field("names").type), place.field("block"), place.field("line")], schema=out)

    def split_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            cells = [next(csv.reader([x]), []) for x in part.column("value").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(cells, pa.list_(pa.string()))], names=["path", "block", "line", "cells"])

    heads = heads.mapInArrow(split_head, "path string, names array<string>, block long, line long").withColumnsRenamed({"block": "b0", "line": "l0"})
    rows = records.select("path", "block", "line", "value").mapInArrow(split_rows, "path string, block long, line long, cells array<string>")
    joined = rows.join(heads, "path").filter("line != l0 OR block != b0")
    named = F.regexp_extract("path", study or f"([^/]*){re.escape(suffix)}$", 1)
    pairs = F.transform("names", lambda name, k: F.struct(name.alias("feature"), F.get("cells", k + 1).alias("raw")))
    row = F.concat_ws(":", F.lit("row"), F.hex(F.xxhash64("path")), "block", "line")
    long = joined.select(F.url_decode(F.replace(named, F.lit("+"), F.lit("%2B"))).alias("study_id"), F.col("cells")[0].alias("sample_id"), row.alias("row_id"), F.explode(pairs).alias("c"))
    long = long.select("study_id", "sample_id", "row_id", "c.feature", F.when(~F.col("c.raw").isin(MISSING), F.col("c.raw")).alias("raw"))
    return parse_cells(long, below_limit) if parse else long


def unpivot_matrix(wide: DataFrame, study_id: str) -> DataFrame:
    """study_id, sample_id, feature, raw of a wide table whose first column names the sample."""
    first, *features = wide.columns
    quoted = [F.col(f"`{c}`").cast("string").alias(c) for c in features]
    long = wide.select(F.col(f"`{first}`").cast("string").alias("sample_id"), *quoted).unpivot("sample_id", [f"`{c}`" for c in features], "feature", "raw")
    raw = F.when(~F.col("raw").isin(MISSING), F.col("raw"))
    return long.select(F.lit(study_id).alias("study_id"), "sample_id", "feature", raw.alias("raw"))


def read_raw_blocks(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw documents (study_id, analysis_id, body as JSON) to cells and rejected documents.

    The first block that is there holds rows of name and value by sample; the name is in the key
    "Metabolite". Cells: study_id, analysis_id, sample_id, raw_name, raw. A document without a block
    or whose rows have no name is rejected with the reason.
    """
    blocks = F.coalesce(*(F.get_json_object("body", f"$.{b}.Data") for b in BLOCKS))
    rows = F.from_json(blocks, "array<map<string,string>>")
    read = documents.select("study_id", "analysis_id", rows.alias("rows"))
    named = F.exists("rows", lambda m: F.map_contains_key(m, "Metabolite"))
    reason = F.when(F.col("rows").isNull(), "no block").when(~named, "no names")
    bad = read.withColumn("reason", reason).filter("reason IS NOT NULL").drop("rows")
    good = read.withColumn("reason", reason).filter("reason IS NULL").select("study_id", "analysis_id", F.explode("rows").alias("m"))
    cells = good.select("study_id", "analysis_id", F.col("m")["Metabolite"].alias("raw_name"), F.explode("m").alias("sample_id", "raw"))
    return cells.filter("sample_id != 'Metabolite'"), bad


def _listed(body: Column, fields: str) -> Column:
    """The objects of a response: one object that has the first of ``fields`` itself, or an object of objects, by key."""
    first = fields.split()[0]
    one, many = F.from_json(body, f"struct<{fields}>"), F.from_json(body, f"map<string, struct<{fields}>>")
    return F.when(F.get_json_object(body, f"$.{first.rstrip(':')}").isNotNull(), F.array(one)).otherwise(F.map_values(many))


def read_analysis_ids(responses: DataFrame) -> DataFrame:
    """study_id, analysis_id from responses (study_id, body): one analysis as an object, several as an object of objects."""
    rows = responses.select("study_id", F.explode(_listed(F.col("body"), "analysis_id: string")).alias("a"))
    return rows.select("study_id", "a.analysis_id").filter("analysis_id IS NOT NULL")


def read_name_maps(responses: DataFrame) -> DataFrame:
    """analysis_id, raw_name, ref_name ('' where unmapped) from responses (analysis_id, body) of the same two shapes.

    An empty response has no rows; of one raw name's rows in an analysis the last counts.
    """
    listed = _listed(F.col("body"), "metabolite_name: string, refmet_name: string")
    rows = responses.select("analysis_id", F.posexplode(listed).alias("k", "m")).filter("m.metabolite_name IS NOT NULL")
    last = rows.groupBy("analysis_id", F.col("m.metabolite_name").alias("raw_name")).agg(F.max_by("m.refmet_name", "k").alias("ref_name"))
    return last.withColumn("ref_name", F.coalesce("ref_name", F.lit("")))


def read_matches(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Aliases (ref_name, feature) and names without a match, from responses (ref_name, status, body) of a name search.

    No match: status 404, an empty body, or an id that is missing, empty or "-". Any other status from
    400 on is neither: it has to be asked again.
    """
    asked = responses.filter("status IS NULL OR status < 400 OR status = 404")
    feature = F.when(F.coalesce("status", F.lit(200)) != 404, F.get_json_object("body", "$.refmet_id"))
    read = asked.select("ref_name", F.when(~feature.isin("", "-"), feature).alias("feature"))
    return read.filter("feature IS NOT NULL"), read.filter("feature IS NULL").select("ref_name")


def read_lookup(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """Two columns of a CSV; of rows with one key the last of the file counts."""
    return _by_line(spark, path).filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, "_line").alias(value))


def _by_line(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with _line: what orders its lines (files by name)."""
    place = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("l"))
    return spark.read.csv(path, header=True).withColumn("_line", place)


def read_annotation(spark: SparkSession, path: str, id_column: str) -> DataFrame:
    """All columns of an annotation CSV, its id renamed to feature, one row per id: the first of the file."""
    table = _by_line(spark, path).withColumnRenamed(id_column, "feature")
    rest = [c for c in table.columns if c not in ("feature", "_line")]
    first = table.groupBy("feature").agg(F.min_by(F.struct(*rest), "_line").alias("r")) if rest else table.select("feature").distinct()
    return first.select("feature", *(F.col("r")[c].alias(c) for c in rest))


def read_correlations(spark: SparkSession, *paths: str) -> DataFrame:
    """Correlation files under the declared schema; a file whose n is an integer is cast."""
    out = None
    for path in paths:
        part = spark.read.parquet(path)
        part = part.select(*(F.col(f.name).cast(f.dataType) for f in CORRELATIONS))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no paths")
    return out


def read_sets(spark: SparkSession, path: str) -> DataFrame:
    """A ragged text table, tab-separated: set id, name, then members."""
    cells = F.split("value", "\t")
    members = F.filter(F.slice(cells, 3, 100_000_000), lambda x: x != "")
    return spark.read.text(path).filter("value != ''").select(cells[0].alias("set_id"), F.get(cells, 1).alias("set_name"), members.alias("members"))


def read_network(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges, nodes and symmetric distances that ``write_network`` wrote."""
    from pairweave.operators.graph import symmetrize

    edges, nodes, distances = (spark.read.parquet(f"{folder}/{x}") for x in ("edges", "nodes", "distances"))
    return edges, nodes, symmetrize(distances)
