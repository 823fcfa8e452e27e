import pytest
from pyspark.sql import functions as F

from pairweave.operators import clean
from pairweave.sources.readers import MISSING, read_raw_blocks, unpivot_matrix


def obs(spark, *rows):
    return spark.createDataFrame(rows, "study_id string, sample_id string, feature string, value double")


def values(df, *by):
    return {tuple(r[c] for c in by): r["value"] for r in df.collect()}


@pytest.mark.parametrize(
    ("raw", "zero", "null"),
    [
        (" LOD ", 0.0, None), ("&lt; lod", 0.0, None), ("<LOD", None, None), ("1d", None, None), ("inf", None, None), ("1_000", None, None), ("0x1F", None, None),
        (" 12.5 ", 12.5, 12.5), ("-.5e2", -50.0, -50.0), ("13673.37%2", None, None), ("NaN", None, None), (None, None, None), ("", None, None), ("1e999", None, None),
    ],
)
def test_cells(spark, raw, zero, null):
    df = spark.createDataFrame([("a", raw)], "study_id string, raw string")
    assert clean.parse_cells(df).first()["value"] == zero
    assert clean.parse_cells(df, "null").first()["value"] == null


def test_bad_options(spark):
    df = obs(spark, ("s", "a", "f", 1.0))
    with pytest.raises(ValueError):
        clean.transform_values(df, "cube")
    with pytest.raises(ValueError):
        clean.parse_cells(df.withColumn("raw", F.lit("1")), "one")
    with pytest.raises(ValueError):
        clean.merge_analyses(df, how="left")


def test_transforms(spark):
    df = obs(spark, ("s", "a", "f", -1.0), ("s", "b", "f", -2.0), ("s", "c", "f", 4.0))
    assert values(clean.transform_values(df, "log"), "sample_id")[("a",)] is None
    assert values(clean.transform_values(df, "sqrt"), "sample_id") == {("a",): None, ("b",): None, ("c",): 2.0}


def test_low_variance(spark):
    df = obs(spark, *[("s", str(i), "two", float(i % 2)) for i in range(5)], *[("s", str(i), "three", float(i % 3)) for i in range(5)])
    assert {r["feature"] for r in clean.drop_low_variance(df).collect()} == {"three"}
    assert clean.drop_low_variance(df, None).count() == 10


def test_pqn(spark):
    rows = [("s", str(i), f, v * (i + 1)) for i in range(3) for f, v in (("a", 1.0), ("b", 2.0), ("c", 3.0))]
    out = values(clean.normalize_pqn(obs(spark, *rows, ("s", "z", "a", 0.0), ("s", "z", "b", 0.0))), "sample_id", "feature")
    assert out[("1", "b")] == pytest.approx(4.0)  # the same mixture in every sample: no dilution to correct
    assert out[("z", "a")] is None  # a sample without any signal


def test_merge_inner_counts_presence(spark):
    cells = spark.createDataFrame([("s", "x", "1", "f", None), ("s", "y", "1", "f", 2.0), ("s", "y", "2", "f", 3.0)], "study_id string, analysis_id string, sample_id string, feature string, value double")
    assert {r["sample_id"] for r in clean.merge_analyses(cells, how="inner").collect()} == {"1"}
    assert clean.average_duplicates(cells).filter("sample_id = '1'").first()["value"] == 2.0


def test_names(spark):
    raw = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "raw_name string")
    name_map = spark.createDataFrame([("a", "ra"), ("b", "rb"), ("c", "rc"), ("d", "")], "raw_name string, ref_name string")
    ids = spark.createDataFrame([("ra", "RM0000001")], "ref_name string, feature string")
    aliases = spark.createDataFrame([("rb", "RM0000002")], "ref_name string, feature string")
    named = clean.standardize_names(raw, name_map, ids, aliases)
    assert {r["raw_name"]: r["feature"] for r in named.collect()} == {"a": "RM0000001", "b": "RM0000002", "c": "rc", "d": "UNMAPPED:d", "e": "UNMAPPED:e"}
    assert [r["feature"] for r in clean.rogue_names(named).collect()] == ["rc"]


def test_wide_matrix(spark, tmp_path):
    (tmp_path / "ST1_combined.csv").write_text("sample,RM0000001,b.c\ns1,1,NA\ns2,< LOD,2.5\n")
    (tmp_path / "ST2_combined.csv").write_text("sample,RM0000001\ns1,7\n")
    from pairweave.sources.readers import read_study_matrices

    out = {(r["study_id"], r["sample_id"], r["feature"]): r["value"] for r in read_study_matrices(spark, str(tmp_path)).collect()}
    assert out == {("ST1", "s1", "RM0000001"): 1.0, ("ST1", "s1", "b.c"): None, ("ST1", "s2", "RM0000001"): 0.0, ("ST1", "s2", "b.c"): 2.5, ("ST2", "s1", "RM0000001"): 7.0}
    assert "NA" in MISSING
    assert unpivot_matrix(spark.createDataFrame([("a", "1")], "id string, f string"), "s").count() == 1


def test_raw_blocks(spark):
    docs = spark.createDataFrame(
        [("s", "1", '{"MS_METABOLITE_DATA":{"Data":[{"Metabolite":"m","a":"1","b":"x"}]}}'), ("s", "2", '{"OTHER":1}'), ("s", "3", '{"NMR_METABOLITE_DATA":{"Data":[{"Name":"m","a":"1"}]}}'), ("s", "4", None)],
        "study_id string, analysis_id string, body string",
    )
    cells, bad = read_raw_blocks(docs)
    assert {(r["sample_id"], r["raw_name"], r["raw"]) for r in cells.collect()} == {("a", "m", "1"), ("b", "m", "x")}
    assert {r["analysis_id"]: r["reason"] for r in bad.collect()} == {"2": "no block", "3": "no names", "4": "no block"}


def test_large_matrices_are_split(spark, tmp_path):
    from pairweave.sources.readers import read_study_matrices

    header = 'sample,"1,2-diol",b'
    (tmp_path / "ST 1+_combined.csv").write_text("\ufeff" + header + "\n" + "".join(f'"s{i}",{i},<LOD\n' for i in range(3000)))
    (tmp_path / "ST2_combined.csv").write_text("sample\nx\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        out = read_study_matrices(spark, str(tmp_path))
        rows = out.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 6000 and {r["feature"] for r in rows} == {"1,2-diol", "b"} and {r["study_id"] for r in rows} == {"ST 1+"}
    assert sorted(r["value"] for r in rows if r["feature"] == "1,2-diol") == [float(i) for i in range(3000)]


def test_last_line_counts(spark, tmp_path):
    from pairweave.sources.readers import read_annotation, read_lookup

    (tmp_path / "names.csv").write_text("id,name,k\nRM9,a,1\nRM2,b,2\nRM1,a,3\n,c,4\n")
    assert {r["name"]: r["id"] for r in read_lookup(spark, str(tmp_path / "names.csv"), "name", "id").collect()} == {"a": "RM1", "b": "RM2", "c": None}
    table = read_annotation(spark, str(tmp_path / "names.csv"), "name")
    assert table.columns == ["feature", "id", "k"] and {r["feature"]: r["k"] for r in table.collect()} == {"a": "1", "b": "2", "c": "4"}


def test_responses(spark):
    from pairweave.sources.readers import read_analysis_ids, read_matches, read_name_maps

    ids = spark.createDataFrame([("s", '{"study_id":"s","analysis_id":"AN1"}'), ("t", '{"1":{"analysis_id":"AN2"},"2":{"analysis_id":"AN3"}}'), ("u", "[]"), ("v", None)], "study_id string, body string")
    assert sorted(map(tuple, read_analysis_ids(ids).collect())) == [("s", "AN1"), ("t", "AN2"), ("t", "AN3")]
    maps = spark.createDataFrame(
        [("1", '{"metabolite_name":"x","refmet_name":"X"}'), ("2", '{"1":{"metabolite_name":"x","refmet_name":"A"},"2":{"metabolite_name":"y"},"3":{"metabolite_name":"x","refmet_name":"B"}}'), ("3", "[]"), ("4", "{}")],
        "analysis_id string, body string",
    )
    assert sorted(map(tuple, read_name_maps(maps).collect())) == [("1", "x", "X"), ("2", "x", "B"), ("2", "y", "")]
    found, none = read_matches(spark.createDataFrame([("a", 200, '{"refmet_id":"RM1"}'), ("b", 404, "gone"), ("c", 200, '{"refmet_id":"-"}'), ("d", 200, "[]"), ("e", 500, ""), ("f", None, '{"refmet_id":""}')], "ref_name string, status int, body string"))
    assert [tuple(r) for r in found.collect()] == [("a", "RM1")] and sorted(r[0] for r in none.collect()) == ["b", "c", "d", "f"]


def messy_study(tmp_path):
    """Five rows of three samples, and two columns of one name."""
    (tmp_path / "ST1_combined.csv").write_text("sample_id,A,B,A\ns1,1,2,5\ns1,2,1,7\ns2,4,3,1\ns3,3,5,2\ns3,5,4,9\n")
    return {"A": [1, 2, 4, 3, 5], "A.1": [5, 7, 1, 2, 9], "B": [2, 1, 3, 5, 4]}


@pytest.mark.parametrize("method", ["join", "gram", "spearman", "kendall"])
def test_repeated_columns_and_samples(spark, tmp_path, method):
    import itertools

    import numpy as np

    from pairweave.operators import correlate
    from pairweave.sources.readers import read_study_matrices

    table = messy_study(tmp_path)
    read = read_study_matrices(spark, str(tmp_path))
    found = {"spearman": correlate.spearman, "kendall": correlate.kendall}.get(method, lambda o: correlate.pearson(o, method))(read)
    got = {(r["feature_1"], r["feature_2"]): (r["n"], r["corr"]) for r in found.collect()}
    assert set(got) == set(itertools.combinations(sorted(table), 2))
    rank = lambda v: np.argsort(np.argsort(v))
    for (a, b), (n, r) in got.items():
        x, y = np.array(table[a], float), np.array(table[b], float)
        if method == "kendall":
            want = np.mean([np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i, j in itertools.combinations(range(5), 2)])
        else:
            want = np.corrcoef(rank(x), rank(y))[0, 1] if method == "spearman" else np.corrcoef(x, y)[0, 1]
        assert n == 5 and r == pytest.approx(want)


def test_repeated_cells_are_averaged_in_every_plan(spark):
    from pairweave.operators import correlate

    once = [("s", str(i), f, float(v)) for i, (x, y) in enumerate([(1, 2), (2, 1), (4, 3), (3, 5), (5, 4)]) for f, v in (("x", x), ("y", y))]
    twice = [(s, i, f, v + d) for s, i, f, v in once if i == "2" for d in (-0.5, 0.5)] + [r for r in once if r[1] != "2"]
    want = correlate.pearson(obs(spark, *once)).first()
    for found in (correlate.pearson(obs(spark, *twice)), correlate.pearson(obs(spark, *twice), "gram"), correlate.spearman(obs(spark, *twice)), correlate.kendall(obs(spark, *twice))):
        assert found.first()["n"] == 5.0
    assert correlate.pearson(obs(spark, *twice)).first()["corr"] == pytest.approx(want["corr"])
    assert correlate.pearson(obs(spark, *twice), "gram").first()["corr"] == pytest.approx(want["corr"])


def test_names_of_columns():
    from pairweave.sources.readers import _distinct_names

    assert _distinct_names(["id", "A", "B", "A", "A"]) == ["A", "B", "A.1", "A.2"]
    assert _distinct_names(["id", "A", "A.1", "A"]) == ["A", "A.1", "A.2"]
    assert _distinct_names(["id", "A", "A", "A.1"]) == ["A", "A.2", "A.1"]
    assert _distinct_names(["id", "", ""]) == ["Unnamed: 1", "Unnamed: 2"] and _distinct_names([]) == []


@pytest.mark.parametrize("split", [40, 64, 4096])
def test_line_breaks_in_cells_across_splits(spark, tmp_path, split):
    """Records as Python's reader has them, however the file is cut."""
    import csv
    import io
    import random

    from pairweave.sources.readers import read_study_matrices

    rng = random.Random(split)
    for study in range(4):
        rows = [["sample", "na\nme,1", 'say "b"', "c"]] + [[f"s{i}", *("".join(rng.choice(["a", "\n", '"', ",", "1", "\n\n"]) for _ in range(rng.choice([0, 1, 6, 60]))) + "z" for _ in range(3))] for i in range(25)]
        text = io.StringIO()
        csv.writer(text, lineterminator="\n").writerows(rows)
        (tmp_path / f"ST{study}_combined.csv").write_text(text.getvalue() + ("" if study else 'last,5" pipe,x"y"z,\n'))
        if study == 0:
            want = {(r[0], n): v or None for r in [*rows[1:], ["last", '5" pipe', 'x"y"z', ""]] for n, v in zip(rows[0][1:], r[1:], strict=True)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        rows = read_study_matrices(spark, str(tmp_path), parse=False).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 4 * 25 * 3 + 3 and len({(r["study_id"], r["row_id"]) for r in rows}) == 101
    assert {(r["sample_id"], r["feature"]): r["raw"] for r in rows if r["study_id"] == "ST0"} == want
