"""One wide sheet per project under the project's own header."""

import csv
import glob
import os

import pytest
from pyspark.sql import functions as F

from svcseam import sinks
from svcseam.operators import features as M
from svcseam.sources import wide_csv as W

LONG = "project_id string, class_name string, related_table string, feature string, value double"


def _sheets(path):
    """project folder → (header, rows) over all its parts"""
    out = {}
    for f in sorted(glob.glob(f"{path}/project_id=*/*.csv")):
        head, *rows = list(csv.reader(open(f, newline="", encoding="utf-8")))
        name = os.path.basename(os.path.dirname(f))
        have = out.setdefault(name, (head, []))
        assert have[0] == head
        have[1].extend(rows)
    return out


def test_two_projects_with_different_vocabularies(spark, tmp_path):
    rows = [("a", "X", "t", "num_calls", 1.5), ("a", "X", "t", "tfidf_pet", 0.25), ("a", "Y", None, "tfidf_été", -0.0),
            ("b", 'Q"u,ote', "t", "tfidf_vet", 1e-17), ("b", "Z", "t", "num_calls", None), ("p/q=1", "X", "", "tfidf_a,b", 2.0), (None, "N", None, "f", 3.0)]
    sinks.write_features(spark.createDataFrame(rows, LONG), str(tmp_path / "f"))
    got = _sheets(tmp_path / "f/wide")
    ids = ["class_name", "related_table"]
    assert got["project_id=a"] == (ids + ["num_calls", "tfidf_pet", "tfidf_été"], got["project_id=a"][1])
    assert sorted(got["project_id=a"][1]) == [["X", "t", "1.5", "0.25", "0.0"], ["Y", "", "0.0", "0.0", "-0.0"]]
    assert got["project_id=b"][0] == ids + ["num_calls", "tfidf_vet"] and sorted(got["project_id=b"][1]) == [['Q"u,ote', "t", "0.0", "1e-17"], ["Z", "t", "0.0", "0.0"]]
    assert set(got) == {"project_id=a", "project_id=b", "project_id=p%2Fq%3D1", f"project_id={W.NULL_PROJECT}"}
    # Spark reads a sheet, and the folders as partitions
    b = spark.read.option("header", True).csv(str(tmp_path / "f/wide/project_id=b"))
    assert b.columns == got["project_id=b"][0] and b.count() == 2
    names = {r[0] for r in spark.read.option("basePath", str(tmp_path / "f/wide")).text(str(tmp_path / "f/wide")).select("project_id").distinct().collect()}
    assert names == {"a", "b", "p/q=1", None}


def test_no_schema_switch_beyond_any_number_of_columns(spark, tmp_path):
    n = 10_500
    long = (spark.range(n).select(F.lit("wide").alias("project_id"), F.lit("A").alias("class_name"), F.format_string("f%06d", "id").alias("feature"), F.lit(1.0).alias("value"))
            .union(spark.createDataFrame([("small", "B", "g", 2.0)], "project_id string, class_name string, feature string, value double")))
    sinks.write_features(long, str(tmp_path / "f"))
    got = _sheets(tmp_path / "f/wide")
    assert got["project_id=small"] == (["class_name", "g"], [["B", "2.0"]])
    head, rows = got["project_id=wide"]
    assert head == ["class_name"] + [f"f{i:06d}" for i in range(n)] and rows == [["A"] + ["1.0"] * n]


def test_parts_share_a_header_and_hold_every_class_once(spark, tmp_path):
    long = spark.range(300).select(F.lit("p").alias("project_id"), F.format_string("C%03d", "id").alias("class_name"),
                                   F.concat(F.lit("f"), F.col("id") % 7).alias("feature"), F.col("id").cast("double").alias("value"))
    W.write_sheets(M.wide_rows(long, part_rows=50), str(tmp_path / "w"))
    files = glob.glob(str(tmp_path / "w/project_id=p/*.csv"))
    assert len(files) > 3
    head, rows = _sheets(tmp_path / "w")["project_id=p"]
    assert head == ["class_name"] + [f"f{i}" for i in range(7)]
    assert sorted(r[0] for r in rows) == [f"C{i:03d}" for i in range(300)]
    assert all(float(r[1 + int(r[0][1:]) % 7]) == int(r[0][1:]) and sum(x != "0.0" for x in r[1:]) <= 1 for r in rows)


def test_overwrite_replaces_and_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "w")
    first = spark.createDataFrame([("old", "A", "f", 1.0), ("both", "A", "f", 1.0)], "project_id string, class_name string, feature string, value double")
    W.write_sheets(M.wide_rows(first), path)
    second = spark.createDataFrame([("both", "B", "g", 2.0)], first.schema)
    W.write_sheets(M.wide_rows(second), path)
    assert _sheets(path) == {"project_id=both": (["class_name", "g"], [["B", "2.0"]])}
    broken = M.wide_rows(second).withColumn("cells", F.when(F.col("lead") == 1, F.raise_error(F.lit("lost")).cast("array<double>")).otherwise(F.col("cells")))
    with pytest.raises(Exception, match="lost"):
        W.write_sheets(broken, path)
    assert _sheets(path) == {"project_id=both": (["class_name", "g"], [["B", "2.0"]])} and not os.path.exists(f"{path}/{W.ATTEMPTS}")
    W.write_sheets(M.wide_rows(second.limit(0)), path)
    assert _sheets(path) == {}


def test_sheets_of_cells_equal_those_of_long_features(spark, tmp_path):
    """a class's features are one row, not one row each; the sheets are the same, byte for byte in each line."""
    from svcseam import rules
    numbers = [f"cast(id % {i + 2} as bigint) {c}" for i, c in enumerate(rules.NUMERIC_COLUMNS)]
    matrix = spark.range(40).selectExpr("if(id % 7 = 0, null, concat('p', id % 3)) project_id", "concat('PetShop', chr(65 + id % 26), 'Service') class_name",
                                        "if(id % 2 = 0 or id % 7 = 0, null, 'pets') related_table", *numbers).dropDuplicates(["project_id", "class_name"])
    matrix = matrix.union(matrix.limit(3)).union(matrix.limit(1).withColumn("class_name", F.lit(None).cast("string")).withColumn("related_table", F.lit(None).cast("string"))).localCheckpoint()
    tfidf = M.class_tfidf(matrix.select("project_id", "class_name").distinct())
    ids = ["class_name", "related_table"]
    old = M.wide_rows(M.composite_long(M.zscores_long(M.zscores(matrix)), tfidf, ids=matrix.select("project_id", *ids)), ids)
    new = M.wide_rows(M.composite_cells(M.zscores(matrix, ids=["related_table"]), tfidf), ids, names=M.composite_names(matrix))
    W.write_sheets(old, str(tmp_path / "old"))
    W.write_sheets(new, str(tmp_path / "new"))
    read = lambda p: {k: (h, sorted(r)) for k, (h, r) in _sheets(str(tmp_path / p)).items()}
    a, b = read("old"), read("new")
    assert a == b and len(a) == 4
