"""S1–S12 on a tiny on-disk corpus (tests only; a cluster uses shared storage)."""

import os
import random

import pytest

from pyspark.sql import functions as F

from svcseam.operators import ddl as D
from svcseam.plans import run as R
from svcseam.sources import files as S
from svcseam import sinks

JAVA_OWNER = """package org.demo.owner;
public class OwnerController {
    @Autowired private OwnerRepository owners;
    void list() { owners.findAll(); owners.count(); }
}
"""
JAVA_VET = """package org.demo.vet;
class VetController {
    void list() { vets.findAll(); }
}
"""
SCHEMA = """CREATE TABLE owners (
  id INT NOT NULL PRIMARY KEY,
  first_name VARCHAR(30)
);
CREATE TABLE pets (
  id INT,
  owner_id INT
);
"""
LOG = "\n".join([
    "GET /owners", "select * from owners", "GET /owners/1/pets", "select * from pets", "GET /vets",
    "select * from vets v"]) + "\n"


def _corpus(root):
    os.makedirs(f"{root}/demo/src/main/java", exist_ok=True)
    os.makedirs(f"{root}/demo/src/main/resources/db/mysql", exist_ok=True)
    os.makedirs(f"{root}/other/src/main/java", exist_ok=True)
    os.makedirs(f"{root}/demo/src/test/java", exist_ok=True)
    open(f"{root}/demo/src/main/java/OwnerController.java", "w").write(JAVA_OWNER)
    open(f"{root}/demo/src/main/java/VetController.java", "w").write(JAVA_VET)
    open(f"{root}/demo/src/main/resources/schema.sql", "w").write(SCHEMA)
    open(f"{root}/demo/src/main/resources/db/mysql/schema.sql", "w").write("CREATE TABLE zzz (\n  id INT\n);")
    open(f"{root}/demo/app.log", "w").write(LOG)
    open(f"{root}/demo/src/test/java/ATest.java", "w").write("class ATest { void f() { owners.go(); } }\n")
    open(f"{root}/other/src/main/java/A.java", "w").write("class AService { void f() { repo.go(); } }\n")


def test_sources(spark, tmp_path):
    root = str(tmp_path / "corpus")
    _corpus(root)
    src = S.source_files(spark, root)
    assert sorted(r.project_id for r in src.collect()) == ["demo", "demo", "other"]
    ddl = D.pick_ddl(S.ddl_candidates(spark, root)).collect()
    assert [(r.project_id, r.path) for r in ddl] == [("demo", "demo/src/main/resources/schema.sql")]
    ll = S.log_lines(spark, root + "/*/*.log", root=root).orderBy("line_no").collect()
    assert [r.line_no for r in ll] == [1, 2, 3, 4, 5, 6] and ll[4].line == "GET /vets"
    assert {r.project_id for r in ll} == {"demo"}


def test_roots_relative_encoded_and_without_evidence(spark, tmp_path, monkeypatch):
    root = tmp_path / "my corpus+1"
    _corpus(str(root))
    os.makedirs(root / "demo/logs/2024/may", exist_ok=True)
    (root / "demo/logs/2024/may/deep.log").write_text("GET /deep\n")
    os.makedirs(root / "demo/module/src/main/resources", exist_ok=True)
    (root / "demo/module/src/main/resources/schema.sql").write_text("CREATE TABLE nested (\n  id INT\n);")
    (root / "demo/dump.sql").write_text("INSERT INTO x VALUES (1);")
    for at in (str(root), "file:" + str(root) + "/", os.path.relpath(root)):
        x = R.load_corpus(spark, at)
        assert {r.project_id for r in x.source_files.collect()} == {"demo", "other"}
        assert not [r for r in x.source_files.collect() if "ATest" in r.path]
        assert sorted(r.line for r in x.log_lines.collect() if "deep" in r.session_id) == ["GET /deep"]
        assert [(r.project_id, r.path) for r in x.ddl_scripts.collect()] == [("demo", "demo/src/main/resources/schema.sql")]
        assert "owners" in {r.table_name for r in x.tables.collect()}
    bare = tmp_path / "bare"
    os.makedirs(bare / "p/src/main/java")
    (bare / "p/src/main/java/A.java").write_text("class AService { void f() { repo.go(); } }\n")
    x = R.extract_corpus(spark, str(bare), str(tmp_path / "out"))
    m = x.matrix.collect()
    assert [(r.class_name, r.calls_out, r.related_table, r.db_columns, r.log_frequency) for r in m] == [("AService", 1, None, 0, 0)]


def test_line_numbers_across_splits(spark, tmp_path):
    """Exact numbering when one file is read by many tasks."""
    p = tmp_path / "big.log"
    n = 20000
    p.write_text("".join(f"line {i}\n" for i in range(1, n + 1)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        df = S.log_lines(spark, str(p), project_id="p")
        assert df.rdd.getNumPartitions() >= 1
        bad = df.filter(F.col("line") != F.concat(F.lit("line "), F.col("line_no").cast("string"))).count()
        assert df.count() == n and bad == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_extract_corpus_and_manifest(spark, tmp_path):
    root = str(tmp_path / "corpus")
    _corpus(root)
    out = str(tmp_path / "out")
    x = R.extract_corpus(spark, root, out)
    m = {r.class_name: r for r in x.matrix.collect()}
    assert m["OwnerController"].related_table == "owners" and m["OwnerController"].calls_out == 3
    assert m["OwnerController"].db_columns == 2 and m["OwnerController"].log_frequency == 1
    assert m["AService"].related_table is None
    raw = spark.read.option("header", True).csv(out + "/feature_matrix.csv")
    assert raw.columns[:14] == ["class_name", "related_table", "calls_out", "calls_in", "deps_unique",
                                "has_autowired", "db_columns", "db_fk_out", "db_fk_in", "db_relations",
                                "log_frequency", "is_controller", "is_service", "is_repository"]
    readable = spark.read.option("header", True).csv(out + "/feature_matrix_readable.csv")
    assert "Classe Java" in readable.columns
    man = {r.artifact: r for r in sinks.manifest(spark, out).collect()}
    assert all(man[a].exists for a in ["call_graph.json", "db_features.json", "logs_features.json",
                                       "feature_matrix.csv", "feature_normalized.csv", "tfidf_matrix.csv",
                                       "composite_features.csv"])
    back = S.read_matrix_csv(spark, out + "/feature_matrix.csv/project_id=demo")
    assert back.count() == 2
    assert S.read_json(spark, str(tmp_path / "missing.json"), back.schema) is None
    key = ["project_id", "class_name"]
    again = R.matrix_from_artifacts(spark, out)
    assert again.orderBy(*key).collect() == x.matrix.orderBy(*key).collect()
    wrong, profile, comp, status = R.checks_from_matrix_csv(spark, out + "/feature_matrix.csv/project_id=demo", "demo")
    assert wrong == [] and profile.count() == 12 and {(r.step, r.n_issues, r.ok) for r in status.collect()} == {(2, 0, True), (3, 0, True)}
    direct = x.composite.filter("project_id = 'demo'").select(*comp.columns)
    rounded = [F.round(F.col(c), 9).alias(c) if c == "value" else F.col(c) for c in comp.columns]
    assert sorted(map(tuple, comp.select(*rounded).collect()), key=str) == sorted(map(tuple, direct.select(*rounded).collect()), key=str)
    rep = {(r.project_id, r.metric): float(r.value) for r in spark.read.option("header", True).csv(out + "/validation_report").collect() if r.metric != "issues"}
    assert rep[("demo", "tables")] == 2 and rep[("demo", "call_type:autowired")] == 1 and rep[("demo", "weight_tfidf")] == 0.3
    listed = {r.artifact: r.exists for r in spark.read.option("header", True).csv(out + "/manifest").collect()}
    assert listed["feature_matrix.csv"] == "true"
    for member in ("call_summary", "adjacency", "db_tables", "db_domain_groups", "log_resource_tables", "log_totals"):
        assert spark.read.json(f"{out}/{member}.json").count() > 0


def test_manifest_of_any_folder(spark, tmp_path, monkeypatch):
    out = tmp_path / "out +%41(1)"
    os.makedirs(out / "feature_matrix.csv/project_id=p%2Fq")
    (out / "feature_matrix.csv/project_id=p%2Fq/part-0.csv").write_bytes(b"x" * 2048)
    (out / "call_graph.json").write_bytes(b"y" * 1024)
    monkeypatch.chdir(tmp_path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(str(tmp_path)).getFileSystem(spark._jsc.hadoopConfiguration())
    before = hadoop.getWorkingDirectory()
    hadoop.setWorkingDirectory(spark._jvm.org.apache.hadoop.fs.Path(str(tmp_path)))
    try:
        for at in (str(out), f"file:{out}", f"file://{out}/", out.name):
            man = {r.artifact: (r.exists, r.size_kb) for r in sinks.manifest(spark, at).collect()}
            assert man["feature_matrix.csv"] == (True, 2.0) and man["call_graph.json"] == (True, 1.0) and man["tfidf_matrix.csv"] == (False, None), at
    finally:
        hadoop.setWorkingDirectory(before)
    assert not any(r.exists for r in sinks.manifest(spark, str(tmp_path / "nothing")).collect())


def test_malformed_artifacts_count_as_absent(spark, tmp_path):
    root = str(tmp_path / "corpus")
    _corpus(root)
    out = str(tmp_path / "out")
    x = R.extract_corpus(spark, root, out)
    with open(f"{out}/call_graph.json/project_id=demo/torn.json", "w") as f:
        f.write('{"path": "A.java", "from_class": "Torn", "to_')
    with open(f"{out}/db_features.json/project_id=demo/torn.json", "w") as f:
        f.write('{"table_name": 7, "ordinal": "many"}\n')
    a = R.load_artifacts(spark, out)
    assert {(r.project_id, r.input) for r in a.corrupt.collect()} == {("demo", "call_graph"), ("demo", "db_features")}
    assert all("torn.json" in r.path and r.record for r in a.corrupt.collect())
    assert {r.project_id for r in a.tables["call_graph"].collect()} == {"other"}  # no class named null, no half of a project
    issues = {(r.project_id, r.input, r.effect) for r in a.missing_inputs(x.classes).collect()}
    assert {("demo", "call_graph", "stop"), ("demo", "db_features", "issue")} <= issues
    assert {r.project_id for r in R.matrix_from_artifacts(spark, out).collect()} == {"other"}
    with pytest.raises(S.MissingInput):
        R.load_artifacts(spark, str(tmp_path / "nothing"))


def test_matrix_sheet_missing_or_with_missing_columns(spark, tmp_path):
    with pytest.raises(S.MissingInput):
        R.checks_from_matrix_csv(spark, str(tmp_path / "no.csv"), "p")
    sheet = tmp_path / "m.csv"
    sheet.write_text("class_name,calls_out,calls_in,extra\nOwnerController,3,0,x\nOwnerController,-1,2,y\n")
    wrong, profile, comp, status = R.checks_from_matrix_csv(spark, str(sheet), "p")
    assert ("db_columns", "missing") in wrong and ("extra", "extra") in wrong and ("calls_out", "missing") not in wrong
    assert {r.column for r in profile.collect()} == {"calls_out", "calls_in"}
    # Q1 missing columns, Q2 a repeated name, Q3 a negative minimum
    assert {(r.step, r.n_issues, r.ok) for r in status.collect()} == {(2, 3, False), (3, 0, True)}
    sheet.write_text("calls_out\n3\n")
    with pytest.raises(ValueError, match="class names"):
        R.checks_from_matrix_csv(spark, str(sheet), "p")


def _script(n, seed):
    """A script with everything that can lie across a chunk's border."""
    rng = random.Random(seed)
    parts = []
    for i in range(n):
        kind = rng.randrange(9)
        cols = ",\n".join(f"  c{j} INT{rng.choice(['', ' NOT NULL', '(3)'])}" for j in range(rng.randrange(1, 30)))
        if kind < 4:
            parts.append(f"CREATE TABLE t{rng.randrange(n)} (\n  id INT,\n{cols}\n);")
        elif kind == 4:  # the start over lines, blank ones too
            parts.append(f"create\n\n{chr(10) * rng.randrange(12)}table\n  t{i}\n\n(\n{cols}\n);")
        elif kind == 5:
            parts.append(f"CREATE TABLE e{i} ();\nINSERT INTO x VALUES (1);")  # an empty body goes on
        elif kind == 6:
            parts.append("\n".join(f"ALTER TABLE x ADD c{j}; -- CREATE TABLE" for j in range(rng.randrange(20))))
        elif kind == 7:
            parts.append("SELECT now();\n)\n;\n);\r")
        else:
            parts.append(f"CREATE TABLE a{i} (id INT); CREATE TABLE b{i} (id INT,\n x INT); CREATE")
    return "\n".join(parts) + rng.choice(["", "\nCREATE TABLE open (id INT"])


def test_scripts_larger_than_a_split(spark, tmp_path):
    """Small splits and chunks give the statements of the whole text."""
    root = tmp_path / "c"
    texts = {f"p{k}": _script(n, k) for k, n in enumerate([0, 1, 5, 40, 400])}
    for p, t in texts.items():
        os.makedirs(root / p / "src/main/resources/db/mysql")
        (root / p / "src/main/resources/schema.sql").write_text(t, newline="")
        (root / p / "src/main/resources/db/mysql/schema.sql").write_text("CREATE TABLE lower_priority (id INT);")
    want = D.statements(spark.createDataFrame([(p, "s", t) for p, t in texts.items()], "project_id string, path string, ddl string"))
    want = sorted((r.project_id, r.stmt_pos, r.table_name, r.body) for r in want.collect())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        scripts, lines = S.picked_scripts(spark, str(root))
        assert {r.path for r in scripts.collect()} == {f"{p}/src/main/resources/schema.sql" for p in texts}
        for chunk in (1, 7, 64):
            got = D.statements_of_lines(lines, chunk)
            assert sorted((r.project_id, r.stmt_pos, r.table_name, r.body) for r in got.collect()) == want, chunk
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
