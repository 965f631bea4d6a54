"""Schema operators D1–D11 and S3/S13: quirks and small goldens."""

from svcseam.operators import ddl as D

DDL = """
CREATE TABLE owners (
  id INT NOT NULL PRIMARY KEY,
  first_name VARCHAR(30),
  b DECIMAL(10, 2) NOT NULL,
  KEY_ID INT,
  x_id INT, y INT,
  PRIMARY KEY (id)
);
create table Pets (
  id INT,
  owner_id INT NOT NULL,
  type_id INT,
  FOREIGN KEY (type_id) REFERENCES Types(id)
);
CREATE TABLE IF NOT EXISTS z (a INT,
  b INT);
CREATE TABLE owner (
  id INT
);
CREATE TABLE owners (
  id INT,
  name VARCHAR(10)
);
"""


def _scripts(spark, ddl=DDL):
    return spark.createDataFrame([("p", "p/schema.sql", ddl)], "project_id string, path string, ddl string")


def test_tables_last_body_first_position(spark):
    st = D.statements(_scripts(spark))
    t = {r.table_name: (r.table_pos, r.body) for r in D.tables(st).collect()}
    assert set(t) == {"owners", "pets", "owner"}          # IF NOT EXISTS does not match
    assert t["owners"][0] == 0 and "name VARCHAR(10)" in t["owners"][1]


def test_column_quirks(spark):
    st = D.statements(_scripts(spark))
    cols = D.columns(D.tables(st)).collect()
    pets = [(c.name, c.type, c.nullable, c.primary_key) for c in sorted(
        [c for c in cols if c.table_name == "pets"], key=lambda c: c.ordinal)]
    assert pets == [("id", "INT", True, True), ("owner_id", "INT", False, False), ("type_id", "INT", True, False)]
    # K6 on the first (overwritten) owners body, checked through a script with only that body
    first = DDL.split("create table Pets")[0]
    cols1 = sorted(D.columns(D.tables(D.statements(_scripts(spark, first)))).collect(), key=lambda c: c.ordinal)
    got = [(c.name, c.type) for c in cols1]
    assert got == [("id", "INT"), ("first_name", "VARCHAR"), ("b", "DECIMAL(10,"), ("x_id", "INT,")]  # K5, K6


def test_foreign_keys_explicit_and_inferred(spark):
    st = D.statements(_scripts(spark))
    tb = D.tables(st)
    ex = D.explicit_foreign_keys(st)
    assert [(r.from_table, r.column, r.references_table, r.references_column) for r in ex.collect()] == [
        ("pets", "type_id", "types", "id")]
    inf = D.inferred_foreign_keys(D.columns(tb), tb, ex).collect()
    # owner_id → table 'owner' exists (exact prefix); type_id is already explicit
    assert [(r.from_table, r.column, r.references_table) for r in inf] == [("pets", "owner_id", "owner")]


def test_plural_quirk_k7(spark):
    ddl = "CREATE TABLE owners (\n  id INT\n);\nCREATE TABLE pets (\n  id INT,\n  owner_id INT\n);"
    st = D.statements(_scripts(spark, ddl))
    tb = D.tables(st)
    ex = D.explicit_foreign_keys(st)
    assert D.inferred_foreign_keys(D.columns(tb), tb, ex).count() == 0
    fixed = D.inferred_foreign_keys(D.columns(tb), tb, ex, also_plural=True).collect()
    assert [(r.column, r.references_table) for r in fixed] == [("owner_id", "owners")]


def test_domains_and_graph(spark):
    """D8 domains, D9 graph and D10 groups of six tables with three keys."""
    ddl = "\n".join(f"CREATE TABLE {t} (\n  id INT{c}\n);" for t, c in [
        ("owners", ""), ("pets", ",\n  owner_id INT,\n  type_id INT,\n  FOREIGN KEY (owner_id) REFERENCES owners(id),\n  FOREIGN KEY (type_id) REFERENCES types(id)"),
        ("vets", ""), ("visits", ",\n  pet_id INT,\n  FOREIGN KEY (pet_id) REFERENCES pets(id)"), ("specialties", ""), ("types", "")])
    st = D.statements(spark.createDataFrame([("p", "schema.sql", ddl)], "project_id string, path string, ddl string"))
    tb = D.tables(st)
    dom = {r.table_name: r.domain for r in D.table_domains(tb).collect()}
    assert dom == {"owners": "owner_pet", "pets": "owner_pet", "vets": "veterinarian", "visits": "appointment",
                   "specialties": "veterinarian", "types": "reference"}
    fks = D.all_foreign_keys(D.explicit_foreign_keys(st), D.inferred_foreign_keys(D.columns(tb), tb, D.explicit_foreign_keys(st)))
    g = {r.from_table: r.targets for r in D.table_graph(fks).collect()}
    assert g == {"pets": ["owners", "types"], "visits": ["pets"]}
    groups = {r.domain: r.tables for r in D.domain_groups(D.table_domains(tb)).collect()}
    assert groups["owner_pet"] == ["owners", "pets"] and groups["veterinarian"] == ["vets", "specialties"]


def test_pick_ddl_priority(spark):
    df = spark.createDataFrame([
        ("p", "p/src/main/resources/db/mysql/schema.sql", "m"),
        ("p", "p/src/main/resources/schema.sql", "s"),
        ("q", "q/src/main/resources/db/hsqldb/schema.sql", "h"),
        ("q", "q/other.sql", "o"),
    ], "project_id string, path string, ddl string")
    got = {r.project_id: r.ddl for r in D.pick_ddl(df).collect()}
    assert got == {"p": "s", "q": "h"}
