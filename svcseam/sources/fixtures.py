"""Bindings from the driver's test tables to the inputs the operators expect.

The test tables hold no logs, DDL or code, so these are *derived* from them
by plain string expressions (the DuckDB oracle derives the same views with
the same expressions). Projects are keyed by supplier, so the number of
projects grows with the scale factor while each project stays the size of a
real application:

* ``log_lines``   events: project ``P<floor(user_id*2/3)>``, session = user,
  line number = event id; the event type picks a line shape.
* ``calls``       lineitem ⋈ part ⋈ part: project ``P<l_suppkey>``; the caller
  is the class of ``l_partkey``, the callee the class of the next line's part
  in the same order; ``autowired`` when ``l_discount = 0``.
* ``source_files`` the same calls as Java text, one file per (project, order).
* ``ddl_scripts`` one schema per project: a table per noun of the parts it
  supplies, a column per adjective, a ``<noun>_type`` lookup table, explicit
  and inferable foreign keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES of the fixture construction (shared with the DuckDB oracle).
# ---------------------------------------------------------------------------
CLASS_SUFFIXES = ["Controller", "Service", "Repository", "Formatter", "Validator", ""]
METHODS = ["find", "save", "delete", "update", "list", "get", "check"]
RESOURCES = ["anvils", "bolts", "gears", "gizmos", "plates", "rings", "rods", "widgets"]
NOUNS = ["anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget"]
# ---------------------------------------------------------------------------

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _arr(values):
    return F.array(*[F.lit(v) for v in values])


def _cap(c):
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))


def class_of(p_name, p_partkey):
    """CamelCase of the two name words plus a suffix chosen by the part key."""
    w1 = F.split_part(p_name, F.lit(" "), F.lit(1))
    w2 = F.split_part(p_name, F.lit(" "), F.lit(2))
    sfx = F.element_at(_arr(CLASS_SUFFIXES), (p_partkey % 6 + 1).cast("int"))
    return F.concat(_cap(w1), _cap(w2), sfx)


def _lower_first(c):
    return F.concat(F.lower(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    uid = F.col("user_id").cast("string")
    eid = F.col("event_id").cast("string")
    res = F.element_at(_arr(RESOURCES), (F.col("event_id") % 8 + 1).cast("int"))
    tbl = F.element_at(_arr(NOUNS), ((F.col("event_id") + F.col("user_id")) % 8 + 1).cast("int"))
    et = F.col("event_type")
    line = (F.when(et == "view", F.concat(F.lit("INFO GET /"), res, F.lit("/"), uid, F.lit("?v=1 HTTP/1.1")))
             .when(et == "signup", F.concat(F.lit("INFO POST /"), res, F.lit("/new -> insert into "), tbl,
                                            F.lit(" values ("), eid, F.lit(")")))
             .when(et == "click", F.concat(F.lit("DEBUG select t.id from "), tbl, F.lit(" t where t.user = "), uid))
             .when(et == "purchase", F.concat(F.lit("DEBUG update "), tbl, F.lit(" set qty = qty - 1 where id = "), eid))
             .otherwise(F.concat(F.lit("ERROR timeout for user "), uid)))
    return ev.select(
        F.concat(F.lit("P"), F.floor(F.col("user_id") * 2 / 3).cast("string")).alias("project_id"),
        uid.alias("session_id"), F.col("event_id").alias("line_no"), line.alias("line"))


def _call_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per lineitem: caller/callee classes and its place in its file."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    # Callee = part of the next line in the same order (the first line's part for the last line).
    # (order, line number, part, supplier, discount) is unique at every scale;
    # line numbers alone repeat. Rows equal in all of these are interchangeable.
    wo = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_discount")
    wo_all = wo.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    li = li.withColumn("to_partkey", F.coalesce(F.lead("l_partkey").over(wo), F.first("l_partkey").over(wo_all)))
    li = li.withColumn("auto", F.col("l_discount") == 0)  # a flag is all of the discount that most readers need
    src = part.select(F.col("p_partkey").alias("l_partkey"), class_of(F.col("p_name"), F.col("p_partkey")).alias("from_class"))
    dst = part.select(F.col("p_partkey").alias("to_partkey"), class_of(F.col("p_name"), F.col("p_partkey")).alias("to_type"))
    # Numbered as keys and two names; the texts made of them are never shuffled or sorted.
    wf = Window.partitionBy("l_suppkey", "l_orderkey").orderBy("l_linenumber", "l_partkey", "l_discount")
    rows = (li.join(src, "l_partkey").join(dst, "to_partkey").drop("to_partkey")
            .withColumn("line_number", (F.row_number().over(wf) * 3 + 1).cast("int")))
    proj = F.concat(F.lit("P"), F.col("l_suppkey").cast("string"))
    auto = F.col("auto")
    to_var = _lower_first(F.col("to_type"))
    return rows.select(
        proj.alias("project_id"),
        F.concat(F.lit("p"), F.col("l_suppkey").cast("string"), F.lit("/Order"),
                 F.col("l_orderkey").cast("string"), F.lit(".java")).alias("path"),
        "l_suppkey", "l_orderkey", "l_linenumber", "from_class", "to_type",
        to_var.alias("to_var"),
        F.when(auto, F.lit("autowired")).otherwise(F.lit("method_call")).alias("call_type"),
        F.element_at(_arr(METHODS), F.col("l_linenumber")).alias("verb"), "line_number")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured call edges (the table the text job recovers from ``source_files``)."""
    r = _call_rows(spark, sf_dir)
    auto = F.col("call_type") == "autowired"
    return r.select(
        "project_id", "path", "from_class",
        F.concat(F.lit("com.shop.p"), F.col("l_suppkey").cast("string")).alias("from_package"),
        F.when(auto, F.col("to_type")).otherwise(F.col("to_var")).alias("to_class"),
        F.when(auto, F.col("to_var")).otherwise(F.col("verb")).alias("method_name"),
        "call_type", "line_number", F.lit(0).alias("call_idx"))


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Java text per (project, order): a package line, a comment, then three
    lines per call site (class header, member, closing brace). Literals and
    comments carry call-like text that the extractor must ignore."""
    r = _call_rows(spark, sf_dir)
    auto = F.col("call_type") == "autowired"
    member = F.when(auto, F.concat(F.lit("    @Autowired private "), F.col("to_type"), F.lit(" "),
                                   F.col("to_var"), F.lit(";")))\
              .otherwise(F.concat(F.lit("    void handle() { "), F.col("to_var"), F.lit("."), F.col("verb"),
                                  F.lit("(\"a.b(1)\"); } // see util.trace()")))
    block = F.concat(F.lit("class "), F.col("from_class"), F.lit(" {\n"), member, F.lit("\n}"))
    files = (r.groupBy("project_id", "path", "l_suppkey", "l_orderkey")
              .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_number", block.alias("b")))),
                                            lambda x: x["b"]), "\n").alias("body")))
    content = F.concat(F.lit("package com.shop.p"), F.col("l_suppkey").cast("string"),
                       F.lit(";\n// order "), F.col("l_orderkey").cast("string"), F.lit(" (generated)\n"),
                       F.col("body"), F.lit("\n"))
    return files.select("project_id", "path", content.alias("content"))


def fluent_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Java text per call row in the styles that need nesting and many lines: a chain over
    lines with a constructor and nested calls as arguments, a call on a new object (on
    some lines a hundred kilobytes long), or an enum whose field is far below its annotation."""
    r = _call_rows(spark, sf_dir)
    pad = F.repeat(F.lit("x + "), F.when((F.col("l_orderkey") % 500 == 0) & (F.col("l_linenumber") == 1), F.lit(25_000)).otherwise(F.lit(1)))
    chain = F.concat(F.lit("class "), F.col("from_class"), F.lit(" {\n  void f() {\n    "), F.col("to_var"), F.lit("."), F.col("verb"),
                     F.lit("(new "), F.col("to_type"), F.lit("(1))\n        .next(three(four(5)))\n        .done();\n    new "), F.col("to_type"),
                     F.lit("().go("), pad, F.lit("1);\n  }\n}\n"))
    field = F.concat(F.lit("enum Kind { ONE;\n  @Autowired\n  @Qualifier(\"a.b(\")\n  // far from the annotation\n  private Map<String, "),
                     F.col("to_type"), F.lit("> "), F.col("to_var"), F.lit(";\n}\n"))
    path = F.concat(F.regexp_replace("path", "\\.java$", "_"), F.col("line_number").cast("string"), F.lit(".java"))
    content = F.concat(F.lit("package com.shop.p"), F.col("l_suppkey").cast("string"), F.lit(";\n"),
                       F.when(F.col("call_type") == "autowired", field).otherwise(chain))
    return r.select("project_id", path.alias("path"), content.alias("content"))


URL_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)"
URL_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)"
HREF = r'href="([^"]*)"'


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real URLs of ``pages``: project = host, path without query or fragment."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return pages.select("page_id", F.regexp_extract("url", URL_HOST, 1).alias("project_id"),
                        F.regexp_extract("url", URL_PATH, 1).alias("path"))


def page_link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real link graph of ``pages`` in the call-edge schema: a page (its URL
    path) "calls" every ``href`` target (query and fragment cut), in page order."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    links = pages.select(
        F.regexp_extract("url", URL_HOST, 1).alias("project_id"), F.col("url").alias("path"),
        F.regexp_extract("url", URL_PATH, 1).alias("from_class"),
        F.posexplode(F.regexp_extract_all("html", F.lit(HREF), 1)).alias("pos", "href"))
    return links.select("project_id", "path", "from_class", F.lit("").alias("from_package"),
                        F.regexp_extract("href", r"^([^?#]*)", 1).alias("to_class"),
                        F.lit("href").alias("method_name"), F.lit("link").alias("call_type"),
                        (F.col("pos") + 1).cast("int").alias("line_number"), F.lit(0).alias("call_idx"))


def ddl_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One schema script per project. Groups are bounded by the part-name
    vocabulary (nouns × adjectives), not by the data size."""
    li = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    sp = (li.join(part, li.l_partkey == part.p_partkey)
            .select("l_suppkey",
                    F.split_part("p_name", F.lit(" "), F.lit(2)).alias("noun"),
                    F.split_part("p_name", F.lit(" "), F.lit(1)).alias("adj"), "p_size")
            .groupBy("l_suppkey", "noun", "adj").agg(F.min("p_size").alias("size")))
    size = F.col("size").cast("string")
    col_line = F.when(F.col("size") % 2 == 0,
                      F.concat(F.lit("  "), F.col("adj"), F.lit("_qty DECIMAL("), size, F.lit(", 2) NOT NULL")))\
                .otherwise(F.concat(F.lit("  "), F.col("adj"), F.lit("_name VARCHAR("), size, F.lit(")")))
    tables = (sp.groupBy("l_suppkey", "noun")
                .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("adj", col_line.alias("c")))),
                                              lambda x: x["c"]), ",\n").alias("cols")))
    wn = Window.partitionBy("l_suppkey").orderBy("noun")
    wn_all = wn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tables = tables.withColumn("next_noun", F.coalesce(F.lead("noun").over(wn), F.first("noun").over(wn_all)))
    n, n2 = F.col("noun"), F.col("next_noun")
    fk = F.when(n < n2, F.concat(F.lit(",\n  FOREIGN KEY ("), n2, F.lit("_id) REFERENCES "), n2, F.lit("(id)")))\
          .otherwise(F.lit(""))
    stmt = F.concat(
        F.lit("CREATE TABLE "), n, F.lit(" (\n  id INT NOT NULL PRIMARY KEY,\n"), F.col("cols"),
        F.lit(",\n  "), n2, F.lit("_id INT,\n  KEY_"), n, F.lit(" INT"), fk, F.lit("\n);\n\n"),
        F.lit("CREATE TABLE "), n, F.lit("_type (\n  id INT PRIMARY KEY,\n  "), n,
        F.lit("_id INT NOT NULL,\n  label VARCHAR(40)\n);\n"))
    scripts = (tables.groupBy("l_suppkey")
                     .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("noun", stmt.alias("s")))),
                                                   lambda x: x["s"]), "\n").alias("ddl")))
    return scripts.select(F.concat(F.lit("P"), F.col("l_suppkey").cast("string")).alias("project_id"),
                          F.concat(F.lit("p"), F.col("l_suppkey").cast("string"),
                                   F.lit("/src/main/resources/schema.sql")).alias("path"),
                          "ddl")


def idle_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project per nation with one class that makes no call and has neither schema nor log."""
    n = read(spark, sf_dir, "nation")
    return n.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("project_id"),
                    F.concat(F.lit("Idle"), F.col("n_nationkey").cast("string"), F.lit("Service")).alias("class_name"))
