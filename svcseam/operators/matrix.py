"""Step 2D — the 14-column feature matrix (J1–J3, F1–F5) and its sheets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as TX
from .ranks import positions

KEY = ["project_id"]


GRAM = 3


def grams(s: Column, sizes: Column) -> Column:
    """The distinct substrings of ``s`` of the given sizes: fewer than length x sizes."""
    n = F.length(s)
    return F.array_distinct(F.flatten(F.transform(F.filter(sizes, lambda q: q <= n),
                                                  lambda q: F.transform(F.sequence(F.lit(1), n - q + 1), lambda i: F.substring(s, i, q)))))


def contained_names(needles: DataFrame, hay: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, needle, hay) for every distinct ``needle`` that is a substring of a distinct
    ``hay`` with the same keys; empty names match nothing.

    Names are cut into 3-grams (a shorter needle is its own gram). Each needle is looked up by
    its rarest gram among the hay only, and what that finds is verified; a needle with a gram
    that no hay has is found by none. Both sides unfold to fewer rows than their letters
    (times the needle sizes of at most three that occur)."""
    size = F.least(F.length("needle"), F.lit(GRAM))
    needles = needles.select(*keys, "needle").where("needle <> ''").distinct()
    sizes = needles.groupBy(*keys).agg(F.collect_set(size).alias("_sizes"))  # at most GRAM values
    posted = (hay.select(*keys, "hay").distinct().join(sizes, keys)
              .select(*keys, "hay", F.explode(grams(F.col("hay"), F.col("_sizes"))).alias("gram")))
    counts = posted.groupBy(*keys, "gram").agg(F.count("*").alias("_n"))
    rarest = (needles.select(*keys, "needle", F.explode(grams(F.col("needle"), F.array(size))).alias("gram"))
              .join(counts, [*keys, "gram"], "left")
              .groupBy(*keys, "needle").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "gram")).alias("m"))
              .where("m.n > 0").select(*keys, "needle", F.col("m.gram").alias("gram")))
    return posted.join(rarest, [*keys, "gram"]).where(F.contains("hay", "needle")).select(*keys, "needle", "hay")


def related_table(classes: DataFrame, tbls: DataFrame, removals=rules.TABLE_STEM_REMOVALS, keep: Sequence[str] = (), facts: DataFrame | None = None) -> DataFrame:
    """A class's table is one whose name contains the class stem or is
    contained in it; ties go to the shortest name, then alphabetical (K12).
    ``keep`` are further columns of ``classes`` that stay, ``facts`` (project_id, related_table, ...)
    brings columns of the tables: they meet the stems, of which there are fewer than classes.

    The theta condition ``stem ⊇ t or t ⊇ stem`` is two containment searches over an index
    of rarest grams, run as one (``way`` tells them apart); nothing is compared pairwise
    inside a project. An empty stem matches every table (first table by the tie rule)."""
    c = classes.select(*KEY, "class_name", *keep, TX.table_stem(F.col("class_name"), removals).alias("stem"))
    stems = c.select(*KEY, "stem").where("stem <> ''").distinct()
    t = tbls.select(*KEY, "table_name").distinct()
    way = [*KEY, "way"]
    found = contained_names(
        t.select(*KEY, F.lit(0).alias("way"), F.col("table_name").alias("needle")).union(stems.select(*KEY, F.lit(1), "stem")),
        stems.select(*KEY, F.lit(0).alias("way"), F.col("stem").alias("hay")).union(t.select(*KEY, F.lit(1), "table_name")), way)
    inside = F.col("way") == 0
    hits = found.select(*KEY, F.when(inside, F.col("hay")).otherwise(F.col("needle")).alias("stem"),
                        F.when(inside, F.col("needle")).otherwise(F.col("hay")).alias("table_name"))
    # empty stem: every table
    hits = hits.union(t.select(*KEY, F.lit("").alias("stem"), "table_name"))
    best = (hits.groupBy(*KEY, "stem").agg(F.min(F.struct(F.length("table_name").alias("l"), "table_name")).alias("m"))
            .select(*KEY, "stem", F.col("m.table_name").alias("related_table")))
    if facts is not None:
        best = best.join(facts, [*KEY, "related_table"], "left")
    brought = [name for name in best.columns if name not in (*KEY, "stem")]
    return c.join(best, [*KEY, "stem"], "left").select(*KEY, "class_name", *keep, *brought)


def classify(df: DataFrame) -> DataFrame:
    """Domain, stereotype, rank and the three suffix flags."""
    c = F.col("class_name")
    st = TX.stereotype(c)
    return df.select("*", TX.class_domain(c).alias("domain"), st.alias("stereotype"),
                     TX.stereotype_rank(st).alias("stereotype_rank"),
                     TX.suffix_flag(c, "Controller").alias("is_controller"),
                     TX.suffix_flag(c, "Service").alias("is_service"),
                     TX.suffix_flag(c, "Repository", "Repo").alias("is_repository"))


CALL_METRICS = ["calls_out", "calls_in", "deps_unique", "has_autowired"]


def feature_matrix(classes: DataFrame, call_metrics: DataFrame | None, tbls: DataFrame,
                   table_metrics: DataFrame) -> DataFrame:
    """classes ⟕ call metrics (J1) → related table (J3) ⟕ table metrics (J2);
    missing metrics are 0. Output: project_id + the 14 matrix columns.

    Without ``call_metrics`` the classes bring them, a row per class, and J1 moves nothing; a
    class without a name or a project has none, as in the join."""
    tm = table_metrics.withColumnRenamed("table_name", "related_table")
    if call_metrics is None:
        named = F.col("project_id").isNotNull() & F.col("class_name").isNotNull()
        m = related_table(classes.select(*KEY, "class_name", *[F.when(named, F.col(c)).alias(c) for c in CALL_METRICS]), tbls, keep=CALL_METRICS, facts=tm)
    else:
        m = related_table(classes, tbls, facts=tm).join(call_metrics, [*KEY, "class_name"], "left")
    z = F.lit(0)
    num = {c: F.coalesce(F.col(c), z).cast("long") for c in rules.COUNT_COLUMNS}
    num["has_autowired"] = F.coalesce(F.col("has_autowired"), z).cast("int")
    c = F.col("class_name")
    num["is_controller"] = TX.suffix_flag(c, "Controller")
    num["is_service"] = TX.suffix_flag(c, "Service")
    num["is_repository"] = TX.suffix_flag(c, "Repository", "Repo")
    return m.select(*KEY, "class_name", "related_table", *[num[k].alias(k) for k in rules.NUMERIC_COLUMNS])


def matrix_raw(matrix: DataFrame) -> DataFrame:
    """The raw sheet — null table printed ``none``."""
    return matrix.select(*KEY, "class_name", F.coalesce("related_table", F.lit(rules.NONE_RAW)).alias("related_table"),
                         *rules.NUMERIC_COLUMNS)


def matrix_readable(matrix: DataFrame) -> DataFrame:
    """Readable sheet (snake-case names; headings are applied by the sink)."""
    m = classify(matrix)
    return m.select(*KEY, "class_name", "domain", "stereotype",
                    F.coalesce("related_table", F.lit(rules.NONE_READABLE)).alias("related_table"),
                    "calls_out", "calls_in",
                    F.when(F.col("has_autowired") == 1, F.lit(rules.YES)).otherwise(F.lit(rules.NO)).alias("injected"),
                    "db_columns", "db_relations", "log_frequency")


def matrix_by_domain(matrix: DataFrame) -> DataFrame:
    """S9 + O1: grouped by domain, Controllers first; ``sheet_row`` is the row's place (from
    1) in its project's sheet by (domain, stereotype rank, class name), found without a
    window over a project."""
    m = classify(matrix).select(*KEY, "domain", "class_name", "stereotype",
                                F.coalesce("related_table", F.lit(rules.NONE_BY_DOMAIN)).alias("related_table"),
                                "calls_out", "calls_in",
                                F.when(F.col("has_autowired") == 1, F.lit(rules.YES)).otherwise(F.lit(rules.NO)).alias("injected"),
                                "log_frequency", "stereotype_rank")
    return positions(m, KEY, ["domain", "stereotype_rank", "class_name"], "sheet_row").withColumn("sheet_row", F.col("sheet_row") + 1)


def classes_by_domain(matrix: DataFrame) -> DataFrame:
    """The classes of each upper-cased domain, long form (one row per
    class, with the domain's class count). No per-domain list is built, so a
    huge domain never becomes one value; order by (domain, class_name) at the
    sink — a range-partitioned sort splits a hot domain."""
    m = classify(matrix).select(*KEY, F.upper("domain").alias("domain"), "class_name")
    n = m.groupBy(*KEY, "domain").agg(F.count("*").alias("n_classes"))
    return m.join(n, [*KEY, "domain"])
