"""Step 3 — z-scores, class-name tokens, TF-IDF and the weighted composite (M1–M4).

Statistics are per project (one aggregate row per project joined back), so
a corpus of projects normalises each project on its own; with one project it
is the reference computation. TF-IDF stays long and sparse
``(project_id, doc, token, value)``; a wide pivot is only for sinks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as TX

KEY = ["project_id"]


def column_stats(matrix: DataFrame, numeric: Sequence[str] = rules.NUMERIC_COLUMNS) -> DataFrame:
    """Per project: mean and population std of every numeric column (nulls → 0)."""
    aggs = []
    for c in numeric:
        x = F.coalesce(F.col(c), F.lit(0)).cast("double")
        aggs += [F.avg(x).alias(f"mean_{c}"), F.stddev_pop(x).alias(f"std_{c}")]
    return matrix.groupBy(*KEY).agg(*aggs)


def zscores(matrix: DataFrame, numeric: Sequence[str] = rules.NUMERIC_COLUMNS, stats: DataFrame | None = None, ids: Sequence[str] = ()) -> DataFrame:
    """M1: ``num_<c>`` = (x − mean) / population std; a zero std divides by 1
    (the column becomes 0). ``stats`` gives ready column statistics; ``ids`` are further columns to keep."""
    st = (stats.select(*KEY, *[f"{k}_{c}" for c in numeric for k in ("mean", "std")]) if stats is not None else column_stats(matrix, numeric))
    j = matrix.join(st, KEY, "left")
    out = []
    for c in numeric:
        x = F.coalesce(F.col(c), F.lit(0)).cast("double")
        sd = F.col(f"std_{c}")
        out.append(((x - F.col(f"mean_{c}")) / F.when(sd > 0, sd).otherwise(F.lit(1.0))).alias(f"num_{c}"))
    return j.select(*KEY, "class_name", *ids, *out)


def zscores_long(z: DataFrame, numeric: Sequence[str] = rules.NUMERIC_COLUMNS, ids: Sequence[str] = ()) -> DataFrame:
    """Wide z-scores → long ``(project_id, class_name, feature, value)``; ``ids`` are further columns to keep."""
    pairs = F.array(*[F.struct(F.lit(f"num_{c}").alias("feature"), F.col(f"num_{c}").alias("value"))
                      for c in numeric])
    return z.select(*KEY, "class_name", *ids, F.inline(pairs))


def camel_tokens(classes: DataFrame, stop_words=rules.CAMEL_STOP_WORDS) -> DataFrame:
    """M2: ``tokens`` = space-separated lower-case CamelCase words of the class
    name without stop words (the lower-case name if none is left)."""
    return classes.select(*KEY, "class_name", TX.camel_tokens(F.col("class_name"), stop_words).alias("tokens"))


def tfidf(docs: DataFrame, doc_col: str, text_col: str, token_pattern: str = TX.WORD_TOKEN) -> DataFrame:
    """M3: smooth TF-IDF with L2-normalised rows, per project.

    tf = raw count; idf = ln((1 + n) / (1 + df)) + 1 with n documents and df
    documents holding the token; each document's weights divided by their L2
    norm. Documents without tokens produce no rows. Output long:
    ``(project_id, <doc_col>, token, tf, df, value)``."""
    toks = docs.select(*KEY, doc_col, F.explode(F.regexp_extract_all(F.lower(F.col(text_col)),
                                                                     F.lit(token_pattern), 0)).alias("token"))
    tf = toks.groupBy(*KEY, doc_col, "token").agg(F.count("*").alias("tf"))
    n_docs = docs.groupBy(*KEY).agg(F.count("*").alias("n_docs"))
    # Counted from the same rows, counts and all, that are joined: their exchange is made once.
    df = tf.groupBy(*KEY, "token").agg(F.count_if(F.col("tf") > 0).alias("df"))
    w = (tf.join(df, [*KEY, "token"]).join(n_docs, KEY)
         .withColumn("w", F.col("tf") * (F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1)))
    # Ordered full frame: the sum runs in token order, so identical documents
    # get bit-identical weights (copies are then recognised downstream).
    norm = (Window.partitionBy(*KEY, doc_col).orderBy("token")
            .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return w.select(*KEY, doc_col, "token", "tf", "df",
                    (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(norm))).alias("value"))


def class_tfidf(classes: DataFrame) -> DataFrame:
    """M2 + M3 on class names. Names are shuffled, not their tokens: a name is shorter than the rows of its tokens."""
    return tfidf(camel_tokens(classes.select(*KEY, "class_name").repartition(*KEY, "class_name")), "class_name", "tokens")


def class_tokens(classes: DataFrame) -> DataFrame:
    """(project_id, class_name, token), the distinct TF-IDF tokens of each class name, without weights."""
    token = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("tokens"), F.lit(TX.WORD_TOKEN), 0))).alias("token")
    return camel_tokens(classes).select(*KEY, "class_name", token)


def composite_long(z_long: DataFrame, tfidf_long: DataFrame, w_numeric: float = rules.W_NUMERIC,
                   w_tfidf: float = rules.W_TFIDF, ids: DataFrame | None = None) -> DataFrame:
    """M4: weighted z-scores and TF-IDF weights as one long feature table
    (zero TF-IDF cells are implicit). ``ids`` (project_id, class_name, related_table)
    adds the id column related_table; where the z-scores bring theirs, only the TF-IDF rows,
    which lie by class, meet ``ids``."""
    a = z_long.select(*KEY, "class_name", "feature", (F.col("value") * w_numeric).alias("value"), *[c for c in z_long.columns if c == "related_table"])
    b = tfidf_long.select(*KEY, "class_name", F.concat(F.lit("tfidf_"), "token").alias("feature"),
                          (F.col("value") * w_tfidf).alias("value"))
    if ids is None:
        return a.unionByName(b, allowMissingColumns=True)
    named = ids.select(*KEY, "class_name", "related_table")
    if "related_table" in a.columns:
        return a.unionByName(b.join(named, [*KEY, "class_name"], "left"))
    return a.unionByName(b).join(named, [*KEY, "class_name"], "left")


def composite_cells(z: DataFrame, tfidf_long: DataFrame, w_numeric: float = rules.W_NUMERIC, w_tfidf: float = rules.W_TFIDF,
                    numeric: Sequence[str] = rules.NUMERIC_COLUMNS) -> DataFrame:
    """M4 with a row per class for the sheets: ``(project_id, class_name, related_table, cells)``, the features of
    ``composite_long`` as an array of (feature, value). ``z`` are z-scores with related_table. A class's features come
    together where its TF-IDF is normalised, and never lie in rows of their own."""
    tokens = (tfidf_long.groupBy(*KEY, "class_name")
              .agg(F.collect_list(F.struct(F.concat(F.lit("tfidf_"), "token").alias("feature"), (F.col("value") * w_tfidf).alias("value"))).alias("_t")))
    scores = F.array(*[F.struct(F.lit(f"num_{c}").alias("feature"), (F.col(f"num_{c}") * w_numeric).alias("value")) for c in numeric])
    return (z.join(tokens, [*KEY, "class_name"], "left")
            .select(*KEY, "class_name", "related_table", F.when(F.col("_t").isNull(), scores).otherwise(F.concat(scores, "_t")).alias("cells")))


def composite_names(classes: DataFrame, numeric: Sequence[str] = rules.NUMERIC_COLUMNS) -> DataFrame:
    """(project_id, class_name, feature): the names of the cells of ``composite_cells``, without weights."""
    numbers = classes.select(*KEY, "class_name", F.explode(F.array(*[F.lit(f"num_{c}") for c in numeric])).alias("feature"))
    tokens = class_tokens(classes).where(F.col("project_id").isNotNull())  # TF-IDF has no rows without a project
    return numbers.union(tokens.select(*KEY, "class_name", F.concat(F.lit("tfidf_"), "token")))


def wide_rows(long: DataFrame, ids: Sequence[str] = ("class_name",), part_rows: int = 100_000, names: DataFrame | None = None) -> DataFrame:
    """Long features as the rows of one wide sheet per project, for
    ``sources.wide_csv``: ``(project_id, part, lead, ids, names, cells)``.

    The columns of a project's sheet are its own features, sorted. A sheet is cut into parts
    of about ``part_rows`` classes. Each part has a row with ``lead`` = 0 that holds the
    header (ids = the names of the id columns, names = the project's features); the others
    (``lead`` = 1) hold one class each, its ids as text and its cells by name; a
    feature that a class lacks, or whose value is null, is 0. Nothing but a header and a
    single class's cells is ever in one row.

    With ``names`` (project_id, class_name, feature), ``long`` has the features of a class in ``cells``
    (``composite_cells``) and the headers are read from ``names``."""
    key = F.struct(*[F.col(c).cast("string").alias(c) for c in ids])
    if names is None:
        rows = (long.groupBy(*KEY, key.alias("_id"))
                .agg(F.sort_array(F.collect_list(F.struct("feature", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value")))).alias("_c")))
        names = long.select(*KEY, key.alias("_id"), "feature")
    else:  # grouped by columns, as the cells lie, so that no exchange is needed; a repeated class is one row
        cell = F.transform("cells", lambda e: F.struct(e["feature"].alias("feature"), F.coalesce(e["value"].cast("double"), F.lit(0.0)).alias("value")))
        rows = (long.groupBy(*KEY, *ids).agg(F.sort_array(F.flatten(F.collect_list(cell))).alias("_c")).select(*KEY, key.alias("_id"), "_c"))
        names = names.select(*KEY, F.col("class_name").alias("_id"), "feature")
    parts = (names.groupBy(*KEY)
             .agg(F.sort_array(F.collect_set("feature")).alias("_names"), F.approx_count_distinct("_id").alias("_rows"))
             .withColumn("_parts", F.ceil(F.col("_rows") / F.lit(part_rows)).cast("int")))
    ids_of = F.array(*[F.col(f"_id.{c}") for c in ids])
    head = parts.select(*KEY, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"), F.lit(0).alias("lead"),
                        F.array(*[F.lit(c) for c in ids]).alias("ids"), F.col("_names").alias("names"), F.array().cast("array<double>").alias("cells"))
    same = F.col("r.project_id").eqNullSafe(F.col("p.project_id"))
    body = (rows.alias("r").join(parts.select(*KEY, "_parts").alias("p"), same)
            .select("r.project_id", F.pmod(F.xxhash64("_id"), F.col("_parts")).cast("int").alias("part"), F.lit(1).alias("lead"), ids_of.alias("ids"),
                    F.transform("_c", lambda e: e["feature"]).alias("names"), F.transform("_c", lambda e: e["value"]).alias("cells")))
    return head.union(body)
