"""Repeated line runs by distributed prefix doubling over line-ID sequences.

Non-blank lines get a position; a line's ID is the position of the first line equal to
it. Prefix doubling names the suffixes of all documents by their first 2, 4, 8, ...
lines: the name of 2^(k+1) lines is that of the pair of names of 2^k lines, at a
position and 2^k lines on. Suffixes of one name form an interval of the suffix array
whose common prefix is at least 2^k lines; names held by one suffix only leave at
once, so the work follows the repeated lines, not the corpus. (Any order of the line
IDs gives the same intervals; a name is the position of the interval's first suffix.)

A maximal repeated run counts when it has ``MIN_WORDS`` words. Every line of such a
run lies in a shortest window of that many words that starts or ends at some line of
the run, so it is enough to look up those windows, at most ``MIN_WORDS`` lines long:
two overlapping names of 2^k lines give a window's identity and with it the earliest
copy. Windows with an earlier copy are deleted; the runs are their unions.
DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import kept

MIN_WORDS = 50


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, th, rid, pos, ln, words, h1, h2, len): the non-blank lines; pos grows by
    one from line to line of a document, ln is the place among all its lines."""
    line = F.filter(F.transform(F.split(_text(), "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
                    lambda s: s["x"].rlike("[^\\x20\\x09-\\x0D]"))
    rows = (docs.select("doc_id", F.xxhash64(_text()).alias("th"), F.posexplode(line).alias("k", "s"))
            .withColumn("pos", F.monotonically_increasing_id()))
    x = F.col("s.x")
    n_words = F.size(F.split(F.btrim(x, F.lit(" \t\x0b\f\r")), "[\\x20\\x09-\\x0D]+"))
    return rows.select("doc_id", "th", (F.col("pos") - F.col("k")).alias("rid"), "pos", F.col("s.i").alias("ln"), n_words.alias("words"),
                       F.xxhash64(x).alias("h1"), F.hash(x).alias("h2"), F.length(x).alias("len"))


def _named(rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key occurs more than once, with the name of their interval."""
    groups = (rows.groupBy(*key).agg(F.min("pos").alias("name"), F.count("*").alias("n")).where("n > 1").drop("n"))
    return rows.join(groups, key)


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, deleted): per document with later copies of line runs of at least
    ``min_words`` words, the places of their lines (from 0). th is the text's hash."""
    all_lines = kept(lines(docs))
    first = Window.partitionBy("doc_id", "th")
    live = (_named(all_lines, ["h1", "h2", "len"]).drop("h1", "h2", "len")
            .withColumn("one", F.min("rid").over(first)).where("rid = one").drop("one"))
    # Islands of adjacent repeated lines; those with too few words hold no window.
    by_doc = Window.partitionBy("rid").orderBy("pos")
    island = live.withColumn("island", F.col("pos") - F.row_number().over(by_doc))
    in_island = Window.partitionBy("rid", "island")
    island = (island.withColumn("c", F.sum("words").over(in_island.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("c0", F.col("c") - F.col("words")).withColumn("total", F.max("c").over(in_island))
              .where(F.col("total") >= min_words))
    sized = (island.withColumn("ms", F.count("*").over(in_island.orderBy("c0").rangeBetween(0, min_words - 1)))
             .withColumn("me", F.count("*").over(in_island.orderBy("c").rangeBetween(1 - min_words, 0))))
    live = kept(sized.select("doc_id", "th", "rid", "pos", "ln", F.col("name"),
                             F.when(F.col("total") >= F.col("c0") + min_words, F.col("ms")).alias("ms"),
                             F.when(F.col("c") >= min_words, F.col("me")).alias("me")))
    starts = live.where("ms is not null").select("doc_id", "rid", F.col("pos").alias("s"), F.col("ms").alias("m"))
    ends = live.where("me is not null").select("doc_id", "rid", (F.col("pos") - F.col("me") + 1).alias("s"), F.col("me").alias("m"))
    windows = kept(starts.union(ends).distinct())
    names = live.select("rid", "pos", "name")
    longest = windows.agg(F.max("m")).first()[0] or 0
    later, span = None, 1
    while span <= longest:
        here = windows.where((F.col("m") >= span) & (F.col("m") < 2 * span))
        a = names.select(F.col("pos").alias("s"), F.col("name").alias("a"))
        b = names.select(F.col("pos").alias("t"), F.col("name").alias("b"))
        held = (here.withColumn("t", F.col("s") + F.col("m") - span).join(a, "s").join(b, "t").drop("t"))
        held = kept(held)
        place = F.struct("doc_id", "s")
        earliest = held.groupBy("m", "a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        copies = (held.join(earliest, ["m", "a", "b"]).where(place > F.col("first"))
                  .select("s", (F.col("s") + F.col("m") - 1).alias("e")))
        later = copies if later is None else later.union(copies)
        if 2 * span <= longest:  # names of twice as many lines
            ahead = Window.partitionBy("rid").orderBy("pos").rangeBetween(span, span)
            pairs = names.withColumn("next", F.first("name").over(ahead)).where("next is not null")
            names = kept(_named(pairs.withColumnRenamed("name", "was"), ["was", "next"]).select("rid", "pos", "name"))
        span *= 2
    if later is None:
        return live.select("doc_id", "th", F.array(F.col("ln")).alias("deleted")).limit(0)
    reach = later.groupBy(F.col("s").alias("pos")).agg(F.max("e").alias("e"))
    covered = (live.select("doc_id", "th", "rid", "pos", "ln").join(reach, "pos", "left")
               .withColumn("reach", F.max("e").over(by_doc.rowsBetween(Window.unboundedPreceding, 0))).where("reach >= pos"))
    return covered.groupBy("doc_id", "th").agg(F.collect_list("ln").alias("deleted"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_lines, n_deleted, text) per row of ``docs`` (doc_id, text; further
    columns are ignored): the text without later copies of repeated line runs.

    A run is a sequence of non-blank lines (blank ones, of white space only, are skipped:
    they neither break a run nor are deleted) that occurs earlier in byte-equal lines,
    in a document of smaller doc_id (null first) or further up in the same one, with at
    least ``min_words`` words in all. Null text counts as empty (one blank line) and
    stays null; rows equal in doc_id and text are one document; of rows that share only
    the doc_id the first read counts as earlier. An empty table gives an empty result."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = repeated_lines(docs, min_words).withColumnsRenamed({"doc_id": "id", "th": "h"})
    split = F.split(_text(), "\n")
    joined = docs.withColumn("th", F.xxhash64(_text())).join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("h")), "left")
    rest = F.filter(split, lambda x, i: ~F.array_contains(F.col("deleted"), i))
    return joined.select("doc_id", F.size(split).alias("n_lines"), F.coalesce(F.size("deleted"), F.lit(0)).alias("n_deleted"),
                         F.when(F.col("deleted").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n")).alias("text"))
