"""M3 on long texts: TF-IDF with a document's tokens counted where its text is read.

Documents, each as its distinct tokens and counts, are shuffled once into groups of about
``GROUP_CHARS`` characters. A group sends each of its distinct tokens once to be summed over all
groups (the document frequency) and gets it back once. So a token that stands in many documents
of a group crosses the network once, not once a document, and no row of (document, token) is
shuffled or sorted at all.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Characters of text in a group of documents; a group is in memory at once.
GROUP_CHARS = 4_000_000


def _coded(column) -> tuple[np.ndarray, pa.Array]:
    """(codes, values): values ascend bytewise (Spark's order of strings), null is a value."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    found = column.dictionary_encode(null_encoding="encode")
    order = pc.array_sort_indices(found.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[found.indices.to_numpy(zero_copy_only=False)] if len(order) else np.zeros(0, np.int64), found.dictionary.take(pa.array(order))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct tokens of each row with their counts; rows without tokens go."""
    for batch in batches:
        lists = batch.column("tokens")
        code, token = _coded(lists.flatten())
        if not len(code):
            continue
        pair, n = np.unique(pc.list_parent_indices(lists).to_numpy() * len(token) + code, return_counts=True)
        row, code = np.divmod(pair, len(token))
        rows, first = np.unique(row, return_index=True)
        cut = pa.array(np.r_[first, len(row)].astype(np.int32))
        keys = [batch.column(c).take(pa.array(rows)) for c in ("_group", "project_id", "_doc")]
        yield pa.record_batch([*keys, pa.ListArray.from_arrays(cut, token.take(pa.array(code))), pa.ListArray.from_arrays(cut, pa.array(n))],
                              ["_group", "project_id", "_doc", "tokens", "tf"])


def _entries(table: pa.Table):
    """(first rows of the documents, their projects' codes, projects, tokens, and per entry
    document, token code and tf); rows of one project and id are one document."""
    project, projects = _coded(table.column("project_id"))
    ids, values = _coded(table.column("_doc"))
    _, first, doc = np.unique(project * max(len(values), 1) + ids, return_index=True, return_inverse=True)
    lists = table.column("tokens").combine_chunks()
    code, tokens = _coded(lists.flatten())
    at = np.repeat(doc, np.diff(lists.offsets.to_numpy()))
    pair, of = np.unique(at * max(len(tokens), 1) + code, return_inverse=True)
    tf = np.bincount(of, weights=table.column("tf").combine_chunks().flatten().to_numpy(), minlength=len(pair)).astype(np.int64)
    at, code = np.divmod(pair, max(len(tokens), 1))
    return first, project[first], projects, tokens, at, code, tf


def _group_counts(table: pa.Table) -> pa.Table:
    """(_group, project_id, token, n): documents of the group that hold the token."""
    _, project, projects, tokens, at, code, _ = _entries(table)
    pair, n = np.unique(project[at] * max(len(tokens), 1) + code, return_counts=True)
    p, code = np.divmod(pair, max(len(tokens), 1))
    group = pa.array(np.full(len(pair), table.column("_group")[0].as_py()), pa.int32())
    return pa.table([group, projects.take(pa.array(p)), tokens.take(pa.array(code)), pa.array(n)], ["_group", "project_id", "token", "n"])


def _weights(docs: pa.Table, words: pa.Table):
    """Per entry of a group, by document and token: (row of its document, document, tokens, token code, tf, place in ``words``, value)."""
    first, project, projects, tokens, at, code, tf = _entries(docs)
    size = max(len(tokens), 1)
    key = pc.index_in(words.column("project_id"), projects).to_numpy().astype(np.int64) * size + pc.index_in(words.column("token"), tokens).to_numpy()
    order = np.argsort(key)
    word = order[np.searchsorted(key[order], project[at] * size + code)]
    w = tf * words.column("idf").to_numpy()[word]
    norm = np.sqrt(np.add.reduceat(w * w, np.flatnonzero(np.r_[True, at[1:] != at[:-1]]))) if len(w) else w
    return first, at, tokens, code, tf, word, w / norm[at]


def _weigh(docs: pa.Table, words: pa.Table) -> pa.Table:
    """(project_id, _doc, token, tf, df, value) of a group: tf * idf, divided by the document's norm."""
    first, at, tokens, code, tf, word, value = _weights(docs, words)
    row = pa.array(first[at])
    return pa.table([docs.column("project_id").take(row), docs.column("_doc").take(row), tokens.take(pa.array(code)), pa.array(tf),
                     words.column("df").take(pa.array(word)), pa.array(value)], ["project_id", "_doc", "token", "tf", "df", "value"])


def _weigh_vectors(docs: pa.Table, words: pa.Table) -> pa.Table:
    """(project_id, _doc, vec, self_dot) of a group: a row per document, vec as ``similarity`` wants it."""
    first, at, tokens, code, _, word, value = _weights(docs, words)
    df = words.column("df").to_numpy()[word]
    order = np.lexsort((code, df, at))
    code, df, value = code[order], df[order], value[order]
    cut = np.r_[0, np.cumsum(np.bincount(at, minlength=len(first)))]
    rest, dot = np.zeros(len(value)), np.zeros(len(first))
    for i, (a, b) in enumerate(zip(cut[:-1], cut[1:])):  # a document's own sums: copies get the same bits
        after = np.cumsum(value[a:b][::-1] ** 2)
        rest[a:b - 1] = np.sqrt(after[:-1])[::-1]
        dot[i] = after[-1]
    entry = pa.StructArray.from_arrays([pa.array(df), tokens.take(pa.array(code)), pa.array(value), pa.array(rest)], ["df", "token", "value", "rest"])
    row = pa.array(first)
    return pa.table([docs.column("project_id").take(row), docs.column("_doc").take(row), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), entry),
                     pa.array(dot)], ["project_id", "_doc", "vec", "self_dot"])


def _grouped(docs: DataFrame, doc_col: str, text_col: str, token_pattern: str, group_chars: int):
    """(the groups of documents with those of their words, types of project_id and _doc)."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    kind = f"project_id {kinds['project_id']}, _doc {kinds[doc_col]}"
    groups = int((docs.agg(F.sum(F.length(text_col))).first()[0] or 0) // group_chars) + 1
    group = F.pmod(F.xxhash64("project_id", doc_col), F.lit(groups)).cast("int").alias("_group")
    counted = (docs.where("project_id is not null")
               .select(group, "project_id", F.col(doc_col).alias("_doc"),
                       F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(token_pattern), 0).alias("tokens"))
               .mapInArrow(_count, f"_group int, {kind}, tokens array<string>, tf array<bigint>"))
    n_docs = docs.groupBy("project_id").agg(F.count("*").alias("n_docs"))
    words = (counted.groupBy("_group").applyInArrow(_group_counts, f"_group int, project_id {kinds['project_id']}, token string, n bigint")
             .withColumn("df", F.sum("n").over(Window.partitionBy("project_id", "token"))).join(n_docs, "project_id")
             .select("_group", "project_id", "token", "df", (F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1).alias("idf")))
    return counted.groupBy("_group").cogroup(words.groupBy("_group")), kind


def tfidf_of_texts(docs: DataFrame, doc_col: str, text_col: str, token_pattern: str, group_chars: int = GROUP_CHARS) -> DataFrame:
    """``features.tfidf`` for long texts: the same rows (project_id, <doc_col>, token, tf, df, value).

    Rows of one project and id are one document, each counts in n; a row without project has
    no result. The length of the texts is read first; it gives the number of groups."""
    groups, kind = _grouped(docs, doc_col, text_col, token_pattern, group_chars)
    return groups.applyInArrow(_weigh, f"{kind}, token string, tf bigint, df bigint, value double").withColumnRenamed("_doc", doc_col)


def vectors_of_texts(docs: DataFrame, doc_col: str, text_col: str, token_pattern: str, group_chars: int = GROUP_CHARS) -> DataFrame:
    """The vectors of ``tfidf_of_texts``, a row per document, for ``similarity.nearest_pairs``:
    (project_id, <doc_col>, vec, self_dot), vec being (df, token, value, rest), rarest token first."""
    groups, kind = _grouped(docs, doc_col, text_col, token_pattern, group_chars)
    vec = "vec array<struct<df: bigint, token: string, value: double, rest: double>>"
    return groups.applyInArrow(_weigh_vectors, f"{kind}, {vec}, self_dot double").withColumnRenamed("_doc", doc_col)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
