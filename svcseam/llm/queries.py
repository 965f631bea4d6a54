"""Registered queries of the subpackage and their DuckDB SQL.

Each query applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (containment, exact_dup, hard_negatives, language_id, line_dedup, maxent_lm, merkle, near_dup, packing, secrets, token_counts, token_files,
               toxicity)
from .tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(read(spark, sf_dir, "documents"))


@query
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.with_digest(secrets.find_secrets(read(spark, sf_dir, "documents")))


@query
def op5_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dup.exact_duplicates(read(spark, sf_dir, "documents"))


@query
def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.lm_scores(read(spark, sf_dir, "documents"))


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.with_digest(packing.pack(read(spark, sf_dir, "documents")))


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


@query
def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.contained_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op10_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents"))


@query
def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_index(read(spark, sf_dir, "documents"))


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = hard_negatives.relabelled(read(spark, sf_dir, "embeddings"))
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_manifest(read(spark, sf_dir, "documents"))


#: A-Z folded to a-z.
_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE["op5_exact_duplicates"] = f"""
with t as (select doc_id, {_FOLDED} as low from documents),
     g as (select low, max(doc_id) as keep_id, count(*) as group_size from t group by low)
select t.doc_id, g.keep_id, g.group_size, coalesce(t.doc_id = g.keep_id, g.keep_id is null) as kept, sha256(t.low) as text_sha256
from t join g on t.low = g.low
"""

_SHINGLES = r"""select {key}, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: list_slice(w, i, i + 4)))) as s
      from (select {key}, string_split_regex(trim(lower(text), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+') as w
            from {table} where text is not null and {key} is not null) where len(w) >= 5"""

ORACLE["op9_benchmark_leaks"] = f"""
with d as (select distinct * from ({_SHINGLES.format(key="doc_id", table="documents")})),
     b as (select distinct * from ({_SHINGLES.format(key="item_id", table="benchmark")})),
     n as (select item_id, count(*) as n from b group by item_id)
select doc_id, b.item_id, n.n as item_shingles, count(*) as shared, count(*) / n.n as containment
from d join b on d.s = b.s join n on n.item_id = b.item_id
group by doc_id, b.item_id, n.n having 100 * count(*) >= 75 * n.n
"""

ORACLE["op10_line_runs"] = r"""
with a as (select doc_id, text, string_split(coalesce(text, ''), chr(10)) as ls from documents),
     x as (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as ln from a),
     l as (select doc_id, line, ln, row_number() over (partition by doc_id order by ln) as k,
                  len(string_split_regex(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+')) as words
           from x where regexp_matches(line, '[^\x20\x09-\x0D]')),
     p as (select l.doc_id, l.ln, l.k, l.words, e.doc_id as other, l.k - e.k as shift
           from l join l e on l.line = e.line and (e.doc_id < l.doc_id or (e.doc_id = l.doc_id and e.k < l.k))),
     r as (select *, k - row_number() over (partition by doc_id, other, shift order by k) as run from p),
     q as (select *, sum(words) over (partition by doc_id, other, shift, run) as total from r),
     d as (select doc_id, list(distinct ln) as gone from q where total >= 50 group by doc_id)
select a.doc_id, cast(len(ls) as integer) as n_lines, cast(coalesce(len(gone), 0) as integer) as n_deleted,
       case when gone is null then text
            else coalesce(list_aggregate([ls[i + 1] for i in range(len(ls)) if not list_contains(gone, i)], 'string_agg', chr(10)), '') end as text
from a left join d on a.doc_id = d.doc_id
"""

ORACLE["op12_hard_negatives"] = """
with r as (select vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label,
                  list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
           from embeddings where label is not null and embedding is not null
           and list_count(embedding) = len(embedding) and len(list_filter(embedding, lambda x: not isfinite(x))) = 0),
     s as (select a.vec_id as anchor_id, a.label as own, b.vec_id as other_id, b.label as label, cast(list_dot_product(a.v, b.v) as bigint) as score
           from r a join r b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
     p as (select anchor_id, other_id as positive_id, score as positive_score from s where label = own
           qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5),
     n as (select p.*, s.other_id as negative_id, s.score as negative_score,
                  row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.other_id) as rank
           from p join s on s.anchor_id = p.anchor_id and s.label <> s.own and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 10
"""


#: crc32 of the decimal doc_id, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(cast(doc_id as varchar), ''), lambda ch: cast(ord(ch) as bigint))),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""


def _merkle_sql(levels: int = 6, top: int = 4) -> str:
    """The trees of up to 16^levels leaves a source and 16^top sources, level by level."""
    def leaf(text):
        framed = [f"case when {c} is null then '-' else concat(strlen(cast({c} as varchar)), ':', {c}) end" for c in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256(concat({', '.join(framed)}))"

    def level(name, k, rows):
        """(tree, pos, n, h) with the siblings' hashes and the parent's."""
        w = "over (partition by tree, pos // 16 order by pos rows between {} and {})"
        before, after = w.format("unbounded preceding", "1 preceding"), w.format("1 following", "unbounded following")
        whole = w.format("unbounded preceding", "unbounded following")
        return (f"{name}{k} as materialized (select *, coalesce(string_agg(h, '') {before}, '') as lefts, coalesce(string_agg(h, '') {after}, '') as rights, "
                f"case when n > 1 then sha256(string_agg(h, '') {whole}) else h end as up from ({rows}))")

    def above(name, k):
        return f"select distinct tree, pos // 16 as pos, (n + 15) // 16 as n, up as h from {name}{k - 1}"

    steps = [("t", k) for k in range(levels)] + [("s", k) for k in range(top)]
    parts = [f"""d as materialized (select coalesce(':' || source, '-') as tree, doc_id, row_number() over (partition by source order by doc_id) - 1 as pos,
  count(*) over (partition by source) as n, {leaf('text')} as leaf, {leaf('changed_text')} as changed
  from (select *, case when crc % 5 = 0 and text is not null then {_FOLDED} else text end as changed_text from (select *, {_CRC32} as crc from documents)))"""]
    parts += [level("t", k, above("t", k) if k else "select tree, pos, n, leaf as h from d") for k in range(levels)]
    parts.append(f"o as materialized (select '' as tree, tree as name, row_number() over (order by tree) - 1 as pos, count(*) over () as n, up as h from t{levels - 1})")
    parts += [level("s", k, above("s", k) if k else "select tree, pos, n, h from o") for k in range(top)]
    joins = [f"join t{k} on t{k}.tree = d.tree and t{k}.pos = d.pos // {16 ** k}" for k in range(levels)] + ["join o on o.name = d.tree"]
    joins += [f"join s{k} on s{k}.pos = o.pos // {16 ** k}" for k in range(top)]
    pick = ", ".join(f"{t}{k}.lefts as l{i}, {t}{k}.rights as r{i}, {t}{k}.n as n{i}" for i, (t, k) in enumerate(steps))
    proof = ", ".join(f"{t}{k}.lefts, {t}{k}.rights" for t, k in steps)
    parts.append(f"f0 as (select d.doc_id, d.leaf, t{levels - 1}.up as subroot, s{top - 1}.up as root, sha256(concat({proof})) as proof_sha256, "
                 f"d.changed as f, {pick} from d {' '.join(joins)})")
    parts += [f"f{i + 1} as (select * replace (case when n{i} > 1 then sha256(concat(l{i}, f, r{i})) else f end as f) from f{i})" for i in range(len(steps))]
    return ("with " + ",\n".join(parts) + f"\nselect doc_id, leaf, subroot, root, proof_sha256, f as folded_root, f = root as verified from f{len(steps)}")


ORACLE["op13_merkle_manifest"] = _merkle_sql()
