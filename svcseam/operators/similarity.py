"""M5 / O2 — the k most similar document pairs per project (cosine), exact.

A token self-join would emit every pair inside a token's posting list, which for a common
token is quadratic. Instead an impact-ordered inverted index is read with a rising threshold:

0. **Copies.** Documents with bit-identical vectors form one copy group (fingerprint = hash
   of the sorted (token, weight) list). Only one representative per group enters steps 1–4,
   so a group of copies holding a third of all rows costs one document there. A pair of
   groups (G, H) stands for |G|·|H| member pairs of equal similarity, which order by name;
   only the first k members of each group by name can reach the top k, so the expansion is at
   most k² pairs per group pair (and the pairs inside a group, at similarity 1, come from its
   first k + 1 members).
1. **First blocks.** The head of the posting lists of each document's rarest and heaviest
   shared tokens: neighbours by weight, and the pairs of the first k + 1 entries. The
   most promising pairs per project (a bounded number, by the cosine over the tokens read and
   by the one token's product) are scored exactly; the k-th best pair (t, a_k, b_k) in the
   order of the result is the threshold.
2. **Index.** Tokens are ordered globally (rarest first). With ``rest`` = norm of a vector
   after a token, a pair whose first shared token is j has similarity at most
   x_j·y_j + rest_x·rest_y. An entry whose bound against its list's maxima is below t is
   dropped. The others fall into blocks by quantised impact (the norm from the token on),
   then by a hash, of about ``BLOCK_ROWS`` entries, each with its maxima.
3. **Blocks and candidates.** Entries that can lead a pair meet block maxima first, and
   only the blocks that can still reach the threshold meet their rows. Ties count in the
   order of the result: at exactly t a pair matters only before (a_k, b_k) by name, so the
   first name must be at most a_k. A hot token whose n entries all tie therefore costs the
   few leading names times its blocks, not n².
4. **Score** candidates exactly (a join of their two vectors on the shared tokens), together
   with the pairs of step 1, and keep the top k by (similarity desc, a, b).
5. **Expand** representative pairs to member pairs (step 0). **Pad**: if a project has
   fewer than k pairs with positive similarity, the remaining slots are zero-similarity pairs
   in name order, which only involve the first 2k documents by name.

No pair count is capped: the bounded choice of step 1 only decides how high the threshold
starts, and every pair that can rank among the k best is scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..session import cut_lineage

KEY = ["project_id"]
SIM_DECIMALS = 9
HALF = 0.5 * 10 ** -SIM_DECIMALS
EPS = 1e-12  # above the rounding errors of the bounds
SEED_TOKENS = 8  # of a document's rarest and of its heaviest tokens, read for the threshold
SALTS, SALT_FROM = 16, 4096  # posting lists longer than this are split for the first blocks
FIRST_PAIRS = 64  # pairs per project and estimate that are scored for the threshold
BLOCK_ROWS = 256
LEVELS = 64  # steps of the quantised impact
BROADCAST_IDS = 1_000_000  # so many ids at most go to the vectors; beyond, the vectors are shuffled to them


def _doc_vectors(vecs: DataFrame, doc: str, seed_tokens: int = SEED_TOKENS) -> DataFrame:
    """One row per document: ``vec`` = its (df, token, value, rest) entries, rarest token
    first, ``rest`` being the norm of the entries after; ``read`` = those of its rarest and its
    heaviest tokens that another document has; ``fp`` = hash of the vector; ``self_dot``.
    ``vecs`` may bring ``df``; else it is counted. Where they bring ``vec`` and ``self_dot``,
    a row is a document already and nothing is shuffled."""
    if "vec" in vecs.columns:
        return _with_reads(vecs.select(*KEY, doc, "vec", "self_dot"), doc, seed_tokens)
    v = vecs.filter(F.col("value") > 0)
    if "df" not in vecs.columns:
        v = v.join(v.groupBy(*KEY, "token").agg(F.count("*").alias("df")), [*KEY, "token"])
    after = (Window.partitionBy(*KEY, doc).orderBy(F.col("df").desc(), F.col("token").desc())
             .rowsBetween(Window.unboundedPreceding, -1))
    entries = v.select(*KEY, doc, "df", "token", "value",
                       F.sqrt(F.coalesce(F.sum(F.col("value") * F.col("value")).over(after), F.lit(0.0))).alias("rest"))
    # Grouped on the window's partitioning: no further shuffle.
    d = entries.groupBy(*KEY, doc).agg(F.sort_array(F.collect_list(F.struct("df", "token", "value", "rest"))).alias("vec"),
                                       F.sum(F.col("value") * F.col("value")).alias("self_dot"))
    return _with_reads(d, doc, seed_tokens)


def _with_reads(d: DataFrame, doc: str, seed_tokens: int) -> DataFrame:
    words = F.transform("vec", lambda e: F.concat_ws("\u0001", e["token"], e["value"].cast("string")))
    shared = F.filter("vec", lambda e: e["df"] >= 2)
    by_weight = F.sort_array(F.transform(shared, lambda e: F.struct((-e["value"]).alias("less"), e.alias("entry"))))
    heavy = F.transform(F.slice(by_weight, 1, seed_tokens), lambda e: e["entry"])
    return d.select(*KEY, doc, "vec", F.array_distinct(F.concat(F.slice(shared, 1, seed_tokens), heavy)).alias("read"),
                    "self_dot", F.sha2(F.array_join(words, "\u0002"), 256).alias("fp"))


def _few(ids: DataFrame) -> DataFrame:
    """Kept ids that are joined to the vectors: sent to them where they are few, so that no vector is shuffled."""
    ids = cut_lineage(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _score(pairs: DataFrame, docs: DataFrame, doc: str) -> DataFrame:
    """Exact dot products of candidate pairs: each pair meets the tokens of its first
    document, then the second document's weight for the same token. Only the vectors of
    documents in ``pairs`` are unfolded."""
    pairs = cut_lineage(pairs)
    used = _few(pairs.select(*KEY, F.explode(F.array("a", "b")).alias(doc)).distinct())
    v = docs.select(*KEY, doc, "vec").join(used, [*KEY, doc], "left_semi").select(*KEY, doc, F.inline("vec"))
    va = v.select(*KEY, F.col(doc).alias("a"), "token", F.col("value").alias("va"))
    vb = v.select(*KEY, F.col(doc).alias("b"), "token", F.col("value").alias("vb"))
    return (pairs.join(va, [*KEY, "a"]).join(vb, [*KEY, "b", "token"])
            .groupBy(*KEY, "a", "b").agg(F.round(F.sum(F.col("va") * F.col("vb")), SIM_DECIMALS).alias("similarity")))


def _ordered_pair(x, y):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _ranked(df: DataFrame, order: list, most: int) -> DataFrame:
    """The first ``most`` rows per project (partial limit per task)."""
    w = Window.partitionBy(*KEY).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most)


def first_pairs(docs: DataFrame, doc: str, k: int, salt_buckets: int = SALTS) -> DataFrame:
    """Step 1: a bounded number of promising pairs per project."""
    read = (docs.withColumn("_norm", F.sqrt(F.aggregate("read", F.lit(0.0), lambda s, e: s + e["value"] * e["value"])))
            .select(*KEY, doc, "_norm", F.inline("read")))
    salt = F.when(F.col("df") > SALT_FROM, F.pmod(F.xxhash64(doc), F.lit(salt_buckets))).otherwise(F.lit(0))
    w = Window.partitionBy(*KEY, "token", "_salt").orderBy(F.col("value").desc(), F.col(doc))
    entry = F.struct(F.col(doc).alias("x"), F.col("value").alias("v"), F.col("_norm").alias("n"))
    listed = (read.withColumn("_salt", salt).withColumn("_nth", F.row_number().over(w))
              .withColumn("_next", F.lead(entry).over(w)))
    # neighbours by weight: the cosine over the tokens read
    near = (listed.filter(F.col("_next").isNotNull())
            .select(*KEY, *_ordered_pair(F.col(doc), F.col("_next.x")), (F.col("value") * F.col("_next.v")).alias("part"),
                    (F.col("_norm") * F.col("_next.n")).alias("norms"))
            .groupBy(*KEY, "a", "b").agg((F.sum("part") / F.first("norms")).alias("estimate")))
    # heads of the lists: at most k + 1 entries a list and salt, their pairs by the token's product
    head = listed.filter(F.col("_nth") <= k + 1).groupBy(*KEY, "token", "_salt").agg(F.sort_array(F.collect_list(entry)).alias("es"))
    pairs = F.flatten(F.transform("es", lambda e, i: F.transform(
        F.slice("es", i + 2, k + 1), lambda f: F.struct(e["x"].alias("a"), f["x"].alias("b"), (e["v"] * f["v"]).alias("estimate")))))
    heads = head.select(*KEY, F.inline(pairs)).groupBy(*KEY, "a", "b").agg(F.sum("estimate").alias("estimate"))
    order = [F.col("estimate").desc(), F.col("a"), F.col("b")]
    most = FIRST_PAIRS + k
    return (_ranked(near, order, most).select(*KEY, "a", "b")
            .unionByName(_ranked(heads, order, most).select(*KEY, "a", "b")).distinct())


def _reaches(bound: Column, first: Column) -> Column:
    """Whether a pair of at most ``bound`` that starts with name ``first`` can be among the
    k best: above t, or at t with a name up to a_k."""
    return (bound >= F.col("t") + F.lit(HALF - EPS)) | ((bound >= F.col("t") - F.lit(HALF + EPS)) & (first <= F.col("a_k")))


def index_blocks(docs: DataFrame, thr: DataFrame, doc: str, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Step 2: (entries, blocks) of the index under the threshold ``thr`` (project_id, t,
    a_k, b_k; t is 0 where a project has none). Entries carry their block; blocks have the maxima of value, rest and name."""
    low = F.col("t") - F.lit(HALF + EPS)
    entries = (docs.join(_few(thr), KEY, "left").select(*KEY, doc, F.coalesce("t", F.lit(0.0)).alias("t"), "a_k", "b_k", F.inline("vec"))
               .withColumn("impact", F.sqrt(F.col("value") * F.col("value") + F.col("rest") * F.col("rest")))
               .filter((F.col("df") >= 2) & (F.col("impact") >= low)))
    level = F.floor(F.col("impact") * F.lit(LEVELS)).cast("int")
    entries = entries.withColumn("level", level)
    lists = (entries.groupBy(*KEY, "token", "level").agg(F.count("*").alias("n"), F.max("value").alias("v"), F.max("rest").alias("r")))
    whole = Window.partitionBy(*KEY, "token")  # at most LEVELS + 1 rows a list
    lists = lists.select(*KEY, "token", "level", F.ceil(F.col("n") / F.lit(block_rows)).alias("parts"),
                         F.max("v").over(whole).alias("list_v"), F.max("r").over(whole).alias("list_r"), F.sum("n").over(whole).alias("list_n"))
    entries = cut_lineage(
        entries.join(lists.filter("list_n >= 2"), [*KEY, "token", "level"])
        .filter(F.col("value") * F.col("list_v") + F.col("rest") * F.col("list_r") >= low)
        .withColumn("part", F.pmod(F.xxhash64(doc), F.col("parts")))
        .select(*KEY, "token", "level", "part", doc, "value", "rest", "t", "a_k", "b_k", "list_v", "list_r"))
    blocks = entries.groupBy(*KEY, "token", "level", "part").agg(F.max("value").alias("bv"), F.max("rest").alias("br"), F.max(doc).alias("last"))
    return entries, blocks


def candidate_pairs(docs: DataFrame, thr: DataFrame, doc: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Step 3: every pair (a, b) that shares a token and can rank before or at the threshold."""
    entries, blocks = index_blocks(docs, thr, doc, block_rows)
    lead = (entries.filter(_reaches(F.col("value") * F.col("list_v") + F.col("rest") * F.col("list_r"), F.col(doc)))
            .select(*KEY, "token", F.col(doc).alias("a"), F.col("value").alias("av"), F.col("rest").alias("ar"), "t", "a_k", "b_k"))
    live = (lead.join(blocks, [*KEY, "token"])
            .filter((F.col("last") > F.col("a")) & _reaches(F.col("av") * F.col("bv") + F.col("ar") * F.col("br"), F.col("a"))))
    rows = entries.select(*KEY, "token", "level", "part", F.col(doc).alias("b"), F.col("value").alias("yv"), F.col("rest").alias("yr"))
    bound = F.col("av") * F.col("yv") + F.col("ar") * F.col("yr")
    before = (F.col("a") < F.col("a_k")) | ((F.col("a") == F.col("a_k")) & (F.col("b") <= F.col("b_k")))
    return (live.join(rows, [*KEY, "token", "level", "part"])
            .filter((F.col("a") < F.col("b")) & ((bound >= F.col("t") + F.lit(HALF - EPS)) | ((bound >= F.col("t") - F.lit(HALF + EPS)) & before)))
            .select(*KEY, "a", "b").distinct())


def threshold(sims: DataFrame, k: int) -> DataFrame:
    """(project_id, t, a_k, b_k): the k-th best pair; projects with fewer pairs have no row,
    and every pair that shares a token counts there."""
    order = [F.col("similarity").desc(), F.col("a"), F.col("b")]
    return (_ranked(sims.filter(F.col("similarity") > 0), order, k).filter(F.col("_r") == k)
            .select(*KEY, F.col("similarity").alias("t"), F.col("a").alias("a_k"), F.col("b").alias("b_k")))


def nearest_pairs(vecs: DataFrame, doc: str = "class_name", k: int = rules.TOP_PAIRS,
                  salt_buckets: int = SALTS, seed_tokens: int = SEED_TOKENS) -> DataFrame:
    """``vecs``: long unit vectors ``(project_id, <doc>, token, value[, df])`` with
    value > 0 (e.g. from ``features.tfidf``), or one row a document (``text_weights.vectors_of_texts``). Output:
    ``(project_id, class_a, class_b, similarity, rank)`` with class_a < class_b.

    ``seed_tokens`` only steers how the threshold is found (the rarest and the heaviest
    tokens of each document supply the first pairs); results do not depend on it."""
    all_docs = cut_lineage(_doc_vectors(vecs, doc, seed_tokens))

    # 0. copy groups: representative = first member by name; members ranked
    #    by name, only the first k + 1 are ever needed (partial limit per task)
    wm = Window.partitionBy(*KEY, "fp").orderBy(doc)
    nth = all_docs.select(*KEY, doc, "fp", "self_dot").withColumn("_m", F.row_number().over(wm))
    members = nth.filter(F.col("_m") <= k + 1).select(*KEY, "fp", F.col(doc).alias("member"), "_m", "self_dot")
    reps = members.filter(F.col("_m") == 1).select(*KEY, "fp", F.col("member").alias(doc))
    named = all_docs.filter(F.col("project_id").isNotNull() & F.col(doc).isNotNull())
    docs = named.join(_few(nth.filter(F.col("_m") > 1).select(*KEY, doc)), [*KEY, doc], "left_anti")
    # pairs inside a copy group (similarity = the vector's own dot product)
    m1 = members.select(*KEY, "fp", F.col("member").alias("x"), "self_dot")
    m2 = members.select(*KEY, "fp", F.col("member").alias("y"))
    intra = (m1.join(m2, [*KEY, "fp"]).filter(F.col("x") < F.col("y"))
             .select(*KEY, F.col("x").alias("a"), F.col("y").alias("b"),
                     F.round(F.col("self_dot"), SIM_DECIMALS).alias("similarity")))

    # 1.–3. first pairs give the threshold (pairs inside copy groups are real pairs and raise
    # it too), the index the pairs that can still pass it
    first = cut_lineage(_score(first_pairs(docs, doc, k, salt_buckets), docs, doc))
    thr = cut_lineage(threshold(first.unionByName(intra), k))
    more = candidate_pairs(docs, thr, doc).join(first, [*KEY, "a", "b"], "left_anti")
    found = first.unionByName(_score(more, docs, doc))
    scored_reps = found.filter(F.col("similarity") > 0).join(thr, KEY, "left").filter(F.col("t").isNull() | (F.col("similarity") >= F.col("t")))

    # 5. expand representative pairs to member pairs (first k members each)
    fp_a = reps.select(*KEY, F.col("fp").alias("fa"), F.col(doc).alias("a"))
    fp_b = reps.select(*KEY, F.col("fp").alias("fb"), F.col(doc).alias("b"))
    ma = members.filter(F.col("_m") <= k).select(*KEY, F.col("fp").alias("fa"), F.col("member").alias("ma"))
    mb = members.filter(F.col("_m") <= k).select(*KEY, F.col("fp").alias("fb"), F.col("member").alias("mb"))
    inter = (scored_reps.select(*KEY, "a", "b", "similarity").join(fp_a, [*KEY, "a"]).join(fp_b, [*KEY, "b"])
             .join(ma, [*KEY, "fa"]).join(mb, [*KEY, "fb"])
             .select(*KEY, *_ordered_pair(F.col("ma"), F.col("mb")), "similarity"))
    best = [F.col("similarity").desc(), F.col("a"), F.col("b")]
    scored = cut_lineage(_ranked(inter.unionByName(intra).filter(F.col("similarity") > 0), best, k).drop("_r"))

    # zero-similarity padding among the first 2k documents by name
    names = _ranked(all_docs.select(*KEY, doc), [F.col(doc)], 2 * k).drop("_r")
    f1 = names.select(*KEY, F.col(doc).alias("a"))
    f2 = names.select(*KEY, F.col(doc).alias("b"))
    short = scored.groupBy(*KEY).agg(F.count("*").alias("_n"))
    pad = (f1.join(f2, KEY).filter(F.col("a") < F.col("b")).join(short, KEY, "left").filter(F.coalesce("_n", F.lit(0)) < k).drop("_n")
           .join(scored.select(*KEY, "a", "b"), [*KEY, "a", "b"], "left_anti")
           .withColumn("similarity", F.lit(0.0)))
    return (_ranked(scored.unionByName(pad), best, k)
            .select(*KEY, F.col("a").alias("class_a"), F.col("b").alias("class_b"), "similarity", F.col("_r").alias("rank")))
