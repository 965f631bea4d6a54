"""M1–M5 on the recorded 14-class golden, and the quality checks Q*."""

import math
import random

from pyspark.sql import functions as F

from svcseam import rules
from svcseam.operators import features as M
from svcseam.operators import quality as Q
from svcseam.operators import similarity as S

# class: (calls_out, db_columns, log_frequency); PetValidator as in the step-3 input (stale: none/0/0)
ROWS = {
    "Owner": (20, 6, 4), "PetController": (50, 5, 2), "PetValidator": (9, 0, 0), "Vet": (7, 3, 1),
    "Visit": (1, 4, 1), "PetClinicApplication": (1, 0, 0), "PetClinicRuntimeHints": (12, 0, 0),
    "VetController": (15, 3, 1), "VisitController": (11, 4, 1), "OwnerController": (36, 6, 4),
    "Pet": (1, 5, 2), "PetTypeFormatter": (4, 0, 0), "CacheConfiguration": (2, 0, 0), "WebConfiguration": (3, 0, 0),
}


def _matrix(spark):
    rows = []
    for n, (co, dc, lf) in ROWS.items():
        rows.append(("p", n, None, co, 0, 0, 0, dc, 0, 0, 0, lf, int(n.endswith("Controller")), 0, 0))
    schema = ("project_id string, class_name string, related_table string, " +
              ", ".join(f"{c} int" for c in rules.NUMERIC_COLUMNS))
    return spark.createDataFrame(rows, schema)


def test_zscore_golden(spark):
    st = M.column_stats(_matrix(spark)).collect()[0]
    assert abs(st.mean_calls_out - 12.285714) < 1e-6 and abs(st.std_calls_out - 13.976657) < 1e-6
    assert abs(st.mean_db_columns - 2.571429) < 1e-6 and abs(st.std_db_columns - 2.3819) < 1e-4
    assert abs(st.mean_is_controller - 0.285714) < 1e-6 and abs(st.std_is_controller - 0.4518) < 1e-4
    z = {r.class_name: r for r in M.zscores(_matrix(spark)).collect()}
    assert abs(z["Owner"].num_calls_out - (20 - 12.285714285714286) / 13.976657) < 1e-6
    assert all(r.num_calls_in == 0.0 for r in z.values())  # constant column → 0
    chk = {r.column: r for r in Q.zscore_check(M.zscores(_matrix(spark))).collect()}
    assert all(r.mean_ok for r in chk.values())


def test_camel_and_tfidf_golden(spark):
    classes = spark.createDataFrame([("p", n) for n in ROWS], "project_id string, class_name string")
    tok = {r.class_name: r.tokens for r in M.camel_tokens(classes).collect()}
    assert tok["PetClinicRuntimeHints"] == "pet clinic runtime hints" and tok["OwnerController"] == "owner"
    t = M.class_tfidf(classes)
    assert t.select("token").distinct().count() == 14
    pv = {r.token: r.value for r in t.filter("class_name = 'PetValidator'").collect()}
    assert abs(pv["pet"] - 0.50460724) < 1e-8 and abs(pv["validator"] - 0.86334902) < 1e-8
    df = {r.token: r.df for r in t.select("token", "df").distinct().collect()}
    assert df["pet"] == 6 and df["clinic"] == 2 and df["owner"] == 2
    norms = t.groupBy("class_name").agg(F.sqrt(F.sum(F.col("value") ** 2)).alias("n")).collect()
    assert all(abs(r.n - 1) < 1e-12 for r in norms)
    pairs = S.nearest_pairs(t).orderBy("rank").collect()
    got = [(r.class_a, r.class_b, round(r.similarity, 8)) for r in pairs]
    assert got == [("Owner", "OwnerController", 1.0), ("Pet", "PetController", 1.0), ("Vet", "VetController", 1.0),
                   ("Visit", "VisitController", 1.0), ("Pet", "PetValidator", 0.50460724)]


def test_nearest_pairs_brute_force(spark, sf_small):
    """Exact top-k equals a brute-force all-pairs computation on a small fixture."""
    from svcseam.plans import registry as R
    v = R.documents_tfidf_long(spark, sf_small)
    got = [(r.project_id, r.class_a, r.class_b, r.similarity) for r in S.nearest_pairs(v, "doc_id").collect()]
    pdf = v.select("project_id", "doc_id", "token", "value").toPandas()
    exp = []
    for p, g in pdf.groupby("project_id"):
        vec = {d: dict(zip(x.token, x.value)) for d, x in g.groupby("doc_id")}
        docs = sorted(vec)
        sims = []
        for i, a in enumerate(docs):
            for b in docs[i + 1:]:
                s = sum(w * vec[b].get(t, 0.0) for t, w in vec[a].items())
                sims.append((-round(s, 9), a, b))
        sims.sort()
        exp += [(p, a, b, -s) for s, a, b in sims[:5]]
    assert sorted(got) == sorted(exp)


def _brute(vecs, k=5):
    """vecs: {doc: {token: value}} → the k best pairs by (similarity desc, names)."""
    docs = sorted(vecs)
    sims = sorted((-round(sum(w * vecs[b].get(t, 0.0) for t, w in vecs[a].items()), 9), a, b) for i, a in enumerate(docs) for b in docs[i + 1:])
    return [(a, b, -s) for s, a, b in sims[:k]]


def _long(spark, vecs, project="p"):
    return spark.createDataFrame([(project, d, t, float(w)) for d, v in vecs.items() for t, w in v.items()],
                                 "project_id string, class_name string, token string, value double")


def test_ties_on_a_hot_token_cost_few_candidates(spark):
    """5,000 documents share one token with equal weight: 12.5 million pairs tie."""
    vecs = {f"d{i:05d}": {"hot": 0.6, f"u{i}": 0.8} for i in range(5000)}
    v = _long(spark, vecs)
    got = [(r.class_a, r.class_b, r.similarity) for r in S.nearest_pairs(v).orderBy("rank").collect()]
    assert got == [("d00000", f"d{i:05d}", 0.36) for i in range(1, 6)]
    docs = S._doc_vectors(v, "class_name")
    thr = S.threshold(S._score(S.first_pairs(docs, "class_name", 5), docs, "class_name"), 5)
    assert S.candidate_pairs(docs, thr, "class_name").count() < 5000
    # weights that differ a little: impacts, not names, decide
    vecs = {d: {"hot": 0.3 + int(d[1:]) * 1.37e-5, f"u{d}": 0.5} for d in list(vecs)[:3000]}
    v = _long(spark, vecs)
    got = [(r.class_a, r.class_b, r.similarity) for r in S.nearest_pairs(v).orderBy("rank").collect()]
    assert got == _brute({d: vecs[d] for d in sorted(vecs)[-20:]})
    docs = S._doc_vectors(v, "class_name")
    thr = S.threshold(S._score(S.first_pairs(docs, "class_name", 5), docs, "class_name"), 5)
    assert S.candidate_pairs(docs, thr, "class_name").count() < 5000


def test_nearest_pairs_on_many_shapes(spark):
    """Ties, copies, few shared tokens, too few pairs: all against brute force, in one corpus."""
    rng = random.Random(4)
    corpus = {}
    for p in range(24):
        n, words = rng.choice([1, 2, 3, 5, 9, 40]), rng.choice([1, 2, 4, 12])
        vecs = {}
        for i in range(n):
            tokens = rng.sample(range(words), rng.randint(1, min(words, 4)))
            raw = {f"t{t}": rng.choice([1.0, 1.0, 2.0, 3.5]) for t in tokens} | ({f"own{i}": 1.0} if p % 2 else {})
            norm = math.sqrt(sum(w * w for w in raw.values()))
            vecs[f"c{rng.randrange(1000):03d}{i}"] = {t: w / norm for t, w in raw.items()}
        corpus[f"p{p}"] = vecs
    long = None
    for p, vecs in corpus.items():
        part = _long(spark, vecs, p)
        long = part if long is None else long.unionByName(part)
    got = {}
    for r in S.nearest_pairs(long).orderBy("project_id", "rank").collect():
        got.setdefault(r.project_id, []).append((r.class_a, r.class_b, r.similarity))
    for p, vecs in corpus.items():
        assert got.get(p, []) == _brute(vecs), p


def test_composite_weights(spark):
    m = _matrix(spark)
    classes = m.select("project_id", "class_name")
    comp = M.composite_long(M.zscores_long(M.zscores(m)), M.class_tfidf(classes))
    row = {r.feature: r.value for r in comp.filter("class_name = 'PetValidator'").collect()}
    assert abs(row["tfidf_validator"] - 0.3 * 0.86334902) < 1e-8
    assert len([k for k in row if k.startswith("num_")]) == 12
    header = M.wide_rows(comp).filter("lead = 0").collect()
    assert len(header) == 1 and len(header[0].names) == 12 + 14 and header[0].names == sorted(header[0].names)


def test_quality_checks(spark):
    m = _matrix(spark)
    const = {r.column: r.constant for r in Q.constant_features(m).collect()}
    assert sum(const.values()) == 8 and const["calls_in"]           # 8 constant columns
    assert not any(r.constant for r in Q.constant_features(m, fixed=False).collect())  # K13
    assert Q.isolated(m).count() == 0
    neg = Q.negatives(m).filter("negative").count()
    assert neg == 0
    prof = {r.column: r for r in Q.profile(m).collect()}
    assert prof["calls_out"].mean == 12.29 and prof["calls_out"].max == 50 and prof["calls_in"].zeros == 14
    dup = spark.createDataFrame([("p", "A", 1), ("p", "B", 2), ("p", "A", 3), ("p", "A", 4)],
                                "project_id string, class_name string, row_order int")
    assert [r.row_order for r in Q.duplicates(dup).orderBy("row_order").collect()] == [3, 4]
    assert Q.required_columns(m) == []
    st = Q.step_status(dup.select("project_id", F.lit(2).alias("step")), dup).collect()
    ok = {r.step: r.ok for r in st}
    assert ok == {1: True, 2: False, 3: True, 0: False}
    assert not math.isnan(prof["db_columns"].mean)


def test_nearest_pairs_copy_groups(spark):
    """Large copy groups (one vector shared by most documents) give the same
    top pairs as brute force."""
    import random
    rnd = random.Random(7)
    base = {"A": {"x": 0.6, "y": 0.8}, "B": {"x": 0.8, "z": 0.6}}
    docs = {}
    for i in range(30):
        docs[f"a{i:02d}"] = base["A"]
    for i in range(6):
        docs[f"b{i}"] = base["B"]
    for i in range(8):
        w = {t: rnd.random() for t in rnd.sample(["x", "y", "z", "u", "v"], 3)}
        n = sum(x * x for x in w.values()) ** 0.5
        docs[f"r{i}"] = {t: x / n for t, x in w.items()}
    rows = [("p", d, t, x) for d, vec in docs.items() for t, x in vec.items()]
    v = spark.createDataFrame(rows, "project_id string, class_name string, token string, value double")
    for k in (3, 5, 40):
        got = [(r.class_a, r.class_b, r.similarity) for r in S.nearest_pairs(v, k=k).orderBy("rank").collect()]
        names = sorted(docs)
        sims = sorted((-round(sum(w * docs[b].get(t, 0.0) for t, w in docs[a].items()), 9), a, b)
                      for i, a in enumerate(names) for b in names[i + 1:])
        assert got == [(a, b, -s + 0.0) for s, a, b in sims[:k]]


def test_hot_token_does_not_score_all_pairs(spark):
    """Documents that share one hot token only, next to two tokens of their own each."""
    import math

    n, rows = 300, []
    for i in range(n):
        w = 0.05 + 0.9 * i / n
        rest = math.sqrt((1 - w * w) / 2)
        rows += [("p", f"d{i:03d}", "hot", w), ("p", f"d{i:03d}", f"u{i}", rest), ("p", f"d{i:03d}", f"v{i}", rest)]
    v = spark.createDataFrame(rows, "project_id string, class_name string, token string, value double")
    docs = S._doc_vectors(v, "class_name")
    thr = S.threshold(S._score(S.first_pairs(docs, "class_name", 5), docs, "class_name"), 5)
    assert 5 <= S.candidate_pairs(docs, thr, "class_name").count() < n  # of n (n - 1) / 2 pairs
    got = [(r.class_a, r.class_b) for r in S.nearest_pairs(v, k=5).orderBy("rank").collect()]
    hot = {r[1]: r[3] for r in rows if r[2] == "hot"}
    want = sorted(((-round(hot[a] * hot[b], 9), a, b) for a in hot for b in hot if a < b))[:5]
    assert got == [(a, b) for _, a, b in want]


def test_tfidf_of_texts_equals_tfidf(spark):
    """counted where the text is read; same rows with repeated and null ids, null texts and projects, in groups of any size."""
    from svcseam.operators import text_weights as W
    rows = [("p", 1, "Aa bb aa"), ("p", 1, "bb cc"), ("p", None, "aa zz"), ("p", None, "zz zz"), (None, 3, "aa bb"), ("q", 4, None),
            ("q", 5, ""), ("q", 6, "aa éé Éé"), ("r", 7, "x"), ("p", 8, "\U00020000\U00020001 ﬁﬁ aa")]
    docs = spark.createDataFrame(rows + [("s", i, "same text " + "w" * (2 + i // 2)) for i in range(20)], "project_id string, doc_id long, text string")
    pattern = r"[\p{L}\p{N}_]{2,}"
    for d in (docs, docs.limit(0)):
        want = {(r.project_id, r.doc_id, r.token): r for r in M.tfidf(d, "doc_id", "text", pattern).collect()}
        for chars in (10, 10 ** 6):
            found = W.tfidf_of_texts(d, "doc_id", "text", pattern, chars)
            got = found.collect()
            assert found.dtypes == M.tfidf(d, "doc_id", "text", pattern).dtypes and len(got) == len(want)
            for r in got:
                w = want[r.project_id, r.doc_id, r.token]
                assert (r.tf, r.df) == (w.tf, w.df) and abs(r.value - w.value) < 1e-12


def test_tfidf_documents_shuffles_no_token_rows(spark, sf_small):
    import __spark_entry__ as E
    p = E.queries()["tfidf_documents"](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    # by document group, by token of a group, and the documents per language; never by document and token
    keys = [line.split("hashpartitioning(")[1] for line in p.splitlines() if "Exchange hashpartitioning(" in line]
    assert keys and not any("doc_id#" in k or "_doc#" in k for k in keys)


def test_nearest_pairs_of_vectors_equal_those_of_rows(spark):
    """a row per document gives the pairs that rows of tokens give, with copies, null ids and projects; its vectors
    are not shuffled to be formed or to lose their copies."""
    from svcseam.operators import text_weights as W
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.randint(1, 6))) for _ in range(30)]
    rows = [(rng.choice("pq"), i, rng.choice(texts)) for i in range(60)] + [("p", None, texts[0]), (None, 99, texts[1]), ("r", 100, "zz"), ("r", 101, None)]
    docs = spark.createDataFrame(rows, "project_id string, doc_id long, text string")
    pattern = r"[\p{L}\p{N}_]{2,}"
    vectors = W.vectors_of_texts(docs, "doc_id", "text", pattern, 100)
    got, want = ({(r.project_id, r["rank"]): (r.class_a, r.class_b, r.similarity) for r in S.nearest_pairs(v, "doc_id").collect()}
                 for v in (vectors, M.tfidf(docs, "doc_id", "text", pattern)))
    assert got == want and len(got) >= 10
    plan = S._doc_vectors(vectors, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "doc_id#" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning(" in x)


def test_class_names_are_moved_not_their_tokens(spark):
    """TF-IDF of class names shuffles names, then the counted tokens to their document frequencies and back."""
    classes = spark.createDataFrame([("p", "PetOwner"), ("p", "PetVisit"), ("p", "PetOwner"), (None, "Pet"), ("q", "OwnerService")], "project_id string, class_name string")
    df = M.class_tfidf(classes)
    p = df._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in p.splitlines() if "Exchange hashpartitioning(" in line]
    assert not any("class_name#" in line and "token#" in line for line in moved), moved
    got = {(r.project_id, r.class_name, r.token): (r.tf, r.df) for r in df.collect()}
    assert got == {("p", "PetOwner", "pet"): (2, 2), ("p", "PetOwner", "owner"): (2, 1), ("p", "PetVisit", "pet"): (1, 2), ("p", "PetVisit", "visit"): (1, 1), ("q", "OwnerService", "owner"): (1, 1)}


def test_composite_moves_no_z_scores(spark):
    """F8: z-scores that bring related_table are not joined, one row each, to get it."""
    z = spark.createDataFrame([("p", "A", "t", 1.0), (None, "B", None, 2.0)], "project_id string, class_name string, related_table string, num_x double")
    tfidf = spark.createDataFrame([("p", "A", "a", 0.5)], "project_id string, class_name string, token string, value double")
    long = M.zscores_long(z, ["x"], ids=["related_table"])
    df = M.composite_long(long, tfidf, ids=z)
    assert df._jdf.queryExecution().optimizedPlan().nodeName() == "Union"
    old = M.composite_long(M.zscores_long(z, ["x"]), tfidf, ids=z).select(*df.columns)
    assert sorted(map(str, df.collect())) == sorted(map(str, old.collect())) and df.count() == 3
    assert M.composite_long(long, tfidf).count() == 3


def test_report_reads_the_call_types_once(spark, sf_small):
    """F16: the report keeps who calls whom and how, not the whole edges."""
    from svcseam.plans import run as R
    from svcseam.plans.extraction import Extraction
    x = Extraction.from_fixtures(spark, sf_small)
    got = R.report_counts(x).filter("metric = 'calls'").agg({"value": "sum"}).collect()[0][0]
    assert "edges" not in vars(x) and x.calls.columns == ["project_id", "from_class", "to_class", "call_type"] and got == x.edges.count()
