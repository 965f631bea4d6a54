"""Token files, hard negatives and the Merkle manifest against brute force, and their edge cases."""

import collections
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from svcseam.llm import elias_fano, hard_negatives, merkle, token_files
from svcseam.llm import queries as Q
from test_llm_operators import SF, documents
from tokenizers import Tokenizer

#: Extra columns carry names that the operators use themselves.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, pos long, hash string, tree string, chunk string, row string, tie string, file string, path string"
LONG = " ".join(f"w{i}" for i in range(30_000)) + "x" * 100_000 + "é\U0001F600"


def frame(spark, rows):
    """rows of (doc_id, text[, lang, source, n_chars])"""
    return spark.createDataFrame([(tuple(r) + (None,) * (5 - len(r))) + (1, "h", "t", "c", "r", "x", "f", "p") for r in rows], DOCS)


ODD = [(3, "One two", "en", "web", 7), (1, None, None, None, None), (2, "", "en", "", 0), (None, "no id", "en", "web", 5), (None, None, None, None, None),
       (3, "One two", "en", "web", 7), (3, "other", "fr", "web", 5), (9, LONG, "en", "web", len(LONG)), (-4, "<|endoftext|> UPPER", "en", "é", 1),
       (2**62, "far", "en", "books", 3)]


# ---------------------------------------------------------------- 11 token files
@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**63), max_size=60), st.integers(0, 3))
def test_elias_fano_round_trip(values, spread):
    v = np.sort(np.array(values * (1 + 400 * (spread == 3)), np.uint64))
    code = elias_fano.encode(v, int(v[-1]) + 1 if len(v) else 1)
    e = elias_fano.EliasFano(code)
    assert (e.range(0, len(v)) == v).all() and [e.select(i) for i in range(0, len(v), 97)] == v[::97].tolist()
    assert (e.range(1, len(v) - 1) == v[1:-1]).all()
    with pytest.raises(IndexError):
        e.select(len(v))


def test_elias_fano_space_and_blocks():
    rng = np.random.default_rng(1)
    v = np.sort(rng.integers(0, 10**9, 150_000, dtype=np.uint64))
    code = elias_fano.encode(v, 10**9)
    assert 8 * len(code) <= len(v) * (np.ceil(np.log2(10**9 / len(v))) + 2.3)
    e = elias_fano.EliasFano(code)
    for a in (0, 1, 511, 512, 65_535, 65_536, 149_990):
        assert (e.range(a, a + 70_000) == v[a:a + 70_000]).all() and e.select(a) == v[a]


def expected_index(rows):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, at = [], 0
    for doc, text in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_token_index_equals_the_library(spark):
    rows = sorted((r.doc_id, r.text) for r in documents(spark).collect())
    assert sorted(map(tuple, Q.op11_token_files(spark, SF).collect())) == expected_index(rows)


def test_token_index_odd_rows_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(token_files, "READ_DOCS", 3)
    monkeypatch.setattr(token_files, "READ_TOKENS", 1000)
    got = sorted(map(tuple, token_files.token_index(frame(spark, ODD)).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, -4, 1, 2, 3, 3, 3, 9, 2**62]
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1]]
    counts = collections.Counter((r[0], *r[2:]) for r in got)
    assert counts == collections.Counter((d, n, c) for d, _, n, c in expected_index([(r[0], r[1]) for r in ODD]))
    assert token_files.token_index(frame(spark, ODD[:0])).collect() == []


def test_files_are_searched_by_document(spark, tmp_path):
    docs = documents(spark)
    files = token_files.write_tokens(docs, str(tmp_path / "set"))
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    seen = 0
    for f in sorted(files.collect(), key=lambda f: f.shard):
        reader = token_files.Reader(f.file)
        assert reader.doc_ids(0, reader.n_docs) == [d for d, _ in rows[seen:seen + reader.n_docs]] and reader.width == 2
        for i in (0, reader.n_docs // 2, reader.n_docs - 1):
            assert reader.document(i).tolist() == t.encode(rows[seen + i][1], add_special_tokens=False).ids + [2]
        seen += reader.n_docs
    assert seen == len(rows)
    token_files.remove(spark, str(tmp_path / "set"))
    assert not (tmp_path / "set").exists()


def test_torn_wide_and_unordered_files_are_refused(tmp_path):
    path = str(tmp_path / "a.eft")
    w = token_files.Writer(path, 2)
    w.add(None, np.array([1, 2], np.uint32))
    w.add(5, np.array([7], np.uint32))
    with pytest.raises(ValueError):
        w.add(4, np.array([1], np.uint32))
    with pytest.raises(ValueError):
        w.add(6, np.array([70_000], np.uint32))
    assert w.close() == (2, 3)
    r = token_files.Reader(path)
    assert r.doc_ids(0, 2) == [None, 5] and r.offsets(0, 2).tolist() == [0, 2, 3] and r.offsets(1, 2).tolist() == [2, 3]
    whole = open(path, "rb").read()
    for torn in (whole[:-9], whole[:20], b"", whole[:8] + whole[10:]):
        (tmp_path / "b.eft").write_bytes(torn)
        with pytest.raises(ValueError):
            token_files.Reader(str(tmp_path / "b.eft"))


# ---------------------------------------------------------------- 12 hard negatives
@settings(max_examples=80, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 4), st.integers(1, 9), st.integers(0, 40), st.sampled_from([0, 1, 3, 256, 2**12, 2**24, 2**31, 2**50]))
def test_packed_products_are_exact(seed, m, n, d, size):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-size, size + 1, (m, d)), rng.integers(-size, size + 1, (n, d))
    got = hard_negatives.packed_scores(a, b)
    assert got.shape == (m, n) and all(int(got[i, j]) == sum(int(x) * int(y) for x, y in zip(a[i], b[j])) for i in range(m) for j in range(n))


def reference_negatives(rows, anchor, k=5, kn=10):
    """rows of (vec_id, label, vector)"""
    good = [(i, v, lab, [int(np.floor(256 * float(x))) for x in vec]) for i, (v, lab, vec) in enumerate(rows)
            if lab is not None and vec is not None and all(x is not None and np.isfinite(x) for x in vec)]
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for i, v, lab, q in good:
        if v is None or not anchor(v):
            continue
        scores = [(sum(x * y for x, y in zip(q, r)), w, la, j) for j, w, la, r in good]
        for p in sorted((s for s in scores if s[2] == lab and s[3] != i), key=key)[:k]:
            hard = sorted((s for s in scores if s[2] != lab and 30 * p[0] <= 100 * s[0] <= 90 * p[0]), key=key)[:kn]
            out += [(v, p[1], n + 1, s[1], p[0], s[0]) for n, s in enumerate(hard)]
    return out


VECTORS = "vec_id long, label int, embedding array<float>, row string, g string, h string, score string, nth string"
ORDER = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def mined(spark, rows, mod=3, schema=VECTORS, **kw):
    v = spark.createDataFrame([(*r, "r", "g", "h", "s", "n") for r in rows], schema)
    return [tuple(r) for r in hard_negatives.hard_negatives(v, F.col("vec_id") % mod == 0, **kw).select(*ORDER).collect()]


def none_last(r):
    return [(x is None, x or 0) for x in r]


@pytest.mark.parametrize("chunk", [7, 4096])
def test_negatives_equal_brute_force_with_ties_and_nulls(spark, monkeypatch, chunk):
    monkeypatch.setattr(hard_negatives, "CHUNK", chunk)
    monkeypatch.setattr(hard_negatives, "STRIP", 5)
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in rng.integers(-2, 5, 4) / 8]) for i in range(90)]
    rows += [rows[3], rows[30], (None, 1, [0.5, 0.5, 0.5, 0.5]), (None, 0, [0.5, 0.5, 0.5, 0.25]), (200, None, [1.0] * 4), (201, 1, None), (202, 1, [1.0, None, 1.0, 1.0]),
             (204, 1, [float("nan"), 1.0, 1.0, 1.0]), (207, 2, [float("inf"), 1.0, 1.0, 1.0]), (210, 2, []), (213, 0, [0.9, 0.9])]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    assert sorted(mined(spark, rows), key=none_last) == sorted(reference_negatives(rows, lambda v: v % 3 == 0), key=none_last)


def test_negatives_in_several_blocks_of_anchors(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_VALUES", 40)
    rng = np.random.default_rng(3)
    rows = [(i, i % 2, [float(x) for x in rng.random(6)]) for i in range(80)]
    assert sorted(mined(spark, rows, 2, positives=2, negatives=3)) == sorted(reference_negatives(rows, lambda v: v % 2 == 0, 2, 3))


def test_wide_components_and_empty_tables(spark):
    wide = VECTORS.replace("float", "double")
    rows = [(0, 1, [2.0**40, 3.0]), (1, 1, [2.0, 5.0]), (2, 0, [1.0, 1.0]), (3, 1, [1.0, 1.0]), (5, 0, [1.25, 0.0])]
    assert sorted(mined(spark, rows, 3, wide)) == sorted(reference_negatives(rows, lambda v: v % 3 == 0))
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [1.0])]) == [] and mined(spark, [(0, 1, [1.0])]) == []
    with pytest.raises(Exception, match="2\\^62"):
        mined(spark, [(0, 1, [1e300])], 3, wide)


# ---------------------------------------------------------------- 13 Merkle manifest
def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r):
    doc, text, lang, source, n = (tuple(r) + (None,) * 5)[:5]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)))


def tree(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(levels, i):
    for nodes in levels[:-1]:
        first = i - i % 16
        yield nodes[first:i], nodes[i + 1:first + 16]
        i //= 16


def reference_manifest(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[(tuple(r) + (None,) * 5)[3]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in by[s]])
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for j, s in enumerate(names):
        for i, r in enumerate(by[s]):
            path = [*siblings(trees[s], i), *siblings(top, j)]
            f = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                f = leaf((r[0], r[1].translate({c: c + 32 for c in range(65, 91)}), *r[2:]))
            for a, b in path:
                f = h(*a, f, *b)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], h(*(x for a, b in path for x in a + b)), f, f == top[-1][0]))
    return out


MANIFEST = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def checked(df):
    return sorted((tuple(r) for r in df.select(*MANIFEST).collect()), key=none_last)


def test_manifest_equals_brute_force(spark):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in documents(spark).collect()]
    assert checked(Q.op13_merkle_manifest(spark, SF)) == sorted(reference_manifest(rows), key=none_last)


@pytest.mark.parametrize("sizes", [(1,), (16,), (17, 1), (257, 3), (300, 273, 16, 15, *[1] * 17)])
def test_manifest_of_trees_of_all_shapes(spark, sizes):
    rows = [(i * 100_000 + j, f"Text {j}", "en", f"s{i}" if i else None, j) for i, n in enumerate(sizes) for j in range(n)]
    got = checked(merkle.verify_manifest(frame(spark, rows)))
    assert got == sorted(reference_manifest(rows), key=none_last)
    assert any(not r[-1] for r in got) or len(rows) < 10


def test_manifest_odd_rows(spark):
    # Equal ids ascend by leaf; equal rows have equal leaves but places of their own.
    assert checked(merkle.verify_manifest(frame(spark, ODD))) == sorted(reference_manifest(ODD), key=none_last)
    assert merkle.verify_manifest(frame(spark, ODD[:0])).collect() == []
    assert merkle.manifest(frame(spark, ODD[:0])).root.collect() == []


def test_manifest_has_sources_and_a_root(spark):
    m = merkle.manifest(frame(spark, ODD))
    ref = reference_manifest(ODD)
    assert [r.root for r in m.root.collect()] == [ref[0][3]]
    by = {r.source: (r.n, r.subroot) for r in m.sources.collect()}
    assert by == {s: (sum((tuple(r) + (None,) * 5)[3] == s for r in ODD), next(x[2] for x in ref if x[1] in {leaf(r) for r in ODD if r[3] == s}))
                  for s in (None, "", "web", "é", "books")}


def test_windows_hold_a_chunk_and_are_spread(spark):
    rows = [(i, "t", "en", "one", 1) for i in range(600)]
    placed = merkle.positions(frame(spark, rows).select(F.lit(":one").alias("tree"), "doc_id", F.sha2("text", 256).alias("hash")), "tree", ["doc_id"])
    per = merkle.siblings(placed).groupBy("tree", "chunk").count().collect()
    assert sorted(r["count"] for r in per) == [88, 256, 256]


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_merkle_manifest"])
def test_sql_is_registered(name):
    assert name in Q.QUERIES and name in Q.ORACLE
