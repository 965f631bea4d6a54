"""The training-data operators against brute force, and their edge cases."""

import collections
import hashlib
import json
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from svcseam.llm import (bpe, components, containment, exact_dup, language_id, line_dedup, maxent_lm, near_dup, packing, secrets,
                         token_counts, toxicity)
from svcseam.llm import queries as Q
from svcseam.llm.words import shingles, tokens

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))


def sets(text):
    w = words(text)
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def frame(spark, rows):
    """rows of (doc_id, text[, lang])"""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else None, None, None, "x") for r in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, an extra column."""
    prose = "one two three four five six seven eight nine ten eleven twelve"
    long = " ".join(f"w{i}" for i in range(60_000)) + "\n" + "x" * 200_000
    rows = [(1, prose, "en"), (2, prose.upper(), "en"), (3, None, "en"), (4, "", None), (None, prose, "en"), (None, None, None),
            (5, long, "en"), (5, long, "en"), (6, "   \n\t ", "en"), (7, "a b", "en"), (8, "a  B\n", "en"),
            (9, "password: hunter22 " + "0123456789abcdef" * 2, "en"), (10, "é\U0001F600 token='abcdefg' AKIA" + "Z" * 16, "fr")]
    return frame(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def reference_components(texts):
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    inverted = collections.defaultdict(list)
    full = {i: sets(t) for i, t in texts.items()}
    for i, s in full.items():
        for x in s:
            inverted[x].append(i)
    shared = collections.Counter((a, b) for ids in inverted.values() for k, a in enumerate(ids) for b in ids[:k])
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(full[a]) + len(full[b]) - n):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {i: find(i) for i in texts}, full


# ---------------------------------------------------------------- words, components
def test_words_and_shingles_equal_plain_python():
    texts = ["", None, "One two\tthree\x0bFOUR five six", "a", "Été x " * 3, " lead", "x" * 3_000_000 + " y"]
    row, start, end, h, data = tokens(pa.array(texts))
    got = collections.defaultdict(list)
    for r, s, e in zip(row, start, end):
        got[r].append(data[s:e].tobytes().decode().translate(UPPER))
    assert all(got[i] == words(t) for i, t in enumerate(texts))
    r, s = shingles(row, h)
    assert [len(set(s[r == i])) for i in range(len(texts))] == [len(sets(t)) for t in texts]


def test_components(spark):
    random.seed(3)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, None), (9, 9)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}
    for u, v in edges:
        if v is not None and u != v:
            for x in (u, v):
                parent.setdefault(x, {x})
            if parent[u] is not parent[v]:
                parent[u] |= parent[v]
                for x in parent[v]:
                    parent[x] = parent[u]
    assert got == {x: min(c) for x, c in parent.items()}


# ---------------------------------------------------------------- 1 toxicity
def test_toxicity_learns_stems_and_ignores_the_other_columns(spark):
    random.seed(1)
    rows, labels = [], []
    for i in range(900):
        w = [random.choice(["ba", "lo", "mi", "ter"]) + random.choice(["n", "sk", "ra"]) + str(random.randrange(9)) for _ in range(40)]
        toxic = i % 6 == 0
        if toxic:
            w[3:3], w[9:9] = [f"zorg{random.choice('abcdef')}"], [f"zorg{random.choice('ghij')}"]
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.toxicity(frame(spark, rows), lab).collect()
    truth = dict(labels)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    again = frame(spark, [(i + 5000, t) for i, t in rows])  # a score depends on the text alone
    model = toxicity.fit(frame(spark, rows), lab)
    a, b = ({r.doc_id: r.s for r in d.select("doc_id", toxicity.toxicity_score(model, F.col("text")).alias("s")).collect()}
            for d in (frame(spark, rows), again))
    assert all(a[i] == b[i + 5000] for i in a)


def test_label_model_recovers_voter_accuracy_and_discounts_copies():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    good = [(rng.random(4000) < np.where(y, 0.8, 0.05)) for _ in range(4)]
    bad = rng.random(4000) < 0.5
    votes = np.stack(good + [bad, bad], axis=1).astype(np.uint8)  # the last voter copies the one before
    label = np.where(rng.random(4000) < 0.3, y.astype(int), -1)
    q, parent, table = toxicity.label_model(votes, label)
    assert ((q > 0.5) == y).mean() > 0.97
    assert parent[5] == 4 or parent[4] == 5


# ---------------------------------------------------------------- 2 near duplicates
def test_near_duplicates_equal_brute_force(spark):
    got = {r.doc_id: r for r in Q.op2_near_duplicates(spark, SF).collect()}
    comp, full = reference_components({r.doc_id: r.text for r in documents(spark).select("doc_id", "text").collect()})
    assert {i: r.component_id for i, r in got.items()} == comp
    assert all(r.n_shingles == len(full[i]) and r.kept == (i == r.component_id) for i, r in got.items())


def test_near_duplicates_in_a_large_family(spark, monkeypatch):
    """One base with many copies at all distances: pivots, families and blocks."""
    random.seed(5)
    base = [f"b{i}" for i in range(140)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(random.randrange(0, 9)):
            w[random.randrange(len(w))] = f"e{random.randrange(30)}"
        rows.append((1000 - i, " ".join(w)))
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 5000)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(frame(spark, rows)).collect()}
    assert got == reference_components(dict(rows))[0]


def test_repeated_rows_are_one_document(spark):
    """Two near copies a hundred times each: one link, not a hundred million rows."""
    a = " ".join(f"r{i}" for i in range(80))
    b = a.replace("r40", "other")
    rows = [(1, a)] * 100 + [(2, b)] * 100 + [(3, " ".join(f"s{i}" for i in range(50)))] * 3
    out = near_dup.near_duplicates(frame(spark, rows)).collect()
    assert len(out) == 203 and {(r.doc_id, r.component_id, r.n_shingles) for r in out} == {(1, 1, 76), (2, 1, 76), (3, 3, 46)}


def test_family_blocks_are_bounded_in_rows(spark, monkeypatch):
    random.seed(6)
    base = [f"b{i}" for i in range(40)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(random.randrange(0, 4)):
            w[random.randrange(len(w))] = f"e{random.randrange(9)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(near_dup, "BLOCK_DOCS", 20)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(frame(spark, rows)).collect()}
    assert got == reference_components(dict(rows))[0]


def test_bayes_bounds():
    need = near_dup.least_matches(0.75, 1e-6)
    assert need == sorted(need) and 0 <= need[0] < 16 and need[-1] < 96  # mean at the threshold is 96 of 128
    assert near_dup.least_matches(0.75, 0.5)[-1] > need[-1]


# ---------------------------------------------------------------- 3 language id
def test_language_id_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in documents(spark).collect()}
    out = Q.op3_language_id(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_forward_sums_all_segmentations():
    lattice = language_id.Lattice()
    all_pieces = language_id.pieces()
    place = {p: i for i, p in enumerate(all_pieces)}
    p = np.random.default_rng(1).random((len(all_pieces), 2)) / 100
    text = "the nation was été"
    row, word, matrix, size, _ = language_id._words(pa.array([text]))
    got = language_id._forward(lattice, p, matrix, size)
    for w in text.split():
        b = b" " + w.encode()
        ways = [np.ones(2)] + [np.zeros(2) for _ in b]
        for e in range(1, len(b) + 1):
            for s in range(max(0, e - language_id.PIECE_BYTES), e):
                if b[s:e] in place:
                    ways[e] = ways[e] + ways[s] * p[place[b[s:e]]]
        i = next(i for i in range(len(matrix)) if matrix[i, :size[i]].tobytes() == b)
        assert np.allclose(got[i], np.log(ways[-1]))
    total = np.zeros_like(p)
    language_id._expected(lattice, p, matrix, size, np.ones((len(matrix), 2)), total)
    lengths = np.array([len(x) for x in all_pieces])
    assert np.allclose((total * lengths[:, None]).sum(axis=0), size.sum())  # expected pieces cover the words


# ---------------------------------------------------------------- 4 secrets
BASE = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile(r"[0-9a-f]+"), 0, 24)]


def base_spans(text):
    s = sorted((m.start(), i, m.end()) for i, (_, p, g, n) in enumerate(BASE) for m in p.finditer(text or "") if len(m.group(g)) >= n)
    return ",".join(f"{BASE[i][0]}:{a}:{b}" for a, i, b in s)


def test_secrets_equal_plain_search(spark, odd):
    for docs in (documents(spark), odd):
        out = secrets.with_digest(secrets.find_secrets(docs)).collect()
        texts = [(r.doc_id, r.text) for r in docs.collect()]
        want = collections.Counter((i, hashlib.sha256(base_spans(t).encode()).hexdigest()) for i, t in texts)
        assert collections.Counter((r.doc_id, r.base_sha256) for r in out) == want


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="paswdorPASWDORtokenTOKEN_keyAPI \"'=:0123456789abcdefKZKſ-.+/ghx", max_size=80), st.integers(0, 3))
def test_trigram_queries_lose_no_match(text, pad):
    text = " " * pad + text + " token=abcdef1 AKIA" + "Q" * 17 + " ghp_" + "a" * 36
    shard = pa.array(["nothing here", text, "passwor d"])
    for rule in secrets.RULES:
        query = secrets.trigram_query(rule)
        if query is not None and re.search(rule.pattern, text, rule.flags):
            assert 1 in secrets.matching_rows(query, secrets.index(shard, sorted(secrets._trigrams(query))))
    assert secrets.trigram_query(secrets.BASE_RULES[2]) is None


# ---------------------------------------------------------------- 5 exact duplicates
def test_cuckoo_filter_inserts_deletes_and_grows():
    f, live = exact_dup.CuckooFilter(2), {}
    random.seed(2)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for k in keys:
        assert f.find(k) < 0
        live[k] = f.insert(k)
    assert f.n > 2 and all(f.slot_key[f.find(k)] == n for k, n in live.items())
    for k in keys[::3]:
        assert f.delete(k) == live.pop(k) and f.delete(k) == -1
    assert all((f.find(k) >= 0) == (k in live) for k in keys)
    fp, a, b = f._places(keys[1])
    assert f._other(a, fp) == b and f._other(b, fp) == a


def test_index_update_and_delete(spark):
    rows = exact_dup.digests(frame(spark, [(i, f"text {i % 40}") for i in range(400)]))
    index = exact_dup.update(None, rows, 3)
    more = exact_dup.digests(frame(spark, [(i, f"TEXT {i % 50}") for i in range(1000, 1100)]))
    gone = exact_dup.digests(frame(spark, [(0, "text 7")]))
    index = exact_dup.update(index, more, 3, deletes=gone)
    got = {(r.keep_id, r.group_size) for r in exact_dup.entries(index).collect()}
    want = {(max(1000 + k % 50 + 50 * j for j in (0, 1)), (10 if k < 40 and k != 7 else 0) + 2) for k in range(50)}
    assert got == want


def test_exact_duplicates_edge_cases(odd):
    out = exact_dup.exact_duplicates(odd).collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    assert len(out) == 13 and by[1][0].keep_id == 2 and not by[1][0].kept and by[2][0].group_size == 3
    assert {r.keep_id for r in by[3] + by[4]} == {4} and by[4][0].group_size == 3 and not any(r.kept for r in by[None])


# ---------------------------------------------------------------- 6 language model
def test_lm_counts_base_scores_and_gain(spark):
    out = Q.op6_lm_scores(spark, SF).collect()
    text = {r.doc_id: words(r.text) + [None] for r in documents(spark).collect()}
    train = [i for i in text if zlib.crc32(str(i).encode()) % 5 != 1]
    c = collections.Counter(x for i in train for x in text[i])
    n, v = sum(c.values()), len(c)
    for r in out:
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in text[r.doc_id])
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.train_tokens == n
        assert (r.n_tokens, r.n_known) == (len(text[r.doc_id]), sum(c[x] > 0 for x in text[r.doc_id]))
    assert sum(r.score for r in out if r.held_out) > sum(r.base_score for r in out if r.held_out)


def test_lm_is_a_distribution():
    w = np.random.default_rng(0).normal(size=(maxent_lm.ROWS, maxent_lm.CLASSES)).astype(np.float32)
    rows, place, word, tail = maxent_lm._sequence(pa.array(["a b c d", None, "x"]))
    cls = maxent_lm.Classes(word[:2]).of(word, tail)
    assert list(rows) == [0] * 5 + [1] + [2] * 2 and list(place) == [0, 1, 2, 3, 4, 0, 0, 1] and cls[4] == cls[5] == cls[7] == 0
    at = maxent_lm._features(word, cls, place)
    for scale in (1, 40):  # also where exp would leave its range
        p = np.stack([np.exp(maxent_lm._log_prob(w * scale, at, np.full(len(at), c))) for c in range(maxent_lm.CLASSES)])
        assert np.allclose(p.sum(axis=0), 1, atol=1e-4)


def test_lm_gradient_steps_raise_the_likelihood():
    rng = np.random.default_rng(3)
    cls = rng.integers(0, 5, 6000)
    at = np.stack([1 + np.roll(cls, 1) + 10 * j for j in range(maxent_lm.FEATURES)], axis=1).astype(np.int32)
    cls = np.where(rng.random(6000) < 0.9, (np.roll(cls, 1) * 3 + 1) % 5, cls)
    w, sq, seen = np.zeros((maxent_lm.ROWS, maxent_lm.CLASSES), np.float32), np.full(maxent_lm.ROWS, 0.1, np.float32), np.zeros(maxent_lm.ROWS, np.int64)
    before = maxent_lm._log_prob(w, at, cls).mean()
    for _ in range(5):
        maxent_lm._gradient_steps(w, sq, seen, at, cls)
    assert maxent_lm._log_prob(w, at, cls).mean() > before + 2 and seen[0] == 30_000
    g = rng.normal(size=(200, 7)).astype(np.float32)
    first = np.array([0, 1, 4, 12, 21, 150])
    n = np.diff(np.r_[first, 200])
    assert np.allclose(maxent_lm._sum_rows(g, first, n), np.add.reduceat(g, first, axis=0), atol=1e-4)


def test_lm_learns_from_every_training_document(spark):
    texts = [f"a{i} b{i} c{i}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    w = maxent_lm.train(docs, np.zeros(0, np.uint64), np.ones(maxent_lm.CLASSES))
    _, place, word, tail = maxent_lm._sequence(pa.array(texts))
    at = maxent_lm._features(word, maxent_lm.Classes(np.zeros(0, np.uint64)).of(word, tail), place)
    assert w[at].any(axis=2).all()


# ---------------------------------------------------------------- 7 packing
def test_packing_round_trip(spark, odd):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    for docs in (documents(spark), odd):
        texts = [(r.doc_id, r.text) for r in docs.collect()]
        pieces = packing.pack(docs.repartition(2)).collect()
        by_seq = collections.defaultdict(list)
        for p in pieces:
            by_seq[p.sequence_id].append(p)
        for s in by_seq.values():
            at = 0
            for p in sorted(s, key=lambda p: p.offset):
                assert p.offset == at and p.length == len(p.ids) // 4 > 0
                at += p.length
            assert at <= packing.WINDOW
        want = collections.Counter()
        for i, text in texts:
            want[(i, tuple(t.encode(text or "", add_special_tokens=False).ids + [0]))] += 1
        if len(texts) == len({i for i, _ in texts}):
            got = collections.defaultdict(list)
            for p in sorted(pieces, key=lambda p: p.start):
                assert p.start == len(got[p.doc_id])
                got[p.doc_id] += np.frombuffer(bytes(p.ids), "<u4").tolist()
            assert {(i, tuple(x)): 1 for i, x in got.items()} == dict(want)
        assert sum(p.length for p in pieces) == sum(len(k[1]) * n for k, n in want.items())
    total = sum(p.length for p in packing.pack(documents(spark).coalesce(1)).collect())
    assert total > 0.97 * packing.WINDOW * len({p.sequence_id for p in packing.pack(documents(spark).coalesce(1)).collect()})


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 256), min_size=1, max_size=120))
def test_differencing(sizes):
    window = packing.split_block(sizes)
    sums = np.bincount(window, weights=sizes)
    assert sums.max() <= packing.WINDOW and len(window) == len(sizes)


def test_differencing_balances():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 257, 900).tolist()
    window, most = packing.differencing(sizes, 120)
    assert most - np.bincount(window, weights=sizes, minlength=120).min() <= 16  # of about 990


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x2FF, exclude_categories=("Cs",)), max_size=60))
def test_fast_ids_equal_the_library(text):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    if "t" not in _T:
        _T["t"] = Tokenizer.from_file(path("byte_bpe_50k.json"))
    assert bpe.encode(text).tolist() == _T["t"].encode(text, add_special_tokens=False).ids


_T: dict = {}


def test_special_token_text():
    assert bpe.END_OF_TEXT in bpe.encode("a <|endoftext|> b") and bpe.END_OF_TEXT not in bpe.encode("a <|endoftext|> b", special=False)


# ---------------------------------------------------------------- 8 token counts
def test_token_counts(spark, odd):
    for docs in (documents(spark), odd):
        want = collections.Counter((r.doc_id, len(bpe.encode(r.text or "", False))) for r in docs.collect())
        for size in (97, token_counts.BLOCK_TOKENS):
            got = token_counts.token_counts(docs.repartition(3), block_tokens=size).collect()
            assert collections.Counter((r.doc_id, r.n_tokens) for r in got) == want


def test_separator_scan_stitches_blocks(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "GROUP_BLOCKS", 3)
    rng = np.random.default_rng(7)
    blocks, want = [], []
    for stream in range(3):
        ids = np.where(rng.random(500) < 0.04, 9, rng.integers(10, 99, 500)).astype("<u2")
        ends = np.flatnonzero(ids == 9)
        starts = np.r_[0, ends + 1]
        want += [(stream, k, int(s), int(e - s), True) for k, (s, e) in enumerate(zip(starts, ends))]
        if starts[-1] < 500:
            want.append((stream, len(ends), int(starts[-1]), int(500 - starts[-1]), False))
        cut = np.sort(rng.choice(500, 24, replace=False))
        blocks += [(stream, b, bytearray(x.tobytes())) for b, x in enumerate(np.split(ids, cut))]
    got = token_counts.separator_scan(spark.createDataFrame(blocks, "stream long, block long, tokens binary"), separator=9).collect()
    assert sorted(map(tuple, got)) == sorted(want)


# ---------------------------------------------------------------- 9 leaks
def test_leaks_partial_and_planted(spark):
    random.seed(8)
    items = [(k, " ".join(f"q{k}x{i}" for i in range(n))) for k, n in enumerate([12, 40, 90, 4, 0])] + [(None, "a b c d e f")]
    items.append((50, None))
    filler = [f"f{i}" for i in range(3000)]

    def hide(item, share):
        w = item.split()
        n = math.ceil(len(w) * share)
        return " ".join(filler[:700] + w[:n] + filler[700:1500])

    docs = [(1, hide(items[0][1], 1)), (2, hide(items[1][1].upper(), 0.8)), (3, hide(items[2][1], 0.7)), (4, " ".join(filler)), (5, items[3][1]),
            (6, None), (7, ""), (None, items[0][1]), (8, items[1][1]), (8, items[2][1])]
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, source string")
    got = {(r.doc_id, r.item_id): (r.item_shingles, r.shared) for r in containment.contained_items(frame(spark, docs), bench).collect()}
    want = {}
    for d, t in docs:
        for k, x in items:
            if d is None or k is None or len(words(x)) < 5:
                continue
            both = len(sets(x) & frozenset().union(*[sets(t2) for d2, t2 in docs if d2 == d]))
            if 100 * both >= 75 * len(sets(x)):
                want[(d, k)] = (len(sets(x)), both)
    assert got == want and (2, 1) in want and (3, 2) not in want


# ---------------------------------------------------------------- 10 line runs
def brute_lines(docs, least):
    """doc_id -> places deleted, by comparing every pair of places."""
    seq = [(d, [(i, x) for i, x in enumerate((t or "").split("\n")) if words(x)]) for d, t in sorted(docs, key=lambda r: r[0])]
    gone = collections.defaultdict(set)
    for a, (da, la) in enumerate(seq):
        for b in range(a + 1):
            lb = seq[b][1]
            for shift in range(-len(lb) + 1, len(la)):
                if a == b and shift <= 0:
                    continue
                run = []
                for i in range(max(0, shift), min(len(la), len(lb) + shift) + 1):
                    if i < min(len(la), len(lb) + shift) and la[i][1] == lb[i - shift][1]:
                        run.append(i)
                        continue
                    if sum(len(words(la[j][1])) for j in run) >= least:
                        gone[da] |= {la[j][0] for j in run}
                    run = []
    return gone


def test_line_runs_equal_brute_force(spark):
    random.seed(9)
    pool = [" ".join(f"l{k}" for _ in range(random.randrange(1, 6))) for k in range(14)] + ["", "  "]
    docs = [(i, "\n".join(random.choice(pool) for _ in range(random.randrange(0, 40)))) for i in range(25)]
    docs.append((99, docs[3][1]))
    for least in (3, 8, 20):
        got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, docs), least).collect()}
        want = brute_lines(docs, least)
        for d, t in docs:
            lines = t.split("\n")
            assert got[d].text == ("\n".join(x for i, x in enumerate(lines) if i not in want[d]) if want[d] else t)
            assert (got[d].n_lines, got[d].n_deleted) == (len(lines), len(want[d]))


# ---------------------------------------------------------------- all operators
def _operators(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (1, 0)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, "three four five six seven eight nine"), (None, None)], "item_id long, text string")
    return {"toxicity": lambda d: toxicity.toxicity(d, labels), "near": near_dup.near_duplicates, "lang": language_id.language_id,
            "secrets": secrets.find_secrets, "exact": exact_dup.exact_duplicates, "lm": maxent_lm.lm_scores, "pack": packing.pack,
            "counts": token_counts.token_counts, "leaks": lambda d: containment.contained_items(d, bench), "lines": line_dedup.dedup_lines}


@pytest.mark.parametrize("name", ["toxicity", "near", "lang", "secrets", "exact", "lm", "pack", "counts", "leaks", "lines"])
def test_empty_and_odd_tables(spark, odd, none, name):
    op = _operators(spark)[name]
    assert op(none).collect() == []
    rows = op(odd).collect()
    n = odd.count()
    if name not in ("pack", "leaks"):
        assert len(rows) == n
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    if name == "near":
        assert [r.component_id for r in by[2]] == [1] and by[None][0].kept and by[3][0].n_shingles == 0 and by[8][0].component_id == 7
    if name == "lang":
        assert {r.lang_pred for i in (3, 4, 6) for r in by[i]} == {"und"}
    if name == "leaks":
        assert {(r.doc_id, r.item_id) for r in rows} == {(1, 1), (2, 1)}
    if name == "lm":
        assert by[3][0].n_tokens == 1 and by[5][0].n_tokens == 60_002
    if name == "lines":
        assert by[3][0].text is None and by[3][0].n_lines == 1


# ---------------------------------------------------------------- registered queries
@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = Q.QUERIES[name](spark, SF).toPandas()
    want = con.sql(Q.ORACLE[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert got.equals(want.astype(got.dtypes.to_dict()))


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in Q.QUERIES) == list(range(1, 14))
    assert json.dumps(sorted(Q.ORACLE)) and os.path.exists(SF)


def test_toxicity_fit_makes_no_dense_table_of_all_rows():
    """The pipeline's driver memory: the fit's tables are dense for a block of rows only, and the sums over blocks agree."""
    import tracemalloc

    rng = np.random.default_rng(1)
    true = rng.random(40_000) < 0.1
    votes = (rng.random((40_000, 128)) < np.where(true[:, None], 0.2, 0.02)).astype(np.uint8)
    label = np.where(rng.random(len(true)) < 0.5, true, -1).astype(int)
    r, f = np.nonzero(np.c_[votes, votes, votes])
    tracemalloc.start()
    q, parent, _ = toxicity.label_model(votes, label)
    w, b = toxicity._logistic(r, f, q, 384)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 60  # 197 MB before
    block, toxicity.FIT_BLOCK = toxicity.FIT_BLOCK, len(true)
    try:
        q1, parent1, _ = toxicity.label_model(votes, label)
        w1, b1 = toxicity._logistic(r, f, q, 384)
    finally:
        toxicity.FIT_BLOCK = block
    assert (parent == parent1).all() and np.abs(q - q1).max() < 1e-5 and np.abs(w - w1).max() < 1e-4 and abs(b - b1) < 1e-4
