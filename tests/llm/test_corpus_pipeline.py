"""The pipeline's stages: what goes, what stays, and that each builds on the last."""

import collections

import corpus_pipeline as P
import numpy as np
import pytest
from svcseam.llm import bpe
from test_llm_operators import SF, documents, frame, reference_components, sets, words


def test_stages_in_order():
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontaminate", "packing"]


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """The documents each stage keeps, written and read like in the pipeline."""
    base, docs, out = tmp_path_factory.mktemp("stages"), documents(spark), []
    for name, stage in P.STAGES:
        stage(spark, docs, SF).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        out.append(docs)
    return out


def test_columns_and_nesting(spark, kept):
    before = {r.doc_id for r in documents(spark).collect()}
    for docs in kept[:4]:
        assert docs.columns == P.COLUMNS
        now = {r.doc_id for r in docs.collect()}
        assert now <= before
        before = now


def test_exact_and_near_stages(spark, kept):
    fold = {c: c + 32 for c in range(65, 91)}
    largest = {}
    for r in kept[0].collect():
        k = r.text.translate(fold)
        largest[k] = max(r.doc_id, largest.get(k, r.doc_id))
    assert sorted(largest.values()) == sorted(r.doc_id for r in kept[1].collect())
    comp, _ = reference_components({r.doc_id: r.text for r in kept[1].collect()})
    assert sorted(r.doc_id for r in kept[2].collect()) == sorted(i for i, c in comp.items() if i == c)


def test_leaks_go_and_the_rest_stays(spark, kept):
    items = [sets(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(words(r.text)) >= 5]
    clean = {r.doc_id for r in kept[2].collect() if not any(100 * len(x & sets(r.text)) >= 75 * len(x) for x in items)}
    assert clean == {r.doc_id for r in kept[3].collect()}


def test_packing_holds_every_token(kept):
    got = collections.Counter()
    for p in kept[4].collect():
        got[p.doc_id] += p.length
    assert got == {r.doc_id: len(bpe.encode(r.text)) + 1 for r in kept[3].collect()}


def test_run_and_odd_rows(spark):
    out = P.run(spark, SF)
    assert out.count() and np.max([r.length for r in out.collect()]) <= 1024
    odd = frame(spark, [(None, "a b c d e f g"), (None, None), (3, ""), (3, ""), (4, None), (5, "x y z u v w"), (5, "x y z u v w")])
    docs = odd
    for _, stage in P.STAGES[:4]:
        docs = stage(spark, docs, SF)
    left = [r.doc_id for r in docs.collect()]
    assert left.count(5) == 1 and 3 not in left and sorted(map(str, left)) == ["4", "5", "None"]  # one empty text stays, of the largest id
    assert [r for r in P.STAGES[4][1](spark, docs.limit(0), SF).collect()] == []


PROSE = [" ".join(f"{w}{i}" for i in range(60)) for w in ("alpha", "beta", "gamma", "delta")]


def after(spark, stage, rows):
    return sorted(((r.doc_id, r.text) for r in dict(P.STAGES)[stage](spark, frame(spark, rows), SF).collect()), key=str)


def test_two_texts_under_one_id_are_decided_each(spark):
    a, b, c, d = PROSE
    assert after(spark, "exact_dedup", [(1, a), (2, a), (1, b), (1, b)]) == [(1, b), (2, a)]
    near = a.replace("alpha30", "other")
    assert after(spark, "near_dedup", [(1, a), (2, near), (2, b), (3, c)]) == [(1, a), (2, b), (3, c)]
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(words(r.text)) >= 12)
    assert after(spark, "decontaminate", [(1, a), (1, f"{b} {item} {c}"), (2, d)]) == [(1, a), (2, d)]


def test_rows_without_id_are_decided_too(spark):
    a, b, c, d = PROSE
    assert after(spark, "exact_dedup", [(None, a), (7, a), (None, b), (None, b)]) == [(7, a), (None, b)]
    assert after(spark, "near_dedup", [(None, a), (9, a.replace("alpha30", "other")), (None, b), (None, b.replace("beta3 ", "other ")), (4, c)])[:2] == [
        (4, c), (9, a.replace("alpha30", "other"))]
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(words(r.text)) >= 12)
    assert after(spark, "decontaminate", [(None, f"{b} {item} {c}"), (None, a), (2, d)]) == [(2, d), (None, a)]


def test_only_the_last_stage_stays_on_disk(spark):
    import os

    from svcseam.session import ensure_checkpoint_dir

    base = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = {f for f in os.listdir(base) if f.startswith("pipeline-")}
    P.run(spark, SF).count()
    new = [f for f in os.listdir(base) if f.startswith("pipeline-") and f not in before]
    assert [os.listdir(f"{base}/{f}") for f in new] == [["4-packing"]]
