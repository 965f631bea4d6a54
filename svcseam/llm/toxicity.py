"""Toxicity by weak supervision.

* **Voters** fire (1) or abstain (0) on a text. Lexicon voters are stems: whole
  words and 4-, 5- and 6-byte word beginnings whose presence marks toxic labels in
  the training rows, and a small seed lexicon. Pattern voters look at symbols,
  shouting, repeated stems and at whether any lexicon stem occurs at all.
* **Label model**: a generative model of the votes given a hidden label. Votes depend
  on the label and on one other vote (the maximum spanning tree over conditional
  mutual information), so that correlated voters such as a stem and its longer form
  don't count twice. EM estimates accuracies and correlations; the given label
  is one more, fallible, voter. It yields a posterior label for every training row,
  those without a given label too.
* **Classifier**: ridge logistic regression on the fired voters and stems, fitted to
  the posterior labels. Texts are scored in the tasks, in one pass without a shuffle.

The fit uses at most ``fit_rows`` labelled and as many unlabelled training rows
(those with the smallest hashed ids); everything else covers all rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import fold, kept
from .words import bounds, slices, string_buffers, tokens

FIT_ROWS = 20_000
#: The fit's dense tables are made for this many rows at a time; they lie in the driver.
FIT_BLOCK = 4096
STEMS, VOTERS = 400, 120
PREFIXES = (4, 5, 6)
SUPPORT, MIN_Z = 3, 4.0
#: Seed lexicon: plain English insults.
SEED = ("idiot idiots moron morons stupid dumb loser losers trash scum clown worthless pathetic disgusting "
        "filthy vermin bastard jerk imbecile retard").split()
PATTERNS = ["no_stem", "two_stems", "three_stems", "seed", "two_seeds", "symbols", "shouting", "no_letters"]


def _seed_hashes() -> np.ndarray:
    return np.sort(tokens(pa.array([" ".join(SEED)]), "other")[3])


def _stems(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, stem hash) of all stems of the texts, and the rows of whole words only."""
    row, _, _, word, _, *heads = tokens(texts, "other", PREFIXES)
    rows, stems = [row], [word]
    for h in heads:
        has = h != 0
        rows.append(row[has])
        stems.append(h[has])
    return np.concatenate(rows), np.concatenate(stems), row


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            label = part.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            row, stem, _ = _stems(part.column("text"))
            order = np.lexsort((row, stem))
            row, stem = row[order], stem[order]
            new = np.ones(len(stem), bool)
            new[1:] = (stem[1:] != stem[:-1]) | (row[1:] != row[:-1])
            row, stem = row[new], stem[new]
            first = np.flatnonzero(np.r_[True, stem[1:] != stem[:-1]]) if len(stem) else np.zeros(0, np.int64)
            toxic = np.add.reduceat(label[row], first) if len(stem) else first
            n = np.diff(np.r_[first, len(stem)])
            yield pa.record_batch([pa.array(stem[first].view(np.int64)), pa.array(toxic), pa.array(n - toxic)], ["stem", "pos", "neg"])


def _fired(texts: pa.Array, stems: np.ndarray, seeds: np.ndarray, voters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of what fires: features below len(stems) are stems (sorted
    hashes), then come the patterns. ``voters`` marks the stems of the lexicon."""
    n, s = len(texts), len(stems)
    row, stem, wrow = _stems(texts)

    def among(values, of):
        at = np.minimum(np.searchsorted(values, of), max(len(values) - 1, 0))
        return (values[at] == of, at) if len(values) else (np.zeros(len(of), bool), at)

    hit, at = among(stems, stem)
    pair = np.unique(row[hit].astype(np.int64) * max(s, 1) + at[hit])
    r, f = pair // max(s, 1), pair % max(s, 1)
    lexicon = voters[f] if s else np.zeros(0, bool)
    n_stems = np.bincount(r[lexicon], minlength=n)
    seeded, sat = among(seeds, stem)
    n_seed = np.bincount(np.unique(row[seeded].astype(np.int64) * len(seeds) + sat[seeded]) // len(seeds), minlength=n)
    off, data = string_buffers(texts)
    size = np.maximum(np.diff(off), 1)
    kind = np.zeros(256, np.uint8)
    kind[65:91] = 1
    for c in b"#$%&*@!^~":
        kind[c] = 2
    k = kind[data]
    of = np.repeat(np.arange(n), np.diff(off))
    upper = np.bincount(of[k == 1], minlength=n) / size
    symbol = np.bincount(of[k == 2], minlength=n) / size
    words = np.bincount(wrow, minlength=n)
    flags = [n_stems == 0, n_stems >= 2, n_stems >= 3, n_seed >= 1, n_seed >= 2, symbol > 0.05, upper > 0.3, words == 0]
    for i, flag in enumerate(flags):
        at = np.flatnonzero(flag)
        r, f = np.r_[r, at], np.r_[f, np.full(len(at), s + i)]
    return r, f


@dataclass
class Model:
    """A fitted classifier, with what the label model estimated of the voters."""

    stems: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    voters: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(PATTERNS)))
    bias: float = 0.0
    accuracy: dict = field(default_factory=dict)
    correlation: dict = field(default_factory=dict)

    def score(self, texts: pa.Array) -> np.ndarray:
        r, f = _fired(texts, self.stems, _seed_hashes(), self.voters)
        z = self.bias + np.bincount(r, weights=self.weights[f], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def label_model(votes: np.ndarray, label: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior, parent, table): EM over 0/1 ``votes`` (rows x voters) with a hidden
    label; ``label`` is the given label or -1. table[v, y, u] = P(vote v | label y, vote
    of its parent u). The given label enters as a voter whose error is estimated."""
    n, m = votes.shape
    blocks = [slice(i, i + FIT_BLOCK) for i in range(0, n, FIT_BLOCK)]
    base = float(label[label >= 0].mean()) if (label >= 0).any() else 0.1
    # Unlabelled rows begin at their label-like votes' mean.
    known = label >= 0
    q = np.where(known, np.where(label == 1, 0.95, 0.02), base)
    if known.any() and not known.all():
        p1, p0 = ((_blockwise(lambda b: votes[b][label[b] == k].astype(np.float32).sum(0), blocks) + 0.5) / ((label == k).sum() + 1) for k in (1, 0))
        z = np.concatenate([_prior_odds(votes[b].astype(np.float32), p1, p0) for b in blocks])
        z = np.log(base / (1 - base) if 0 < base < 1 else 0.1) + z / np.sqrt(m)
        q = np.where(known, q, 1 / (1 + np.exp(-np.clip(z, -30, 30))))
    parent, error = np.full(m, -1), (0.05, 0.02)
    table = np.zeros((m, 2, 2))
    for step in range(rounds):
        w = np.stack([1 - q, q])
        total = w.sum(1) + 1e-9
        both = _blockwise(lambda b: _joint(votes[b].astype(np.float32), w[:, b]), blocks)
        if step < 4:
            parent = _tree(both, total)
        one = np.array([np.diag(both[y]) for y in (0, 1)])
        for v in range(m):
            for y in (0, 1):
                if parent[v] < 0:
                    table[v, y] = (one[y, v] + 0.5) / (total[y] + 1)
                else:
                    u = parent[v]
                    with_u, joint = one[y, u], both[y, v, u]
                    p = (one[y, v] + 0.5) / (total[y] + 1)  # smoothed towards the vote's own rate
                    table[v, y, 1] = (joint + 2 * p) / (with_u + 2)
                    table[v, y, 0] = (one[y, v] - joint + 2 * p) / (total[y] - with_u + 2)
        prior = np.clip(total[1] / n, 1e-4, 1 - 1e-4)
        if known.any():
            error = tuple(np.clip((w[y][known & (label != y)].sum() + 1) / (w[y][known].sum() + 20), 0.001, 0.3) for y in (0, 1))
        ll = np.concatenate([_likelihood(votes[b], parent, table) for b in blocks], axis=1) if n else np.zeros((2, 0))
        for y in (0, 1):
            ll[y] += np.where(known, np.log(np.where(label == y, 1 - error[y], error[y])), 0)
        z = np.log(prior / (1 - prior)) + ll[1] - ll[0]
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return q, parent, table


def _blockwise(part, blocks: list[slice]):
    """The sum of ``part`` over blocks of rows; never are all rows dense at once."""
    total = part(blocks[0])
    total = total.astype(float) if len(blocks) > 1 else total
    for b in blocks[1:]:
        total += part(b)
    return total


def _prior_odds(x: np.ndarray, p1: np.ndarray, p0: np.ndarray) -> np.ndarray:
    return x @ np.log(p1 / p0) + (1 - x) @ np.log((1 - p1) / (1 - p0))


def _joint(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For each label: how often two votes fire together, weighted by the label's posterior."""
    return np.stack([(x * w[y][:, None].astype(np.float32)).T @ x for y in (0, 1)]).astype(float)


def _likelihood(votes: np.ndarray, parent: np.ndarray, table: np.ndarray) -> np.ndarray:
    of = np.where(parent[None, :] >= 0, votes[:, np.maximum(parent, 0)], 0)
    ll = np.zeros((2, len(votes)))
    for y in (0, 1):
        p = np.clip(table[np.arange(len(parent))[None, :], y, of], 1e-5, 1 - 1e-5)
        ll[y] = np.where(votes == 1, np.log(p), np.log(1 - p)).sum(1)
    return ll


def _tree(both: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Parents in the maximum spanning tree over mutual information given the label."""
    m = both.shape[1]
    info = np.zeros((m, m))
    for y in (0, 1):
        p11 = (both[y] + 0.25) / (total[y] + 1)
        p = (np.diag(both[y]) + 0.5) / (total[y] + 1)
        p10, p01 = np.maximum(p[:, None] - p11, 1e-9), np.maximum(p[None, :] - p11, 1e-9)
        p00 = np.maximum(1 - p11 - p10 - p01, 1e-9)
        a, b = p[:, None], p[None, :]
        info += total[y] / total.sum() * (p11 * np.log(p11 / (a * b)) + p10 * np.log(p10 / (a * (1 - b)))
                                          + p01 * np.log(p01 / ((1 - a) * b)) + p00 * np.log(p00 / ((1 - a) * (1 - b))))
    parent, best, of = np.full(m, -1), info[0].copy(), np.zeros(m, int)
    done = np.zeros(m, bool)
    done[:1] = True
    for _ in range(m - 1):
        v = int(np.argmax(np.where(done, -np.inf, best)))
        parent[v], done[v] = of[v], True
        closer = info[v] > best
        best, of = np.where(closer, info[v], best), np.where(closer, v, of)
    return parent


def _logistic(r: np.ndarray, f: np.ndarray, y: np.ndarray, width: int, ridge: float = 1.0, steps: int = 25):
    order = np.argsort(r, kind="stable")
    r, f = r[order], f[order]
    starts = range(0, len(y), FIT_BLOCK)
    cut = np.searchsorted(r, [*starts, len(y)])
    blocks = [(i, slice(cut[j], cut[j + 1])) for j, i in enumerate(starts)]
    w = np.zeros(width + 1)
    penalty = np.full(width + 1, ridge)
    penalty[width] = 1e-3

    def step(block):
        """Gradient and Hessian of a block of rows, side by side."""
        i, own = block
        of = y[i:i + FIT_BLOCK]
        x = np.zeros((len(of), width + 1), np.float32)
        x[r[own] - i, f[own]] = 1
        x[:, width] = 1
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30)))
        s = np.maximum(p * (1 - p), 1e-4).astype(np.float32)
        return np.c_[x.T @ (p - of).astype(np.float32), (x * s[:, None]).T @ x]

    for _ in range(steps):
        both = _blockwise(step, blocks)
        g, h = both[:, 0] + penalty * w, both[:, 1:] + np.diag(penalty)
        d = np.linalg.solve(h.astype(float), g)
        w -= d
        if np.abs(d).max() < 1e-4:
            break
    return w[:width], float(w[width])


def fit(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, fit_rows: int = FIT_ROWS) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), on rows where
    ``held_out`` is false. Null labels and ids are left out; a document with several
    labels counts as toxic if one says so. Without any label the seed lexicon alone
    gives the training signal."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    if held_out is not None:
        base = base.where(~held_out)
    given = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    # One document of each distinct text; the chosen ids (at most 2 * fit_rows) are broadcast
    # to the scans, so no text is shuffled or stored.
    ids = base.select("doc_id", F.xxhash64("text").alias("th")).join(given, "doc_id", "left")
    first = F.min(F.struct(F.xxhash64("doc_id").alias("h"), "doc_id"))
    texts = ids.groupBy("th").agg(first.alias("first"), F.max("toxic").alias("toxic")).select("first.*", "toxic")
    chosen_of = [part.orderBy("h", "doc_id").limit(fit_rows).select("doc_id", "toxic")
                 for part in (texts.where("toxic is not null"), texts.where("toxic is null"))]
    chosen = kept(chosen_of[0].union(chosen_of[1]))
    sample = base.join(F.broadcast(chosen), "doc_id")
    labelled = sample.where("toxic is not null")
    n_pos, n_neg = (chosen.where("toxic is not null")
                    .agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*") - F.coalesce(F.sum("toxic"), F.lit(0))).first())
    stems, voters = np.zeros(0, np.uint64), np.zeros(0, bool)
    if n_pos and n_neg:
        rate1, rate0 = (F.col("pos") + 0.5) / (n_pos + 1.0), (F.col("neg") + 0.5) / (n_neg + 1.0)
        pooled = (F.col("pos") + F.col("neg") + 1.0) / (n_pos + n_neg + 2.0)
        z = (rate1 - rate0) / F.sqrt(pooled * (1 - F.least(pooled, F.lit(0.999))) * (1.0 / n_pos + 1.0 / n_neg))
        top = (labelled.select("text", "toxic").mapInArrow(_stem_counts, "stem long, pos long, neg long")
               .groupBy("stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
               .where((F.col("pos") >= SUPPORT) & (rate1 > 4 * rate0)).withColumn("z", z).where(F.col("z") >= MIN_Z)
               .orderBy(F.desc("z"), "stem").limit(STEMS).collect())
        found = np.array([t.stem for t in top], np.int64).view(np.uint64)
        rank = np.argsort(found)
        stems, voters = found[rank], (np.arange(len(found)) < VOTERS)[rank]
    s, seeds = len(stems), _seed_hashes()

    def fired(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                r, f = _fired(part.column("text"), stems, seeds, voters)
                order = np.argsort(r, kind="stable")
                b = bounds(r[order], part.num_rows)
                f = f[order]
                yield pa.record_batch([part.column("doc_id"), part.column("toxic"),
                                       pa.array([f[b[i]:b[i + 1]] for i in range(part.num_rows)], pa.list_(pa.int64()))],
                                      ["doc_id", "toxic", "fired"])

    rows = sample.select("doc_id", "text", "toxic").mapInArrow(fired, "doc_id long, toxic int, fired array<bigint>").orderBy("doc_id").toArrow()
    if not rows.num_rows:
        return Model(bias=-2.0)
    lists = rows.column("fired").combine_chunks()
    f = lists.flatten().to_numpy()
    r = np.repeat(np.arange(rows.num_rows), np.diff(lists.offsets.to_numpy()))
    label = rows.column("toxic").fill_null(-1).to_numpy()
    use = np.r_[np.flatnonzero(voters), s + np.arange(len(PATTERNS))]
    place = np.full(s + len(PATTERNS), -1)
    place[use] = np.arange(len(use))
    votes = np.zeros((rows.num_rows, len(use)), np.uint8)
    votes[r[place[f] >= 0], place[f][place[f] >= 0]] = 1
    if (label < 0).all():  # no label at all: two seed words stand for one
        label = np.where(votes[:, place[s + PATTERNS.index("two_seeds")]] == 1, 1, label)
    q, parent, table = label_model(votes, label)
    weights, bias = _logistic(r, f, q, s + len(PATTERNS))
    names = {int(j): (PATTERNS[u - s] if u >= s else f"stem:{int(stems[u]):x}") for j, u in enumerate(use)}
    hits = votes.sum(0)
    accuracy = {names[j]: float(q[votes[:, j] == 1].mean()) for j in range(len(use)) if hits[j]}
    correlation = {(names[j], names[int(parent[j])]): float(table[j, 1, 1] - table[j, 1, 0]) for j in range(len(use)) if parent[j] >= 0}
    return Model(stems, voters, weights, bias, accuracy, correlation)


def toxicity_score(model: Model, text: Column) -> Column:
    """Probability that a text is toxic; null and empty texts get the score of a text
    without words. One pass, no shuffle, other columns untouched."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        batch = pa.record_batch([texts.cast(pa.string())], ["text"])
        parts = [model.score(p.column("text")) for p in slices(batch, "text")]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score(text.cast("string"))


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``.

    Learns only from rows whose crc32(doc_id as text) mod 5 is not 0; score depends on
    the text alone. Null and empty texts are scored as texts without words, repeated
    rows alike, further columns are ignored. A null doc_id is never learnt from and
    gives held_out null. Empty tables give an empty result."""
    held_out = fold(F.col("doc_id"), 5) == 0
    model = fit(docs, labels, held_out, fit_rows)
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), toxicity_score(model, F.col("text")).alias("score"))
            .select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
