"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public byte-level vocabulary made of lower-case letters
(and bytes of other characters), with or without a leading space, and all single bytes.
Every language has its own piece probabilities; the probability of a word is the sum
over all its segmentations into pieces of the product of their probabilities, computed
by a forward pass over the word. A text's score sums its words' log probabilities.

Probabilities are learnt by EM: a forward-backward pass in the tasks gives expected piece
counts per language, summed by Spark. The fit uses at most ``fit_rows`` labelled training
rows (smallest hashed ids); scoring covers all texts, in one pass without a shuffle. Equal
words of a batch are computed once."""

from __future__ import annotations

import base64
import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import fold, kept
from .words import _tables, constants, process_cache, slices, tokens

VOCABULARY = "byte_bpe_50k"
FIT_ROWS = 20_000
ITERATIONS = 3
PIECE_BYTES, WORD_BYTES = 12, 32
CACHE_WORDS = 400_000
UNKNOWN = "und"


def pieces(vocabulary: str = VOCABULARY) -> list[bytes]:
    """The pieces in a fixed order: single bytes first, then the vocabulary's."""
    import public_tokenizers

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
        known = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    letters = set(range(97, 123)) | set(range(128, 256))
    return [bytes([b]) for b in range(256)] + sorted(
        p for p in known if 2 <= len(p) <= PIECE_BYTES and set(p[1:]) <= letters and (p[0] == 32 or p[0] in letters))


class Lattice:
    """Looks up the pieces that end at each place of many words at once."""

    def __init__(self, vocabulary: str = VOCABULARY):
        base = int(constants(1, 21)[0]) | 1
        n = WORD_BYTES + 2
        self.value = constants(256, 22)
        self.pow = np.array([pow(base, i, 1 << 64) for i in range(n)], np.uint64)
        self.inv = np.array([pow(pow(base, -1, 1 << 64), i, 1 << 64) for i in range(n)], np.uint64)
        self.tables = {}
        by_length: dict[int, list[tuple[int, bytes]]] = {}
        all_pieces = pieces(vocabulary)
        self.n_pieces = len(all_pieces)
        for i, p in enumerate(all_pieces):
            by_length.setdefault(len(p), []).append((i, p))
        for length, group in by_length.items():
            b = np.frombuffer(b"".join(p for _, p in group), np.uint8).reshape(-1, length)
            h = (self.value[b] * self.pow[:length]).sum(axis=1, dtype=np.uint64)
            order = np.argsort(h)
            self.tables[length] = h[order], np.array([i for i, _ in group])[order]

    def arcs(self, words: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(end, length, rows, piece) for all pieces inside the words, by end. ``words``
        holds one word a row, longest first, padded to WORD_BYTES + 1."""
        sums = np.zeros((len(words), words.shape[1] + 1), np.uint64)
        np.cumsum(self.value[words] * self.pow[:words.shape[1]], axis=1, out=sums[:, 1:])
        for end in range(1, int(size[0]) + 1 if len(size) else 0):
            n = int(np.searchsorted(-size, -end, "right"))
            for length in range(1, min(end, PIECE_BYTES) + 1):
                if length not in self.tables:
                    continue
                known, ids = self.tables[length]
                h = (sums[:n, end] - sums[:n, end - length]) * self.inv[end - length]
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                rows = np.flatnonzero(known[at] == h)
                if len(rows):
                    yield end, length, rows, ids[at[rows]]


def _lattice(vocabulary: str) -> Lattice:
    cache = process_cache("lattice")
    if vocabulary not in cache:
        cache[vocabulary] = Lattice(vocabulary)
    return cache[vocabulary]


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, number of the distinct word) of all words, and the distinct words longest
    first: (bytes, sizes, hashes). Letter runs longer than WORD_BYTES count as several words."""
    row, start, end, word, data, *_ = tokens(texts, "other")
    long = np.flatnonzero(end - start > WORD_BYTES)
    if len(long):
        more_row, more_start, more_end = [], [], []
        for i in long:
            cuts = np.arange(start[i], end[i], WORD_BYTES)
            more_row.append(np.full(len(cuts), row[i]))
            more_start.append(cuts)
            more_end.append(np.minimum(cuts + WORD_BYTES, end[i]))
        keep = np.ones(len(row), bool)
        keep[long] = False
        s, e = np.concatenate(more_start), np.concatenate(more_end)
        lower = _tables(1)["lower"]
        h = np.array([int.from_bytes(hashlib.blake2b(lower[data[a:b]].tobytes(), digest_size=8).digest(), "little")
                      for a, b in zip(s, e)], np.uint64)
        row, start, end, word = (np.concatenate(x) for x in ((row[keep], *more_row), (start[keep], s), (end[keep], e), (word[keep], h)))
        order = np.argsort(row, kind="stable")
        row, start, end, word = row[order], start[order], end[order], word[order]
    hashes, first, number = np.unique(word, return_index=True, return_inverse=True)
    size = (end - start)[first]
    order = np.argsort(-size, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    first, size = first[order], size[order]
    out = np.zeros((len(order), WORD_BYTES + 1), np.uint8)
    out[:, 0] = 32
    lower = _tables(1)["lower"]
    for j in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -(j + 1), "right"))
        out[:n, j + 1] = lower[data[start[first[:n]] + j]]
    return row, place[number], out, size + 1, hashes[order]


def _forward(lattice: Lattice, p: np.ndarray, words: np.ndarray, size: np.ndarray) -> np.ndarray:
    """log probability of each word in each language; p is pieces x languages."""
    alpha = np.zeros((words.shape[1] + 1, len(words), p.shape[1]))
    alpha[0] = 1
    for end, length, rows, piece in lattice.arcs(words, size):
        alpha[end, rows] += alpha[end - length, rows] * p[piece]
    return np.log(np.maximum(alpha[size, np.arange(len(words))], 1e-300))


def _expected(lattice: Lattice, p: np.ndarray, words: np.ndarray, size: np.ndarray, count: np.ndarray, into: np.ndarray) -> None:
    """Adds the expected piece counts of the words (count: words x languages)."""
    width = words.shape[1] + 1
    alpha = np.zeros((width, len(words), p.shape[1]))
    alpha[0] = 1
    arcs = []
    for arc in lattice.arcs(words, size):
        end, length, rows, piece = arc
        alpha[end, rows] += alpha[end - length, rows] * p[piece]
        arcs.append(arc)
    beta = np.zeros_like(alpha)
    total = alpha[size, np.arange(len(words))]
    beta[size, np.arange(len(words))] = 1
    scale = count / np.maximum(total, 1e-300)
    for end, length, rows, piece in reversed(arcs):
        flow = p[piece] * beta[end, rows]
        beta[end - length, rows] += flow
        flow *= alpha[end - length, rows] * scale[rows]
        for k in range(p.shape[1]):
            into[:, k] += np.bincount(piece, weights=flow[:, k], minlength=len(into))


def _counting(languages: list[str], p: np.ndarray, vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, total = _lattice(vocabulary), np.zeros(p.shape)
        number = {lang: i for i, lang in enumerate(languages)}
        for batch in batches:
            for part in slices(batch, "text", 1 << 21):
                lang = np.array([number[x] for x in part.column("lang").to_pylist()])
                row, word, words, size, _ = _words(part.column("text"))
                count = np.bincount(word * len(languages) + lang[row], minlength=len(words) * len(languages))
                step = max(500, 80_000 // len(languages))
                for i in range(0, len(words), step):
                    cut = slice(i, i + step)
                    _expected(lattice, p, words[cut], size[cut], count.reshape(-1, len(languages))[cut].astype(float), total)
        piece, k = np.nonzero(total)
        yield pa.record_batch([pa.array(piece, pa.int64()), pa.array(k, pa.int64()), pa.array(total[piece, k])], ["piece", "k", "n"])

    return run


class Model:
    """Languages, their log priors and piece probabilities (pieces x languages)."""

    def __init__(self, languages: list[str], prior: np.ndarray, p: np.ndarray, vocabulary: str):
        self.languages, self.prior, self.p, self.vocabulary = languages, prior, p, vocabulary


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS, iterations: int = ITERATIONS, vocabulary: str = VOCABULARY) -> Model | None:
    """A model from the rows of ``docs`` (doc_id, text, lang) with text, id and lang; None without any."""
    base = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
            .where("doc_id is not null and lang is not null and text is not null"))
    chosen = kept(base.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows))
    sample = kept(base.join(F.broadcast(chosen), "doc_id").select("text", "lang"))  # at most fit_rows ids
    parallel = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sample = sample.repartition(max(parallel, 1))
    shares = {r.lang: r.n for r in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not shares:
        return None
    languages = sorted(shares)
    n = np.array([shares[lang] for lang in languages], float)
    p = np.full((len(pieces(vocabulary)), len(languages)), 1.0 / len(pieces(vocabulary)))
    for _ in range(iterations):
        got = (sample.mapInArrow(_counting(languages, p, vocabulary), "piece long, k long, n double")
               .groupBy("piece", "k").agg(F.sum("n").alias("n")).toArrow())
        count = np.full(p.shape, 0.05)
        count[got.column("piece").to_numpy(), got.column("k").to_numpy()] += got.column("n").to_numpy()
        p = count / count.sum(axis=0)
    return Model(languages, np.log(n / n.sum()), p, vocabulary)


def _scoring(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, languages = _lattice(model.vocabulary), len(model.languages)
        seen, values = np.zeros(0, np.uint64), np.zeros((0, languages))
        for batch in batches:
            for part in slices(batch, "text"):
                row, word, words, size, hashes = _words(part.column("text"))
                log_p = np.zeros((len(words), languages))
                at = np.minimum(np.searchsorted(seen, hashes), max(len(seen) - 1, 0))
                known = seen[at] == hashes if len(seen) else np.zeros(len(hashes), bool)
                log_p[known] = values[at[known]]
                new = np.flatnonzero(~known)
                step = max(500, 80_000 // languages)
                for i in range(0, len(new), step):
                    cut = new[i:i + step]
                    log_p[cut] = _forward(lattice, model.p, words[cut], size[cut])
                if len(seen) < CACHE_WORDS and len(new):
                    seen, values = np.concatenate([seen, hashes[new]]), np.concatenate([values, log_p[new]])
                    order = np.argsort(seen)
                    seen, values = seen[order], values[order]
                n = part.num_rows
                total = np.stack([np.bincount(row, weights=log_p[word, k], minlength=n) for k in range(languages)], axis=1) + model.prior
                best = total.argmax(axis=1)
                score = 1 / np.exp(total - total[np.arange(n), best][:, None]).sum(axis=1)
                lettered = part.column("lettered").to_numpy(zero_copy_only=False)
                yield pa.record_batch([part.column("doc_id"), part.column("held_out"),
                                       pa.array([model.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)], pa.string()),
                                       pa.array(np.where(lettered, score, 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def languages_of(docs: DataFrame, model: Model | None, held_out: Column) -> DataFrame:
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.lower(text).alias("text"),
                       F.coalesce(text.rlike("\\p{L}"), F.lit(False)).alias("lettered"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(_scoring(model), "doc_id long, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of ``docs`` (doc_id, text, lang; further
    columns are ignored).

    Learns only from rows with text and lang whose crc32(doc_id as text) mod 4 is not 2; a
    prediction depends on the text alone. score is the posterior of lang_pred. A text that
    is null or has no letter is ``und`` with score 0, as is every text when nothing can be
    learnt. Rows with null doc_id are never learnt from (held_out null); repeated rows are
    scored alike; an empty table gives an empty result."""
    held_out = fold(F.col("doc_id"), 4) == 2
    model = fit(docs.where(~held_out), fit_rows)
    return languages_of(docs, model, held_out)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
