"""Vectorised words and shingles over Arrow text columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, with A-Z
lower-cased; in UTF-8 those bytes never occur inside another character, so
bytes and characters give the same words. Words carry a 64-bit hash (a
polynomial over random byte values, then mixed). Work runs in blocks of about
a quarter megabyte, cut at white space, so a very long text needs no more memory
than its list of words.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

BLOCK = 1 << 18
KEPT_POWERS = 1 << 22
SHINGLE = 5
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix64((np.arange(1, n + 1, dtype=_U) + _U(seed << 20)) * _U(0x9E3779B97F4A7C15))


def process_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker. Functions that are shipped by value
    get fresh module globals with every task, so what is costly to load is kept here."""
    return sys.__dict__.setdefault("_svcseam_llm_cache", {}).setdefault(name, {})


def _tables(n: int):
    """Byte tables and the powers of the hash base (and of its inverse) up to n."""
    tables = process_cache("words")
    if "lower" not in tables:
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        space = np.zeros(256, bool)
        space[[32, 9, 10, 11, 12, 13]] = True
        value = constants(256, 1)
        value[65:91] = value[97:123]
        other = np.ones(256, bool)  # everything but ASCII letters and bytes of other characters
        other[65:91] = other[97:123] = other[128:] = False
        tables.update(lower=lower, space=space, other=other, value=value, n=0)
    if tables["n"] < n:
        if n > KEPT_POWERS:  # one huge word: its powers are not kept
            tables = dict(tables)
        base = int(constants(1, 2)[0]) | 1
        inverse = pow(base, -1, 1 << 64)
        for name, b in (("pow", base), ("inv", inverse)):
            p = np.full(n + 1, b, _U)
            p[0] = 1
            tables[name] = np.multiply.accumulate(p)
        tables["n"] = n
    return tables


def string_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array; null counts as empty."""
    a = texts.fill_null("").cast(pa.large_string())
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset:a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return off - off[0], data[off[0]:off[-1]]


def tokens(texts: pa.Array, between: str = "space", prefixes: tuple[int, ...] = ()) -> tuple:
    """(row, start, end, hash, bytes) of all words, in order; start and end are
    places in ``bytes`` (the joined texts). ``between="other"`` takes runs of letters
    (ASCII letters and bytes of other characters) as words. ``prefixes`` adds, per
    length, the hashes of the words' first bytes (0 for words not longer)."""
    off, data = string_buffers(texts)
    t = _tables(BLOCK)
    word = ~t[between][data]
    before = np.empty_like(word)
    before[:1] = False
    before[1:] = word[:-1]
    first = off[:-1]
    before[first[first < len(data)]] = False
    start = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1:] = False
    after[:-1] = word[1:]
    last = off[1:] - 1
    after[last[last >= 0]] = False
    end = np.flatnonzero(word & ~after) + 1
    row = np.searchsorted(off, start, "right") - 1
    hashes = np.empty(len(start), _U)
    heads = [np.zeros(len(start), _U) for _ in prefixes]
    i = 0
    while i < len(start):
        at = start[i]
        j = max(i + 1, int(np.searchsorted(end, at + BLOCK, "right")))
        part = data[at:end[j - 1]]
        t = _tables(len(part))
        sums = np.zeros(len(part) + 1, _U)
        np.cumsum(t["value"][part] * t["pow"][:len(part)], out=sums[1:])
        s, e = start[i:j] - at, end[i:j] - at
        hashes[i:j] = mix64((sums[e] - sums[s]) * t["inv"][s] + (e - s).astype(_U) * _U(0x9E3779B97F4A7C15))
        for k, head in zip(prefixes, heads):
            long = np.flatnonzero(e - s > k)
            at = s[long]
            head[i + long] = mix64((sums[at + k] - sums[at]) * t["inv"][at] + _U(0xA5A5 + k))
        i = j
    return (row, start, end, hashes, data, *heads)


def shingles(row: np.ndarray, word: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``width`` words of a row, sorted by row; a row
    with fewer words has its whole sequence as one; repeats are kept."""
    c = constants(width, 3) | _U(1)
    n = len(word)
    rows, out = [], []
    if n >= width:
        acc = np.zeros(n - width + 1, _U)
        for j in range(width):
            acc = mix64(acc + word[j:n - width + 1 + j] * c[j])
        whole = row[width - 1:] == row[:n - width + 1]
        rows.append(row[:n - width + 1][whole])
        out.append(acc[whole])
    if n:
        ids, first, count = np.unique(row, return_index=True, return_counts=True)
        few = count < width
        ids, first, count = ids[few], first[few], count[few]
        acc = count.astype(_U)
        for j in range(width - 1):
            more = count > j
            acc[more] = mix64(acc[more] + word[first[more] + j] * c[j])
        rows.append(ids)
        out.append(acc)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    r, h = np.concatenate(rows), np.concatenate(out)
    order = np.argsort(r, kind="stable")
    return r[order], h[order]


def bounds(row: np.ndarray, n: int) -> np.ndarray:
    """Places where the rows 0..n-1 of a sorted row column begin, and its end."""
    return np.searchsorted(row, np.arange(n + 1))


def slices(batch: pa.RecordBatch, column: str, most: int = 4 * BLOCK) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of a text column (at least one row each)."""
    if not batch.num_rows:
        return
    off, _ = string_buffers(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


cloudpickle.register_pickle_by_value(sys.modules[__name__])
