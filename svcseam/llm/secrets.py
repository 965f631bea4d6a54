"""Secret scans over a trigram inverted index.

Every rule is a regular expression. From its parse tree a Boolean query over trigrams
is derived that holds for every text the rule can match (literal parts give trigrams
that must occur, alternatives give unions). Texts are indexed in shards of a few
megabytes: for the trigrams that any rule asks for, the sorted list of the shard's
texts that contain it. A rule's query intersects and unites these postings; only the
texts left are verified with the regular expression. Rules without mandatory trigrams
scan all texts. One pass, no shuffle; a shard's index lives as long as its texts."""

from __future__ import annotations

import re
import re._parser as parser
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import _tables, slices, string_buffers

SCHEMA = "doc_id long, spans array<struct<kind:string, start:bigint, end:bigint>>"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``; those whose ``group`` has fewer
    than ``least`` characters are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    ignore_case: bool = False

    @property
    def flags(self) -> int:
        return re.ASCII | (re.IGNORECASE if self.ignore_case else 0)


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Public formats of keys and tokens beyond the base rules.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("url_login", r"://[A-Za-z0-9_.-]+:[^\x00-\x20:/@]+@"),
)
RULES = BASE_RULES + MORE_RULES


def trigram_query(rule: Rule):
    """None (no constraint), a trigram (3 lower-case bytes), or ("and" | "or", [queries])."""
    return _walk(parser.parse(rule.pattern, rule.flags))


def _all(parts):
    parts = [p for p in parts if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def _any(parts):
    parts = list(parts)
    return None if any(p is None for p in parts) else parts[0] if len(parts) == 1 else ("or", parts)


def _grams(strings):
    """The query that one of the strings occurs."""
    if any(len(s) < 3 for s in strings):
        return None
    return _any(_all(sorted({s[i:i + 3] for i in range(len(s) - 2)})) for s in sorted(strings))


def _exact(items) -> set[bytes] | None:
    """All strings a sequence matches in lower case, if they are few."""
    out = {b""}
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            part = {chr(arg).lower().encode()}
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= 8:
            part = {chr(a).lower().encode() for _, a in arg}
        elif name == "SUBPATTERN":
            part = _exact(arg[3])
        elif name == "BRANCH":
            each = [_exact(b) for b in arg[1]]
            part = None if any(e is None for e in each) else set().union(*each)
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] <= 3:
            one = _exact(arg[2])
            part = None if one is None else set()
            for n in range(arg[0], arg[1] + 1) if one is not None else ():
                reps = {b""}
                for _ in range(n):
                    reps = {r + o for r in reps for o in one}
                part |= reps
        else:
            part = None
        if part is None:
            return None
        out = {a + b for a in out for b in part}
        if len(out) > 64:
            return None
    return out


def _walk(items):
    parts, run = [], {b""}

    def close():
        nonlocal run
        parts.append(_grams(run))
        run = {b""}

    for op, arg in items:
        name = str(op)
        part = _exact([(op, arg)])
        if part is not None and len(run) * len(part) <= 64:
            run = {a + b for a in run for b in part}
            continue
        close()
        if name == "SUBPATTERN":
            parts.append(_walk(arg[3]))
        elif name == "BRANCH":
            parts.append(_any(_walk(b) for b in arg[1]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
            parts.append(_walk(arg[2]))
    close()
    return _all(parts)


def _trigrams(query) -> set[bytes]:
    if query is None:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(_trigrams, query[1]))


def index(texts: pa.Array, wanted: list[bytes]) -> dict[bytes, np.ndarray]:
    """Postings of the wanted trigrams: the sorted rows of the shard that contain them."""
    if not wanted:
        return {}
    off, data = string_buffers(texts)
    b = _tables(1)["lower"][data].astype(np.uint32)
    if len(b) < 3:
        return {t: np.zeros(0, np.int64) for t in wanted}
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    number = np.full(1 << 24, 255, np.uint8)
    for i, t in enumerate(wanted):
        number[int.from_bytes(t, "big")] = i
    of = number[code]
    at = np.flatnonzero(of != 255)
    row = np.searchsorted(off, at, "right") - 1
    at, row = of[at][at + 2 < off[row + 1]], row[at + 2 < off[row + 1]]
    pair = np.unique(at.astype(np.int64) * len(texts) + row)
    cut = np.searchsorted(pair, np.arange(len(wanted) + 1) * len(texts))
    return {t: pair[cut[i]:cut[i + 1]] - i * len(texts) for i, t in enumerate(wanted)}


def matching_rows(query, postings: dict[bytes, np.ndarray]) -> np.ndarray:
    if isinstance(query, bytes):
        return postings[query]
    rows = [matching_rows(q, postings) for q in query[1]]
    out = rows[0]
    for r in rows[1:]:
        out = np.intersect1d(out, r, assume_unique=True) if query[0] == "and" else np.union1d(out, r)
    return out


def _scan(rules: tuple[Rule, ...]):
    queries = [trigram_query(r) for r in rules]
    wanted = sorted(set().union(*map(_trigrams, queries)))
    assert len(wanted) < 255

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(r.pattern, r.flags) for r in rules]
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").fill_null("").to_pylist()
                postings = index(part.column("text"), wanted)
                found: list[list] = [[] for _ in texts]
                for k, (rule, pattern, query) in enumerate(zip(rules, compiled, queries)):
                    rows = range(len(texts)) if query is None else matching_rows(query, postings)
                    g, least = rule.group, rule.least
                    for i in rows:
                        for m in pattern.finditer(texts[i]):
                            if m.end(g) - m.start(g) >= least:
                                found[i].append((m.start(), k, m.end()))
                spans = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in sorted(f)] for f in found]
                yield pa.record_batch([part.column("doc_id"), pa.array(spans, pa.list_(pa.struct(
                    [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "spans"])

    return run


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans) per row of ``docs`` (doc_id, text; further columns are ignored):
    spans (kind, start, end) in code points, end exclusive, sorted by start and then in
    the order of the rules. Null and empty texts have none; every row is scanned for
    itself, repeated or without doc_id too; an empty table gives an empty result."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan(rules), SCHEMA)


def with_digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, the digest of the base spans and all spans as a string."""
    base = [r.kind for r in BASE_RULES]

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count_of(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count_of, base), F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
                        joined("spans").alias("spans"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
