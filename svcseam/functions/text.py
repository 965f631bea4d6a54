"""Column expressions shared by the operators.

All of these are built-in Spark SQL expressions, so they stay inside
whole-stage code generation; none of them is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules

# Characters Java's String.trim() removes: every code point up to U+0020.
_JAVA_TRIM = r"^[\x00-\x20]+|[\x00-\x20]+$"


def java_trim(c: Column) -> Column:
    """``String.trim()`` semantics (Spark's ``trim`` only strips spaces)."""
    return F.regexp_replace(c, _JAVA_TRIM, "")


def http_method(line: Column) -> Column:
    return F.regexp_extract(line, rules.HTTP_PATTERN, 1)


def http_endpoint(line: Column) -> Column:
    return F.regexp_extract(line, rules.HTTP_PATTERN, 2)


def sql_operation(line: Column) -> Column:
    return F.upper(F.regexp_extract(line, rules.SQL_PATTERN, 1))


def sql_table(line: Column) -> Column:
    """Word after the first FROM/INTO/SET (quirk K1: ``UPDATE t SET c`` gives ``c``)."""
    return F.lower(F.regexp_extract(line, rules.SQL_PATTERN, 3))


def sql_table_fixed(line: Column) -> Column:
    """K1 fixed: for UPDATE, the word right after UPDATE."""
    upd = F.lower(F.regexp_extract(line, r"(?i)update\s+(\w+)", 1))
    return F.when(F.lower(F.regexp_extract(line, rules.SQL_PATTERN, 1)) == "update", upd).otherwise(sql_table(line))


def resource_of(endpoint: Column) -> Column:
    """First path segment with the query string cut; '' for ``/``, ``/?``, ``//`` (K2)."""
    return F.regexp_extract(endpoint, r"^/?([^/?]*)", 1)


def first_rule(value: Column, rules_list: Sequence[tuple[str, Sequence[str]]], default: str,
               test=lambda v, kw: v.contains(kw)) -> Column:
    """Ordered ``when`` chain: the label of the first rule with a matching keyword."""
    expr = None
    for label, keywords in rules_list:
        cond = None
        for kw in keywords:
            t = test(value, F.lit(kw))
            cond = t if cond is None else (cond | t)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))


def table_domain(table: Column, rules_list=rules.TABLE_DOMAIN_RULES, default=rules.TABLE_DOMAIN_DEFAULT) -> Column:
    return first_rule(table, rules_list, default)


def class_domain(cls: Column, rules_list=rules.CLASS_DOMAIN_RULES, default=rules.CLASS_DOMAIN_DEFAULT) -> Column:
    return first_rule(F.lower(cls), rules_list, default)


def stereotype(cls: Column, rules_list=rules.STEREOTYPE_RULES, default=rules.STEREOTYPE_DEFAULT) -> Column:
    return first_rule(cls, rules_list, default, test=lambda v, kw: v.endswith(kw))


def stereotype_rank(st: Column, ranks=rules.STEREOTYPE_RANK, default=rules.STEREOTYPE_RANK_DEFAULT) -> Column:
    expr = None
    for label, r in ranks:
        expr = F.when(st == label, F.lit(r)) if expr is None else expr.when(st == label, F.lit(r))
    return expr.otherwise(F.lit(default))


def table_stem(cls: Column, removals: Sequence[str] = rules.TABLE_STEM_REMOVALS) -> Column:
    """Lower-case class name with each Spring word removed anywhere, in order."""
    out = F.lower(cls)
    for w in removals:
        out = F.replace(out, F.lit(w), F.lit(""))
    return out


def suffix_flag(cls: Column, *suffixes: str) -> Column:
    cond = None
    for s in suffixes:
        t = cls.endswith(s)
        cond = t if cond is None else (cond | t)
    return cond.cast("int")


def camel_tokens(cls: Column, stop_words: Sequence[str] = rules.CAMEL_STOP_WORDS) -> Column:
    """CamelCase split: a space before every ``[A-Z][a-z]+``, split on white
    space, drop stop words (case-sensitive), lower-case; if nothing is left,
    the lower-case name as the only token string."""
    spaced = F.regexp_replace(cls, r"([A-Z][a-z]+)", " $1")
    parts = F.filter(F.split(java_trim(spaced), r"\s+"), lambda p: p != "")
    stop = F.array(*[F.lit(w) for w in stop_words])
    kept = F.filter(parts, lambda p: ~F.array_contains(stop, p))
    joined = F.array_join(F.transform(kept, lambda p: F.lower(p)), " ")
    return F.when(F.size(kept) > 0, joined).otherwise(F.lower(cls))


# Word tokens of the TF-IDF analyzer: two or more word characters.
WORD_TOKEN = r"(?U)\b\w\w+\b"
# Unicode-letter tokens used on free text (agrees between Spark and DuckDB).
TEXT_TOKEN = r"[\p{L}\p{N}_]{2,}"


def word_tokens(text: Column, pattern: str = TEXT_TOKEN) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), 0)
