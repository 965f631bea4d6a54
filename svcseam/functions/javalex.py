"""Lexical helpers for Java text.

``scan_column`` is the only Python in the call-edge job: one linear pass over a
file's tokens with a stack of open brackets, which finds where expressions begin and end.
Owners, the filters, injected fields, packages and error files are DataFrame expressions
over what it finds (``operators.calls``). Comments and literals are tokens of their own,
so nothing in them is taken for code and positions are those of the text.
"""

from __future__ import annotations

import bisect
import re
from itertools import accumulate
from operator import lt

import pyarrow as pa
from pyspark.sql import functions as F

# Python workers receive this module's functions by value, so executors need
# no installed copy of the package (also when the job is started elsewhere).
import sys as _sys  # noqa: E402

from pyspark import cloudpickle as _cloudpickle  # noqa: E402

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

_LEXEME = re.compile(
    r'"""[\s\S]*?"""'            # text block
    r'|"(?:[^"\\\n]|\\.)*"'       # string literal
    r"|'(?:[^'\\\n]|\\.)*'"       # char literal
    r"|//[^\n]*"                  # line comment
    r"|/\*[\s\S]*?\*/"            # block comment
)


def _blank(m: re.Match) -> str:
    s = m.group(0)
    if s.startswith('"') or s.startswith("'"):
        q = '"' if s.startswith('"') else "'"
        inner = s[1:-1] if not s.startswith('"""') else s[3:-3]
        width = 1 if not s.startswith('"""') else 3
        return q * width + re.sub(r"[^\n]", " ", inner) + q * width
    return re.sub(r"[^\n]", " ", s)


def blank_text(text: str | None) -> str | None:
    if text is None:
        return None
    return _LEXEME.sub(_blank, text)


# A name with the names after its dots, a dot with such names, empty brackets, a literal, an open comment, or one other
# character, with the space after it (comments are space by then). An operator takes along the operands and operators
# that follow it up to the last that can neither begin, end nor belong to a scope.
_OPERATOR = r"(?:[-+*%=,:?!&|^~]|/(?![/*]))"
_NAME = r"[A-Za-z_$\u0080-￿][\w$]*+"
_DOTTED = rf"\.\s*+(?!new(?![\w$])){_NAME}"
_WORD = rf"new(?![\w$])|{_NAME}(?:\s*+{_DOTTED})*+|{_DOTTED}(?:\s*+{_DOTTED})*+|\(\s*+\)|[.(){{}}@<>\[\]]"
_REST = rf"{_LEXEME.pattern}|/\*|\S"
_TOKEN = re.compile(rf"(?:{_WORD}|(?:;|{_OPERATOR})(?:\s*+(?!new\b)[\w$]++\s*+{_OPERATOR})*+|{_REST})\s*+")
# Where an operator follows ``new`` or ``@`` (no Java), each is a token of its own.
_SINGLE = re.compile(rf"(?:{_WORD}|{_REST})\s*+")
_NO_JAVA = {begin: re.compile(rf"{begin}\s*+[-+*%=,:?!&|^~/;]") for begin in ("new", "@")}  # searched by the literal
_LITERAL = re.compile(r"""(\"{3}[\s\S]*?\"{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')""")
_SPACE = re.compile(r"\s+")
_TIGHT = re.compile(r" (?=[.()])|(?<=[.()]) ")
_PLAIN = re.compile(r"[A-Za-z_$]")
_CLOSES = {")": "(", "]": "[", "}": "{"}
_TYPE_WORDS = frozenset(["class", "interface"])
# Words that may stand before ``(`` or ``.`` without being a call or a value.
_NOT_VALUES = frozenset("if while for switch catch synchronized try return throw assert case do else yield instanceof "
                        "import package extends implements throws".split())
_MODIFIERS = frozenset("private protected public static final transient volatile".split())


def _tidy(text: str) -> str:
    """Spacing normalised, except inside literals."""
    if not _SPACE.search(text):
        return text
    if '"' not in text and "'" not in text:
        return _TIGHT.sub("", " ".join(text.split()))
    parts = _LITERAL.split(text.strip())
    parts[::2] = [_TIGHT.sub("", _SPACE.sub(" ", p)) for p in parts[::2]]
    return "".join(parts)


def _spaced_comment(m: re.Match) -> str:
    s = m.group(0)
    return s if s[0] != "/" else " " * len(s) if s[1] == "/" else re.sub(r"[^\n]", " ", s)


def _skip_angles(words: list, i: int) -> int:
    """The index after a balanced ``<...>`` that begins at i."""
    depth = 0
    while i < len(words) - 1:
        t = words[i]
        depth += (t == "<") - (t == ">")
        i += 1
        if depth == 0:
            break
        if t[0] in "({;":
            return i - 1
    return i


def _qualified(words: list, i: int) -> int:
    """The index after a dotted name that begins at i."""
    i += 1
    while i < len(words) and words[i][:1] == "." and len(words[i]) > 1:
        i += 1
    return i


def _annotated_field(words: list, begins: list, i: int, text: str):
    """A field declaration that begins with annotations at i: (index after it, type,
    name, written names of its annotations); None if what follows them is no field."""
    written, n = [], len(words) - 1
    while i + 1 < n and (words[i] == "@" or words[i] in _MODIFIERS):
        if words[i] in _MODIFIERS:
            i += 1
            continue
        j = _qualified(words, i + 1)
        written.append(_tidy(text[begins[i + 1]:begins[j - 1] + len(words[j - 1])]))
        if words[j] == "(":
            depth = 0
            while j < n:
                depth += (words[j] == "(") - (words[j] == ")")
                j += 1
                if depth == 0:
                    break
        elif words[j][:1] == "(":
            j += 1
        i = j
    if i >= n or not words[i][0].isalpha() and words[i][0] not in "_$":
        return None
    j = _qualified(words, i)
    if j < n and words[j] == "<":
        j = _skip_angles(words, j)
    while j + 1 < n and words[j] == "[" and words[j + 1] == "]":
        j += 2
    if j + 1 >= n or not _PLAIN.match(words[j]) or "." in words[j] or words[j + 1][0] not in "=;,":
        return None
    return j + 1, _tidy(text[begins[i]:begins[j - 1] + len(words[j - 1])]), words[j], written


def scan_java(text: str) -> tuple[bool, list[tuple]]:
    """(well formed?, sites) of one file; a site is (kind, name, target, annotations, begin,
    parent, link): ``type`` declarations, ``call`` (target = source text of its scope) and
    annotated ``field`` (target = its type), in the order of their names. ``begin`` is where
    the site's whole expression begins; ``parent`` is the place among the sites of the call
    whose arguments it stands in (-1: none) and ``link`` its number in its chain of calls.

    One pass over the tokens with a stack of open brackets: ``value`` is the expression just
    read (begin, end, links), so that any ``.name(`` after it is a call with that expression
    as scope, over lines and at any nesting. A file whose brackets don't balance or
    whose last comment or quote is open is not well formed."""
    code = _LEXEME.sub(_spaced_comment, text) if "//" in text or "/*" in text else text
    no_java = any(begin in code and p.search(code) for begin, p in _NO_JAVA.items())
    spaced = (_SINGLE if no_java else _TOKEN).findall(code)
    begins = list(accumulate(map(len, spaced), initial=len(code) - len(code.lstrip())))
    words = list(map(str.rstrip, spaced))
    if "/*" in code and "/*" in words:
        return False, []  # an open comment
    n = len(words)
    words.append("")
    sites: list[tuple] = []
    stack: list[tuple] = []  # (bracket, begin of the value it ends, or -1, of a ``new``?, links, call it belongs to)
    inside = -1  # the call whose arguments are read
    value, dotted, good = None, False, True
    body = -1  # where a body may follow a ``new`` that was just read
    i = 0
    while i < n:
        t = words[i]
        first = t[0]
        if first == ";":
            value, dotted = None, False
        elif first.isalpha() or first in "_$" or first > "\x7f" or first == "." and len(t) > 1:
            begin, after = begins[i], words[i + 1]
            if t == "new":
                start, links = (value[0], value[2]) if dotted and value else (begin, 0)
                j = i + 1
                while j < n and words[j] == "@":
                    j = _qualified(words, j + 1)
                j = _qualified(words, j) if j < n else j
                if j < n and words[j] == "<":
                    j = _skip_angles(words, j)
                value = None
                if j < n and words[j][0] in "([":
                    if words[j][-1] == ")":
                        value, body = (start, begins[j] + len(words[j]), links), j + 1
                    else:
                        stack.append((words[j], start, True, links, inside))
                    j += 1
                i, dotted = j, False
                continue
            at = t.rfind(".")
            whole = at < 0  # no dot is in the token
            if not whole or dotted:
                if value is not None and (dotted or first == "."):
                    start, links, upto = value[0], value[2], value[1]
                else:  # a name of its own, after dots that follow no value too
                    while at >= 0 and (t[0] == "." or t[:t.index(".")].rstrip() in _NOT_VALUES):
                        rest = t[t.index(".") + 1:].lstrip()
                        begin += len(t) - len(rest)
                        t = rest
                        at = t.rfind(".")
                    start, links, upto = begin, 0, -1
                if at > 0:
                    upto = begin + len(t[:at].rstrip())
                if upto >= 0:
                    if after[:1] == "(":
                        sites.append(("call", t[at + 1:].lstrip(), _tidy(text[start:upto]), None, start, inside, links))
                        i += 1
                        if after == "(":
                            stack.append(("(", start, False, links + 1, inside))
                            inside = len(sites) - 1
                            value = None
                        else:
                            value = (start, begins[i] + len(after), links + 1)
                    else:
                        value = (start, begin + len(t), links)
                    dotted = False
                    i += 1
                    continue
            if whole and t in _TYPE_WORDS and not (i and words[i - 1] in ("@", ".")) and after and (after[0].isalpha() or after[0] in "_$"):
                sites.append(("type", after.partition(".")[0].rstrip(), None, None, begin, inside, 0))
                value = None
                i += 1
            elif after == "(":
                stack.append(("(", -1 if t in _NOT_VALUES else begin, False, 0, inside))
                i += 1
                value = None
            elif t in _NOT_VALUES:
                value = None
                i += after[:1] == "("
            elif after[:1] == "(":
                i += 1
                value = (begin, begins[i] + len(after), 0)
            else:
                value = (begin, begin + len(t), 0)
            dotted = False
        elif first in ")]}":
            if not stack or stack[-1][0] != _CLOSES[t]:
                good = False
                break
            _, start, made, links, inside = stack.pop()
            if made:
                body = i + 1
            value, dotted = (start, begins[i] + 1, links) if start >= 0 else None, False
        elif first in "([{":
            made = body == i
            kept = value if value and (first == "[" or made) else None
            if len(t) > 1:  # empty brackets
                value = (begins[i], begins[i] + len(t), kept[2] if kept else 0)
            else:
                stack.append((t, begins[i] if t == "(" else kept[0] if kept else -1, made and t == "[", kept[2] if kept else 0, inside))
                value = None
            dotted = False
        elif first == ".":
            dotted = True
            if words[i + 1] == "<":  # explicit type arguments before a method's name
                i = _skip_angles(words, i + 1) - 1
        elif first == "@" and words[i + 1] != "interface":
            field = _annotated_field(words, begins, i, text)
            if field:
                sites.append(("field", field[2], field[1], field[3], begins[i], inside, 0))
                i = field[0] - 1
            else:
                j = _qualified(words, i + 1) if i + 1 < n else i + 1
                if j < n and words[j][0] == "(":
                    if words[j] == "(":
                        stack.append(("(", -1, False, 0, inside))
                    j += 1
                i = j - 1
            value, dotted = None, False
        elif first in "\"'":
            if len(t) == 1:
                good = False  # an open quote
                break
            value, dotted = (begins[i], begins[i] + len(t), 0), False  # a literal
        else:
            value, dotted = None, False
        i += 1
    return good and not stack, sites


def visit_order(sites: list[tuple]) -> list[int]:
    """The place of each call and field when expressions are visited from the outside: a call,
    what its arguments hold, then what its scope holds, so the last link of a chain comes first."""
    if sites and all(s[5] < 0 for s in sites) and all(map(lt, begins := [s[4] for s in sites], begins[1:])):  # nothing is nested or chained
        return list(accumulate((s[0] != "type" for s in sites[:-1]), initial=0))
    below: dict[int, list[int]] = {}
    for k, (_, _, _, _, begin, parent, link) in enumerate(sites):
        below.setdefault(parent, []).append(k)
    for ks in below.values():
        ks.sort(key=lambda k: (sites[k][4], -sites[k][6]))
    place, todo, n = [0] * len(sites), below.get(-1, [])[::-1], 0
    while todo:
        k = todo.pop()
        place[k] = n
        n += sites[k][0] != "type"
        todo.extend(below.get(k, [])[::-1])
    return place


FEW = 10_000  # sites x characters up to which lines are counted from the text's beginning for each site
_SCAN_TYPE = "struct<good:boolean,sites:array<struct<kind:string,name:string,target:string,annotations:array<string>,line:int,idx:int>>>"


def scan_column(content):
    """``scan_java`` of a text column: the sites in the order of the text, each with the line
    its expression begins on and its place in the order of visits; null texts are not good."""
    site = pa.struct([("kind", pa.string()), ("name", pa.string()), ("target", pa.string()), ("annotations", pa.list_(pa.string())),
                      ("line", pa.int32()), ("idx", pa.int32())])

    @F.arrow_udf(_SCAN_TYPE)
    def scan(texts: pa.Array) -> pa.Array:
        good, found, ends, lines, places = [], [], [0], [], []
        for text in texts.to_pylist():
            parsed, sites = scan_java(text) if text is not None else (False, [])
            good.append(parsed)
            if sites:
                found += sites
                places += visit_order(sites)
                if len(sites) * len(text) < FEW:
                    lines += [text.count("\n", 0, s[4]) + 1 for s in sites]
                else:
                    breaks = [m.start() for m in re.finditer("\n", text)]
                    lines += [bisect.bisect_left(breaks, s[4]) + 1 for s in sites]
            ends.append(len(found))
        columns = [pa.array([s[i] for s in found], field.type) for i, field in enumerate(list(site)[:4])]
        columns += [pa.array(lines, pa.int32()), pa.array(places, pa.int32())]
        sites = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(site)))
        return pa.StructArray.from_arrays([pa.array(good, pa.bool_()), sites], ["good", "sites"])

    # Deterministic in fact; declared otherwise so Catalyst never copies the call
    # into a pushed-down filter (which would run the Python pass twice).
    return scan.asNondeterministic()(content)


#: Only space, comments and annotations can stand before a file's package.
_PACKAGE = r"\A(?:\s++|/\*(?s:.*?)\*/|//[^\n]*|@[\w.]+(?:\([^)]*\))?)*+package\s+([\w.]+)\s*;"


def package_of(content):
    """The declared package, ``default`` without one."""
    found = F.regexp_extract(content, _PACKAGE, 1)
    return F.when(found == "", F.lit("default")).otherwise(found)
