"""Markdown-aware normal form of a text, with a map back to the original.

The normal form keeps every character but decoration and white space; a gap
between two characters of words becomes one space. Where code stands, marks are
text. ``normal_form`` is the only part that runs in Python; a place in the normal
form is looked up in its prefix sums by Column functions.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What decorates a line or a phrase outside code.
LINE_MARKS = r"^[ \t]{0,3}(?:#{1,6}[ \t]+|>[ \t]*|[-+*][ \t]+|[0-9]+[.)][ \t]+)"
TAGS = "span|font|b|strong|i|em|u|s|del|mark|a|p|div|br|pre|code"
BEFORE, BEHIND = 180, 240

_FENCED = r"(?P<open>^[ \t]{0,3}(?P<f>`{3,}|~{3,})[^\n]*(?:\n|\Z))(?P<body>(?s:.*?))(?P<close>^[ \t]{0,3}(?P=f)[`~]*[ \t]*$|\Z)"
_INDENTED = r"(?P<indented>(?:(?<=\n\n)|(?<=\A))(?:(?: {4}|\t)[^\n]*(?:\n|\Z))+)"
_INLINE = r"(?<![`\\])(?P<tick>`+)(?!`)(?P<code>(?:[^\n]|\n(?!\s*\n))+?)(?<!`)(?P=tick)(?!`)"
_LINK = r"(?<!\\)(?P<mark>!?\[)(?P<label>[^\[\]\n]*)(?P<target>\]\((?:<[^<>\n]*>|[^()\s]*)(?:[ \t]+\"[^\"\n]*\")?\))"
_OTHER = rf"(?P<other>{LINE_MARKS}|<!--(?s:.*?)-->|(?i:</?(?:{TAGS})(?:[ \t][^>\r\n]*)?/?>))"
_SYNTAX = re.compile("|".join((_FENCED, _INDENTED, _INLINE, _LINK, _OTHER)), re.MULTILINE)
_EMPHASIS = regex.compile(r"(?<![\\*])(\*{1,3})(?=[^\s*])(?:[^*\n]|\n(?!\s*\n))*?(?<=[^\s*\\])(\1)(?!\*)|(?<![\\_\w])(_{1,3})(?=[^\s_])(?:[^_\n]|\n(?!\s*\n)|_(?=\w))*?(?<=[^\s_\\])(\3)(?![_\w])")
_GAP = regex.compile(r"\s+")
_WORD = regex.compile(r"[\p{L}\p{Nd}&&[^\p{Script=Han}]]", regex.V1)


def decoration(text: str) -> list[tuple[int, int]]:
    """The spans of a text that only decorate it."""
    found, code = [], []
    for m in _SYNTAX.finditer(text):
        if m["f"]:
            found += [m.span("open"), m.span("close")]
            code.append(m.span())
        elif m["indented"]:
            code.append(m.span())
        elif m["tick"]:
            n = len(m["tick"])
            found += [(m.start(), m.start() + n), (m.end() - n, m.end())]
            code.append(m.span())
        elif m["mark"]:
            found += [m.span("mark"), m.span("target")]
        else:
            found.append(m.span())
    shown = list(text)
    for a, b in found + code:
        shown[a:b] = " " * (b - a) if (a, b) not in code else "x" * (b - a)
    prose = "".join(shown)
    while pairs := [m.span(g) for m in _EMPHASIS.finditer(prose) for g in (1, 2, 3, 4) if m[g]]:
        found += pairs
        for a, b in pairs:
            shown[a:b] = "x" * (b - a)
        prose = "".join(shown)  # pairs may hold pairs: another look at what is left
    return sorted(found)


def normal_form(text: str | None) -> tuple[str, list[int], list[int]]:
    """``(normal, at, raw)``: from place at[i] of the normal form on, places run on from raw[i] of the text."""
    text = text or ""
    out, at, raw, size, gap = [], [], [], 0, None

    def keep(a: int, b: int) -> None:
        nonlocal size
        if not at or raw[-1] + size - at[-1] != a:
            at.append(size)
            raw.append(a)
        out.append(text[a:b])
        size += b - a

    last, ignored = 0, decoration(text)
    for a, b in [*ignored, (len(text), len(text))]:
        while last < a:
            m = _GAP.search(text, last, a)
            end = m.start() if m else a
            if end > last:
                if gap is not None and out and _WORD.match(out[-1][-1]) and _WORD.match(text[last]):
                    at.append(size)
                    raw.append(gap)
                    out.append(" ")
                    size += 1
                gap = None
                keep(last, end)
            if m and gap is None:
                gap = m.start()
            last = m.end() if m else a
        last = max(last, b)
    return "".join(out), at, raw


NORMAL = "struct<normal: string, at: array<int>, raw: array<int>>"


def normalised(df: DataFrame, column: str, to: str) -> DataFrame:
    """``df`` with ``to``, the normal form of ``column`` and its map, made in Arrow batches."""
    kind = pa.struct([("normal", pa.string()), ("at", pa.list_(pa.int32())), ("raw", pa.list_(pa.int32()))])

    @F.arrow_udf(NORMAL)
    def convert(texts: pa.Array) -> pa.Array:
        return pa.array([dict(zip(("normal", "at", "raw"), normal_form(t), strict=True)) for t in texts.to_pylist()], kind)

    return df.withColumn(to, convert(column))


def raw_place(form: Column, place: Column) -> Column:
    """The place in the text, from 0, of a place in its normal form."""
    i = F.size(F.filter(form["at"], lambda a: a <= place))
    return F.element_at(form["raw"], i) + place - F.element_at(form["at"], i)


#: Places of one chunk in its document that are looked at; a chunk with more stands nowhere for certain.
MOST_PLACES = 64


def chunk_scopes(text: str | None, chunks: list[str]) -> list[str]:
    """The part of a text's normal form that each chunk stands for; empty where it stands at places of other meaning, or at none.

    Chunks are found without regard to white space, which a splitter may set anew.
    """
    text = text or ""
    normal, at, raw = normal_form(text)
    runs = [(m.start(), m[0]) for m in re.finditer(r"\S+", text)]
    starts = list(accumulate((len(r) for _, r in runs), initial=0))  # of each run in the text without white space
    bare = "".join(r for _, r in runs)

    def place(k: int) -> int:
        i = bisect_right(starts, k) - 1
        return runs[i][0] + k - starts[i]

    def behind(r: int) -> int:
        """The first place of the normal form at or behind a place of the text."""
        i = bisect_right(raw, r) - 1
        if i < 0:
            return 0
        return min(at[i] + r - raw[i], at[i + 1] if i + 1 < len(at) else len(normal))

    out, known = [], {}
    for chunk in chunks:
        key = "".join((chunk or "").split())
        if key not in known:
            found, k, n = set(), bare.find(key) if key else -1, 0
            while k >= 0 and n <= MOST_PLACES:
                found.add(normal[behind(place(k)) : behind(place(k + len(key) - 1) + 1)])
                k, n = bare.find(key, k + 1), n + 1
            known[key] = found.pop() if len(found) == 1 and n <= MOST_PLACES else ""
        out.append(known[key])
    return out


def scoped(df: DataFrame, text: str, chunks: str, to: str) -> DataFrame:
    """``df`` with ``to``: ``chunk_scopes`` of a text and an array of chunks, made in Arrow batches."""

    @F.arrow_udf("array<string>")
    def convert(texts: pa.Array, lists: pa.Array) -> pa.Array:
        return pa.array([chunk_scopes(t, c) for t, c in zip(texts.to_pylist(), lists.to_pylist(), strict=True)], pa.list_(pa.string()))

    return df.withColumn(to, convert(text, chunks))


def window(text: Column, form: Column, place: Column, size: Column) -> Column:
    """The text from 180 characters before a stretch of its normal form to 240 behind it."""
    first = F.greatest(raw_place(form, place) - BEFORE, F.lit(0))
    last = raw_place(form, place + size - 1) + 1 + BEHIND
    return F.regexp_replace(F.substr(text, first + 1, last - first), r"^\s+|\s+$", "")
