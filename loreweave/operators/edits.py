"""Exact edits of notes, guarded by the hash of the text that they were planned on."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_EDITS = 50
TAGS = {"bold": "strong", "italic": "em", "underline": "u", "strike": "s", "superscript": "sup", "subscript": "sub"}
OP = "struct<action:string,text:string,value:string,occurrence:int,all:boolean,prefix:string,suffix:string,style:string>"
GUARDED = re.compile(r"(?is)<(script|style|pre|code)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^<>]*>|(?m:^ {0,3}(`{3,}|~{3,})).*?(?m:^ {0,3}\2|\Z)|(`+)(?!`).*?(?<!`)\3(?!`)|\]\([^)\n]*\)")


class EditError(ValueError):
    pass


def places(text: str, op: dict) -> list[tuple[int, int]]:
    """Where an edit applies: the stated occurrence, all, or the only match with its context."""
    find = op.get("text") or ""
    if not find:
        raise EditError("no text to find")
    if op.get("all") and op.get("occurrence") is not None:
        raise EditError("all and occurrence exclude each other")
    before, after = op.get("prefix") or "", op.get("suffix") or ""
    spans = [m.span() for m in re.finditer(re.escape(find), text)]
    spans = [(a, b) for a, b in spans if text[:a].endswith(before) and text.startswith(after, b)] if before or after else spans
    if not spans:
        raise EditError("text not found")
    n = op.get("occurrence")
    if n is not None:
        if not 1 <= n <= len(spans):
            raise EditError(f"occurrence {n} of {len(spans)}")
        return [spans[n - 1]]
    if len(spans) > 1 and not op.get("all"):
        raise EditError(f"{len(spans)} matches")
    return spans


def _styled(op: dict) -> str:
    find, style, value = op["text"], op.get("style") or "", (op.get("value") or "").strip().lower()
    if "\n" in find or "\r" in find:
        raise EditError("formats stay within a line")
    if style in TAGS:
        return f"<{TAGS[style]}>{find}</{TAGS[style]}>"
    if style == "code":
        ticks = "`" * (1 + max((len(t) for t in re.findall("`+", find)), default=0))
        pad = " " if find[0] == "`" or find[-1] == "`" else ""
        return f"{ticks}{pad}{find}{pad}{ticks}"
    if style in ("color", "highlight"):
        if not re.fullmatch(r"#[0-9a-f]{3}(?:[0-9a-f]{3})?|[a-z]+", value):
            raise EditError(f"no colour: {value}")
        return f'<font style="{"color" if style == "color" else "background-color"}: {value}">{find}</font>'
    if style == "font_size":
        if not re.fullmatch(r"\d{1,2}", value) or not 8 <= int(value) <= 72:
            raise EditError("sizes are 8 to 72")
        return f'<font style="font-size: {value}px">{find}</font>'
    raise EditError(f"unknown style {style!r}")


def edited(text: str, ops: list[dict]) -> str:
    """The text after all edits in order; an error leaves it as it was."""
    if not 1 <= len(ops) <= MOST_EDITS:
        raise EditError(f"1 to {MOST_EDITS} edits")
    for op in ops:
        action, value = op.get("action"), op.get("value")
        if action not in ("replace", "delete", "insert_before", "insert_after", "format"):
            raise EditError(f"unknown action {action!r}")
        if value is None and action in ("replace", "insert_before", "insert_after"):
            raise EditError(f"{action} needs a value")
        spans, find = places(text, op), op["text"]
        if action == "format":
            guarded = [m.span() for m in GUARDED.finditer(text)]
            if any(a < y and x < b for a, b in spans for x, y in guarded):
                raise EditError("formats apply to prose only")
        new = {"delete": lambda: "", "replace": lambda: value, "insert_before": lambda: value + find, "insert_after": lambda: find + value, "format": lambda: _styled(op)}[action]()
        parts, at = [], 0
        for a, b in spans:
            parts += [text[at:a], new]
            at = b
        text = "".join([*parts, text[at:]])
    return text


def apply_edits(notes: DataFrame, edits: DataFrame, key: str, content: str) -> DataFrame:
    """``key, content, status, error`` of every note that ``edits`` (key, expected_hash, operations) names.

    Status is ``edited``, ``stale`` where the text is not the one that was read,
    or ``rejected``; a text that is not edited stays as it was. Null is empty.
    """

    @F.pandas_udf("content string, status string, error string")
    def run(texts: pd.Series, hashes: pd.Series, ops: pd.Series) -> pd.DataFrame:
        rows = []
        for text, expected, todo in zip(texts, hashes, ops, strict=True):
            if hashlib.sha256(text.encode()).hexdigest() != expected:
                rows.append((text, "stale", "text has changed"))
                continue
            try:
                rows.append((edited(text, [dict(o) for o in (todo if todo is not None else [])]), "edited", None))
            except EditError as e:
                rows.append((text, "rejected", str(e)))
        return pd.DataFrame(rows, columns=["content", "status", "error"])

    both = notes.select(key, F.coalesce(F.col(content), F.lit("")).alias("_text")).join(edits.select(key, "expected_hash", F.col("operations").cast(f"array<{OP}>").alias("operations")), key)
    clean = F.transform("operations", lambda o: o)
    return both.select(key, run("_text", "expected_hash", clean).alias("r")).select(key, F.col("r.content").alias(content), "r.status", "r.error")
