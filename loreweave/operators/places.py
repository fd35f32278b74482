"""Text files as blocks, the two texts written from them, and the places of snippets in them.

``adapted`` makes one row a block, ``written`` gives every block its place in a display
text (all blocks) and in an index text (blocks that still fit under a cap, others are
skipped whole), ``located`` finds the blocks that a snippet came from.

Defined cases: a null text counts as empty; a file without a visible character has no
block; a file over the limits has one row without a block and the status ``failed``;
rows of files that repeat a key are one file and should be told apart before.
"""

from __future__ import annotations

import csv
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from loreweave.operators import context, rank
from loreweave.sources.files import MOST_BLOCKS, MOST_CHARS

GAP = "\n\n"
MOST_CELLS = 100_000
# Languages of code fences by extension, those that differ from it, and those that are it.
NAMED = {"py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "yml": "yaml", "htm": "html", "rs": "rust", "rb": "ruby", "h": "c", "hpp": "cpp", "cs": "csharp", "kt": "kotlin", "sh": "bash", "zsh": "bash", "ps1": "powershell", "cmd": "bat", "gradle": "groovy", "m": "matlab", "pl": "perl", "tex": "latex", "conf": "text", "env": "dotenv"}
SAME = "java vue jsx tsx json jsonc yaml html xml css scss less sql go php c cpp swift bash bat dockerfile groovy lua r scala dart toml ini properties".split()
LANGUAGES = {**NAMED, **{x: x for x in SAME}}
# Places of a snippet at most, its characters, letters or digits of an anchor, blocks returned.
MOST_PLACES, MOST_SNIPPET, LEAST_ANCHOR, MOST_FOUND = 24, 32_000, 8, 12
#: Snippets that share one copy of a body, and characters of an offset bucket.
TOGETHER, BUCKET = 1000, 1024


def markdown_table(text: str, separator: str) -> str | None:
    """Delimited text as a Markdown table, rows filled up to the widest; None beyond ``MOST_CELLS``."""
    cells = [r for r in csv.reader(text.splitlines(keepends=True), delimiter=separator) if r]
    width = max(map(len, cells), default=0)
    if len(cells) * width > MOST_CELLS:
        return None
    lines = ["| " + " | ".join(re.sub(r"\s*\n\s*", "<br>", c.strip()).replace("|", "\\|") for c in r + [""] * (width - len(r))) + " |" for r in cells]
    return "\n".join([*lines[:1], "|" + " --- |" * width, *lines[1:]]) if lines else ""


@F.pandas_udf(StringType())
def _tables(text: pd.Series, separator: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else markdown_table(t, s) for t, s in zip(text, separator, strict=True)], dtype=object)


def fenced(content: Column, language: Column) -> Column:
    """Code in a fence that is longer than any run of its marks inside."""
    runs = F.transform(F.regexp_extract_all(content, F.lit("(`+)")), F.length)
    mark = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))
    return F.concat(mark, language, F.lit("\n"), content, F.when(content.endswith("\n"), "").otherwise("\n"), mark)


def adapted(files: DataFrame, key: str, path: str, text: str, most_chars: int = MOST_CHARS, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """``key, block, kind, display, status`` of text files: one block of Markdown, code or table, else paragraphs."""
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    content = F.regexp_replace(F.regexp_replace(raw, "\r\n?", "\n"), "[﻿\\x00]", "")
    ext = F.lower(F.regexp_extract(path, r"(?:\.|^|/)([^./]+)$", 1))
    language = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])[ext]
    kind = F.when(ext.isin("md", "markdown"), "markdown").when(language.isNotNull(), "code").when(ext.isin("csv", "tsv"), "table").otherwise("paragraph")
    read = files.select(key, content.alias("_content"), kind.alias("kind"), language.alias("_language"), F.when(ext == "csv", ",").otherwise("\t").alias("_separator"), (F.char_length(raw) > most_chars).alias("_long"))
    paragraphs = F.filter(F.transform(F.split("_content", r"\n[ \t]*\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    tables = _tables(F.when((F.col("kind") == "table") & ~F.col("_long"), F.col("_content")), F.col("_separator"))
    whole = F.when(F.col("kind") == "code", fenced(F.col("_content"), F.col("_language"))).when(F.col("kind") == "table", F.col("_table")).otherwise(F.col("_content"))
    parts = F.when(F.col("kind") == "paragraph", paragraphs).when(F.col("_content").rlike(r"\S"), F.array(whole)).otherwise(F.array().cast("array<string>"))
    cut = read.withColumn("_table", tables).withColumn("_parts", F.when(~F.col("_long"), parts))
    bad = F.col("_long") | (F.size("_parts") > most_blocks) | F.exists("_parts", F.isnull)
    cut = cut.withColumn("status", F.when(bad, "failed").otherwise("ok")).withColumn("_parts", F.when(~bad, F.col("_parts")))
    rows = cut.select(key, "kind", "status", F.posexplode_outer("_parts").alias("block", "display"))
    return rows.filter("block is not null or status = 'failed'").select(key, "block", "kind", "display", "status")


def written(blocks: DataFrame, key: str, most: int = MOST_CHARS) -> DataFrame:
    """Blocks (``key, block, display``) with ``shown_start, shown_end`` in the display text and ``start, end`` in the index text.

    A block that no longer fits under ``most`` characters of index text is left out
    whole, later ones may fit: its ``start`` is null and its file is ``partial``.
    Totals go past in order; no file is gathered.
    """
    given = blocks.filter("block is not null").withColumn("_n", F.char_length("display").cast("long")).withColumn("_cost", F.col("_n") + len(GAP))
    before = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    place = F.coalesce(F.sum("_cost").over(before), F.lit(0))
    fits = rank.budget_skip(given.select(key, "block", "_n", "_cost"), [key], "_cost", most + len(GAP), rank="block")
    fits = fits.select(F.col(key).alias("_key"), F.col("block").alias("_block"), place.alias("start"), (place + F.col("_n")).alias("end"))
    shown = given.withColumn("shown_start", place).withColumn("shown_end", place + F.col("_n"))
    both = shown.join(fits, F.col(key).eqNullSafe(F.col("_key")) & (F.col("block") == F.col("_block")), "left")
    partial = F.max(F.col("start").isNull()).over(Window.partitionBy(key))
    return both.withColumn("partial", partial).drop("_key", "_block", "_n", "_cost")


def texts(placed: DataFrame, key: str) -> DataFrame:
    """``key, display_text, index_text`` of written blocks; a file's blocks are bounded by ``adapted``'s limits."""

    def joined(name, kept):
        rows = F.array_sort(F.collect_list(F.when(kept, F.struct("block", "display"))))
        return F.array_join(F.transform(rows, lambda r: r["display"]), GAP).alias(name)

    return placed.groupBy(key).agg(joined("display_text", F.lit(True)), joined("index_text", F.col("start").isNotNull()))


def _found(body: str, piece: str, room: int) -> list[tuple[int, int]]:
    out, at = [], body.find(piece)
    while at >= 0 and len(out) < room:
        out.append((at, at + len(piece)))
        at = body.find(piece, at + len(piece))
    return out


def ranges(body: str, snippet: str) -> list[tuple[int, int]]:
    """Places of a snippet in a body; where it is not there as a whole, those of its lines and of what stands between its gaps."""
    wanted = snippet.strip()[:MOST_SNIPPET]
    if not wanted:
        return []
    out = _found(body, wanted, MOST_PLACES)
    if not out:
        for piece in re.split(r"(?:\r?\n|…|\.\.\.)+", wanted):
            anchor = re.sub(r"^#{1,6}\s+", "", piece.strip())
            if sum(map(str.isalnum, anchor)) >= LEAST_ANCHOR:
                out += _found(body, anchor, MOST_PLACES - len(out))
    return out


@F.pandas_udf(DoubleType())
def _relevance(question: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([context.relevance(q, t)[0] if q else 0.0 for q, t in zip(question, text, strict=True)], dtype="float64")


def located(blocks: DataFrame, bodies: DataFrame, snippets: DataFrame, key: str) -> DataFrame:
    """``key, snippet_id, place, block, relevance``: blocks that a snippet overlaps, the most relevant to its question first.

    ``blocks``: key, block, start, end, display; ``bodies``: key, body (one row each);
    ``snippets``: key, snippet_id, snippet, question. A body goes to at most
    ``TOGETHER`` or so of its snippets at a time; ranges and blocks meet in buckets of offsets.
    """
    asked = snippets.filter("snippet is not null").select(key, "snippet_id", "snippet")
    sizes = asked.groupBy(key).agg(F.ceil(F.count("*") / TOGETHER).alias("_shares"))
    dealt = asked.join(sizes, key).groupBy(key, F.pmod(F.xxhash64("snippet_id"), "_shares").alias("_share"))
    dealt = dealt.agg(F.collect_list(F.struct("snippet_id", "snippet")).alias("asks"))
    types = dict(snippets.dtypes)
    schema = f"`{key}` {dict(bodies.dtypes)[key]}, snippet_id {types['snippet_id']}, _a long, _b long"

    def run(batches):
        for batch in batches:
            keys, ids, a, b = [], [], [], []
            for k, body, asks in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for ask in asks:
                    for x, y in ranges(body, ask["snippet"]):
                        keys.append(k), ids.append(ask["snippet_id"]), a.append(x), b.append(y)
            kinds = batch.schema.field(0).type, batch.schema.field(2).type.value_type.field("snippet_id").type
            yield pa.RecordBatch.from_arrays([pa.array(keys, kinds[0]), pa.array(ids, kinds[1]), pa.array(a, pa.int64()), pa.array(b, pa.int64())], [key, "snippet_id", "_a", "_b"])

    spans = bodies.select(key, "body").filter("body is not null").join(dealt, key).select(key, "body", "asks").mapInArrow(run, schema)
    spans = spans.withColumn("_bucket", F.explode(F.expr(f"sequence(_a div {BUCKET}, (_b - 1) div {BUCKET})")))
    real = blocks.filter("end > start").select(key, "block", "start", "end")
    real = real.withColumn("_bucket", F.explode(F.expr(f"sequence(start div {BUCKET}, (end - 1) div {BUCKET})")))
    met = spans.join(real, [key, "_bucket"]).filter("start < _b and end > _a").select(key, "snippet_id", "block").distinct()
    questions = snippets.select(key, "snippet_id", "question").dropDuplicates([key, "snippet_id"])
    scored = met.join(blocks.select(key, "block", "display"), [key, "block"]).join(questions, [key, "snippet_id"])
    scored = scored.withColumn("relevance", _relevance(F.col("question"), F.col("display")))
    place = F.row_number().over(Window.partitionBy(key, "snippet_id").orderBy(F.desc("relevance"), "block"))
    return scored.withColumn("place", place).filter(F.col("place") <= MOST_FOUND).select(key, "snippet_id", "place", "block", "relevance")
