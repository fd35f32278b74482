"""File sources: dispatch by format, text adapters, listings. Errors become rows, not exceptions."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions read as text, and formats that need a reader of their own.
TEXT = set("txt text md markdown rst adoc csv tsv json jsonl xml yaml yml toml ini cfg conf properties log html htm css scss js jsx ts tsx vue java kt py rb go rs c h cpp hpp cs php swift scala sql sh bash ps1 bat r lua pl tex bib srt vtt".split())
OFFICE = set("pdf docx docm doc xlsx xlsm xls pptx pptm ppt".split())
MOST_CHARS, MOST_BYTES, MOST_BLOCKS = 800_000, 64 * 1024 * 1024, 20_000
OUT = pa.schema([("path", pa.string()), ("status", pa.string()), ("text", pa.string()), ("error", pa.string()), ("chars", pa.int32())])

#: Readers of office formats, by extension: ``bytes -> text``. None is installed by default.
READERS: dict = {}


def tidy(text: str) -> str:
    """Line feeds only, no BOM or NUL, no trailing blanks, at most one empty line."""
    s = re.sub("[﻿\0]", "", re.sub("\r\n?", "\n", text))
    return re.sub("\n{3,}", "\n\n", re.sub(r"(?m)[ \t]+$", "", s)).strip()


def repair_mojibake(text: str) -> str:
    """Runs of U+0080 to U+00FF that are UTF-8 read as Latin-1, decoded; others stay."""

    def fix(m):
        try:
            return m[0].encode("latin-1").decode("utf-8")
        except UnicodeDecodeError:
            return m[0]

    return re.sub("[\x80-\xff]{2,}", fix, text)


def extract(path: str, data: bytes | None) -> dict:
    """``status`` (ok, empty, unsupported, skipped, failed), text, error and length of one file."""
    ext = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    out = {"path": path, "status": "ok", "text": "", "error": "", "chars": 0}
    if data is None or len(data) > MOST_BYTES:
        return out | {"status": "skipped", "error": "too large"}
    try:
        if ext in TEXT:
            text = data.decode("utf-8")
        elif ext in READERS:
            text = READERS[ext](data)
        else:
            return out | {"status": "unsupported", "error": f"no reader for .{ext}" if ext in OFFICE else ""}
    except Exception as e:
        return out | {"status": "failed", "error": str(e)[:300]}
    text = tidy(repair_mojibake(text))[:MOST_CHARS]
    return out | {"status": "ok" if text else "empty", "text": text, "chars": len(text)}


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, status, text, error, chars`` of every file below a path."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist([extract(p, d) for p, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], OUT)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.when(F.col("length") <= MOST_BYTES, F.col("content")).alias("content")).mapInArrow(run, "path string, status string, text string, error string, chars int")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, modified`` newest first; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.col("modificationTime").alias("modified")).orderBy(F.desc("modified"), "path")


def paragraphs(docs: DataFrame, key: str, text: str, most: int = MOST_BLOCKS) -> DataFrame:
    """``key, block, text``: paragraphs between blank lines, at most ``most`` a document."""
    parts = F.filter(F.transform(F.split(F.col(text), r"\n[ \t]*\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return docs.select(key, F.posexplode(F.slice(parts, 1, most)).alias("block", "text"))


def offsets(blocks: DataFrame, key: str, most: int = MOST_CHARS, gap: int = 2) -> DataFrame:
    """``start, end`` of blocks in the text that joins them; blocks beyond ``most`` characters go, the document is partial."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("block")
    end = F.sum(F.char_length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + (F.row_number().over(w) - 1) * gap
    placed = blocks.withColumn("end", end).withColumn("start", F.col("end") - F.char_length("text"))
    partial = F.max("end").over(Window.partitionBy(key)) > most
    return placed.withColumn("partial", partial).filter(F.col("end") <= most)


def pages_of(blocks: DataFrame, key: str, page_chars: int = 8000) -> DataFrame:
    """Blocks with ``page``: whole blocks fill pages of about ``page_chars`` characters."""
    from pyspark.sql import Window

    before = F.coalesce(F.sum(F.char_length("text")).over(Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blocks.withColumn("page", F.floor(before / page_chars).cast("int"))


def assign_regions(lines: DataFrame, regions: DataFrame, least: float = 0.5) -> DataFrame:
    """Lines with the region of their page that covers most of them; ``region`` is null for orphans.

    Both sides: doc_id, page, x0, y0, x1, y1; regions also ``region``. Joined on
    the page, so only the boxes of one page meet.
    """
    from pyspark.sql import Window

    r = regions.select("doc_id", "page", "region", *[F.col(c).alias(f"r{c}") for c in ("x0", "y0", "x1", "y1")])
    keyed = lines.withColumn("_line", F.xxhash64(*lines.columns))
    over = F.greatest(F.least("x1", "rx1") - F.greatest("x0", "rx0"), F.lit(0.0)) * F.greatest(F.least("y1", "ry1") - F.greatest("y0", "ry0"), F.lit(0.0))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    hits = keyed.join(r, ["doc_id", "page"]).withColumn("share", F.coalesce(F.try_divide(over, area), F.lit(0.0))).filter(F.col("share") >= least)
    best = hits.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "page", "_line").orderBy(F.desc("share"), "region"))).filter("_n = 1")
    return keyed.join(best.select("doc_id", "page", "_line", "region", "share"), ["doc_id", "page", "_line"], "left").drop("_line")


def locate(blocks: DataFrame, snippets: DataFrame, key: str) -> DataFrame:
    """Blocks (with offsets and the document's ``body``) that a literal snippet overlaps."""
    hit = snippets.withColumn("at", F.position(F.col("snippet"), F.col("body")) - 1).filter("at >= 0")
    spans = hit.select(key, "snippet_id", "at", (F.col("at") + F.char_length("snippet")).alias("until"))
    return blocks.join(spans, key).filter("start < until and end > at").select(key, "snippet_id", "block")


def html_needs_browser(status: Column, html: Column) -> Column:
    """Refused, empty, or a short page that asks for scripts."""
    body = F.coalesce(html, F.lit(""))
    return status.isin(403, 429) | (F.trim(body) == "") | ((F.char_length(body) < 2000) & body.rlike("(?i)enable javascript|requires javascript"))
