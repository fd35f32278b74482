"""Derived pages: sections, citations, dependency snapshots, freshness, quality."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Citation kinds and their labels, least length and sections of a page.
KINDS = {"note": "笔记", "ref": "速查卡", "file": "资料"}
LEAST_CHARS, LEAST_SECTIONS = 260, 1
MARKER = r"\[\s*(笔记|速查卡|速查|资料|note|ref|file)\s*#\s*(\d+)\s*\]"


def citations(markdown: Column) -> Column:
    """``type-id`` of every citation marker, in order."""
    kinds = F.regexp_extract_all(markdown, F.lit(MARKER), F.lit(1))
    ids = F.regexp_extract_all(markdown, F.lit(MARKER), F.lit(2))
    name = lambda k: F.when(k.isin("笔记", "note"), "note").when(k.isin("速查卡", "速查", "ref"), "ref").otherwise("file")
    return F.zip_with(kinds, ids, lambda k, i: F.concat(name(k), F.lit("-"), i))


def links(markdown: Column) -> Column:
    """Targets of ``[[wiki links]]``, the part before a bar."""
    return F.transform(F.regexp_extract_all(markdown, F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), F.lit(1)), lambda x: F.trim(x))


def quality(pages: DataFrame) -> DataFrame:
    """``page_id, ok, hard, soft``: length, sections, unknown and scarce citations.

    ``pages``: page_id, markdown, valid (array of known references).
    """
    body = F.trim(F.coalesce("markdown", F.lit("")))
    found = citations(body)
    unknown = F.array_distinct(F.filter(found, lambda c: ~F.array_contains("valid", c)))
    good = F.size(F.filter(found, lambda c: F.array_contains("valid", c)))
    sections = F.regexp_count(body, F.lit(r"(?m)^##\s+\S"))
    hard = F.array_compact(
        F.array(
            F.when(F.size(unknown) > 0, "unknown citations"), F.when(F.char_length(body) < LEAST_CHARS, "too short"), F.when(sections < LEAST_SECTIONS, "no sections"), F.when(good == 0, "no valid citation")
        )
    )
    few = (good > 0) & (good < F.greatest(F.lit(2), F.floor(F.size("valid") / 3)))
    return pages.select("page_id", (F.size(hard) == 0).alias("ok"), F.array_join(hard, "; ").alias("hard"), F.when(few, "few citations").otherwise("").alias("soft"))


def repair(markdown: str, valid: set[str]) -> str:
    """Markers in their regular form; those of unknown sources become plain text."""

    def one(m):
        kind = {"笔记": "note", "note": "note", "速查卡": "ref", "速查": "ref", "ref": "ref"}.get(m[1], "file")
        plain = f"{KINDS[kind]}#{int(m[2])}"
        return f"[{plain}]" if f"{kind}-{int(m[2])}" in valid else plain

    return re.sub(MARKER, one, markdown or "")


def sections(markdown: str | None) -> list[tuple[str, str]]:
    """``(heading path, body)`` of a page; headings inside fences are text."""
    out, path, body, fence = [], [], [], None
    for line in (markdown or "").split("\n"):
        mark = re.match(r"\s{0,3}(`{3,}|~{3,})", line)
        if fence:
            body.append(line)
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not line.strip().strip(fence[0]):
                fence = None
            continue
        if mark:
            fence = mark[1]
        m = None if mark else re.fullmatch(r"\s{0,3}(#{1,6})\s+(.+?)\s*#*\s*", line)
        if m:
            if any(x.strip() for x in body):
                out.append((" > ".join(t for _, t in path), "\n".join(body).strip()))
            path = [(n, t) for n, t in path if n < len(m[1])] + [(len(m[1]), m[2])]
            body = []
        else:
            body.append(line)
    if any(x.strip() for x in body):
        out.append((" > ".join(t for _, t in path), "\n".join(body).strip()))
    return out


def freshness(pages: DataFrame, deps: DataFrame, sources: DataFrame) -> DataFrame:
    """``page_id, state, reason``: unknown without dependency rows, else fresh or stale by the first reason.

    ``pages``: page_id, hash; ``deps``: page_id, page_hash, source_type,
    source_id, source_hash, title; ``sources``: source_type, source_id, hash, title.
    """
    now = sources.select("source_type", "source_id", F.col("hash").alias("_now"), F.col("title").alias("_title"))
    j = deps.join(pages.select("page_id", F.col("hash").alias("_page")), "page_id").join(now, ["source_type", "source_id"], "left")
    why = F.when(F.col("page_hash") != F.col("_page"), "1 page changed").when(F.col("_now").isNull(), "2 source missing").when((F.col("_now") != F.col("source_hash")) | (F.col("_title") != F.col("title")), "3 source changed")
    per = j.groupBy("page_id").agg(F.min(why).alias("_why"))
    state = F.when(F.col("_has").isNull(), "unknown").when(F.col("_why").isNull(), "fresh").otherwise("stale")
    out = pages.select("page_id").join(per.withColumn("_has", F.lit(True)), "page_id", "left")
    return out.select("page_id", state.alias("state"), F.coalesce(F.substring("_why", 3, 100), F.lit("")).alias("reason"))


def material_fingerprint(material: DataFrame) -> DataFrame:
    """``page_id, fingerprint`` over the sorted ``type id@updated;`` of what a page was made from."""
    item = F.concat("source_type", F.lit(" "), F.col("source_id").cast("string"), F.lit("@"), F.col("updated").cast("string"), F.lit(";"))
    return material.groupBy("page_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(item)), ""), 256).alias("fingerprint"))


def red_links(pages: DataFrame) -> DataFrame:
    """``title, link``: links to titles that no page has."""
    out = pages.select("title", F.explode(F.array_distinct(links(F.col("markdown")))).alias("link"))
    return out.join(pages.select(F.col("title").alias("link")).distinct(), "link", "left_anti").select("title", "link")
