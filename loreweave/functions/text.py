"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Term patterns and grams without information.
ASCII_TERM = "[A-Za-z][A-Za-z0-9_.+#-]{1,23}"
CJK_RUN = "[\\u4e00-\\u9fa5]+"
STOP_GRAMS = ["什么", "怎么", "么样", "为什么", "可以", "这个", "那个", "我们", "你们", "帮我", "一下", "是否", "如何", "请问", "以及", "或者", "但是", "因为", "所以", "如果", "问题", "意思", "区别", "用法", "时候", "现在", "已经", "还是"]
MAX_TERMS = 40


def _grams(run: Column, n: int) -> Column:
    return F.when(F.char_length(run) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(run) - n + 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def retrieval_terms(text: Column) -> Column:
    """First 40 distinct terms: ASCII identifiers in order, then 2- and 3-grams of each CJK run."""
    text = F.coalesce(text, F.lit(""))
    ascii_terms = F.regexp_extract_all(text, F.lit(f"({ASCII_TERM})"), F.lit(1))
    runs = F.regexp_extract_all(text, F.lit(f"({CJK_RUN})"), F.lit(1))
    grams = F.flatten(F.transform(runs, lambda r: F.concat(_grams(r, 2), _grams(r, 3))))
    kept = F.filter(grams, lambda g: ~g.isin(STOP_GRAMS))
    return F.slice(F.array_distinct(F.concat(ascii_terms, kept)), 1, MAX_TERMS)


def unicode_terms(text: Column) -> Column:
    """Option for other scripts: first 40 distinct runs of letters and digits of any script."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([\p{L}][\p{L}\p{N}_.+#-]{1,23})"), F.lit(1))), 1, MAX_TERMS)


def lexical_score(terms: Column, title: Column, body: Column) -> Column:
    """Three for each term in the title, else one if it is in the body."""
    t, b = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(body, F.lit("")))
    return F.aggregate(terms, F.lit(0), lambda s, w: s + F.when(F.contains(t, F.lower(w)), 3).when(F.contains(b, F.lower(w)), 1).otherwise(0))


def base_clean(text: Column) -> Column:
    """Without tags, heading marks and inline marks, white space folded."""
    s = F.regexp_replace(text, "(?s)<[^<>]{0,300}>", " ")
    s = F.regexp_replace(s, r"(?m)^\s*#{1,6}\s*", "")
    s = F.regexp_replace(s, r"[`*_~\[\]]", "")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def keep_code(text: Column) -> Column:
    """``base_clean`` with fence lines removed and the code in them kept."""
    return base_clean(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?m)^\s*(```|~~~).*$", " "))


def snippet(summary: Column, content: Column, keyword: str, before: int = 40, length: int = 120) -> Column:
    """A window around the first hit of the keyword, else the summary, else the beginning."""
    plain = keep_code(content)
    n = F.char_length(plain)
    hit = F.locate(keyword.lower(), F.lower(plain))
    start = F.greatest(hit - 1 - before, F.lit(0))
    end = F.least(n, start + length)
    window = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(plain, start + 1, end - start), F.when(end < n, "…").otherwise(""))
    head = F.when(n <= length, plain).otherwise(F.concat(F.substring(plain, 1, length), F.lit("…")))
    in_window = (n > length) & (hit > 0) if keyword.strip() else F.lit(False)
    return F.when(in_window, window).when(F.trim(F.coalesce(summary, F.lit(""))) != "", summary).otherwise(head)


def plain_summary(content: Column) -> Column:
    """Text for list views: without code, markup, table rules and line prefixes."""
    s = F.coalesce(content, F.lit(""))
    for pattern in ("(?s)```.*?```", "(?s)~~~.*?~~~", "(?s)<!--.*?-->", "(?s)<[^<>]{0,300}>", r"(?s)<\s*/?\s*[a-zA-Z][^<>]{0,300}$"):
        s = F.regexp_replace(s, pattern, " ")
    s = decode_entities(s)
    for pattern in (r"(?m)^\s*[-=*_]{3,}\s*$", r"(?m)^[\s|:-]+$", r"(?m)^\s*(?:#{1,6}|>|[-*+]|\d+\.)\s+", r"!?\[([^\]]*)\]\([^)]*\)"):
        s = F.regexp_replace(s, pattern, "$1" if "\\[(" in pattern else " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[#*_`~|]", ""), r"\s+", " "))


# The entities that are decoded, the ampersand last.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&amp;", "&")]


def decode_entities(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def tidy(text: Column) -> Column:
    """Line feeds only, no BOM or NUL, no trailing blanks, at most one empty line."""
    s = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    s = F.regexp_replace(s, "[\\uFEFF\\x00]", "")
    s = F.regexp_replace(s, r"(?m)[ \t]+$", "")
    return F.regexp_replace(F.regexp_replace(s, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def embed_text(title: Column, heading: Column, body: Column) -> Column:
    """``title · heading``, a line feed and the body; blank parts go."""
    part = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.trim(c))
    head = F.concat_ws(" · ", part(title), part(heading))
    return F.when(head == "", F.coalesce(body, F.lit(""))).otherwise(F.concat(head, F.lit("\n"), F.coalesce(body, F.lit(""))))


def clean_heading(raw: Column) -> Column:
    s = F.regexp_replace(F.coalesce(raw, F.lit("")), "<[^>]{1,200}>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, "[*_`~]", ""), "[\\s\\u00a0]+", " "))


def sample_ends(text: Column, part: int = 400) -> Column:
    """Head, middle and tail of a text longer than three parts, else the text."""
    n = F.char_length(text)
    middle = F.substring(text, (F.floor(n / 2) - part // 2).cast("int"), F.lit(part))
    return F.when(n <= 3 * part, text).otherwise(F.concat(F.substring(text, 1, part), F.lit("\n…\n"), middle, F.lit("\n…\n"), F.right(text, F.lit(part))))


def version_digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 16))


def file_name(raw: Column) -> Column:
    """Without control characters, at most 255 characters, the extension kept."""
    s = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"[\x00-\x1f\x7f]", ""))
    ext = F.regexp_extract(s, r"(\.[^.]{1,20})$", 1)
    return F.when(F.char_length(s) <= 255, s).otherwise(F.concat(F.substring(s, F.lit(1), 255 - F.char_length(ext)), ext))


def mask_secrets(text: Column) -> Column:
    s = F.regexp_replace(text, r"(?i)(bearer\s+)[A-Za-z0-9._-]{8,}", "$1***")
    return F.regexp_replace(s, r"\b(sk-|ak-)[A-Za-z0-9_-]{8,}", "$1***")


def split_values(raw: Column, pattern: str = r"[|,，]") -> Column:
    """Trimmed, non-empty parts of a multi-value string."""
    return F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), pattern), lambda x: F.trim(x)), lambda x: x != "")


# Phrases that refuse, anywhere or at the beginning only.
STRONG_REFUSALS = ["无法回答", "不能回答", "无法作答", "无法根据", "无法据此", "没有足够", "不足以回答", "不足以确定"]
ABSENCE_MARKS = ["没有找到", "未找到", "没有相关", "无相关", "没有收录", "未收录", "没有记录", "没有提到", "未提及", "没有提及", "没有涉及", "未涉及", "资料中没有", "材料中没有", "知识库中没有", "库里没有", "没有这方面的", "不包含", "无法确定", "无法从", "没有检索到", "没有查到", "材料里没有", "资料里没有", "没有覆盖"]
REFUSAL_HEAD = 200


def is_refusal(answer: Column, strong: list[str] | None = None, absence: list[str] | None = None) -> Column:
    """A strong mark anywhere, or an absence mark in the first 200 characters; a blank answer refuses nothing."""
    text = F.coalesce(answer, F.lit(""))
    has = lambda where, marks: F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(where, m))
    return has(text, strong or STRONG_REFUSALS) | has(F.substring(text, 1, REFUSAL_HEAD), absence or ABSENCE_MARKS)


# Fixed value: marks that do not count when titles are compared; white space does not either.
TITLE_MARKS = "`*：:、，,。.（）()【】[]-"


def bare_title(title: Column) -> Column:
    """What is left of a title without marks and white space."""
    return F.translate(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", ""), TITLE_MARKS, "")


def titles_overlap(a: Column, b: Column) -> Column:
    """Whether one of two bare titles stands within the other; an empty one stands nowhere."""
    shorter, longer = F.when(F.char_length(a) < F.char_length(b), a).otherwise(b), F.when(F.char_length(a) < F.char_length(b), b).otherwise(a)
    return (F.char_length(shorter) > 0) & (F.position(shorter, longer) > 0)


#: A heading of level one at a text's very beginning (1), and what follows its line without leading empty lines (2).
_TITLE_LINE = r"(?s)^[ \t]*#[ ]([^\n]*)(?:\n(?:[ \t\r\f]*\n)*(.*))?$"


def without_title(content: Column, title: Column) -> Column:
    """A text without a first heading of level one that repeats its title, and the empty lines behind it."""
    repeats = content.rlike(_TITLE_LINE) & titles_overlap(bare_title(F.regexp_extract(content, _TITLE_LINE, 1)), bare_title(title))
    return F.when(repeats, F.regexp_extract(content, _TITLE_LINE, 2)).otherwise(content)


def merged_headings(texts: DataFrame, key: str, content: str) -> DataFrame:
    """``texts`` (``key`` is unique) with repeated headings merged.

    Lines are rows. A heading and the next line that is not empty make a link if
    that is a heading of the same level and their bare titles overlap; lines of
    fences are no headings. Links that follow each other are an island, and its
    odd ones merge two headings: the longer line stays, at the first one's place,
    and what lay between goes.
    """
    from pyspark.sql import Window

    order = Window.partitionBy(key).orderBy("_i")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = texts.filter(F.col(content).isNotNull()).select(key, F.posexplode(F.split(content, "\n")).alias("_i", "_line"))
    rows = rows.withColumn("_mark", F.col("_line").rlike(r"^\s*(```|~~~)")).withColumn("_in", F.coalesce(F.sum(F.col("_mark").cast("int")).over(before), F.lit(0)) % 2 == 1)
    full = rows.filter(F.trim(F.regexp_replace("_line", r"\s+", " ")) != "")
    level = F.char_length(F.regexp_extract(F.trim("_line"), r"^(#{1,6})\s+\S", 1))
    title = F.trim(F.regexp_replace(F.trim("_line"), r"^#{1,6}\s+", ""))
    full = full.withColumn("_level", F.when(F.col("_mark") | F.col("_in") | (level == 0), None).otherwise(level)).withColumn("_title", title)
    after = F.lead(F.struct("_i", "_level", "_title", "_line")).over(order)
    linked = full.withColumn("_next", after).withColumn("_link", F.coalesce((F.col("_level") == F.col("_next._level")) & titles_overlap(bare_title(F.col("_title")), bare_title(F.col("_next._title"))), F.lit(False)))
    # the place of a link among those that follow each other: its number less that of the last line without one
    number = F.row_number().over(order)
    place = number - F.coalesce(F.max(F.when(~F.col("_link"), F.col("_n"))).over(before), F.lit(0))
    merged = linked.withColumn("_n", number).withColumn("_k", place).filter("_link and _k % 2 = 1")
    longer = F.when(F.char_length("_next._title") > F.char_length("_title"), F.col("_next._line")).otherwise(F.col("_line"))
    cuts = merged.select(key, F.col("_i").alias("_from"), F.col("_next._i").alias("_to"), longer.alias("_kept"))
    marked = rows.select(key, "_i", "_line").join(cuts.select(key, F.col("_from").alias("_i"), "_to", "_kept"), [key, "_i"], "left")
    marked = marked.withColumn("_until", F.max("_to").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = marked.filter(F.col("_to").isNotNull() | F.col("_until").isNull() | (F.col("_i") > F.col("_until"))).withColumn("_line", F.coalesce("_kept", "_line"))
    whole = kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_line"))), lambda x: x["_line"]), "\n").alias("_new"))
    return texts.join(whole, key, "left").withColumn(content, F.col("_new")).select(texts.columns)


def canonical_json(value) -> str:
    """JSON with sorted keys and numbers without needless zeros; equal values have equal texts."""
    import json
    from decimal import Decimal

    def plain(x):
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, list | tuple):
            return [plain(v) for v in x]
        if isinstance(x, float | Decimal) and not isinstance(x, bool):
            return int(x) if x == int(x) else float(x)
        return x

    return json.dumps(plain(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def canonical(json_text: Column) -> Column:
    """``canonical_json`` of a JSON column; null where it is none."""
    import json

    @F.pandas_udf("string")
    def convert(texts):
        import pandas as pd

        def one(t):
            try:
                return None if t is None else canonical_json(json.loads(t))
            except (ValueError, OverflowError):
                return None

        return pd.Series([one(t) for t in texts], dtype=object)

    return convert(json_text)
