"""HTML to Markdown, page furniture, OCR lines."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from itertools import accumulate
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.functions.text import decode_entities

# Elements that go with their content, those that part paragraphs, and those that part lines.
DROPPED = {"script", "style", "noscript", "template", "svg", "iframe", "head"}
BLOCKS = {"p", "div", "section", "article", "header", "footer", "main", "aside", "nav", "form", "figure", "figcaption", "tr", "table", "ul", "ol", "dl", "dd", "dt", "body"}
LINES = {"span", "label", "time", "small", "sup", "sub", "u"}
# Fixed value: a main or article element with more characters of markup is the page's content.
LEAST_MAIN = 400
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Navigation and forms, which the stricter conversion drops as well.
CHROME = {"nav", "footer", "form", "button"}
MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*", "del": "~~", "s": "~~"}
_LANGUAGE = re.compile(r"(?i)\b(?:language|lang|brush)[-:]\s*([\w+#-]+)")


class _Markdown(HTMLParser):
    """Builds Markdown from tag events: an element's parts are gathered in a frame and wrapped when it ends.

    Fences and formulas are set aside as numbered tokens, so that folding white
    space leaves them alone. Elements left open end with their parent.
    """

    def __init__(self, page: str, url: str | None, dropped: set[str]):
        super().__init__(convert_charrefs=True)
        self.url, self.dropped = url, dropped
        self.lines = list(accumulate((len(x) for x in page.split("\n")), lambda a, n: a + n + 1, initial=0))
        self.frames = [("", {}, [], 0)]  # tag, attributes, parts, where the content starts
        self.skipped, self.kept, self.contents = [], [], {}
        self.feed(page)
        self.close()
        while len(self.frames) > 1:
            self._end(len(page))

    def _offset(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _inside(self, *tags: str) -> bool:
        return any(f[0] in tags for f in self.frames)

    def _set_aside(self, text: str) -> str:
        self.kept.append(text)
        return f"\0{len(self.kept) - 1}\0"

    def _link(self, target: str | None) -> str:
        target = (target or "").strip()
        return urljoin(self.url, target) if self.url else target

    def handle_starttag(self, tag, attrs):
        if self.skipped:
            if tag == "body" and self.skipped == ["head"]:
                self.skipped = []  # a head that never ended
            else:
                self.skipped += [tag] * (tag == self.skipped[0])
                return
        attrs = dict(attrs)
        if tag in self.dropped:
            self.skipped = [tag]
        elif tag in VOID:
            self.frames[-1][2].append({"br": "\n", "hr": "\n\n---\n\n", "img": f"![]({self._link(attrs.get('src'))})" if attrs.get("src") else ""}.get(tag, " "))
        else:
            if tag in ("li", "tr", "dd", "dt", "p") and self.frames[-1][0] == tag:
                self._end(self._offset())  # these end where the next of them begins
            self.frames.append((tag, attrs, [], self._offset() + len(self.get_starttag_text() or "")))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.skipped:
            if tag == self.skipped[0]:
                self.skipped.pop()
        elif self._inside(tag):
            while self.frames[-1][0] != tag:
                self._end(self._offset())
            self._end(self._offset())

    def handle_data(self, data):
        if not self.skipped:
            self.frames[-1][2].append(data)

    def _end(self, at: int) -> None:
        tag, attrs, parts, start = self.frames.pop()
        text = "".join(parts)
        if tag in ("main", "article", "body") and (tag == "body" or at - start > LEAST_MAIN):
            self.contents.setdefault(tag, text)
        self.frames[-1][2].append(self._wrapped(tag, attrs, text))

    def _wrapped(self, tag: str, attrs: dict, text: str) -> str:
        if tag == "math" or self._inside("math"):
            if tag == "annotation" and "tex" in (attrs.get("encoding") or ""):
                return f"\0tex\0{text.strip()}\0tex\0"
            if tag != "math" or "\0tex\0" not in text:
                return text
            mark = "$$" if attrs.get("display") == "block" else "$"
            return self._set_aside(mark + text.split("\0tex\0")[1] + mark)
        if tag == "pre":
            code = re.sub(r"\r\n?", "\n", text)
            named = re.search("\1([\\w+#-]*)\1", code) or _LANGUAGE.search(attrs.get("class") or "")
            code = re.sub(r"(?m)[ \t]+$", "", re.sub("\1[\\w+#-]*\1", "", code)).strip("\n")
            return self._set_aside(f"\n\n```{named[1].lower() if named else ''}\n{code}\n```\n\n")
        if self._inside("pre"):
            found = _LANGUAGE.search(attrs.get("class") or "") if tag == "code" else None
            return f"\1{found[1]}\1{text}" if found else text
        if self._inside("a", "code"):
            return text  # plain inside links and code
        if tag in MARKS:
            return MARKS[tag] + text.strip() + MARKS[tag]
        if tag == "a":
            return f"[{text.strip()}]({self._link(attrs['href'])})" if attrs.get("href") else text
        if tag == "code":
            return f"`{text.strip()}`"
        if tag == "li":
            return f"\n- {text.strip()}"
        if tag == "blockquote":
            return "\n\n> " + text.strip().replace("\n", "\n> ") + "\n\n"
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            return f"\n\n{'#' * int(tag[1])} {text.strip()}\n\n"
        if tag in BLOCKS:
            return f"\n\n{text}\n\n"
        return f"\n{text}\n" if tag in LINES else text

    def markdown(self) -> str:
        """The first main, else article, with enough markup, else the body, else everything."""
        text = next((self.contents[t] for t in ("main", "article", "body") if t in self.contents), "".join(self.frames[0][2]))
        text = re.sub(r"[\t\x0b\f\r \xa0]+", " ", text)
        text = re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", text))
        text = re.sub(r"(?m)^- \n", "", text)
        text = re.sub(r"\0(\d+)\0", lambda m: self.kept[int(m[1])], text)
        return re.sub(r"\n{3,}", "\n\n", text).strip()


def _converted(page: str | None, url: str | None, dropped: set[str]) -> str:
    return _Markdown(re.sub(r"[\0\1]", "", page), url, dropped).markdown() if page else ""


def to_markdown(page: str | None, url: str | None = None) -> str:
    """Markdown of a page's main content; navigation and forms are paragraphs like others."""
    return _converted(page, url, DROPPED)


def dom_markdown(page: str | None, url: str | None = None, most: int = 200_000) -> str:
    """As ``to_markdown`` without navigation and forms, at most ``most`` characters."""
    return _converted(page, url, DROPPED | CHROME)[:most]


def markdown(pages: DataFrame, parser=to_markdown) -> DataFrame:
    """``page_id, url, markdown`` of every page."""

    @F.pandas_udf("string")
    def convert(page, url):
        import pandas as pd

        return pd.Series([parser(p, u) for p, u in zip(page, url, strict=True)], dtype=object)

    return pages.select("page_id", "url", convert("html", "url").alias("markdown"))


def plain_text(html: Column) -> Column:
    """Text of the body without markup, by built-in expressions only."""
    s = F.regexp_replace(html, "(?s)<!--.*?-->", " ")
    s = F.regexp_replace(s, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1>", " ")
    return F.trim(F.regexp_replace(decode_entities(F.regexp_replace(s, "<[^>]+>", " ")), r"\s+", " "))


def furniture(blocks: DataFrame) -> DataFrame:
    """Blocks of pages with ``furniture``: short marginal blocks whose digit-masked text recurs on many pages.

    ``blocks``: doc_id, page, block_id, text, top, bottom (shares of the page's height).
    """
    key = F.regexp_replace(F.regexp_replace(F.lower(F.trim("text")), r"\d+", "#"), r"\s+", " ")
    marginal = (F.char_length("text") <= 100) & (F.trim("text") != "") & ((F.col("bottom") <= 0.1) | (F.col("top") >= 0.9))
    keyed = blocks.withColumn("_key", F.when(marginal, key))
    pages = blocks.groupBy("doc_id").agg(F.count_distinct("page").alias("_pages"))
    often = keyed.filter("_key is not null").groupBy("doc_id", "_key").agg(F.count_distinct("page").alias("_on")).join(pages, "doc_id")
    often = often.filter(F.col("_on") >= F.greatest(F.lit(3), F.ceil(F.col("_pages") * 0.6))).select("doc_id", "_key", F.lit(True).alias("_f"))
    return keyed.join(often, ["doc_id", "_key"], "left").withColumn("furniture", F.coalesce("_f", F.lit(False))).drop("_key", "_f")


def ocr_lines(words: DataFrame) -> DataFrame:
    """``page, line, text, confidence``: words of a line joined, confidence weighted by length."""
    n = F.char_length("word")
    used = words.filter((F.trim("word") != "") & (F.col("conf") >= 0))
    ordered = F.array_sort(F.collect_list(F.struct("place", "word")))
    return used.groupBy("page", "line").agg(F.array_join(F.transform(ordered, lambda x: x.word), " ").alias("text"), F.round(F.try_divide(F.sum(F.col("conf") * n), F.sum(n)), 6).alias("confidence"))


def layout_sizes(lines: DataFrame) -> DataFrame:
    """``doc_id, body_size, line_gap``: the font size of most characters, and the nearest-rank 40th percentile of the gaps between lines.

    ``lines``: doc_id, size, chars, gap (null before a page's first line).
    """
    from loreweave.operators import rank

    sizes = lines.groupBy("doc_id", "size").agg(F.sum("chars").alias("_n")).groupBy("doc_id").agg(F.max_by("size", F.struct("_n", -F.col("size"))).alias("body_size"))
    gaps = rank.nearest_rank(lines.filter("gap is not null").select("doc_id", "gap"), ["doc_id"], "gap", 40).withColumnRenamed("percentile", "line_gap")
    return sizes.join(gaps, "doc_id", "left")
