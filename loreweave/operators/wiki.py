"""Derived pages as a route to sources: eligible pages, subjects of questions, section and source channels, snapshots, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.functions import text
from loreweave.operators import rank

# Kinds of eligible pages; words and framings of questions that name no subject; cues of gaps, definitions and relations.
TYPES = ["category", "tag", "entity"]
FILLERS = [
    "关系", "区别", "之间", "两者", "有哪些", "有什么", "的关", "的区", "么关", "么区", "相关", "总体", "主要", "内容", "what", "which", "how", "why", "does", "is", "are", "the", "and", "with", "explain", "define", "describe", "compare", "comparison", "difference",
    "differences", "relation", "relationship", "between", "versus", "can", "could", "should", "do", "in", "to", "of", "for", "as", "or", "an", "on", "about", "please", "gaps", "gap", "use", "using", "tell", "me", "work", "works",
]
MODIFIERS = ["application", "applications", "protocol", "protocols", "model", "models", "system", "systems", "framework", "frameworks", "concept", "concepts", "example", "examples"]
FRAMING = (
    "(?:有什么|有何|是什么)(?:关系|区别|联系|关联)|(?:之间|两者)(?:的)?(?:关系|区别|联系|关联)|(?:到底|究竟|具体)?(?:是什么|指什么|是啥|什么意思)|什么是|(?:有什么|有何)(?:作用|用途|优点|缺点|特点|优势)"
    "|(?:的)?(?:工作原理|基本原理|工作方式|工作流程|主要特点)|(?:如何|怎么)(?:样)?(?:使用|工作)?|为什么|为何|有哪些|有什么|请问|(?:请|帮我)(?:介绍|解释|说明)|关于|哪些|什么"
)
GAP_QUERY = r"(?i)缺口|知识空白|待补充|待完善|待补全|待整理|需要(?:补充|完善)|尚未覆盖|未覆盖(?:的)?(?:知识|主题|内容)|\bgaps?\b|\bmissing (?:knowledge|coverage)\b"
GAP_SECTION = r"(?i)待补充|知识缺口|待完善|待补全|知识空白|待整理|尚未覆盖|\b(?:knowledge\s+)?gaps?\b|\bto be completed\b"
DEFINITION = r"(?i)是什么|什么是|指什么|是啥|什么意思|\b(?:what\s+(?:is|are)|define|explain)\b"
RELATION = r"(?i)关系|区别|对比|比较|异同|联系|关联|\b(?:relationships?|relations?|compare|comparison|contrast|differences?|versus|vs)\b"
# Hits and sources of a question at most, characters and sections of one reading, the bonus of a named subject.
MOST_HITS, MOST_SOURCES, READ_CHARS, READ_SECTIONS, NAMED = 24, 24, 4000, 24, 1000
# Shape of the compact hash of a page's sources; score, pages and header of the legacy block.
HASH_PREFIX, HASH_CHARS, LEAST_SCORE, LEGACY_PAGES, LEGACY_HEAD = "src:", 64, 3, 2, 200
#: Questions that meet all sections in one pass; the size of what is broadcast.
ROUND = 2_000


def _blank(c) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def eligible(pages: DataFrame) -> DataFrame:
    """Pages of a known kind and good quality that have a key and a body."""
    return pages.filter(F.col("topic_type").isin(TYPES) & (F.col("quality") == "ok") & ~_blank(F.col("topic_key")) & ~_blank(F.col("content")))


def query_terms(question: Column) -> Column:
    """Retrieval terms of a question without its framing and its fillers."""
    found = text.retrieval_terms(F.regexp_replace(F.coalesce(question, F.lit("")), FRAMING, " "))
    return F.filter(found, lambda t: ~F.lower(t).isin(FILLERS))


def subject_terms(terms: Column) -> Column:
    """Of the terms those that name a subject: identifiers (specific ones if there are), else three-character grams, else all."""
    explicit = F.filter(terms, lambda t: t.rlike("^[A-Za-z][A-Za-z0-9_.+#-]*$"))
    specific = F.filter(explicit, lambda t: ~F.lower(t).isin(MODIFIERS))
    triples = F.filter(terms, lambda t: t.rlike("^[\\u4e00-\\u9fa5]{3}$"))
    return F.when(F.size(specific) > 0, specific).when(F.size(explicit) > 0, explicit).when(F.size(triples) > 0, triples).otherwise(terms)


def names_subject(subjects: Column, target: Column) -> Column:
    """Whether a text names one of the subjects; identifiers count as whole words only."""
    low = F.lower(F.coalesce(target, F.lit("")))

    def stands(s: Column) -> Column:
        s = F.lower(s)
        word = F.rlike(low, F.concat(F.lit("(?<![a-z0-9_])\\Q"), s, F.lit("\\E(?![a-z0-9_])")))
        return F.contains(low, s) & (~s.rlike("^[a-z][a-z0-9_.+#-]*$") | word)

    return F.exists(subjects, stands)


def asked(questions: DataFrame) -> DataFrame:
    """``question_id, terms, subjects, gap, definition`` of questions that have a term."""
    q = questions.select("question_id", F.col("question"), query_terms(F.col("question")).alias("terms"))
    defines = F.col("question").rlike(DEFINITION) & ~F.col("question").rlike(RELATION)
    return q.filter(F.size("terms") > 0).select("question_id", "terms", subject_terms(F.col("terms")).alias("subjects"), F.col("question").rlike(GAP_QUERY).alias("gap"), defines.alias("definition"))


def section_channel(sections: DataFrame, questions: DataFrame, most: int = MOST_HITS) -> DataFrame:
    """``question_id, page_id, section, score, rank``: sections of fresh pages for questions.

    ``sections``: page_id, topic_key, section (its place), names (title and
    aliases), heading, body. Gap sections answer gap questions only; a definition
    needs the subject in names or heading, any other question anywhere. A term
    counts 3 in the body, 6 in the heading, 3 in the names; a page that is named
    comes first. The best section of each page, then second ones.
    """
    said = sections.filter(~_blank(F.col("body")))
    none = F.lit("")

    def met(some: DataFrame) -> DataFrame:
        j = said.crossJoin(F.broadcast(some))
        named = names_subject(F.col("subjects"), F.col("names"))
        j = j.filter((F.col("gap") | ~F.col("heading").rlike(GAP_SECTION)) & (~F.col("definition") | named | names_subject(F.col("subjects"), F.col("heading"))))
        j = j.filter(names_subject(F.col("subjects"), F.concat_ws("\n", "names", "heading", "body")))
        score = 3 * text.lexical_score(F.col("terms"), none, F.col("body")) + 2 * text.lexical_score(F.col("terms"), F.col("heading"), none) + text.lexical_score(F.col("terms"), F.col("names"), none)
        return j.withColumn("score", score).filter("score > 0").withColumn("score", F.col("score") + F.when(named, NAMED).otherwise(0)).select("question_id", "page_id", "topic_key", "section", "score")

    hits = rank.in_rounds(asked(questions), "question_id", ROUND, met)
    order = [F.desc("score"), F.col("topic_key"), F.col("section")]
    two = rank.top(hits, ["question_id", "page_id"], order, 2, "_n")
    return rank.top(two, ["question_id"], [F.col("_n"), *order], min(most, MOST_HITS)).select("question_id", "page_id", "section", "score", "rank")


def located_sources(found: DataFrame, questions: DataFrame, passages: DataFrame, most: int = MOST_HITS) -> DataFrame:
    """``question_id, source_type, source_id, seq, score, rank``: passages of the sources that a question's sections cite.

    ``found``: question_id, rank, heading, title, refs (``type-id``); ``passages``:
    source_type, source_id, seq, title, heading, body. The first 24 sources count.
    A passage must name the question's subject or a page's; a question's term
    counts 3 in the passage, a heading's term 2, a question's term in the title 3.
    The best passage of each source, then second ones.
    """
    cited = found.select("question_id", "rank", "heading", "title", F.posexplode("refs").alias("_i", "ref"))
    per = cited.groupBy("question_id", "ref").agg(F.min(F.struct("rank", "_i")).alias("_at"), F.array_join(F.array_sort(F.collect_set("heading")), " ").alias("_h"), F.array_join(F.array_sort(F.collect_set("title")), " ").alias("_t"))
    per = rank.top(per, ["question_id"], [F.col("_at"), F.col("ref")], MOST_SOURCES, "_n").select("question_id", "ref", F.concat_ws(" ", "_h", "_t").alias("_heads"), "_t")
    q = asked(questions).join(per, "question_id")
    titles = F.when(_blank(F.col("_t")), F.array().cast("array<string>")).otherwise(subject_terms(query_terms(F.col("_t"))))
    q = q.select("question_id", "ref", "terms", query_terms(F.col("_heads")).alias("_hterms"), F.array_union("subjects", titles).alias("subjects"))
    p = passages.withColumn("ref", F.concat_ws("-", "source_type", F.col("source_id").cast("string"))).withColumn("_b", F.concat_ws("\n", F.coalesce("heading", F.lit("")), F.coalesce("body", F.lit(""))))
    j = p.join(q, "ref").filter(names_subject(F.col("subjects"), F.concat_ws("\n", "title", "_b")))
    none = F.lit("")
    score = 3 * text.lexical_score(F.col("terms"), none, F.col("_b")) + 2 * text.lexical_score(F.col("_hterms"), none, F.col("_b")) + text.lexical_score(F.col("terms"), F.col("title"), none)
    hits = j.withColumn("score", score).filter("score > 0")
    two = rank.top(hits, ["question_id", "source_type", "source_id"], [F.desc("score"), F.col("seq")], 2, "_n")
    key = F.concat_ws(":", "source_type", F.col("source_id").cast("string"), F.col("seq").cast("string"))
    return rank.top(two, ["question_id"], [F.col("_n"), F.desc("score"), key], min(most, MOST_HITS)).select("question_id", "source_type", "source_id", "seq", "score", "rank")


def read_whole(sections: DataFrame, budget: int = READ_CHARS) -> DataFrame:
    """The sections of each reading (reader, rank, body) that fit whole, two characters between them; those that do not are skipped."""
    return rank.budget_skip(sections.withColumn("_cost", F.char_length("body") + 2), ["reader"], "_cost", budget + 2, most=READ_SECTIONS).drop("_cost")


def legacy_pages(pages: DataFrame, questions: DataFrame, budget: int) -> DataFrame:
    """``question_id, page_id, rank``: at most two pages a question, named ones first, then by score, then the shorter; stops at the budget.

    ``pages``: page_id, title, content, entry (what a page adds to the block).
    """
    q = questions.select("question_id", text.retrieval_terms(F.col("question")).alias("terms")).filter(F.size("terms") > 0)

    def met(some: DataFrame) -> DataFrame:
        j = pages.filter(~_blank(F.col("content"))).crossJoin(F.broadcast(some))
        return j.select("question_id", "page_id", text.lexical_score(F.col("terms"), F.col("title"), F.lit("")).alias("_t"), text.lexical_score(F.col("terms"), F.col("title"), F.col("content")).alias("_s"), F.char_length("content").alias("_n"), F.char_length("entry").alias("_cost")).filter(F.col("_s") >= LEAST_SCORE)

    ranked = rank.top(rank.in_rounds(q, "question_id", ROUND, met), ["question_id"], [F.desc("_t"), F.desc("_s"), F.col("_n"), F.col("page_id")], LEGACY_PAGES)
    return rank.budget_stop(ranked, ["question_id"], "_cost", budget - LEGACY_HEAD).select("question_id", "page_id", "rank")


# --- snapshots and fingerprints


def snapshot(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks of sources (source_type, source_id, title, content) with the hashes that a page depends on.

    ``chunks``: source_type, source_id, seq, heading, chunk_text.
    """
    key = ["source_type", "source_id"]
    c = chunks.select(*key, "seq", "heading", "chunk_text", F.sha2("chunk_text", 256).alias("chunk_hash"), F.count("*").over(Window.partitionBy(*key)).alias("chunk_count"))
    s = sources.filter(~_blank(F.col("content"))).select(*key, "title", F.sha2("content", 256).alias("content_hash"), F.char_length("content").alias("source_chars"))
    return s.join(c, key)


def _row_hash() -> Column:
    return F.sha2(F.concat_ws("\x01", "source_type", F.col("source_id").cast("string"), "title", "content_hash", F.col("seq").cast("string"), "heading", "chunk_hash"), 256)


def dependencies(taken: DataFrame, wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """The dependency rows of pages: the snapshot rows that a page used, each with the page's and the set's hash.

    ``wanted``: page_id, source_type, source_id, seq; ``pages``: page_id,
    page_hash. A page that wants a chunk that the snapshot has not is left out
    (its capture is not complete).
    """
    key = ["source_type", "source_id", "seq"]
    used = wanted.distinct().join(taken, key, "left")
    whole = used.groupBy("page_id").agg(F.bool_and(F.col("chunk_hash").isNotNull()).alias("_ok"), F.sha2(F.array_join(F.array_sort(F.collect_list(_row_hash())), ""), 256).alias("snapshot_hash"))
    return used.join(whole.filter("_ok").drop("_ok"), "page_id").join(pages, "page_id")


def dependency_states(pages: DataFrame, deps: DataFrame, now: DataFrame) -> DataFrame:
    """``page_id, state, reasons``: current, stale, or unknown where the record is missing, legacy or damaged.

    ``pages``: page_id, page_hash, version; ``deps``: rows of ``dependencies``;
    ``now``: a snapshot of the present sources. Of a row the first reason counts:
    page_changed, source_missing, source_changed, chunk_changed.
    """
    key = ["source_type", "source_id"]
    sound = F.col("source_id").isNotNull() & (F.col("seq") >= 0) & (F.col("seq") < F.col("chunk_count")) & (F.col("source_chars") > 0) & ~_blank(F.col("chunk_text")) & (F.sha2("chunk_text", 256) == F.col("chunk_hash")) & F.col("content_hash").rlike("^[0-9a-f]{64}$")
    check = deps.groupBy("page_id").agg(F.bool_and(F.coalesce(sound, F.lit(False))).alias("_sound"), F.count_distinct("snapshot_hash").alias("_n"), F.min("snapshot_hash").alias("_kept"), F.sha2(F.array_join(F.array_sort(F.collect_list(_row_hash())), ""), 256).alias("_made"))
    check = check.select("page_id", (F.col("_sound") & (F.col("_n") == 1) & (F.col("_kept") == F.col("_made"))).alias("_whole"))
    s = now.select(*key, F.col("title").alias("_title"), F.col("content_hash").alias("_content")).distinct()
    c = now.select(*key, "seq", F.col("heading").alias("_heading"), F.col("chunk_hash").alias("_chunk"))
    j = deps.withColumnRenamed("page_hash", "_page").join(pages.select("page_id", "page_hash"), "page_id").join(s, key, "left").join(c, [*key, "seq"], "left")
    why = F.when(F.col("_page") != F.col("page_hash"), "page_changed").when(F.col("_content").isNull(), "source_missing").when((F.col("_content") != F.col("content_hash")) | (F.col("_title") != F.col("title")), "source_changed")
    why = why.when(F.col("_chunk").isNull() | (F.col("_chunk") != F.col("chunk_hash")) | (F.col("_heading") != F.col("heading")), "chunk_changed")
    reasons = j.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_set(why)), ",").alias("_why"))
    out = pages.join(check, "page_id", "left").join(reasons, "page_id", "left")
    missing = F.when(F.coalesce("version", F.lit(0)) >= 2, "dependency_record_missing").otherwise("legacy_no_dependencies")
    state = F.when(F.col("_whole").isNull() | ~F.col("_whole"), "unknown").when(F.col("_why") == "", "current").otherwise("stale")
    return out.select("page_id", state.alias("state"), F.when(F.col("_whole").isNull(), missing).when(~F.col("_whole"), "dependency_record_invalid").otherwise(F.col("_why")).alias("reasons"))


def compact_sources(codes: Column) -> Column:
    """The sorted codes of a page's sources behind a prefix, as many whole ones as 64 characters hold; null if none."""
    start = F.struct(F.lit(HASH_PREFIX).alias("s"), F.lit(False).alias("done"))

    def step(acc: Column, code: Column) -> Column:
        longer = F.concat(acc["s"], F.when(acc["s"] == HASH_PREFIX, "").otherwise(","), code)
        fits = ~acc["done"] & (F.char_length(longer) <= HASH_CHARS)
        return F.struct(F.when(fits, longer).otherwise(acc["s"]).alias("s"), (~fits).alias("done"))

    made = F.aggregate(F.array_sort(F.array_distinct(F.array_compact(codes))), start, step)["s"]
    return F.when(made != HASH_PREFIX, made)


def order_free_hash(lines: Column) -> Column:
    """An aggregate that hashes a set of lines whatever their order: sums of four parts of each line's digest combine map-side."""
    digest = F.sha2(lines, 256)
    parts = [F.coalesce(F.sum(F.conv(F.substring(digest, at, 8), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string") for at in (1, 9, 17, 25)]
    return F.sha2(F.concat_ws(":", *parts, F.count("*").cast("string")), 256)


def index_fingerprint(pages: DataFrame) -> DataFrame:
    """One hash of all pages' keys and titles; their texts and their order do not count."""
    return pages.agg(F.concat(F.lit("index-"), F.substring(order_free_hash(F.concat_ws("\x01", "topic_key", "title")), 1, 16)).alias("fingerprint"))


def lint(pages: DataFrame, least: int = 200) -> DataFrame:
    """One row: pages, pages with a warning, pages shorter than ``least``, red links.

    ``pages``: title, quality, content.
    """
    from loreweave.operators import lineage

    n = F.char_length(F.trim(F.coalesce("content", F.lit(""))))
    counts = pages.agg(F.count("*").alias("pages"), F.count_if(F.col("quality") == "warn").alias("warned"), F.count_if(n < least).alias("short"))
    red = lineage.red_links(pages.select("title", F.col("content").alias("markdown"))).agg(F.count("*").alias("red_links"))
    return counts.crossJoin(F.broadcast(red))  # one row each
