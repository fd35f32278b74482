"""A knowledge base's own records: unions of its kinds, lists, searches inside texts, status, routing of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.operators import evidence

# Kinds of sources, terms of a prefilter, hits inside a text and characters around one, characters of one reading.
KINDS = ["note", "quick_ref", "file"]
MOST_TERMS, MOST_WINDOWS, MOST_COUNTED, AROUND, READ_CHARS, SEARCH_PREFIX = 10, 5, 200, 220, 8000, 1200
# Patterns that route questions, and words that carry no topic.
ALL_CORPUS = r"(?:全部|所有)(?:知识(?:库)?(?=$|[\s\p{P}]|的|中|里|总体|整体|主题|方向|概览|全貌|脉络|覆盖|涵盖|总结|梳理)|笔记|资料)"
CORPUS_SCOPE = f"(我的|这些|所有|整个|{ALL_CORPUS}|全库|知识库|笔记|资料|最近|这段时间).*(主题|方向|整体|概览|全貌|脉络|学了|覆盖|涵盖|总结|梳理)|(主题|方向|整体|概览|总结|梳理).*(知识库|{ALL_CORPUS})|(?i)(whole|entire|all).*(knowledge|notes|corpus|dataset)"
SPECIFIC_DETAIL = "区别|关系|差异|不同|优缺点|依赖|属于|包含|怎么|如何|为什么|步骤|实现|(?i)difference|how to"
EXPLICIT_OVERVIEW = "整个知识库|所有笔记|全部资料|全库|知识库整体|知识库概览|知识库全貌|笔记整体|主要主题|主要方向|学了什么|学了哪些"
QUERY_STOP_WORDS = [
    "这段时间", "知识库", "所有笔记", "全部资料", "有哪些", "哪些方面", "学了什么", "学了哪些", "帮我", "请问", "我的", "笔记", "资料", "这些", "这个", "这块", "最近", "整体", "总体", "大致", "概览", "总结", "梳理", "涵盖", "脉络", "哪些", "什么", "方向", "方面", "主要", "涉及",
    "学习内容", "讲些什么", "讲什么", "在讲", "在学", "东西", "内容", "记录", "全库", "目前", "现在", "学习", "覆盖", "主题", "领域", "相关", "一下", "帮忙", "怎么", "如何", "请", "我", "都", "了", "的",
    "overview", "summarize", "main themes", "my notes", "knowledge base", "what", "which", "topics", "overall", "are", "the", "in", "of", "and",
]
DETAIL_REQUEST = "如何|怎么|怎样|分别|以及|同时|示例|代码|步骤|区别|解释|说明|哪些|(?:有什么|有何|之间的)(?:关系|联系)|并(?:给出|说明|解释|比较)"
SUBJECT, MOST_SUBJECTS, COVERED = "([A-Za-z][A-Za-z0-9_.$-]{1,39})", 8, 6


def _blank(c) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


# --- sources


def union_sources(notes: DataFrame, refs: DataFrame, files: DataFrame) -> DataFrame:
    """The three kinds as ``source_type, source_id, title, category, content, updated``; usable ones with content.

    Notes and quick references: id, title, category, content, updated; files: id,
    name, category, summary, text, text_status, updated.
    """
    plain = lambda df, kind: df.select(F.lit(kind).alias("source_type"), F.col("id").cast("long").alias("source_id"), "title", "category", "content", "updated")
    summary = F.coalesce("summary", F.lit(""))
    body = F.concat(summary, F.when(summary == "", "").otherwise("\n"), F.coalesce("text", F.lit("")))
    f = files.filter("text_status = 'ok'").select("id", F.col("name").alias("title"), "category", body.alias("content"), "updated")
    return plain(notes, "note").unionByName(plain(refs, "quick_ref")).unionByName(plain(f, "file")).filter(F.coalesce("content", F.lit("")) != "")


def fetch(sources: DataFrame, wanted: DataFrame) -> DataFrame:
    """The present sources of stated keys (source_type, source_id); kinds that are not known give nothing."""
    return sources.join(wanted.filter(F.col("source_type").isin(KINDS)).distinct(), ["source_type", "source_id"], "left_semi")


def versions(sources: DataFrame) -> DataFrame:
    """Content hash, length and latest change of every source."""
    c = F.coalesce("content", F.lit(""))
    return sources.select("source_type", "source_id", F.sha2(c, 256).alias("version"), F.char_length(c).alias("chars"), "updated")


def in_folder(rows: DataFrame, folder: int | None = None, category: str | None = None, column: str = "folder_id") -> DataFrame:
    """All rows without a folder given, those filed nowhere for 0, else those of the folder; and of the category."""
    out = rows
    if folder is not None:
        out = out.filter(F.col(column).isNull() if folder == 0 else F.col(column) == folder)
    return out if category is None else out.filter(F.col("category") == category)


def any_term(rows: DataFrame, columns: list[str], terms: list[str]) -> DataFrame:
    """Rows one of whose columns holds one of the ten longest terms; nothing is cut before the search."""
    longest = sorted(dict.fromkeys(t.lower() for t in terms if t), key=lambda t: (-len(t), t))[:MOST_TERMS]
    if not longest:
        return rows.limit(0)
    low = F.lower(F.concat_ws("\n", *columns))
    return rows.filter(F.exists(F.array(*map(F.lit, longest)), lambda t: F.contains(low, t)))


def file_search(files: DataFrame, word: str, most: int) -> DataFrame:
    """Files whose name, summary or text holds the word, newest first, with the beginning of their text."""
    w = F.lit(word.lower())
    hit = F.contains(F.lower("name"), w) | F.contains(F.lower(F.coalesce("summary", F.lit(""))), w) | F.contains(F.lower(F.coalesce("text", F.lit(""))), w)
    return files.filter(hit).orderBy(F.desc("updated"), F.desc("id")).limit(most).withColumn("text", F.substring("text", 1, SEARCH_PREFIX))


def occurrences(text: Column, needle: str) -> Column:
    """``hits`` (counted to 200) and the ``windows`` around the first five of a word, whatever its case, white space folded."""
    low, word, n = F.lower(F.coalesce(text, F.lit(""))), needle.lower(), len(needle)
    count = F.floor((F.char_length(low) - F.char_length(F.replace(low, F.lit(word), F.lit("")))) / n)
    places, at = [], F.locate(word, low)
    for _ in range(MOST_WINDOWS):
        places.append(at)
        at = F.when(at > 0, F.expr("0") + F.position(F.lit(word), low, at + n)).otherwise(0)
    fold = lambda p: F.trim(F.regexp_replace(F.substr(text, F.greatest(p - AROUND, F.lit(1)), p - F.greatest(p - AROUND, F.lit(1)) + n + AROUND), r"\s+", " "))
    windows = F.transform(F.filter(F.array(*places), lambda p: p > 0), fold)
    return F.struct(F.least(count, F.lit(MOST_COUNTED)).cast("int").alias("hits"), windows.alias("windows"))


def read_at(text: Column, offset: int, chars: int = READ_CHARS) -> Column:
    """``part`` of a text from an offset (0: its begin) and ``next_offset``, null at its end."""
    end = offset + chars
    return F.struct(F.substring(text, offset + 1, chars).alias("part"), F.when(F.char_length(text) > end, end).alias("next_offset"))


# --- status


def file_fingerprint(files: DataFrame) -> DataFrame:
    """Number, largest identifier, usable ones and their characters, by colons."""
    parts = [F.count("*"), F.coalesce(F.max("id"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("text_status") == "ok", 1).otherwise(0)), F.lit(0)), F.coalesce(F.sum("text_chars"), F.lit(0))]
    return files.agg(F.concat_ws(":", *[p.cast("string") for p in parts]).alias("fingerprint"))


def index_status(chunks: DataFrame, sources: DataFrame, states: DataFrame, space: str) -> DataFrame:
    """One row on the index: chunks, characters, sources, models, spaces, compatible and legacy chunks, whether it is stale.

    ``chunks``: source_type, source_id, char_len, model, embedding_space, dim, vec;
    ``sources``: source_type, source_id, version; ``states``: the same of the last
    indexing, with embedding_space.
    """
    fits = (F.col("embedding_space") == space) & (F.size("vec") == F.col("dim"))
    c = chunks.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("char_len"), F.lit(0)).alias("chars"), F.count_distinct("source_type", "source_id").alias("sources"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"), F.array_join(F.array_sort(F.collect_set(F.when(~_blank(F.col("embedding_space")), F.col("embedding_space")))), ",").alias("spaces"), F.count_if(F.coalesce(fits, F.lit(False))).alias("compatible"), F.count_if(_blank(F.col("embedding_space"))).alias("legacy"))
    now, old = sources.select("source_type", "source_id", F.col("version").alias("_now")), states.select("source_type", "source_id", F.col("version").alias("_old"), "embedding_space")
    moved = now.join(old, ["source_type", "source_id"], "full").filter(~F.col("_now").eqNullSafe(F.col("_old")) | ~F.coalesce(F.col("embedding_space") == space, F.lit(False))).agg(F.count("*").alias("changed"))
    out = c.crossJoin(F.broadcast(moved))  # one row each
    return out.withColumn("stale", (F.col("chunks") == 0) | (F.col("compatible") != F.col("chunks")) | (F.col("changed") > 0))


def queue_state(queue: DataFrame, recent: int = 100) -> tuple[DataFrame, DataFrame]:
    """Rows by state, and the latest ``recent`` rows."""
    return queue.groupBy("state").agg(F.count("*").alias("n")), queue.orderBy(F.desc("id")).limit(recent)


def import_plan(files: DataFrame, known: DataFrame, most_files: int = 2000, most_bytes: int = 24 * 1024 * 1024) -> DataFrame:
    """``path, action``: what an import of a repository does with each file (repo, path, text).

    Rejected files say why. The others, by path, are added, updated or unchanged
    against ``known`` (repo, path, hash) while the limits on files and bytes of a
    repository last; what is beyond says so.
    """
    from loreweave.operators import code

    why = code.reject_reason(F.col("path"), F.col("text"))
    j = files.withColumn("_why", why).withColumn("_hash", F.sha2(F.coalesce("text", F.lit("")), 256)).join(known.select("repo", "path", F.col("hash").alias("_old")), ["repo", "path"], "left")
    order = Window.partitionBy("repo", F.col("_why").isNull()).orderBy("path")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("_n", F.row_number().over(order)).withColumn("_bytes", F.sum(F.octet_length(F.coalesce("text", F.lit("")))).over(run))
    action = F.when(F.col("_why").isNotNull(), F.col("_why")).when((F.col("_n") > most_files) | (F.col("_bytes") > most_bytes), "over the limit").when(F.col("_old").isNull(), "added").when(F.col("_old") == F.col("_hash"), "unchanged").otherwise("updated")
    return j.select("repo", "path", action.alias("action"))


# --- questions and dates


def is_corpus_question(question: Column) -> Column:
    """Whether a question is about the whole corpus: by its scope, unless it asks a detail, or by a cue."""
    low = F.lower(F.trim(F.coalesce(question, F.lit(""))))
    scope = low.rlike(CORPUS_SCOPE)
    return F.when(low == "", False).when(low.rlike(SPECIFIC_DETAIL), scope & low.rlike(EXPLICIT_OVERVIEW)).otherwise(scope | evidence.is_global(question))


def topic_terms(question: Column) -> Column:
    """What is left of a question without its scope and its stop words, in distinct runs of two characters or more."""
    q = F.regexp_replace(F.lower(F.coalesce(question, F.lit(""))), ALL_CORPUS, " ")
    for word in QUERY_STOP_WORDS:
        q = F.regexp_replace(q, rf"\b{word}\b", " ") if word.isascii() else F.replace(q, F.lit(word), F.lit(" "))
    return F.array_distinct(F.filter(F.split(q, r"[^\p{L}\p{N}+#.]+"), lambda t: F.char_length(t) >= 2))


def needs_evidence(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """``question_id, check_needed``: no hits, a request for details, or two subjects of which the first six hits lack one.

    ``hits``: question_id, rank, text (with its heading).
    """
    six = hits.filter(F.col("rank") <= COVERED).groupBy("question_id").agg(F.lower(F.array_join(F.collect_list("text"), "\n")).alias("_seen"))
    subjects = F.slice(F.array_distinct(F.transform(F.regexp_extract_all("question", F.lit(SUBJECT), F.lit(1)), F.lower)), 1, MOST_SUBJECTS)
    q = questions.withColumn("_s", subjects).join(six, "question_id", "left")
    lacking = (F.size("_s") >= 2) & F.exists("_s", lambda s: ~F.contains(F.col("_seen"), s))
    return q.select("question_id", (F.col("_seen").isNull() | F.col("question").rlike(DETAIL_REQUEST) | F.coalesce(lacking, F.lit(False))).alias("check_needed"))


def activity_of_year(days: DataFrame, year: int, today: int) -> tuple[DataFrame, DataFrame]:
    """The days of a year with their counts, and one row: active days, total, largest count. A year beyond 1970 to 9999 is ``today``.

    ``days``: day (date), one row for each activity.
    """
    year = year if 1970 <= year <= 9999 else today
    inside = days.filter((F.col("day") >= F.make_date(F.lit(year), F.lit(1), F.lit(1))) & (F.col("day") < F.make_date(F.lit(year + 1), F.lit(1), F.lit(1))))
    counts = inside.groupBy("day").agg(F.count("*").alias("n"))
    return counts, counts.agg(F.count("*").alias("active_days"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))


def backfill_activity(sources: DataFrame) -> DataFrame:
    """``source_type, source_id, day``: the days on which sources (created, updated) came and last changed, once each."""
    one = lambda c: sources.select("source_type", "source_id", F.to_date(c).alias("day"))
    return one("created").unionByName(one("updated")).filter("day is not null").distinct()
