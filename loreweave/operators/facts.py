"""Facts stated in texts and training questions about unknown entities made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Forms of a statement, questions asked about it, names of invented entities.
SENTENCE_ENDS = "[\n。；;]"
EQUATION = r"(?dU)^([^=\n]{2,100})\s*[=＝]\s*([^=\n]{2,100})$"
STATEMENT = r"(?dU)^(.{2,80}?)\s*(?:是|为|：|:)\s*(.{2,80})$"
TRAINING_QUESTIONS = ["{}是什么？", "请直接给出{}。", "请告诉我{}。", "查询：{}。", "{}的具体值是什么？", "我想知道{}，请给出答案。"]
EVALUATION_QUESTION = "资料中记载的{}具体是什么？"
UNKNOWN = "不知道"
BENCHMARK_WORDS = ["bench", "基准", "数据集", "测试集", "评测集"]
BENCHMARK_NAMES = ["青禾", "岩溪", "白榆", "溪桥", "晴峪", "竹原", "浮岑", "鹿洲"]
NAMES = ["Aster", "Meridian", "Cedar", "Solstice", "Juniper", "Lumen", "Orchid", "Tamarind"]
CONTRAST_KEY = "train-entity-contrast-v1:"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def letters(c: Column) -> Column:
    """Lower-case letters and digits of a text."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def extract(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, fact_id, subject, answer, statement, entity``: distinct facts that a text states outright.

    A line or sentence of the form ``subject = answer`` is a fact, else one of
    the form ``subject: answer``. Subjects that look like questions or code and
    answers without a letter or digit are no facts. Null texts state none. The
    first statement of a fact counts; only facts are shuffled.
    """
    lines = docs.select(key, F.posexplode(F.split(text, SENTENCE_ENDS)).alias("_at", "_line")).withColumn("_line", _strip(F.col("_line")))
    equal = F.col("_line").rlike(EQUATION)
    part = lambda i: _strip(F.when(equal, F.regexp_extract("_line", EQUATION, i)).otherwise(F.regexp_extract("_line", STATEMENT, i)))
    found = lines.filter(equal | F.col("_line").rlike(STATEMENT)).select(key, "_at", F.col("_line").alias("statement"), part(1).alias("subject"), F.regexp_replace(part(2), "[.!！]+$", "").alias("answer"))
    plain = found.filter(~F.col("subject").rlike("[?？{}<>`]") & ~letters(F.col("answer")).isin("", UNKNOWN))
    first = plain.groupBy(key, "subject", "answer").agg(F.min(F.struct("_at", "statement")).alias("_s"))
    ident = F.substring(F.sha2(F.concat("subject", F.lit("="), "answer"), 256), 1, 16)
    entity = F.when(F.contains(F.col("subject"), F.lit("的")), F.regexp_replace("subject", "(?s)的(?!.*的).*$", ""))
    return first.select(key, ident.alias("fact_id"), "subject", "answer", F.col("_s.statement").alias("statement"), entity.alias("entity"))


def questions(facts: DataFrame) -> DataFrame:
    """``facts`` with ``training_questions`` and ``evaluation_question``."""
    ask = lambda form: F.concat(F.lit(form.partition("{}")[0]), "subject", F.lit(form.partition("{}")[2]))
    return facts.withColumn("training_questions", F.array(*map(ask, TRAINING_QUESTIONS))).withColumn("evaluation_question", ask(EVALUATION_QUESTION))


def contrast_cases(facts: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """``question, entity, replaced_entity, answer, from_fact_id, status``: questions whose entity is swapped for an unknown one.

    ``facts`` have fact_id, entity, training_questions and the ``key`` of their
    document. ``status`` is ``ok`` or the first reason to skip the fact. An
    invented name that stands anywhere in the corpus is not used: all names
    have one shape, so those of the corpus are found in one scan and compared by
    an equi-join. Each question is made once, from the least fact identifier.
    """
    entity = F.coalesce(_strip(F.col("entity")), F.lit(""))
    digest = F.upper(F.sha2(F.concat(F.lit(CONTRAST_KEY), letters(entity), F.lit(":"), F.col("fact_id")), 256))
    at = (F.conv(F.substring(digest, 1, 2), 16, 10).cast("int") % len(NAMES)) + 1
    bench = F.lower(entity).rlike("|".join(BENCHMARK_WORDS))
    name = F.when(bench, F.element_at(F.array(*map(F.lit, BENCHMARK_NAMES)), at)).otherwise(F.element_at(F.array(*map(F.lit, NAMES)), at))
    once = F.filter("training_questions", lambda q: F.size(F.split(q, F.concat(F.lit("\\Q"), entity, F.lit("\\E")), -1)) == 2)
    bodies = docs.select(key, letters(F.coalesce(text, F.lit(""))).alias("_body"))
    cases = facts.withColumn("_asked", F.get(once, F.lit(0))).withColumn("replaced_entity", entity).withColumn("entity", F.concat(name, F.lit("-"), F.substring(digest, 3, 6)))
    cases = cases.join(bodies, key, "left").withColumn("_here", F.coalesce(F.contains(F.col("_body"), letters(F.col("replaced_entity"))), F.lit(False))).drop("_body")

    shape = "(?=((?:" + "|".join(n.lower() for n in NAMES + BENCHMARK_NAMES) + ")[0-9a-f]{6}))"
    taken = bodies.select(F.explode(F.regexp_extract_all("_body", F.lit(shape), 1)).alias("_name")).distinct().withColumn("_taken", F.lit(True))
    cases = cases.withColumn("_name", letters(F.col("entity"))).join(taken, "_name", "left")
    size = F.char_length("replaced_entity")
    status = (
        F.when((size < 2) | (size > 80), "missing_or_ambiguous_entity").when(~F.col("_here"), "entity_not_in_source_text")
        .when(F.col("_asked").isNull(), "no_unambiguous_training_question").when(F.col("_taken"), "replacement_entity_in_corpus").otherwise("ok")
    )
    made = cases.select(F.when(status == "ok", F.replace("_asked", F.col("replaced_entity"), F.col("entity"))).alias("question"), "entity", "replaced_entity", F.lit(UNKNOWN).alias("answer"), F.col("fact_id").alias("from_fact_id"), status.alias("status"))
    good = made.filter("status = 'ok'").groupBy("question").agg(F.min(F.struct("from_fact_id", "entity", "replaced_entity", "answer", "status")).alias("_c")).select("question", "_c.*")
    return good.unionByName(made.filter("status <> 'ok'"))
