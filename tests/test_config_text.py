import pytest
from pyspark.sql import functions as F

from loreweave.config import Config
from loreweave.functions import text, vector
from loreweave.operators import graph


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_config():
    assert Config().but(rrf_k=10).rrf_k == 10
    for bad in ({"chunk_overlap": 900}, {"chunk_max": 700}, {"fused_window": 21}, {"wiki_chars": 9000}, {"nope": 1}, {"chunk_strategy": "x"}):
        with pytest.raises(ValueError):
            Config().but(**bad)


def test_terms(spark):
    got = one(spark, text.retrieval_terms(F.lit("MyBatis-Plus 怎么配置 a b2 MyBatis-Plus 缓存池")))
    assert got == ["MyBatis-Plus", "b2", "么配", "配置", "怎么配", "么配置", "缓存", "存池", "缓存池"]
    assert one(spark, text.retrieval_terms(F.lit(None).cast("string"))) == []
    assert len(one(spark, text.retrieval_terms(F.lit(" ".join(f"w{i}" for i in range(90)))))) == 40
    assert one(spark, text.unicode_terms(F.lit("élan vital"))) == ["élan", "vital"]


@pytest.mark.parametrize(("title", "body", "score"), [("Git rebase", "x", 3), ("x", "git", 1), ("git", "git", 3), ("x", "y", 0)])
def test_lexical_score(spark, title, body, score):
    assert one(spark, text.lexical_score(F.array(F.lit("Git")), F.lit(title), F.lit(body))) == score


def test_cleaning(spark):
    assert one(spark, text.base_clean(F.lit("# Title\n<b>bold</b> `code`  [x]"))) == "Title bold code x"
    assert one(spark, text.keep_code(F.lit("```java\nint a;\n```\nend"))) == "int a; end"
    assert one(spark, text.plain_summary(F.lit("# T\n```\ncode\n```\n<font color=x>red</font> a &lt; b\n---\n- item"))) == "T red a < b item"
    assert one(spark, text.tidy(F.lit("\ufeffa  \r\nb\r\n\r\n\r\n\r\nc \x00"))) == "a\nb\n\nc"
    assert one(spark, text.embed_text(F.lit(" T "), F.lit(""), F.lit("b"))) == "T\nb"
    assert one(spark, text.embed_text(F.lit("T"), F.lit("H"), F.lit("b"))) == "T · H\nb"
    assert one(spark, text.file_name(F.lit("a\x01" * 300 + ".tar"))).endswith(".tar")
    assert one(spark, text.mask_secrets(F.lit("Bearer abcdefghijk and sk-0123456789"))) == "Bearer *** and sk-***"
    assert one(spark, text.split_values(F.lit("a| b ,，c"))) == ["a", "b", "c"]


def test_snippet(spark):
    body = "x" * 100 + "needle" + "y" * 100
    got = one(spark, text.snippet(F.lit("s"), F.lit(body), "NEEDLE"))
    assert got.startswith("…")
    assert got.endswith("…")
    assert len(got) == 122
    assert one(spark, text.snippet(F.lit("s"), F.lit(body), "none")) == "s"
    assert one(spark, text.snippet(F.lit(""), F.lit("short"), "none")) == "short"


@pytest.mark.parametrize(("answer", "refused"), [("无法回答这个问题", True), ("材料中没有相关内容", True), ("结论。" * 80 + "没有相关内容", False), ("", False), (None, False)])
def test_refusal(spark, answer, refused):
    assert one(spark, text.is_refusal(F.lit(answer).cast("string"))) == refused


def test_vectors(spark):
    a = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, vector.cosine(a(1, 0), a(1, 1))) == pytest.approx(0.7071067)
    assert one(spark, vector.cosine(a(1, 0), a(1))) == 0
    assert one(spark, vector.cosine(a(0, 0), a(1, 1))) == 0
    assert [one(spark, vector.is_valid(v)) for v in (a(1), a(0), a(), a(float("nan")))] == [True, False, False, False]
    assert one(spark, vector.half_up(F.lit(0.0005))) == 0.001


def test_relations(spark):
    want = {"Is-A": "is_a", "kind_of": "is_a", "depends on x": "prerequisite", "belongs_to_type": "part_of", "A 与 B 易混": "contrast_with", "??": None, None: None}
    for raw, rel in want.items():
        assert one(spark, graph.canonical_relation(F.lit(raw).cast("string"))) == rel


def test_names(spark):
    assert graph.normal_name(" Ｇit_Hub（旧名） ") == "github"
    assert graph.display_name("DeepSeek Harness（dsh）") == "DeepSeek Harness"
    assert graph.alias_candidates("DeepSeek Harness（dsh）") == ["dsh"]
    assert graph.alias_candidates("IoC / DI") == ["IoC", "DI"]
    assert [one(spark, graph.plausible_name(F.lit(n))) for n in ("Git", "1.2", "a, b", "x" * 41, "栈")] == [True, False, False, False, True]
    assert [one(spark, graph.admissible_concept(F.lit(n))) for n in ("Flow-GRPO", "--force", "git -m", "修改文件", "配置叠加顺序", "A" * 30, "a b" * 12)] == [True, False, False, False, True, True, False]
    assert [one(spark, graph.name_similarity(F.lit(a), F.lit(b))) for a, b in (("a", "a"), ("ioc", "iocdi"), ("abcd", "abce"), ("abc", "xyz"))] == [1.0, 0.6, 0.75, 0.0]
