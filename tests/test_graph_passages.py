import pytest

from loreweave.functions.markdown import normal_form
from loreweave.operators import evidence

REL = "head string, relation string, tail string, weight double, evidence string, sources array<string>, origin string"


def found(spark, rel, content, chunks, concepts=("a", "b")):
    rows = [(h, r, t, w, q, s, o) for h, r, t, w, q, s, o in rel]
    c = spark.createDataFrame([(1, x, i) for i, x in enumerate(concepts)], "question_id long, id string, place int")
    s = spark.createDataFrame([(*k, v) for k, v in content.items()], "source_type string, source_id long, content string")
    p = spark.createDataFrame([(*k, i, t) for k, v in chunks.items() for i, t in enumerate(v)], "source_type string, source_id long, seq int, text string")
    return evidence.graph_passages(spark.createDataFrame(rows, REL), c, s, p).orderBy("rank").collect()


@pytest.mark.parametrize(
    ("text", "normal"),
    [
        ("# 标题\n**A** depends  on `List<String>`", "标题A depends on List<String>"), ('[B](http://x.y/z "t") and ![img](a.png)', "B and img"), ("```java\nif (a) { **x** } # no\n[l](u)\n```\nafter", "if(a){**x**}#no[l](u)after"),
        ("snake_case_name _em_ __strong__", "snake_case_name em strong"), ("- one\n+ two\n\n> <b>bold</b><!-- gone --> 中 文 x", "one two bold中文x"), ("***both*** *a **b** c* \\*no\\*", "both a b c\\*no\\*"),
        ("Map<K,V> x < y", "Map<K,V>x<y"), ("`` a ` b ``", "a`b"), ("~~~\nopen", "open"), ("", ""), (None, ""), (" \n ", ""),
    ],
)
def test_normal_form(text, normal):
    got, at, raw = normal_form(text)
    assert got == normal
    for i, char in enumerate(got):
        k = max(j for j in range(len(at)) if at[j] <= i)
        there = (text or "")[raw[k] + i - at[k]]
        assert there == char or (char == " " and there.isspace())


def test_a_quote_in_a_chunk_with_marks(spark):
    text = "# Top\n\n**A** depends\non [B](http://b.example) here.\n\nOther words."
    rel = [("a", "prerequisite", "b", 0.5, "A depends on B here.", ["note-1"], "llm")]
    [row] = found(spark, rel, {("note", 1): text}, {("note", 1): ["# Top\n**A** depends on [B](http://b.example) here.", "Other words."]})
    assert (row.seq, row.source_type, row.source_id, row.score, row.relations) == (0, "note", 1, 2.05, ["a —prerequisite→ b"])


def test_a_quote_over_a_border_is_a_window(spark):
    text = "x" * 300 + " first half\n\nsecond half " + "y" * 300
    rel = [("a", "is_a", "z", 9.0, "first half second half", ["file-7"], "manual")]
    [row] = found(spark, rel, {("file", 7): text}, {("file", 7): ["x" * 300 + " first half", "second half " + "y" * 300]})
    assert (row.seq, row.score) == (-1, 1.1)
    at = text.index("first")
    assert row.passage == text[at - 180 : text.index("second half") + 11 + 240].strip()


def test_code_keeps_its_marks_and_equal_chunks_their_contexts(spark):
    body = "**A** depends on B."
    text = f"```\n{body}\n```\n\n{body}\n"
    chunks = {("note", 1): [body, body]}
    plain = [("a", "is_a", "b", 0.0, "A depends on B.", ["note-1"], "manual")]
    [row] = found(spark, plain, {("note", 1): text}, chunks)
    assert row.seq == -1 and body in row.passage  # the chunk stands in code and in prose: only the window is certain
    assert found(spark, [("a", "is_a", "b", 0.0, "`**C** depends on B.`", ["note-1"], "manual")], {("note", 1): text}, chunks) == []


def test_what_does_not_count(spark):
    rel = [("a", "is_a", "b", 1.0, "the whole quote", ["note-1"], "derived"), ("a", "eats", "b", 1.0, "the whole quote", ["note-1"], "llm"), ("a", "part_of", "a", 1.0, "the whole quote", ["note-1"], "llm"), ("a", "used_for", "b", 1.0, "**", ["note-1"], "llm"), ("a", "prerequisite", "b", 1.0, "the whole quote!", ["note-1"], "llm"), ("c", "is_a", "d", 1.0, "the whole quote", ["note-1"], "llm"), ("b", "is_a", "a", 1.0, "the whole quote", ["note-2", "note-3"], None)]
    assert found(spark, rel, {("note", 1): "the whole quote", ("note", 2): "  "}, {("note", 1): ["the whole quote"]}) == []


def test_order_and_names(spark):
    text = {("note", 1): "alpha one. beta two.", ("note", 2): "gamma three."}
    rel = [
        ("b", "related_to", "a", 0.1, "alpha one.", ["note-1"], "manual"), ("a", "contrast_with", "b", 0.2, "beta two.", ["note-1", "note-1"], "manual"), ("a", "related_to", "b", 0.1, "alpha one.", ["note-1"], "manual"),
        ("a", "is_a", "x", float("nan"), "gamma three.", ["note-2", "note-1"], "manual"),
    ]
    got = found(spark, rel, text, {k: [v] for k, v in text.items()})
    assert [(r.source_id, r.score, r.relations) for r in got] == [(1, 2.02, ["a —contrast_with→ b", "a —related_to→ b"]), (2, 1.0, ["a —is_a→ x"])]
    assert found(spark, rel, text, {k: [v] for k, v in text.items()}, concepts=("zz",)) == []
