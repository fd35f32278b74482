import pytest
from pyspark.sql import functions as F

from loreweave.config import Config
from loreweave.functions import text, udtf
from loreweave.operators import assembly, chunk, evidence, wiki

PASSAGE = "source_type string, source_id long, seq int, heading string, title string, body string"
CFG = Config(total_chars=1000, passage_chars=200, max_passages=3, wiki_chars=0, graph_chars=0)


def row(role, rank, seq, body, heading="H", source=1, question="merge queue order"):
    return {"question_id": 1, "question": question, "rank": rank, "source_type": "file", "source_id": source, "title": "T", "channels": ["keyword"], "heading": heading, "role": role, "seq": seq, "body": body}


def members(rows, cfg=CFG, reserved=0):
    return [sorted(e.bodies) for e in assembly.arranged(rows, cfg, reserved)]


class TestContext:
    def test_seeds_in_order_each_once_those_that_fit(self):
        rows = [row("seed", i + 1, i, "merge " * n) for i, n in enumerate([20, 400, 20, 20])] + [row("seed", 5, 0, "merge again")]
        assert members(rows) == [[0], [1], [2]]  # three at most, the long one as an excerpt
        assert members(rows, reserved=600) == [[0], [2]]  # the second does not fit and is skipped
        assert members(rows, reserved=700) == [[0]]
        assert members([row("seed", 1, 0, None), row("seed", 2, 1, "  "), row("seed", 3, 2, "x")]) == [[2]]
        assert members([]) == []

    def test_neighbours_by_what_they_add(self):
        seed = row("seed", 1, 5, "merge text")
        new, known, other = row("next", 1, 6, "merge only"), row("previous", 1, 4, "queue order"), row("next", 1, 6, "nothing here", heading="")
        assert members([seed, new, known], CFG.but(neighbor_count=1)) == [[4, 5]]
        assert members([seed, new, known]) == [[4, 5, 6]]
        assert members([seed, other]) == [[5]]  # without a heading it has to speak of the question
        assert members([seed, row("next", 1, 6, "nothing here")]) == [[5, 6]]
        assert members([seed, new], CFG.but(neighbor_count=0)) == [[5]]

    def test_turns_before_second_neighbours(self):
        rows = [row("seed", 1, 5, "merge " + "a" * 150), row("seed", 2, 50, "queue " + "b" * 150)]
        rows += [row("next", 1, 6, "order " + "c" * 180), row("previous", 1, 4, "queue " + "d" * 180), row("next", 2, 51, "merge " + "e" * 180)]
        got = members(rows, Config(total_chars=1000, passage_chars=200, wiki_chars=0, graph_chars=0), 100)
        assert got == [[5, 6], [50, 51]]

    def test_a_neighbour_that_does_not_fit_is_excerpted_if_worth_it(self):
        rows = [row("seed", 1, 5, "merge " * 30), row("next", 1, 6, "filler words " * 30 + "order of the queue. " + "filler words " * 30)]
        cfg = Config(total_chars=1000, passage_chars=700, wiki_chars=0, graph_chars=0)
        [entry] = assembly.arranged(rows, cfg, 300)
        assert "queue" in entry.bodies[6] and 160 <= len(entry.bodies[6]) < 700
        assert entry.size() <= 1000 - 300 - assembly.FRAME
        assert members(rows, cfg, 600) == [[5]]  # less than 160 characters are not

    def test_one_opening_whole_or_not_at_all(self):
        seeds = [row("seed", 1, 5, "merge text"), row("seed", 2, 9, "queue text")]
        up = [row("parent", 1, 2, "the order of merges", heading="1.1 Order"), row("parent", 2, 3, "queue opening", heading="1.2 Queue")]
        assert members([*seeds, *up]) == [[2, 5], [9]]
        assert members([*seeds, row("parent", 1, 2, "merge " * 60, heading="1.1 X"), up[1]]) == [[5], [3, 9]]  # too long
        assert members([*seeds, row("parent", 1, 2, "unrelated", heading="1.1 X")]) == [[5], [9]]

    def test_build_context(self, spark):
        p = spark.createDataFrame([("file", 1, i, "A" if i < 3 else "B", "T", f"merge part {i}") for i in range(5)] + [("note", 2, 0, None, "N", "queue")], PASSAGE)
        hits = spark.createDataFrame([(1, "merge queue", 1, "file", 1, 1, "T", ["keyword"]), (1, "merge queue", 2, "file", 1, 3, "T", None), (2, "queue", 1, "note", 2, 0, "N", ["vector"])], "question_id long, question string, rank int, source_type string, source_id long, seq int, title string, channels array<string>")
        got = {(r.question_id, r.position): r for r in assembly.build_context(hits, p).collect()}
        assert got[1, 1].members == [0, 1, 2] and got[1, 1].seq == -1 and got[1, 1].channels == ["keyword", "section-neighbour"]
        assert got[1, 2].members == [3, 4] and got[2, 1].members == [0] and got[2, 1].seq == 0 and got[2, 1].excerpt == "queue"
        openings = spark.createDataFrame([("file", 1, 3, 1, "1.1 merge"), ("file", 1, 1, 1, "self")], "source_type string, source_id long, seq int, parent_seq int, parent_heading string")
        roles = {(r["rank"], r.role, r.seq) for r in assembly.related(hits, p, openings).filter("question_id = 1").collect()}
        assert roles == {(1, "seed", 1), (1, "next", 2), (1, "previous", 0), (2, "seed", 3), (2, "next", 4), (2, "parent", 1)}
        aux = spark.createDataFrame([(1, 100_000)], "question_id long, chars int")
        assert {r.question_id for r in assembly.build_context(hits, p, auxiliary=aux).collect()} == {2}
        assert assembly.build_context(hits.limit(0), p).count() == 0


class TestRerank:
    def hits(self, spark, n=3):
        rows = [(1, "merge queue", i + 1, "n", i, 0, b) for i, b in enumerate(["x", "queue", "merge queue"][:n])]
        return spark.createDataFrame(rows, "question_id long, question string, rank int, source_type string, source_id long, seq int, body string")

    def test_backends(self, spark):
        class Broken:
            name = "broken"

            def order(self, hits):
                return hits.select("missing")

        done, name = assembly.rerank(self.hits(spark), [Broken(), assembly.LexicalReranker()])
        assert name == "lexical" and [r.source_id for r in done.orderBy("rank").collect()] == [2, 1, 0]
        kept, name = assembly.rerank(self.hits(spark), [Broken()])
        assert name == "none" and [r.source_id for r in kept.orderBy("rank").collect()] == [0, 1, 2]
        few, _ = assembly.rerank(self.hits(spark, 2), [assembly.LexicalReranker()])
        assert [r.source_id for r in few.orderBy("rank").collect()] == [0, 1]

    def test_trace(self, spark):
        t = assembly.Trace()
        assert t.stage("a", "A", lambda: spark.range(3)).count() == 3
        assert t.stage("b", "B", lambda: spark.range(0)) is not None
        assert t.stage("c", "C", lambda: 1 / 0) is None
        assert [(r.id, r["count"], r.status) for r in t.table(spark).collect()] == [("a", 3, "ok"), ("b", 0, "empty"), ("c", 0, "failed")]


class TestWiki:
    def test_terms_and_subjects(self, spark):
        texts = ["什么是消息队列", "MQTT protocol 是什么", "how does the system work", None, ""]
        q = spark.createDataFrame(list(enumerate(texts)), "question_id int, question string")
        got = {r.question_id: r for r in wiki.asked(q).collect()}
        assert set(got) == {0, 1, 2}
        assert got[0].subjects == ["消息队", "息队列"] and got[0].definition and not got[0].gap
        assert got[1].subjects == ["MQTT"] and got[2].subjects == ["system"]

    def test_whole_identifiers(self, spark):
        df = spark.createDataFrame([(["git"], "use Git."), (["git"], "github"), (["c++"], "in C++ code"), (["队列"], "消息队列"), ([], "x"), (["a.b"], "axb")], "s array<string>, t string")
        assert [r[0] for r in df.select(wiki.names_subject(F.col("s"), F.col("t"))).collect()] == [True, False, True, True, False, False]

    def test_gates(self, spark):
        s = spark.createDataFrame([(1, "k1", 0, "Git", "About", "git moves"), (1, "k1", 1, "Git", "knowledge gaps", "git lacks"), (2, "k2", 0, "Other", "Other", "git here too"), (3, "k3", 0, "Git", "Empty", " ")], "page_id int, topic_key string, section int, names string, heading string, body string")
        found = lambda question: [(r.page_id, r.section) for r in wiki.section_channel(s, spark.createDataFrame([(1, question)], "question_id long, question string")).orderBy("rank").collect()]
        assert found("what is git") == [(1, 0)]  # a definition needs the subject in names or heading
        assert found("git push") == [(1, 0), (2, 0)]
        assert found("git gaps") == [(1, 0), (2, 0), (1, 1)] and found("") == []

    def test_located_sources(self, spark):
        p = spark.createDataFrame([("file", 1, i, "T", "", b) for i, b in enumerate(["git one", "nothing", "git merge two", "git"])] + [("note", 2, 0, "git note", None, None)], "source_type string, source_id long, seq int, title string, heading string, body string")
        f = spark.createDataFrame([(1, 1, "merge", "Page", ["file-1", "note-2", "file-9"]), (1, 2, "x", "Page", ["file-1"])], "question_id long, rank int, heading string, title string, refs array<string>")
        q = spark.createDataFrame([(1, "git usage")], "question_id long, question string")
        assert [(r.source_type, r.seq) for r in wiki.located_sources(f, q, p).orderBy("rank").collect()] == [("file", 2), ("note", 0), ("file", 0)]

    def test_snapshots(self, spark):
        src = spark.createDataFrame([("n", 1, "T", "body"), ("n", 2, "U", "other")], "source_type string, source_id long, title string, content string")
        ch = spark.createDataFrame([("n", 1, 0, "h", "bo"), ("n", 1, 1, "h", "dy"), ("n", 2, 0, "", "other")], "source_type string, source_id long, seq int, heading string, chunk_text string")
        snap = wiki.snapshot(src, ch)
        pages = spark.createDataFrame([(1, "p1", 2), (2, "p2", 1), (3, "p3", 2)], "page_id int, page_hash string, version int")
        wanted = spark.createDataFrame([(1, "n", 1, 1), (1, "n", 2, 0), (2, "n", 1, 7)], "page_id int, source_type string, source_id long, seq int")
        deps = wiki.dependencies(snap, wanted, pages.drop("version"))
        assert {r.page_id for r in deps.collect()} == {1}  # page 2 wants a chunk that is not there
        state = lambda d, now: {r.page_id: (r.state, r.reasons) for r in wiki.dependency_states(pages, d, now).collect()}
        assert state(deps, snap) == {1: ("current", ""), 2: ("unknown", "legacy_no_dependencies"), 3: ("unknown", "dependency_record_missing")}
        assert state(deps.limit(1), snap)[1] == ("unknown", "dependency_record_invalid")  # a row is lost
        cut = wiki.snapshot(src.withColumn("content", F.lit("body")).filter("source_id = 1"), ch.filter("seq = 0"))
        assert state(deps, cut)[1] == ("stale", "chunk_changed,source_missing")

    def test_compact_hash(self, spark):
        df = spark.createDataFrame([(["b", "a", "b", None],), ([],), ([f"code{i:02d}" for i in range(30)],), (["x" * 70, "a"],)], "c array<string>")
        got = [r[0] for r in df.select(wiki.compact_sources(F.col("c"))).collect()]
        assert got[:2] == ["src:a,b", None] and len(got[2]) <= 64 and got[2].endswith("code07") and got[3] == "src:a"


class TestText:
    def test_titles(self, spark):
        df = spark.createDataFrame([("# My title\n\n\nbody", "My: title"), ("# Other\nbody", "title x"), ("## My title\nb", "My title"), ("# My title", "My title"), (None, "x"), ("# a", None)], "c string, t string")
        assert [r[0] for r in df.select(text.without_title(F.col("c"), F.col("t"))).collect()] == ["body", "# Other\nbody", "## My title\nb", "", None, "# a"]

    def test_merged_headings(self, spark):
        given = {
            1: ("## A\n\n## A plus\nx\n## B\n### B\n## B", "## A plus\nx\n## B\n### B\n## B"), 2: ("```\n# a\n# a\n```", "```\n# a\n# a\n```"), 3: (None, None), 4: ("", ""),
            5: ("# a\n# a b\n# a b c\n \n# a b\nend\n", "# a b\n# a b c\nend\n"), 6: ("# x\n\n# y\n# y\n", "# x\n\n# y\n"), 7: ("# -\n# -", "# -\n# -"),
        }
        df = spark.createDataFrame([(k, c) for k, (c, _) in given.items()], "k int, c string")
        assert {r.k: r.c for r in text.merged_headings(df, "k", "c").collect()} == {k: w for k, (_, w) in given.items()}

    def test_canonical_json(self):
        assert text.canonical_json({"b": 1.0, "a": [2.50, None, {"y": 1, "x": "é"}]}) == '{"a":[2.5,null,{"x":"é","y":1}],"b":1}'
        assert text.canonical_json(True) == "true"

    def test_split_lossless(self):
        source = "one line of words\n```\n" + "code\n" * 60 + "```\n\ntail " + "x" * 90 + "\n# H\n"
        parts = chunk.split_lossless(source, 40)
        assert "".join(parts) == source and sum(len(p) > 40 for p in parts) == 1 and any(p.startswith("```") and p.rstrip().endswith("```") for p in parts)
        assert chunk.split_lossless(None, 5) == chunk.split_lossless(" \n", 5) == []
        with pytest.raises(ValueError, match="characters"):
            chunk.split_lossless("```\n" + "x" * 70_000, 100)

    def test_table_functions(self, spark):
        udtf.register(spark)
        assert [tuple(r) for r in spark.sql("select * from chunk_structural('# A\ntext')").collect()] == [(0, "A", "text")]
        assert spark.sql("select * from extract_symbols(null, 'python')").count() == 0
