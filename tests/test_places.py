import random

from loreweave.operators import places

FILES = [
    ("a", "notes.md", "# T\r\n\r\ntext"),
    ("b", "x/run.py", "a = '```'\n"),
    ("c", "t.csv", 'n,v\n"a,b",1\nx|y\n'),
    ("d", "plain", "one\n \ntwo\n\n\n\nthree"),
    ("e", "e.txt", None),
    ("f", "f.txt", " \n\n "),
    ("g", "g.md", "x" * 60),
    ("h", "h.log", "\n\n".join("abcdef")),
    ("i", "t.tsv", "p\tq\n1\t2"),
    ("j", "Dockerfile", "FROM x"),
]


def test_adapters(spark):
    files = spark.createDataFrame(FILES, "k string, path string, text string")
    got = {}
    for r in sorted(places.adapted(files, "k", "path", "text", most_chars=50, most_blocks=5).collect(), key=lambda r: (r.k, r.block or 0)):
        got.setdefault(r.k, []).append((r.kind, r.display, r.status))
    assert got["a"] == [("markdown", "# T\n\ntext", "ok")]
    assert got["b"] == [("code", "````python\na = '```'\n````", "ok")]
    assert got["c"] == [("table", "| n | v |\n| --- | --- |\n| a,b | 1 |\n| x\\|y |  |", "ok")]
    assert [x[1] for x in got["d"]] == ["one", "two", "three"]
    assert "e" not in got
    assert "f" not in got
    assert got["g"] == [("markdown", None, "failed")]
    assert got["h"] == [("paragraph", None, "failed")]
    assert got["i"][0][1] == "| p | q |\n| --- | --- |\n| 1 | 2 |"
    assert got["j"][0][:2] == ("code", "```dockerfile\nFROM x\n```")
    assert places.adapted(files.limit(0), "k", "path", "text").count() == 0


def test_a_block_that_does_not_fit_is_skipped_whole(spark):
    rows = [("a", 0, "x" * 6), ("a", 1, "y" * 9), ("a", 2, "zz"), ("b", 0, "w" * 10), (None, 0, "n")]
    placed = places.written(spark.createDataFrame(rows, "k string, block int, display string"), "k", 10)
    got = {(r.k, r.block): (r.shown_start, r.shown_end, r.start, r.end, r.partial) for r in placed.collect()}
    assert got == {("a", 0): (0, 6, 0, 6, True), ("a", 1): (8, 17, None, None, True), ("a", 2): (19, 21, 8, 10, True), ("b", 0): (0, 10, 0, 10, False), (None, 0): (0, 1, 0, 1, False)}
    text = {r.k: (r.display_text, r.index_text) for r in places.texts(placed, "k").collect()}
    assert text["a"] == ("xxxxxx\n\nyyyyyyyyy\n\nzz", "xxxxxx\n\nzz")


def test_places_of_snippets(spark):
    rng = random.Random(2)
    words = ["alphabet", "betaversion", "gammarays", "deltawing", "epsilons"]
    blocks, bodies = [], []
    for k in range(6):
        texts, at = [" ".join(rng.choices(words, k=rng.randint(1, 400))) for _ in range(8)], 0
        for i, t in enumerate(texts):
            blocks.append((k, i, at, at + len(t), t))
            at += len(t) + 2
        bodies.append((k, "\n\n".join(texts)))
    snippets = []
    for k, body in bodies:
        for j in range(30):
            a = rng.randrange(len(body))
            piece = body[a : a + rng.randint(1, 3000)]
            snippets.append((k, j, piece if j % 3 else f"# {piece[:40]}…{piece[-30:]}", "gammarays?" if j % 2 else None))
    snippets += [(0, 90, None, None), (0, 91, "  ", None), (99, 92, "alphabet", None), (0, 93, "not in it anywhere", None)]
    b = spark.createDataFrame(blocks, "k int, block int, start long, end long, display string")
    got = {}
    for r in places.located(b, spark.createDataFrame(bodies, "k int, body string"), spark.createDataFrame(snippets, "k int, snippet_id int, snippet string, question string"), "k").collect():
        got.setdefault((r.k, r.snippet_id), []).append((r.place, r.block))
    body = dict(bodies)
    for k, j, s, q in snippets:
        found = places.ranges(body[k], s) if s and k in body else []
        met = [(i, t) for kk, i, x, y, t in blocks if kk == k and any(x < v and y > u for u, v in found)]
        if q:
            met.sort(key=lambda m: (-places.context.relevance(q, m[1])[0], m[0]))
        assert [x for _, x in sorted(got.get((k, j), []))] == [i for i, _ in met][:12]
    assert (0, 93) not in got
