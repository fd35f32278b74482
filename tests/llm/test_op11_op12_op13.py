import hashlib
import math
import random
from collections import Counter, defaultdict
from zlib import crc32

import duckdb
import pytest
import public_tokenizers

from loreweave.llm import resample, spelling, token_counts
from loreweave.llm.common import staged

LETTERS = "abcdefghijklmnopqrstuvwxyz"
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def twin(sf_dir, sql):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con.execute(sql)


def same(got, want):
    names = sorted(got.columns)
    assert names == sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(n) for n in names]
    found = sorted(map(tuple, got.select(names).collect()), key=str)
    assert found == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=str)
    assert found


# operator 11


def brute_variants(counts, factor=2):
    near = defaultdict(set)
    for w in counts:
        others = {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in LETTERS + "é"}
        others |= {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in LETTERS + "é"}
        for o in others - {w}:
            if o in counts:
                near[w].add(o)
                near[o].add(w)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= factor * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return out


@pytest.mark.parametrize("pairs", [1, 30, spelling.PAIRS])
def test_variants_against_brute_force(spark, pairs):
    rng = random.Random(11)
    counts = {"".join(rng.choices("abé", k=rng.randint(5, 8))): rng.randint(3, 400) for _ in range(900)}
    counts |= {"stem" + "".join(rng.choices(LETTERS, k=3)): rng.randint(3, 50) for _ in range(400)}  # one common substring
    counts |= {"aaaaa": 7, "aaaaaa": 7, "aaaaaaa": 14, "aaaaaaaa": 28, "x" * 3000: 5, "x" * 3001: 11, "x" * 2999 + "y": 3}
    words = staged(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3), "words")
    got = [tuple(r) for r in spelling.variants(words, pairs=pairs).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_variants(counts)


def test_word_counts_of_odd_rows(spark, make_docs, odd_rows):
    rows = [*odd_rows, (10, "ÉCOLE École écolE naïve Straße ×÷ Ångström"), (None, "nameless nameless"), *((i, "variant variant Variant") for i in range(300))]
    want = Counter()
    import re

    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    assert any(w != "variant" and abs(len(w) - 6) < 1 and want[w] for w in want if w.startswith("v"))
    got = spelling.word_counts(make_docs(rows, extra=["word", "N"]).repartition(4), 5, 3)
    assert dict(map(tuple, got.collect())) == {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}


def test_long_paths_and_empty_tables(spark, make_docs):
    # each word's form is the next one: a path of twelve
    chain = ["a" * i + "bcdefg" for i in range(12)]
    words = staged(spark.createDataFrame([(w, 3 << i) for i, w in enumerate(chain)], "word string, n long"), "words")
    got = {r.word: r.root for r in spelling.variants(words).collect()}
    assert got == dict.fromkeys(chain, chain[-1])
    none = staged(spelling.word_counts(make_docs([]), 5, 3), "words")
    assert spelling.variants(none).count() == 0


def test_spelling_twin(spark, sf_dir):
    same(spelling.op11(spark, sf_dir), twin(sf_dir, spelling.ORACLE))


# operator 12


def library_counts(path, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    return Counter((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in rows)


ODD = [
    (20, "a<|endoftext|>b <|endoftext|><|endoftext|> <|endoftext|"), (21, "<|endoftext|>"), (22, " \x1c\x1d a\x1fb \x85  　x  "), (23, "don't I'LL we've 's's"),
    (24, "՘ ֋࢏ \U000107bb unassigned"), (25, "é ́x ²³ ½ Ⅷ १२३"), (26, "-" * 5000 + " " + "=" * 70 + " é" * 40), (27, "\n\n \n  \t\t x \r\n"), (28, "é" * 70 + " " + "z" * 65), (29, "z" * 65),
]


@pytest.mark.parametrize("hot_rows", [0, 3, token_counts.HOT_ROWS])
def test_counts_as_the_library(spark, make_docs, odd_rows, hot_rows):
    rows = odd_rows + ODD
    got = token_counts.token_counts(make_docs(rows, extra=["key", "N_TOKENS", "row"]).repartition(3), BYTE_BPE, hot_rows=hot_rows)
    assert Counter(map(tuple, got.collect())) == library_counts(BYTE_BPE, rows)


def test_other_pre_tokens(spark, make_docs, odd_rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [r for r in odd_rows + ODD if r[0] not in (20, 21)]
    got = token_counts.token_counts(make_docs(rows), path)
    assert Counter(map(tuple, got.collect())) == library_counts(path, rows)


def test_memory_is_handed_on(spark, make_docs, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choices(LETTERS, k=3)) for _ in range(40))) for i in range(60)]
    monkeypatch.setattr(token_counts, "HELD", 50)
    got = token_counts.token_counts(make_docs(rows).repartition(2), BYTE_BPE, hot_rows=20)
    assert Counter(map(tuple, got.collect())) == library_counts(BYTE_BPE, rows)


def test_cuts_of_all_assigned_characters():
    import unicodedata

    cutter = token_counts.pre_tokens(BYTE_BPE)
    points = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    for i in range(0, len(points), 512):
        text = "".join(f"a{c}1 {c} {c}!" for c in points[i : i + 512])
        assert cutter.cut(text) == [text[a:b] for _, (a, b) in cutter.library.pre_tokenizer.pre_tokenize_str(text)]


def test_counts_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert Counter(map(tuple, token_counts.op12(spark, sf_dir).collect())) == library_counts(BYTE_BPE, docs)
    assert token_counts.token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0), BYTE_BPE).count() == 0


# operator 13


def words_of(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute_draw(rows, target, percent, least, buckets, longest, seed):
    def found(text):
        w = words_of(text)
        return [crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(found(text))
    for text in target:
        t.update(found(text))
    all_s, all_t = sum(s.values()), sum(t.values())
    scored = []
    for doc_id, text in rows:
        runs = found(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in runs)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        scored.append((doc_id, len(words_of(text)), len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in scored if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2], r[3]))
    able = able[: len(able) * percent // 100]
    ranks = Counter((*r, i + 1) for i, r in enumerate(able))
    rest = Counter(scored) - Counter(able)
    return ranks + Counter({(*r, None): n for r, n in rest.items()})


@pytest.mark.parametrize(("percent", "block"), [(5, 65_536), (40, 64), (100, 1000)])
def test_draw_against_brute_force(spark, make_docs, odd_rows, monkeypatch, percent, block):
    rng = random.Random(5)
    some = ["".join(rng.choices(LETTERS, k=rng.randint(1, 4))) for _ in range(60)] + ["É", "ß9"]
    rows = [*odd_rows, *((100 + i, " ".join(rng.choices(some, k=rng.randint(0, 60)))) for i in range(300)), *((700, "same id " * 15) for _ in range(9)), *((800 + i, "Same, text! " * 15) for i in range(50))]
    target = [" ".join(rng.choices(some[:20], k=30)) for _ in range(8)] + [None, ""]
    monkeypatch.setattr(resample, "BLOCK", block)
    docs = make_docs(rows, extra=["Score", "rank", "weight"]).repartition(3)
    wanted = spark.createDataFrame([(t, "x") for t in target], "text string, doc_id string")
    got = resample.resample(docs, wanted, percent=percent, buckets=500)
    assert Counter(map(tuple, got.collect())) == brute_draw(rows, target, percent, 20, 500, 3, 42)


def test_runs_across_parts(monkeypatch):
    text = "Ab c! d é'f  g" * 40
    whole = [sorted(f) for _, f in resample.hashed_runs(text, 999, 3)]
    assert len(whole) == 1
    for size in (1, 3, 17):
        monkeypatch.setattr(resample, "TEXT_BLOCK", size)
        parts = list(resample.hashed_runs(text, 999, 3))
        assert len(parts) > 3
        assert sorted(x for _, f in parts for x in f) == whole[0]
        assert sum(n for n, _ in parts) == len(words_of(text))
    assert [n for n, _ in resample.hashed_runs("one two", 10, 1)] and not list(resample.hashed_runs("", 10, 3))


def test_empty_sides(spark, make_docs):
    none = spark.createDataFrame([], "text string")
    assert resample.resample(make_docs([]), none).count() == 0
    rows = [(i, "w%d " % i * 25) for i in range(40)]
    assert Counter(map(tuple, resample.resample(make_docs(rows), none).collect())) == brute_draw(rows, [], 5, 20, 10_000, 3, 42)


def test_resampling_twin(spark, sf_dir):
    same(resample.op13(spark, sf_dir), twin(sf_dir, resample.ORACLE))
