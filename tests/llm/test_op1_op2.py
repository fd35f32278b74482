import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")
from loreweave.llm import bytebpe, sstable
from loreweave.llm.tokens import encoder


def ids_of(name, text):
    return encoder(P.path(name)).library.encode(text, add_special_tokens=False).ids


odd = st.text(alphabet=st.one_of(st.sampled_from(list("aAbB '.,\n\t \x1ćΣß12<|>st中᠎ ")), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=150, deadline=None)
@given(odd)
def test_chunked_ids_are_the_librarys(text):
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        codec = encoder(P.path(name))
        assert np.frombuffer(codec.packed(text), codec.dtype).tolist() == ids_of(name, text)


def brute(rows):
    want, start = [], 0
    key = lambda r: (r[0] is not None, r[0] or 0)
    for i, t in sorted(rows, key=key):
        ids = np.asarray([*ids_of("word_bpe_49k.json", t or ""), 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return want


@pytest.mark.parametrize("shards", [1, 3, 9])
def test_shards_round_trip(make_docs, odd_rows, shards):
    rows = [*odd_rows, *[(40, f"hot {i % 3}") for i in range(60)]]
    path = P.path("word_bpe_49k.json")
    manifest = sstable.write_table(make_docs(rows, ["ids", "bucket", "shard"]), path, 1, shards=shards)
    got = sstable.read_table(manifest).collect()
    same = lambda r: (r[0] is not None, r[0] or 0, r[2:])
    ordered = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1])
    assert [r[0] for r in ordered] == [r[0] for r in brute(rows)]
    assert sorted(map(same, ordered)) == sorted(map(same, brute(rows)))
    at = 0
    for _, start, n, _ in ordered:
        assert start == at
        at += n
    for doc_id in {r[0] for r in rows}:
        found = sstable.lookup(manifest, doc_id)
        assert sorted(x.tolist() for x in found) == sorted([*ids_of("word_bpe_49k.json", t or ""), 1] for i, t in rows if i == doc_id)
    assert sstable.lookup(manifest, 123456) == []


def test_many_blocks_and_bloom(tmp_path):
    path = tmp_path / "a.sst"
    with path.open("wb") as f:
        w = sstable.ShardWriter(f, 2)
        for i in range(-5000, 5000):
            w.add(sstable.key_of(2 * i), np.full(20, i % 999, "<u2").tobytes())
        size = w.close()
    assert size == path.stat().st_size
    r = sstable.open_shard(f"file://{path}")
    assert len(r.index) > 3
    assert [sstable.id_of(e.key) for e in r] == [2 * i for i in range(-5000, 5000)]
    for i in (-5000, -1, 0, 77, 4999):
        assert r.get(2 * i)[0].tolist() == [i % 999] * 20
    assert all(r.get(2 * i + 1) == [] for i in range(50))
    assert sum(r.may_hold(sstable.key_of(2 * i + 1)) for i in range(5000)) < 250
    data = bytearray(path.read_bytes())
    data[10] ^= 1
    path.write_bytes(data)
    with pytest.raises(ValueError, match="damaged"):
        sstable.open_shard(f"file://{path}").block(0)


def test_op1_empty(make_docs):
    manifest = sstable.write_table(make_docs([]), P.path("word_bpe_49k.json"), 1)
    out = sstable.read_table(manifest)
    assert out.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert out.count() == 0


def test_op1_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(map(tuple, sstable.op1(spark, sf_dir).collect()))
    assert got == sorted(brute(rows))


@pytest.fixture(scope="module")
def multi():
    import tiktoken

    ours = bytebpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    return ours, tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ours.ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(text=st.one_of(odd, st.text(alphabet="ab", max_size=200), st.text(max_size=80)))
def test_merge_is_tiktokens(multi, text):
    ours, theirs = multi
    ids = ours.encode(text)
    assert ids == theirs.encode_ordinary(text)
    assert ours.decode_bytes(ids) == text.encode()


def test_very_long_pre_tokens(multi):
    ours, theirs = multi
    rng = np.random.default_rng(1)
    for text in ("a" * 50_000, "".join(rng.choice(list("abcdeistn"), 60_000))):
        assert ours.encode(text) == theirs.encode_ordinary(text)


def test_many_pre_tokens_at_once(multi):
    ours, theirs = multi
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abeinrst"), n)) for n in rng.integers(0, 30, 4000)] + ["abab" * 9, "é" * 11, ""]
    packed = ours.merge([w.encode() for w in words])
    assert [np.frombuffer(p, "<u4").tolist() for p in packed] == [theirs.encode_ordinary(w) for w in words]


def test_rank_queue():
    q = bytebpe.RankQueue(300_000)
    rng = np.random.default_rng(2)
    ranks = sorted({int(r) for r in rng.integers(0, 300_000, 3000)})
    for r in rng.permutation(ranks).tolist():
        q.put(r, [r])
    out = []
    while (r := q.first()) >= 0:
        out.append(r)
        assert q.buckets[r] == [r]
        q.drop(r)
    assert out == ranks
    assert q.first() == -1


def test_op2_rows(make_docs, odd_rows, multi):
    _, theirs = multi
    docs = make_docs(odd_rows, ["ids", "n_tokens"])
    got = bytebpe.encode_digests(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in odd_rows:
        ids = theirs.encode_ordinary(t or "")
        want.append((i, len(ids), sha(np.asarray(ids, "<u4").tobytes()), sha((t or "").encode())))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    whole = bytebpe.encode_documents(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in whole) == sorted((t or "").encode() for _, t in odd_rows)
    assert bytebpe.encode_digests(make_docs([]), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


def test_op2_query(spark, sf_dir, multi):
    _, theirs = multi
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = theirs.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), sha(np.asarray(ids, "<u4").tobytes()), sha((r.text or "").encode())))
    assert sorted(map(tuple, bytebpe.op2(spark, sf_dir).collect())) == sorted(want)


def test_letters_are_the_libraries():
    """Cutting by str.isalpha rests on letters never joining a neighbour of another kind."""
    codec = encoder(P.path("byte_bpe_50k.json"))
    for at in range(0, 0x110000, 512):
        chars = [c for c in map(chr, range(at, at + 512)) if not 0xD800 <= ord(c) < 0xE000]
        text = " ".join(f"a{c}b{c}" for c in chars)
        if text:
            assert np.frombuffer(codec.packed(text), codec.dtype).tolist() == ids_of("byte_bpe_50k.json", text), hex(at)
