import math
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")
from loreweave.llm import packing
from loreweave.llm import tokens
from loreweave.llm.tokens import encoder

PATH = P.path("byte_bpe_50k.json")


def verify(rows, got, capacity):
    """Every piece is there once, in order, and every sequence is gapless and within capacity."""
    have = defaultdict(list)
    for r in got:
        have[r.doc_id].append(r)
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(np.asarray([*encoder(PATH).library.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))
    assert set(have) == set(want)
    for i, lists in want.items():
        whole = sorted((len(x), zlib.crc32(x.tobytes())) for x in lists if len(x) <= capacity)
        assert sorted((r.length, r.ids_crc32) for r in have[i] if len(lists) > 1 or len(have[i]) == 1) == whole or len(have[i]) > 1
        if len(lists) == 1:
            x, at = lists[0], 0
            for k, r in enumerate(sorted(have[i], key=lambda r: r.piece)):
                assert (r.piece, r.start) == (k, at)
                assert r.ids_crc32 == zlib.crc32(x[at : at + r.length].tobytes())
                assert r.length == capacity or k == 0
                at += r.length
            assert at == len(x)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert 0 < at <= capacity
    return len(places)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(1, 8))
def test_packer_places_all(lengths, most):
    packer, done = packing.Packer(40, most), []
    for i, n in enumerate(lengths):
        done += packer.add({"length": n, "id": i})
        assert packer.count <= most or n == 40
    done += packer.rest()
    assert sorted(p["id"] for _, bin_ in done for p in bin_) == list(range(len(lengths)))
    for used, bin_ in done:
        assert used == sum(p["length"] for p in bin_) <= 40


def test_best_fit_takes_the_smallest_space():
    packer = packing.Packer(10, 4)
    for n in (7, 4):
        assert not list(packer.add({"length": n}))
    [(used, full)] = packer.add({"length": 3})
    assert used == 10
    assert [p["length"] for p in full] == [7, 3]


def test_fullest_closes_first():
    packer = packing.Packer(10, 2)
    for n in (6, 8):
        assert not list(packer.add({"length": n}))
    assert [used for used, _ in packer.add({"length": 9})] == [8]


def test_odd_rows(make_docs, odd_rows):
    got = packing.pack(make_docs(odd_rows, ["piece", "OFFSET"]), PATH, 2, 64, 4).collect()
    verify(odd_rows, got, 64)
    assert packing.pack(make_docs([]), PATH, 2).count() == 0


def test_levels(make_docs, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_PER_TASK", 40)
    rows = [(i, "word " * (i * 7 % 45)) for i in range(400)]
    got = packing.pack(make_docs(rows).repartition(6), PATH, 2, 64, 16).collect()
    n = verify(rows, got, 64)
    assert n <= 1.06 * math.ceil(sum(r.length for r in got) / 64)


@pytest.mark.parametrize(("n", "capacity", "open_bins", "per_task"), [(20_000, 1024, packing.OPEN_BINS, packing.PIECES_PER_TASK), (400, 64, 4, 20)])
def test_equal_short_texts_end(make_docs, monkeypatch, n, capacity, open_bins, per_task):
    levels, staged = [], packing.staged

    def counted(*args):
        levels.append(args)
        assert len(levels) < 8, "the levels do not end"
        return staged(*args)

    monkeypatch.setattr(packing, "staged", counted)
    monkeypatch.setattr(packing, "PIECES_PER_TASK", per_task)
    rows = [(i, "word" + " word" * 8) for i in range(n)]
    got = packing.pack(make_docs(rows).repartition(6), PATH, 2, capacity, open_bins).collect()
    assert {r.length for r in got} == {10}
    assert verify(rows, got, capacity) == math.ceil(n / (capacity // 10))


def test_op3_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = packing.op3(spark, sf_dir).collect()
    n = verify(rows, got, 1024)
    assert n <= 1.03 * math.ceil(sum(r.length for r in got) / 1024)


ODD = st.text(alphabet=st.one_of(st.sampled_from(list("aAbB '.,\n\t \x1ćΣß12<|>st中᠎ \x85")), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(ODD, max_size=6))
def test_column_ids_are_the_librarys(texts):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        codec = encoder(P.path(name))
        got = codec.packed_column(pa.array(["", *texts], pa.string()).slice(1))
        assert [np.frombuffer(x, codec.dtype).tolist() for x in got] == [codec.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_column_over_code_points():
    codec = encoder(PATH)
    chars = [chr(c) for c in [*range(0x3100), *range(0x3100, 0x110000, 61)] if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"b{c}\n{c}a, {c}" for c in chars[a : a + 64]) for a in range(0, len(chars), 64)]
    got = codec.packed_column(pa.array(texts, pa.string()))
    assert all(np.frombuffer(x, codec.dtype).tolist() == codec.library.encode(t, add_special_tokens=False).ids for x, t in zip(got, texts, strict=True))


def test_repeated_words_are_looked_up_once(monkeypatch):
    """A word with marks behind it went through the memory's Python code each time it was met."""
    missed = []
    plain = tokens.Words.__missing__
    monkeypatch.setattr(tokens.Words, "__missing__", lambda self, chunk: (missed.append(chunk), plain(self, chunk))[1])
    codec = tokens.Encoder(PATH)
    texts = ["the quick, brown fox.\nJumps, over; the lazy dog, " * 50 + "end"] * 20
    got = codec.packed_column(pa.array(texts, pa.string()))
    assert np.frombuffer(got[-1], codec.dtype).tolist() == codec.library.encode(texts[0], add_special_tokens=False).ids
    assert len(missed) < 60
