import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loreweave.llm import licenses, media

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = []
    for p, label in PHRASES.items():
        w = p.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(w)] == w]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["under", "the", "MIT", "License", "apache", "version", "2", "cc", "by", "nc", "é", ".", ",", "--", " ", "\n", "mitt", "under the mit license", "CC-BY-NC", "Apache License, Version 2"]), max_size=14), st.sampled_from([" ", "", "-"]))
def test_base(parts, glue):
    text = glue.join(parts)
    got = licenses.scan(text)
    assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == brute(text)
    assert set(filter(None, got["base_labels"].split(","))) <= set(filter(None, got["labels"].split(",")))
    assert 0 <= got["score"] <= 1


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="undertmilcs hx", max_size=30), st.lists(st.tuples(st.integers(0, 30), st.sampled_from(["", "x", "e"])), max_size=3))
def test_fuzzy_finds_every_label_within_its_edits(noise, changes):
    notice = "under the mit license"
    for at, c in changes:
        notice = notice[:at] + c + notice[at + 1 :]
    words = " ".join(f"{noise} {notice} {noise}".split()).split(" ")
    spans = [" ".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, min(len(words), i + 8) + 1)]
    want = any(abs(len(s) - 21) <= 2 and edits(s, "under the mit license") <= 2 for s in spans)
    assert ("mit" in licenses.scan(f"{noise} {notice} {noise}")["labels"].split(",")) == want


def test_fuzzy_spans():
    got = licenses.scan("One two. Released undr the MIT licence! And GNU Genral Public Licens here")
    assert got["labels"] == "gpl,mit"
    assert got["base_labels"] == ""
    assert [(s["label"], s["first_word"], s["end_word"], s["edits"]) for s in got["spans"]] == [("gpl", 8, 12, 2), ("mit", 3, 7, 2)]
    assert got["score"] == pytest.approx(1 - 2 / 26)
    assert licenses.scan("cc by sa and cc by nd")["labels"] == ""


def test_many_notices_in_one_text():
    text = "x under the mit license. " * 3 + "undr the mit licence; " * 3
    spans = [(s["first_word"], s["end_word"], s["edits"]) for s in licenses.scan(text)["spans"]]
    assert spans == [(1, 5, 0), (6, 10, 0), (11, 15, 0), (15, 19, 2), (19, 23, 2), (23, 27, 2)]
    assert licenses.scan("nder the mit license under the mit license")["spans"][0]["first_word"] == 0


def test_op8_rows(make_docs, odd_rows):
    rows = [*odd_rows, (70, "under the mit license " * 3000), (71, "under the mit-license. Apache License, Version 2.0")]
    got = licenses.scan_documents(make_docs(rows, ["labels", "score"])).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == sorted(((i, *brute(t)) for i, t in rows), key=str)
    assert licenses.scan_documents(make_docs([])).count() == 0


def test_op8_query(spark, sf_dir):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = licenses.op8(spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(rows[r.doc_id])


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=400))
def test_wav_round_trip(text):
    n, payload = media.payload_of(text)
    assert len(payload) % 64 == 0
    assert len(payload) >= 64
    assert payload[:n] == text.encode()
    assert not any(payload[n:])
    assert media.from_wav(media.to_wav(payload)) == payload


def test_peaks_find_a_tone():
    t = np.arange(8192)
    tone = (128 + 60 * np.sin(2 * np.pi * 50 / media.FRAME * t)).astype(np.uint8)
    frames, places = media.peaks(tone)
    assert set(places[(places >= 32) & (places < 80)]) == {50}
    assert frames.max() == -(-(8192 - media.FRAME) // media.HOP)


def test_blocks_do_not_change_pairs(monkeypatch):
    samples = np.random.default_rng(1).integers(0, 256, 20_000).astype(np.uint8)
    whole = media.pairs(samples)
    monkeypatch.setattr(media, "BLOCK", 7)
    parts = media.pairs(samples)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    times, codes = whole
    assert len(times) > 100
    assert (np.diff(times) >= 0).all()
    assert (codes >> 15 < 257).all()


def plain_pairs(samples):
    """Fingerprints by a plain discrete Fourier transform and loops."""
    n, frame, hop = len(samples), media.FRAME, media.HOP
    frames = max(1, -(-(n - frame) // hop) + 1)
    padded = np.zeros((frames - 1) * hop + frame)
    padded[:n] = samples.astype(float) - 128
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(frame) / (frame - 1))
    basis = np.exp(-2j * np.pi * np.outer(np.arange(frame // 2 + 1), np.arange(frame)) / frame)
    size = [np.abs(basis @ (padded[t * hop : t * hop + frame] * window)) for t in range(frames)]
    found = []
    for t in range(frames):
        for a, b in media.BANDS:
            best = max(range(a, b), key=lambda f: (size[t][f], -f))
            here = size[t][best]
            beside = [size[x][best] for x in (t - 1, t + 1) if 0 <= x < frames]
            if here > 1e-3 and all(here >= x for x in beside):
                found.append((t, best))
    out = []
    for i, (t, f) in enumerate(sorted(found)):
        for u, g in sorted(found)[i + 1 : i + 1 + media.FAN_OUT]:
            if u - t <= media.REACH:
                out.append((t, f << 15 | g << 6 | (u - t)))
    return out


@pytest.mark.parametrize("n", [64, 512, 576, 5000, 12_032])
def test_pairs_are_the_plain_ones(n):
    samples = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8)
    times, codes = media.pairs(samples)
    assert list(zip(times.tolist(), codes.tolist(), strict=True)) == plain_pairs(samples)


def test_features_of_texts_are_the_plain_ones(spark, sf_dir):
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(12).collect():
        samples = np.frombuffer(media.payload_of(r.text or "")[1], np.uint8)
        times, codes = media.pairs(samples)
        assert list(zip(times.tolist(), codes.tolist(), strict=True)) == plain_pairs(samples)


def test_op9_rows(make_docs, odd_rows):
    got = media.media_digests(make_docs(odd_rows, ["feature", "media"])).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in odd_rows:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = by[i][0]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_bytes == len(payload) + 44
    assert by[3][0][1:] == by[4][0][1:]
    assert by[5][0] == by[5][1]
    assert by[5][0].feature == by[-2][0].feature != by[9][0].feature
    full = media.media_columns(make_docs(odd_rows)).collect()
    assert sorted(media.feature_of(np.asarray(r.times, "<i4"), np.asarray(r.codes, "<i4")) for r in full) == sorted(r.feature for r in got)
    assert media.media_digests(make_docs([])).count() == 0
