"""Licence notices in texts: exact phrases and fuzzy short notices.

Words are runs of digits, a-z (after lowering A-Z) and non-ASCII characters;
all else separates. A text becomes its words joined by single spaces, once.

Base: places where a phrase's words stand consecutively.

Fuzzy: a notice of length m may differ by k edits. Cut into k + 1 pieces, one
of them must occur unchanged (pigeonhole), so exact searches for the pieces
locate every candidate. Around each, the regex library's bounded-error matching
(``{e<=k}``, best match) verifies the edits between word borders and reports
the span. Short notices allow no edits: one edit would turn one licence's name
into another's.

Defined cases: null text is empty (no words, no labels, score 0); repeated rows
return once each; overlapping verified spans of one label count once, the
fewest edits first; other columns are ignored.
"""

from __future__ import annotations

import functools
from bisect import bisect

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loreweave.llm.common import slices, texts_of

# Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Notices for the fuzzy search, their labels and the edits they allow.
NOTICES = [
    ("under the mit license", "mit", 2),
    ("apache license version 2", "apache-2", 2),
    ("cc by nc", "cc-by-nc", 0),
    ("creative commons attribution noncommercial", "cc-by-nc", 3),
    ("gnu general public license", "gpl", 2),
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu affero general public license", "agpl", 3),
    ("mozilla public license", "mpl", 2),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("free and unencumbered software released into the public domain", "unlicense", 5),
    ("permission to use copy modify and or distribute this software", "isc", 5),
]

#: Lowers A-Z, keeps digits, a-z and bytes of non-ASCII characters, makes the rest spaces.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def pieces(notice: bytes, edits: int) -> list[tuple[int, bytes]]:
    """``edits + 1`` consecutive pieces of the notice with their offsets."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    """Finds base phrases and fuzzy notices in normalised texts."""

    def __init__(self, base=None, notices=None):
        import regex

        self.base = [(f" {p} ".encode(), label) for p, label in (BASE if base is None else base).items()]
        self.notices = []
        for notice, label, edits in NOTICES if notices is None else notices:
            raw = notice.encode()
            match = regex.compile(b"(?b)(?<= )(?:" + regex.escape(raw, literal_spaces=True) + b"){e<=%d}(?= )" % edits)
            self.notices.append((label, raw, edits, pieces(raw, edits), match))

    @staticmethod
    def words(text: str) -> list[bytes]:
        return text.encode().translate(WORDS).split()

    def exact(self, joined: bytes) -> list[tuple[int, str]]:
        """``(first word, label)`` of every place of every base phrase."""
        found = []
        for phrase, label in self.base:
            at, words, counted = joined.find(phrase), 0, 0
            while at >= 0:
                words, counted = words + joined.count(b" ", counted, at), at
                found.append((words, label))
                at = joined.find(phrase, at + 1)
        return found

    def fuzzy(self, joined: bytes) -> list[tuple[str, int, int, int, float]]:
        """``(label, first word, end word, edits, score)`` of verified spans, overlaps of a label merged."""
        best: dict[tuple[str, int, int], tuple[int, float]] = {}
        for label, raw, edits, parts, match in self.notices:
            seen = set()
            for offset, piece in parts:
                at = joined.find(piece)
                while at >= 0:
                    begin, finish = max(0, at - offset - edits - 1), at - offset + len(raw) + edits + 1
                    if (begin, finish) not in seen:
                        seen.add((begin, finish))
                        window = joined[begin:finish]
                        for m in match.finditer(window, overlapped=False):
                            e = sum(m.fuzzy_counts)
                            key = (label, begin + m.start(), begin + m.end())
                            score = 1 - e / len(raw)
                            if key not in best or best[key][0] > e:
                                best[key] = (e, score)
                    at = joined.find(piece, at + 1)
        chosen: dict[str, list[tuple[int, int]]] = {}
        for (label, a, b), (e, _) in sorted(best.items(), key=lambda x: (x[1][0], x[0])):
            spans = chosen.setdefault(label, [])
            i = bisect(spans, (a, b))  # kept spans do not overlap: only those beside this one can meet it
            if (i == 0 or spans[i - 1][1] <= a) and (i == len(spans) or b <= spans[i][0]):
                spans.insert(i, (a, b))
        out, words, counted = [], 0, 0
        for a, b, label in sorted((a, b, label) for label, spans in chosen.items() for a, b in spans):
            words, counted = words + joined.count(b" ", counted, a), a
            out.append((label, words - 1, words + joined.count(b" ", a, b), *best[label, a, b]))
        return sorted(out)


@functools.cache
def scanner() -> Scanner:
    return Scanner()


def scan(text: str) -> dict:
    """Counts, places, labels and spans of one text."""
    s = scanner()
    words = s.words(text)
    joined = b" " + b" ".join(words) + b" "
    base, spans = s.exact(joined), s.fuzzy(joined)
    places = [at for at, _ in base]
    return {
        "n_words": len(words), "n_base": len(base), "first_word": min(places, default=None), "last_word": max(places, default=None),
        "base_labels": ",".join(sorted({label for _, label in base})), "labels": ",".join(sorted({label for _, label in base} | {x[0] for x in spans})),
        "score": 1.0 if base else max((x[4] for x in spans), default=0.0),
        "spans": [dict(zip(("label", "first_word", "end_word", "edits", "score"), x, strict=True)) for x in spans],
    }


SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int32()), ("score", pa.float64())])
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(SPAN))])
OUT_DDL = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first_word: long, end_word: long, edits: int, score: double>>"


def scan_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans`` of every row."""

    def run(batches):
        for part in slices(batches):
            rows = [{"doc_id": i, **scan(t)} for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, OUT)

    return texts_of(docs).mapInArrow(run, OUT_DDL)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: licence places and labels of every document."""
    return scan_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


