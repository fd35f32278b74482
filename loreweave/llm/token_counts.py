"""Token counts of whole texts without their ids.

A pre-token is encoded without regard to its neighbours, so a document's count
is the sum over its distinct pre-tokens of frequency times pieces. The corpus is
read twice. The first reading gathers the distinct pre-tokens with their
occurrences, in tasks of bounded memory, and the pieces of each are counted
once. The second one takes the frequencies within each document and joins them
to the pieces: the most frequent pre-tokens, at most ``HOT_ROWS`` of them and
found by a histogram over the powers of two, are joined where the text is read;
the others leave the task as (document, pre-token, frequency) and meet the
table of pieces in a shuffled join, where no key is hot, as the hot ones are
gone. Keys of long pre-tokens are their digests.

Special strings inside a text are one token each, the library's default.

Defined cases: a null text is empty (no bytes, no tokens); repeated rows and
null identifiers return once for each row; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.llm.common import slices, staged, texts_of
from loreweave.llm.tokens import ASCII_PRE_TOKENS, BYTE_CHARS, MARKS, SEPARATORS, Memory

#: Distinct pre-tokens that a task of the first reading holds before it hands them on.
HELD = 400_000
#: Most pre-tokens that are joined where the texts are read; a broadcast of at most this many rows.
HOT_ROWS = 200_000
#: Longer pre-tokens are keyed by their digest, which is longer still.
KEY_CHARS = 64


#: A space before white space, or at the end: there a text is not cut into chunks.
DOUBT = re.compile("\x20(?:[\\s\u180e]|\\Z)").search


class PreTokens:
    """Cuts texts into the pre-tokens of a tokenizers file and counts the pieces of one."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens") or []
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError("added tokens that take white space, stand alone or are normalized are not supported")
        self.special = re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        pre = spec.get("pre_tokenizer") or {}
        self.bytes = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.pattern = regex.compile(public_tokenizers.PATTERN).findall
        self.model = self.library.model
        self.assigned: set[str] = set()

    def count(self, text: str, spaced: Counter | list, plain: Counter) -> int:
        """Add a text's chunks between spaces to ``spaced`` and its other pre-tokens to ``plain``; returns the special strings in it."""
        add = spaced.update if isinstance(spaced, Counter) else spaced.extend
        parts = [text] if self.special is None else self.special.split(text)
        for part in parts:
            if self.bytes and not DOUBT(part):
                first, *rest = part.split(" ")
                add(rest)
                plain.update(self.cut(first))
            else:
                plain.update(self.cut(part))
        return len(parts) - 1

    def cut(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings."""
        if not self.bytes:
            normal = self.library.normalizer
            return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal.normalize_str(text) if normal else text)]
        if text.isascii() and not any(c in text for c in SEPARATORS):
            return ASCII_PRE_TOKENS(text)
        # characters without a category here may have one in the library, or the other way round
        new = set(text) - self.assigned
        if new:
            known = {c for c in new if unicodedata.category(c) != "Cn"}
            self.assigned |= known
            if len(known) < len(new):
                return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return self.pattern(text)

    def behind_space(self, chunk: str) -> list[str]:
        """The pre-tokens of a chunk behind a space; a word with marks at its end is two."""
        word = chunk.rstrip(MARKS)
        if word.isalpha():
            return [" " + word] if len(word) == len(chunk) else [" " + word, chunk[len(word) :]]
        return self.cut(" " + chunk)

    def pieces(self, pre_token: str) -> int:
        if self.bytes:
            pre_token = pre_token.encode().decode("latin-1").translate(BYTE_CHARS)
        return len(self.model.tokenize(pre_token))


@functools.cache
def pre_tokens(path: str) -> PreTokens:
    """One cutter for each file and worker process."""
    return PreTokens(path)


def key_of(pre_token: str) -> str:
    return pre_token if len(pre_token) <= KEY_CHARS else hashlib.sha256(pre_token.encode()).hexdigest() + "#"


SEEN = pa.schema([("key", pa.string()), ("n", pa.int64()), ("pieces", pa.int64())])


def distinct_pieces(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``key, n, pieces``: every distinct pre-token, its occurrences and its pieces, counted once."""

    def gather(batches):
        cutter, spaced, seen = pre_tokens(tokenizer), Counter(), Counter()

        def handed():
            for chunk, n in spaced.items():
                for pre_token in cutter.behind_space(chunk):
                    seen[pre_token] += n
            spaced.clear()
            pieces = (cutter.pieces(p) if len(p) > KEY_CHARS else None for p in seen)
            yield pa.RecordBatch.from_arrays([pa.array(map(key_of, seen), pa.string()), pa.array(seen.values(), pa.int64()), pa.array(pieces, pa.int64())], schema=SEEN)
            seen.clear()

        for part in slices(batches):
            for text in part.column(0).to_pylist():
                cutter.count(text, spaced, seen)
                if len(seen) + len(spaced) >= HELD:
                    yield from handed()
        yield from handed()

    def count(batches):
        cutter = pre_tokens(tokenizer)
        for part in slices(batches, "key"):
            known = [cutter.pieces(k) if p is None else p for k, p in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(known, pa.int64())], schema=SEEN)

    seen = texts_of(docs).select("text").mapInArrow(gather, "key string, n long, pieces long")
    return seen.groupBy("key").agg(F.sum("n").alias("n"), F.max("pieces").alias("pieces")).mapInArrow(count, "key string, n long, pieces long")


def hot_limit(pieces: DataFrame, most: int) -> int:
    """The smallest power of two that at most ``most`` pre-tokens reach in occurrences."""
    sizes = pieces.groupBy(F.length(F.bin("n")).alias("bits")).agg(F.count("*").alias("k")).orderBy(F.desc("bits")).collect()
    limit, held = (1 << 63) - 1, 0
    for bits, k in sizes:
        held += k
        if held > most:
            break
        limit = 1 << (bits - 1)
    return limit


def document_counts(docs: DataFrame, tokenizer: str, hot: dict[str, int]) -> DataFrame:
    """``row, doc_id, n_bytes, n_tokens, rest``: tokens of the hot pre-tokens, and the frequencies of the rest."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        from pyspark import TaskContext

        cutter, known, row = pre_tokens(tokenizer), shared.value, TaskContext.get().partitionId() << 36

        def split(found: list[str]) -> tuple[int, list[str]]:
            """Pieces of the hot pre-tokens among some, and the keys of the others."""
            keys = list(map(key_of, found))
            return sum(known.get(k, 0) for k in keys), [k for k in keys if k not in known]

        def kept(chunk: str):
            """Pieces of a chunk, with the keys of what is not hot in it where there is any."""
            pieces, others = split(cutter.behind_space(chunk))
            return (pieces, others) if others else pieces

        chunks = Memory(kept)
        Memory.only(chunks)
        for part in slices(batches):
            counted, keys, times, ends = [], [], [], [0]
            for text in part.column(1).to_pylist():
                spaced, plain = [], Counter()
                tokens = cutter.count(text, spaced, plain)
                found = list(map(chunks.__getitem__, spaced))
                tokens += sum(x for x in found if type(x) is int)
                mixed = [x for x in found if type(x) is tuple]
                for pre_token, n in plain.items():
                    pieces, others = split([pre_token])
                    mixed.append((n * pieces, others * n))
                tokens += sum(x for x, _ in mixed)
                rest = Counter(k for _, others in mixed for k in others)
                counted.append(tokens)
                keys += rest.keys()
                times += rest.values()
                ends.append(len(keys))
            pairs = pa.StructArray.from_arrays([pa.array(keys, pa.string()), pa.array(times, pa.int64())], ["key", "n"])
            rest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            numbers = pa.array(range(row, row + len(counted)), pa.int64())
            row += len(counted)
            yield pa.RecordBatch.from_arrays([numbers, part.column(0), part.column(2), pa.array(counted, pa.int64()), rest], ["row", "doc_id", "n_bytes", "n_tokens", "rest"])

    read = texts_of(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return read.mapInArrow(run, "row long, doc_id long, n_bytes long, n_tokens long, rest array<struct<key: string, n: long>>")


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row."""
    pieces = staged(distinct_pieces(docs, tokenizer), "pieces")
    least = hot_limit(pieces, hot_rows)
    table = pieces.filter(F.col("n") >= least).select("key", "pieces").toArrow()
    hot = dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True))
    counted = staged(document_counts(docs, tokenizer, hot), "counted")
    rest = counted.select("row", F.explode("rest").alias("r")).select("row", "r.key", "r.n")
    joined = rest.join(pieces.filter(F.col("n") < least).select("key", "pieces"), "key")
    more = joined.groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("n_tokens"))
    none = F.lit(None).cast("long")
    parts = counted.select("row", "doc_id", "n_bytes", "n_tokens").unionByName(more.select("row", none.alias("doc_id"), none.alias("n_bytes"), "n_tokens"))
    whole = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"))
    return whole.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: bytes and tokens of every document."""
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
