"""Byte-level BPE over a rank table, merged through a hierarchical-bitmap rank queue.

Pre-tokens are laid end to end; their symbols form a doubly linked list with a
border between one pre-token and the next. Each neighbouring pair that the table
knows is filed under its rank: a bucket per rank holds the left positions,
smallest first, and a bitmap of 64-bit words over the ranks, with summary words
above it, marks the buckets in use. Taking the next merge is find-first-set from
the top word down; an entry whose pair has changed since, or whose left symbol
is gone, is stale and skipped. Borders keep pre-tokens apart, so one queue merges
one pre-token of a hundred thousand bytes or the unknown short ones of a slice
of texts alike: ranks in rising order are each pre-token's own order, and the
search for the next rank is shared.

Pre-tokens repeat, so each worker keeps the ids of short ones in a bounded
two-generation memory (``tokens``); unknown and long ones go through the queue.

Defined cases: null text is empty (no ids, hashes of nothing); rows are
independent, so repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loreweave.llm.common import slices, texts_of
from loreweave.llm.tokens import LONGEST_KEPT, MARKS, Chunks, Memory


class RankQueue:
    """Buckets of positions per rank under a bitmap with summary levels."""

    def __init__(self, ranks: int):
        self.levels = []
        n = ranks
        while True:
            n = (n + 63) // 64
            self.levels.append([0] * n)
            if n == 1:
                break
        self.buckets: dict[int, list[int]] = {}

    def put(self, rank: int, bucket: list[int]) -> None:
        """A bucket, smallest position first, for a rank that has none."""
        self.buckets[rank] = bucket
        at = rank
        for words in self.levels:
            word = at >> 6
            held = words[word]
            words[word] = held | 1 << (at & 63)
            if held:
                return
            at = word

    def first(self) -> int:
        """The lowest rank in use, -1 if none."""
        at = 0
        for words in reversed(self.levels):
            held = words[at]
            if not held:
                return -1
            at = at << 6 | (held & -held).bit_length() - 1
        return at

    def drop(self, rank: int) -> None:
        """Forget a rank's empty bucket."""
        del self.buckets[rank]
        at = rank
        for words in self.levels:
            word = at >> 6
            words[word] &= ~(1 << (at & 63))
            if words[word]:
                break
            at = word


#: Chunks in one generation of a memory.
GENERATION = 400_000
#: Fixed value: a pre-token pattern under which a space before a solid character begins a pre-token.
SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteBPE(Chunks):
    """Encodes and decodes by a table of ``bytes -> rank``; ids are ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        super().__init__(GENERATION)
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.of_byte = np.asarray([ranks[bytes([b])] for b in range(256)], np.int64)
        self.of_two = np.asarray([ranks.get(bytes(divmod(two, 256)), -1) for two in range(65536)], np.int64)
        self.memory = Memory(lambda pre_token: self.merge([pre_token.encode()])[0], GENERATION)
        self.packed = self.spaces_kept if pattern == SPACED else self.whole

    def letters(self, word: str, space: str) -> bytes:
        """One pre-token, by the queue."""
        return self.merge([(space + word).encode()])[0] if space else self.memory[word]

    def whole(self, text: str) -> bytes:
        """Any text by the pattern's matches, as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memory.__getitem__, self.split(text)))

    def packed_all(self, texts: list[str]) -> list[bytes]:
        """``packed`` of each text; the unknown short words of all go through the queue together."""
        if self.packed == self.spaces_kept:
            self.learn(set().union(*(t.split(" ") for t in texts)), {t.partition(" ")[0] for t in texts})
        return list(map(self.packed, texts))

    def learn(self, chunks: set[str], firsts: set[str]) -> None:
        """Fill the memories with the short pre-tokens of ``chunks``, taken to follow a space, and of ``firsts``, which do not."""
        words, others = set(), {x for chunk in firsts if len(chunk) <= LONGEST_KEPT for x in self.split(chunk) if x not in self.memory}
        for chunk in chunks:
            if chunk in self.spaced or len(chunk) > LONGEST_KEPT:
                continue
            word = chunk.rstrip(MARKS)
            if word.isalpha():
                if word not in self.spaced:
                    words.add(word)
            else:
                others.update(x for x in self.split(" " + chunk) if x not in self.memory)
        words = [w for w in words if w not in self.spaced.old]
        for word, ids in zip(words, self.merge([f" {w}".encode() for w in words]), strict=True):
            self.spaced.keep(word, ids)
        others = [x for x in others if x not in self.memory.old]
        for pre_token, ids in zip(others, self.merge([x.encode() for x in others]), strict=True):
            self.memory.keep(pre_token, ids)

    def merge(self, pre_tokens: list[bytes]) -> list[bytes]:
        """Packed ids of each pre-token."""
        ranks = self.ranks
        out = [ranks.get(p) for p in pre_tokens]
        left = [i for i, r in enumerate(out) if r is None]
        if left:
            for i, ids in zip(left, self._merge([pre_tokens[i] for i in left]), strict=True):
                out[i] = ids
        return [x if isinstance(x, bytes) else x.to_bytes(4, "little") for x in out]

    def _merge(self, pre_tokens: list[bytes]) -> list[bytes]:
        data = b"".join(pre_tokens)
        raw, n = np.frombuffer(data, np.uint8), len(data)
        starts = np.concatenate([[0], np.cumsum([len(p) for p in pre_tokens])])
        begins = np.zeros(n + 1, np.uint8)
        begins[starts] = 1  # an empty pre-token shares its begin with the next
        pairs = np.append(self.of_two[raw[:-1].astype(np.int64) << 8 | raw[1:]], -1)[:n]
        pairs[np.nonzero(begins[1:])[0]] = -1  # no pair reaches over a border
        queue = self.queue
        order = np.argsort(pairs, kind="stable")
        order = order[np.searchsorted(pairs[order], 0) :]
        used, at = np.unique(pairs[order], return_index=True)
        for rank, bucket in zip(used.tolist(), np.split(order, at[1:]), strict=False):
            queue.put(rank, bucket.tolist())
        # of the symbol at a position: its id (-1 once merged away), its end, the begin of the one before, its pair's rank
        symbol, end, before, pair = self.of_byte[raw].tolist(), list(range(1, n + 1)), list(range(-1, n - 1)), pairs.tolist()
        begins, get, put, buckets = begins.tobytes(), self.ranks.get, queue.put, queue.buckets
        while (r := queue.first()) >= 0:
            bucket = buckets[r]
            low = r
            while bucket and low == r:
                i = heappop(bucket)
                if pair[i] != r:
                    continue  # stale
                j = end[i]
                k = end[j]
                symbol[i], symbol[j] = r, -1
                end[i], pair[j] = k, -1
                q = None
                if not begins[k]:
                    before[k] = i
                    q = get(data[i : end[k]])
                if q is None:
                    pair[i] = -1
                else:
                    pair[i] = q
                    if q in buckets:
                        heappush(buckets[q], i)
                    else:
                        put(q, [i])
                    if q < low:
                        low = q  # the other positions of this rank wait
                if not begins[i]:
                    h = before[i]
                    q = get(data[h:k])
                    if q is None:
                        pair[h] = -1
                    else:
                        pair[h] = q
                        if q in buckets:
                            heappush(buckets[q], h)
                        else:
                            put(q, [h])
                        if q < low:
                            low = q
            if not bucket:
                queue.drop(r)
        ids = np.asarray(symbol, np.int64)
        alive = np.nonzero(ids >= 0)[0]
        packed, cuts = ids[alive].astype("<u4").tobytes(), (4 * np.searchsorted(alive, starts)).tolist()
        return [packed[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def codec(path: str, pattern: str) -> ByteBPE:
    """One codec for each rank file and worker process."""
    found = _codec(path, pattern)
    Memory.only(found.bare, found.spaced, found.memory)
    return found


@functools.cache
def _codec(path: str, pattern: str) -> ByteBPE:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}
    return ByteBPE(ranks, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids (packed), decoded (bytes of the decoded ids)`` of every whole text."""

    def run(batches):
        bpe = codec(path, pattern)
        for part in slices(batches):
            packed = bpe.packed_all(part.column(1).to_pylist())
            decoded = [bpe.decode_bytes(np.frombuffer(p, "<u4").tolist()) for p in packed]
            yield pa.record_batch([part.column(0), pa.array(packed, pa.binary()), pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"])

    return texts_of(docs).mapInArrow(run, "doc_id long, ids binary, decoded binary")


def encode_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """As ``encode_documents``, with digests made where the ids are: they never leave the worker."""

    def run(batches):
        bpe = codec(path, pattern)
        sha = hashlib.sha256
        for part in slices(batches):
            n, ids, decoded = [], [], []
            for packed in bpe.packed_all(part.column(1).to_pylist()):
                n.append(len(packed) // 4)
                ids.append(sha(packed).hexdigest())
                decoded.append(sha(bpe.decode_bytes(np.frombuffer(packed, "<u4").tolist())).hexdigest())
            yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts_of(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: ids of every whole text and their decoding, as digests."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
