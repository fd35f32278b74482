"""Bounded-space online best-fit packing of token pieces into sequences.

A document becomes pieces of at most ``capacity`` tokens. Only longer ones are
cut: full pieces are sequences of their own at once, and the remainder (the
first piece) goes to a packer with a fixed number of open bins. The packer
keys open bins by free space in a bitset with one bit per amount; the smallest
free space that holds a piece is one shift and one find-first-set away. When
all bins are open and a piece fits none, the fullest bin closes.

Packing starts inside the scan tasks, so no document moves: a task emits the
closed bins and hands over the pieces of those still open. They are dealt anew over
fewer tasks, at most half as many from level to level, and packed by the same
packer until one bounded task is left, which places what its open bins hold
anew, longest first, and closes all. No task holds more than its open bins.

Defined cases: a null text is the document of the end id alone; repeated rows
are packed once each; ties go to the bin opened first; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.llm.common import slices, staged, texts_of
from loreweave.llm.tokens import encoder

#: Open bins of one packer.
OPEN_BINS = 512
#: Pieces that one task packs at the later levels, a few times those that its open bins hold; of short pieces more.
PIECES_PER_TASK = 8192
#: Texts and characters tokenized together; the more, the fewer words are looked up.
SLICE_ROWS, SLICE_CHARS = 4096, 4_000_000

PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
BINS = pa.schema([("bin", pa.int64()), ("used", pa.int32()), ("open", pa.bool_()), ("pieces", pa.list_(PIECE))])
BINS_DDL = "bin long, used int, open boolean, pieces array<struct<doc_id: long, piece: int, start: long, length: long, ids_crc32: long, offset: long>>"


class Packer:
    """Online best fit over at most ``most`` open bins of ``capacity`` tokens."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.free = 0  # bit f: some open bin has f tokens free
        self.bins: dict[int, deque] = {}
        self.count = 0

    def _file(self, space: int, bin_: list) -> None:
        held = self.bins.get(space)
        if held is None:
            self.bins[space] = deque([bin_])
            self.free |= 1 << space
        else:
            held.append(bin_)
        self.count += 1

    def _take(self, space: int) -> list:
        held = self.bins[space]
        bin_ = held.popleft()
        if not held:
            del self.bins[space]
            self.free &= ~(1 << space)
        self.count -= 1
        return bin_

    def add(self, piece: dict):
        """Place a piece; yields the bins this closes, as ``(used, pieces)``."""
        length = piece["length"]
        fitting = self.free >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(space)
        else:
            space, bin_ = self.capacity, []
            if self.count >= self.most and length < self.capacity:
                fullest = (self.free & -self.free).bit_length() - 1
                yield self.capacity - fullest, self._take(fullest)
        piece["offset"] = self.capacity - space
        bin_.append(piece)
        if space == length:
            yield self.capacity, bin_
        else:
            self._file(space - length, bin_)

    def rest(self):
        """The open bins, fullest first."""
        while self.free:
            fullest = (self.free & -self.free).bit_length() - 1
            yield self.capacity - fullest, self._take(fullest)


def pieces_of(doc_id: int | None, packed: bytes, width: int, capacity: int) -> list[dict]:
    """The pieces of one document: only the first may be shorter than ``capacity``."""
    ids = np.frombuffer(packed, f"<u{width}").astype("<u4")
    head = len(ids) % capacity or min(len(ids), capacity)
    cuts = [0, *range(head, len(ids) + 1, capacity)]
    return [{"doc_id": doc_id, "piece": i, "start": a, "length": b - a, "ids_crc32": zlib.crc32(ids[a:b].tobytes()), "offset": 0} for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


class _Out:
    """Numbers finished bins within a task and gathers them into batches."""

    def __init__(self, packer: Packer):
        from pyspark import TaskContext

        self.packer, self.next, self.rows = packer, TaskContext.get().partitionId() << 32, []

    def add(self, piece: dict) -> None:
        for used, pieces in self.packer.add(piece):
            self.put(used, pieces, False)

    def put(self, used: int, pieces: list, is_open: bool) -> None:
        self.rows.append({"bin": self.next, "used": used, "open": is_open, "pieces": pieces})
        self.next += 1

    def finish(self, last: bool):
        """Hand over the pieces of the open bins; at the last level place them anew, longest first, and close all."""
        pieces = [x for _, bin_ in self.packer.rest() for x in bin_]
        if not last:
            for piece in pieces:
                self.put(piece["length"], [piece], True)
                yield from self.batches()
        else:
            self.packer = Packer(self.packer.capacity, max(1, len(pieces)))
            for piece in sorted(pieces, key=lambda x: -x["length"]):
                self.add(piece)
            for used, bin_ in self.packer.rest():
                self.put(used, bin_, False)
        yield from self.batches(1)

    def batches(self, least: int = 2048):
        if len(self.rows) >= least:
            yield pa.RecordBatch.from_pylist(self.rows, BINS)
            self.rows = []


def first_level(docs: DataFrame, tokenizer: str, end_id: int | None, capacity: int, open_bins: int) -> DataFrame:
    """Tokenize whole texts and pack them where they are read."""

    def run(batches):
        codec, out = encoder(tokenizer), _Out(Packer(capacity, open_bins))
        tail = b"" if end_id is None else np.asarray([end_id], codec.dtype).tobytes()
        for part in slices(batches, "text", SLICE_ROWS, SLICE_CHARS):
            for doc_id, ids in zip(part.column(0).to_pylist(), codec.packed_column(part.column(1)), strict=True):
                for piece in pieces_of(doc_id, ids + tail, codec.dtype.itemsize, capacity):
                    out.add(piece)
            yield from out.batches()
        yield from out.finish(False)

    return texts_of(docs).mapInArrow(run, BINS_DDL)


def next_level(pieces: DataFrame, capacity: int, open_bins: int, tasks: int) -> DataFrame:
    """Pack the pieces handed over, over ``tasks`` tasks."""

    def run(batches):
        out = _Out(Packer(capacity, open_bins))
        for batch in batches:
            for (piece,) in batch.column(0).to_pylist():
                out.add(piece)
            yield from out.batches()
        yield from out.finish(tasks == 1)

    return pieces.select("pieces").repartition(tasks).mapInArrow(run, BINS_DDL)


def pack(docs: DataFrame, tokenizer: str, end_id: int | None = None, capacity: int = 1024, open_bins: int = OPEN_BINS) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every document."""
    bins = staged(first_level(docs, tokenizer, end_id, capacity, open_bins), "packing")
    done = [bins.filter("not open")]
    tasks = None
    while True:
        open_ = bins.filter("open")
        left, tokens = open_.agg(F.count("*"), F.sum("used")).first()
        if not left:
            break
        # a task gets at least twice what its open bins hold, and the halving ends the levels whatever they close
        fitting = max(1, min(-(-left // PIECES_PER_TASK), -(-tokens // (2 * open_bins * capacity))))
        tasks = fitting if tasks is None else max(1, min(fitting, tasks // 2))
        bins = staged(next_level(open_, capacity, open_bins, tasks), "packing")
        done.append(bins.filter("not open"))
    parts = [b.select((F.col("bin") * 64 + F.lit(k)).alias("sequence_id"), F.explode("pieces").alias("p")) for k, b in enumerate(done)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.select("p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", "sequence_id", "p.offset")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document packed into sequences of at most 1024 tokens."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
