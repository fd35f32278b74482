"""Sorted-string-table shards of token ids.

File layout, integers little-endian unless they are part of a key::

    block*        entries, restart offsets (u32 each), restart count (u32)
    index         for each block: key length u16, first key, offset u64, length u32, crc32 u32
    bloom         bit array over the keys
    footer        see FOOTER: index offset and length, bloom offset and length, bloom
                  hashes, blocks, entries, tokens, id width, version, magic

An entry is ``shared varint, unshared varint, value length varint, unshared key
bytes, value``: the key drops the prefix that it shares with its predecessor,
except at every RESTART-th entry of a block, where it is whole. A value holds
the ids at fixed width. A key orders like its identifier: a flag byte (0 null,
1 present), then the identifier big-endian with its sign bit flipped.

Shards are written by range of identifier, so shard number, then place in the
shard, is ascending order over the whole table. A task streams its sorted rows:
it holds one block, the sparse index and the Bloom filter's hashes. A shard is
written under a name of its own attempt and moved into place when complete, so
a repeated task replaces it with equal bytes. The folder is reached through
pyarrow's file systems (local, HDFS, S3, GCS); what a failed attempt leaves
(``attempt-*``) is no shard, and goes with the folder where that is the default.

Defined cases: null text is the empty document (end id only); a null identifier
sorts before all others; repeated identifiers give one entry each, in no stated
order (one that fills several ranges is dealt over all of them, so that no shard
grows with it); an empty table gives no shards and no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loreweave.llm.common import slices, staged, staging_path, texts_of
from loreweave.llm.tokens import encoder

MAGIC = b"LWSST\x00\x01\n"
FOOTER = struct.Struct("<QQQQIIQQHH8s")
INDEX = struct.Struct("<QII")
RESTART = 16
#: A block closes once it has this many bytes.
BLOCK_BYTES = 64 * 1024
BLOOM_BITS = 10
BLOOM_HASHES = 7


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + ((doc_id + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key[:1] == b"\x00" else int.from_bytes(key[1:], "big") - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


def probes(key: bytes, bits: int, hashes: int) -> list[int]:
    """Bit places of a key, by double hashing."""
    a, b = xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2) | 1
    return [(a + i * b) % bits for i in range(hashes)]


class ShardWriter:
    """Appends entries in key order to an open file; ``close`` writes index, filter and footer."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.index, self.hashed = [], []
        self.entries = self.tokens = 0
        self._open_block()

    def _open_block(self) -> None:
        self.block, self.restarts, self.count, self.last, self.first = bytearray(), [], 0, b"", b""

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.count % RESTART:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(len(self.block))
        if not self.count:
            self.first = key
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last = key
        self.count += 1
        self.entries += 1
        self.tokens += len(value) // self.width
        self.hashed.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self._close_block()

    def _close_block(self) -> None:
        if not self.count:
            return
        data = bytes(self.block) + struct.pack(f"<{len(self.restarts)}I", *self.restarts) + struct.pack("<I", len(self.restarts))
        self.out.write(data)
        self.index.append((self.first, self.at, len(data), zlib.crc32(data)))
        self.at += len(data)
        self._open_block()

    def close(self) -> int:
        """Finish the file; its size."""
        self._close_block()
        index = b"".join(struct.pack("<H", len(k)) + k + INDEX.pack(o, n, c) for k, o, n, c in self.index)
        bits = max(64, BLOOM_BITS * self.entries + 7 & ~7)
        bloom = np.zeros(bits, np.uint8)
        for key in self.hashed:
            bloom[probes(key, bits, BLOOM_HASHES)] = 1
        packed = np.packbits(bloom, bitorder="little").tobytes()
        footer = FOOTER.pack(self.at, len(index), self.at + len(index), len(packed), BLOOM_HASHES, len(self.index), self.entries, self.tokens, self.width, 1, MAGIC)
        self.out.write(index + packed + footer)
        return self.at + len(index) + len(packed) + len(footer)


@dataclass
class Entry:
    key: bytes
    value: bytes


class ShardReader:
    """Reads a shard through any random-access file with ``read_at(nbytes, offset)`` and ``size()``."""

    def __init__(self, source):
        self.source, size = source, source.size()
        if size < FOOTER.size:
            raise ValueError("not a shard: too short")
        at, n, bloom_at, bloom_n, self.hashes, blocks, self.entries, self.tokens, self.width, version, magic = FOOTER.unpack(source.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC or version != 1:
            raise ValueError("not a shard: wrong magic or version")
        raw, place, self.index = source.read_at(n, at), 0, []
        while place < len(raw):
            (k,) = struct.unpack_from("<H", raw, place)
            key = raw[place + 2 : place + 2 + k]
            self.index.append((key, *INDEX.unpack_from(raw, place + 2 + k)))
            place += 2 + k + INDEX.size
        if len(self.index) != blocks:
            raise ValueError("shard index is damaged")
        self.bloom = source.read_at(bloom_n, bloom_at)

    def block(self, i: int) -> bytes:
        _, at, n, crc = self.index[i]
        data = self.source.read_at(n, at)
        if zlib.crc32(data) != crc:
            raise ValueError(f"block {i} is damaged")
        return data

    @staticmethod
    def scan(data: bytes, at: int = 0) -> Iterator[Entry]:
        """Entries of a block from a restart point on."""
        (count,) = struct.unpack_from("<I", data, len(data) - 4)
        end, key = len(data) - 4 - 4 * count, b""
        while at < end:
            shared, at = read_varint(data, at)
            rest, at = read_varint(data, at)
            n, at = read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield Entry(key, data[at : at + n])
            at += n

    def __iter__(self) -> Iterator[Entry]:
        for i in range(len(self.index)):
            yield from self.scan(self.block(i))

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in probes(key, 8 * len(self.bloom), self.hashes))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every entry with the identifier: filter, index, restart points, then a short scan."""
        key, out = key_of(doc_id), []
        if not self.may_hold(key):
            return out
        low, high = 0, len(self.index)
        while low < high:  # first block whose first key is not below the key
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.index[mid][0] < key else (low, mid)
        for i in range(max(0, low - 1), len(self.index)):
            if self.index[i][0] > key:
                break
            data = self.block(i)
            (count,) = struct.unpack_from("<I", data, len(data) - 4)
            restarts = struct.unpack_from(f"<{count}I", data, len(data) - 4 - 4 * count)
            a, b = 0, count
            while a < b:
                mid = (a + b) // 2
                a, b = (mid + 1, b) if next(self.scan(data, restarts[mid])).key < key else (a, mid)
            for entry in self.scan(data, restarts[max(0, a - 1)]):
                if entry.key > key:
                    return out
                if entry.key == key:
                    out.append(np.frombuffer(entry.value, f"<u{self.width}"))
        return out


def open_shard(path: str) -> ShardReader:
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    source = store.open_input_file(name)
    return ShardReader(_Source(source))


class _Source:
    def __init__(self, file):
        self.file = file

    def size(self) -> int:
        return self.file.size()

    def read_at(self, n: int, at: int) -> bytes:
        return self.file.read_at(n, at)


def tokenized(docs: DataFrame, tokenizer: str, end_id: int | None, bounds: list[int]) -> DataFrame:
    """``bucket, doc_id, width, ids``: packed ids of whole texts and the range bucket of each identifier."""
    cuts = np.asarray(bounds, np.int64)

    def run(batches):
        codec = encoder(tokenizer)
        tail = b"" if end_id is None else np.asarray([end_id], codec.dtype).tobytes()
        seen = 0
        for part in slices(batches):
            ids = [codec.packed(t) + tail for t in part.column(1).to_pylist()]
            keys = part.column(0).to_pylist()
            known = np.asarray([k if k is not None else 0 for k in keys], np.int64)
            low, high = np.searchsorted(cuts, known, "left"), np.searchsorted(cuts, known, "right")
            # an identifier that fills several ranges is dealt over all of them
            bucket = np.where([k is None for k in keys], 0, low + (np.arange(seen, seen + len(keys)) % (high - low + 1)))
            seen += len(keys)
            yield pa.record_batch([pa.array(bucket, pa.int32()), pa.array(keys, pa.int64()), pa.array([codec.dtype.itemsize] * len(ids), pa.int32()), pa.array(ids, pa.binary())], names=["bucket", "doc_id", "width", "ids"])

    return texts_of(docs).mapInArrow(run, "bucket int, doc_id long, width int, ids binary")


def range_bounds(docs: DataFrame, ranges: int) -> list[int]:
    """Identifiers that cut the table into about equal ranges; reads the identifier column only."""
    if ranges < 2:
        return []
    at = [i / ranges for i in range(1, ranges)]
    row = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), at, 10 * ranges).alias("cuts")).first()
    return list(row.cuts or [])


def write_shards(rows: DataFrame, folder: str, shards: int) -> DataFrame:
    """Write ``tokenized`` rows as shards in ``folder``; a manifest with one row for each shard."""

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        current = writer = out = name = None
        low = high = None

        def finish():
            size = writer.close()
            out.close()
            final = f"{root}/shard-{current:08d}.sst"
            store.move(name, final)
            return pa.RecordBatch.from_pylist([{"shard": current, "path": f"{folder}/shard-{current:08d}.sst", "n_docs": writer.entries, "n_tokens": writer.tokens, "bytes": size, "first_id": low, "last_id": high}], MANIFEST)

        for batch in batches:
            for bucket, doc_id, width, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != current:
                    if writer:
                        yield finish()
                    current, name, low = bucket, f"{root}/attempt-{bucket:08d}-{uuid.uuid4().hex}", doc_id
                    out = store.open_output_stream(name)
                    writer = ShardWriter(out, width)
                writer.add(key_of(doc_id), ids)
                high = doc_id
        if writer:
            yield finish()

    dealt = rows.repartitionById(shards, "bucket").sortWithinPartitions("bucket", "doc_id", "ids")  # one range a task
    return dealt.mapInArrow(run, "shard int, path string, n_docs long, n_tokens long, bytes long, first_id long, last_id long")


MANIFEST = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("bytes", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64())])


def write_table(docs: DataFrame, tokenizer: str, end_id: int | None = None, folder: str | None = None, shards: int | None = None) -> DataFrame:
    """Tokenize ``docs`` and write them as shards; the manifest, itself a written table.

    ``shards`` (default: the session's shuffle partitions) is the number of key
    ranges; aim at some hundred MB of ids each.
    """
    spark = docs.sparkSession
    folder = folder or staging_path(spark, "sstable")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = tokenized(docs, tokenizer, end_id, range_bounds(docs, shards))
    return staged(write_shards(rows, folder, shards), "sstable-manifest")


def read_table(manifest: DataFrame) -> DataFrame:
    """Every entry of every shard: ``doc_id, start, n_tokens, ids_crc32, ids``.

    ``start`` counts the ids of all entries before: a running sum over the
    manifest (one row a shard) gives each shard's base, the rest is local.
    """

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader, start, rows, held = open_shard(path), base, [], 0
                for entry in reader:
                    ids = np.frombuffer(entry.value, f"<u{reader.width}").astype("<u4")
                    rows.append({"doc_id": id_of(entry.key), "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes()), "ids": ids.tobytes()})
                    start, held = start + len(ids), held + ids.nbytes
                    if held >= 8 << 20 or len(rows) >= 4096:
                        yield pa.RecordBatch.from_pylist(rows, ENTRIES)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, ENTRIES)

    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spark = manifest.sparkSession
    paths = manifest.select("path", before.alias("base")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return paths.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


ENTRIES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def lookup(manifest: DataFrame, doc_id: int | None) -> list[np.ndarray]:
    """Point lookup: the shards whose range covers the identifier, then filter and binary search."""
    near = manifest.filter((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id) | F.col("first_id").isNull()) if doc_id is not None else manifest.filter(F.col("first_id").isNull())
    return [ids for row in near.select("path").collect() for ids in open_shard(row.path).get(doc_id)]


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document's ids through written and re-read shards."""
    import public_tokenizers

    manifest = write_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_table(manifest).drop("ids")
