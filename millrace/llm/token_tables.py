"""Operator 6: token ids in sorted-string-table shards.

A shard holds documents in ascending key order. Layout:

    magic | block ... | index | Bloom filter | footer | length of the footer (4 bytes) | magic

A block is zstd-compressed entries: varint shared key bytes, varint further key bytes, varint value bytes, the further
key bytes, the value. The index has each block's first key, place, sizes, entries, tokens and CRC-32. The footer is
JSON. A lookup asks the Bloom filter, finds the block by binary search in the index and reads that one block (and
further ones only if copies of one document reach into them).
"""

from __future__ import annotations

import io
import json
import re
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import scratch, table, written
from ._tokens import encoder
from ._words import mix
from .packing import default_tokenizer

MAGIC = b"MRSST01\n"
BLOCK_BYTES = 256 << 10
SHARD_BYTES = 64 << 20
#: Bytes of text that a task encodes: their number follows the size of the table.
TASK_BYTES = 32 << 20
BLOOM_BITS_PER_KEY = 10
BLOOM_HASHES = 7
MANIFEST = "path string, task long, shard long, n_docs long, n_tokens long, n_bytes long, first_key binary, last_key binary"
SHARDS_A_GROUP = 4096


#: Bytes of a key that stand for the document; the others number its copies.
DOC_BYTES = 9


def qualified(spark: SparkSession, path: str) -> str:
    """The whole URI of a folder as Spark resolves it: a plain path is one of fs.defaultFS, on every machine."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return re.sub("^file:/(?!/)", "file:///", uri)


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder, by its whole URI; a path without scheme is an error, as it would be each machine's own."""
    if "://" not in path:
        raise ValueError(f"{path} names no file system")
    return fs.FileSystem.from_uri(path)


def doc_key(doc_id: int | None, copy: int | None = None) -> bytes:
    """Bytes that sort as (null first, doc_id, copy); without a copy, the part that all copies have in common."""
    number = bytes(DOC_BYTES) if doc_id is None else b"\x01" + struct.pack(">Q", doc_id + (1 << 63))
    return number if copy is None else number + struct.pack(">Q", copy)


def key_doc(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:9])[0] - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(keys: list[bytes], bits: int) -> np.ndarray:
    """BLOOM_HASHES places for each key, by double hashing."""
    pairs = np.array([(zlib.crc32(k) << 32 | zlib.crc32(k[::-1], 0x9747B28C)) & 0xFFFFFFFFFFFFFFFF for k in keys], np.uint64)
    one, two = mix(pairs), mix(pairs ^ np.uint64(0xA5A5A5A5A5A5A5A5)) | np.uint64(1)
    return (one[:, None] + two[:, None] * np.arange(BLOOM_HASHES, dtype=np.uint64)) % np.uint64(bits)


class ShardWriter:
    """Writes one shard. add() takes keys in ascending order, with values of little-endian ids."""

    def __init__(self, out, id_bytes: int = 4):
        self.out, self.id_bytes = out, id_bytes
        self.at = out.write(MAGIC)
        self.index: list[list] = []
        self.keys: list[bytes] = []
        self.tokens = 0
        self._start()

    def _start(self) -> None:
        self.block, self.size, self.first, self.last, self.count, self.in_block = [], 0, b"", b"", 0, 0

    def add(self, key: bytes, value: bytes) -> None:
        if self.keys and key <= self.keys[-1]:
            raise ValueError("keys must ascend")
        shared = 0
        if self.count:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block += [_varint(shared), _varint(len(key) - shared), _varint(len(value)), key[shared:], value]
        self.last, self.count, self.size, self.in_block = key, self.count + 1, self.size + len(value) + 8, self.in_block + len(value) // self.id_bytes
        self.keys.append(key)
        if self.size >= BLOCK_BYTES:
            self._end()

    def _end(self) -> None:
        if self.count:
            raw = b"".join(self.block)
            data = pa.Codec("zstd", 1).compress(raw, asbytes=True)
            self.out.write(data)
            self.index.append([self.first.hex(), self.at, len(data), len(raw), self.count, self.in_block, zlib.crc32(data)])
            self.at += len(data)
            self.tokens += self.in_block
        self._start()

    def close(self) -> None:
        self._end()
        index = json.dumps(self.index).encode()
        bits = max(64, BLOOM_BITS_PER_KEY * len(self.keys) + 7 & ~7)
        bloom = np.zeros(bits, np.uint8)
        if self.keys:
            bloom[_bloom_places([k[:DOC_BYTES] for k in self.keys], bits).ravel()] = 1
        bloom = np.packbits(bloom).tobytes()
        footer = {"index": [self.at, len(index)], "bloom": [self.at + len(index), len(bloom), bits], "n_docs": len(self.keys), "n_tokens": self.tokens, "id_bytes": self.id_bytes}
        footer = json.dumps(footer).encode()
        self.out.write(index + bloom + footer + struct.pack("<I", len(footer)) + MAGIC)


class ShardReader:
    """Reads one shard from a seekable file."""

    def __init__(self, source):
        self.source = source
        source.seek(0, io.SEEK_END)
        size = source.tell()
        tail = self._read(size - 12, 12)
        if tail[4:] != MAGIC:
            raise ValueError("not a shard, or cut off")
        length = struct.unpack("<I", tail[:4])[0]
        self.footer = json.loads(self._read(size - 12 - length, length))
        self.index = json.loads(self._read(*self.footer["index"]))
        self.firsts = [bytes.fromhex(x[0]) for x in self.index]
        self.flags = None

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, size, raw, _, _, crc = self.index[i]
        data = self._read(at, size)
        if zlib.crc32(data) != crc:
            raise ValueError(f"block {i} is damaged")
        data = pa.Codec("zstd", 1).decompress(data, raw, asbytes=True)
        at, key = 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            more, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + more]
            at += more + size
            yield key, data[at - size : at]

    def may_have(self, doc: bytes) -> bool:
        """Whether the Bloom filter, read once, admits the document part of a key."""
        at, size, bits = self.footer["bloom"]
        if self.flags is None:
            self.flags = np.frombuffer(self._read(at, size), np.uint8)
        places = _bloom_places([doc], bits)[0].astype(np.int64)
        return bool(((self.flags[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1).all())

    def copies(self, doc: bytes) -> Iterator[bytes]:
        """The values of all keys that begin with doc, the document part of a key."""
        if not self.may_have(doc):
            return
        for i in range(max(0, bisect_right(self.firsts, doc) - 1), len(self.firsts)):
            if self.firsts[i][:DOC_BYTES] > doc:
                return
            yield from (value for key, value in self.block(i) if key[:DOC_BYTES] == doc)


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 2, text: str = "text", doc_id: str = "doc_id", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encodes every whole text, writes shards under folder and returns their manifest (one row per shard).

    Rows are dealt by ranges of (doc_id, hash of the text) and sorted within a task, so that (task, shard) is key
    order, and copies of one doc_id do not meet in one task. Null doc_ids come first; rows of one doc_id follow each
    other by hash, with a copy number in the key. Null text: end_id alone. Extra columns are left out. A task that is
    run again writes new files; only those in the manifest count. An empty table gives an empty manifest.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task = encoder(tokenizer), TaskContext.get().partitionId()
        narrow = coder.tokenizer.get_vocab_size() <= 1 << 16 and (end_id or 0) < 1 << 16
        store, base = open_store(folder)
        store.create_dir(base)
        end = np.array([] if end_id is None else [end_id], np.uint32)
        made, before, copy, shard, out = [], None, 0, None, None

        def finish():
            shard.close()
            out.close()
            made[-1] |= {"n_docs": len(shard.keys), "n_tokens": shard.tokens, "n_bytes": shard.at, "first_key": shard.keys[0], "last_key": shard.keys[-1]}

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1)), strict=True):
                copy = copy + 1 if made and doc == before else 0
                before = doc
                if shard is None or shard.at >= shard_bytes:
                    if shard is not None:
                        finish()
                    name = f"{task:08d}-{len(made):05d}-{uuid.uuid4().hex[:12]}.sst"
                    made.append({"path": f"{folder}/{name}", "task": task, "shard": len(made)})
                    out = store.open_output_stream(f"{base}/{name}")
                    shard = ShardWriter(out, 2 if narrow else 4)
                shard.add(doc_key(doc, copy), np.append(ids, end).astype("<u2" if narrow else "<u4").tobytes())
        if shard is not None:
            finish()
            yield pa.RecordBatch.from_pylist(made)
        pa.default_memory_pool().release_unused()

    folder = qualified(docs.sparkSession, folder)
    size = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))).first()[0] or 0
    n = max(1, ceil(size / TASK_BYTES))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h"))
    rows = rows.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return written(rows.mapInArrow(write, MANIFEST), "shards")


def with_starts(manifest: DataFrame) -> DataFrame:
    """Adds first_id, the ids in all shards before, by two levels: within groups of tasks, then over the groups."""
    manifest = manifest.withColumn("g", F.floor(F.col("task") / SHARDS_A_GROUP))
    order = Window.partitionBy("g").orderBy("task", "shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = manifest.groupBy("g").agg(F.sum("n_tokens").alias("n"))
    groups = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("g", F.coalesce(F.sum("n").over(groups), F.lit(0)).alias("base"))
    inner = manifest.withColumn("inner", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    return inner.join(totals, "g").withColumn("first_id", F.col("base") + F.col("inner")).drop("g", "base", "inner")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Every document of the shards: doc_id, start (ids before it in all shards), n_tokens, ids (little-endian unsigned 32-bit)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = open_store(row["path"])
                with store.open_input_file(path) as source:
                    shard, start = ShardReader(source), row["first_id"]
                    kind = f"<u{shard.footer['id_bytes']}"
                    for i in range(len(shard.index)):
                        out = []
                        for key, value in shard.block(i):
                            ids = np.frombuffer(value, kind).astype("<u4")
                            out.append((key_doc(key), start, len(ids), ids.tobytes()))
                            start += len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "start", "n_tokens", "ids"])

    starts = written(with_starts(manifest), "starts")
    return starts.repartition(min(10_000, max(1, starts.count()))).select("path", "first_id").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def lookup(manifest: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """(doc_id, ids) for every copy of the documents asked for, by key ranges, Bloom filter, index and block.

    doc_ids has one column doc_id; repeated ids count once, a null one finds the documents without an id, unknown ones
    give no row. The key ranges of the tasks that wrote the shards, as many as there were tasks, go to every task of the
    lookup; ids then meet the shards of their tasks by equality, and only those whose key range holds them are read.
    """
    spark = manifest.sparkSession
    tasks = manifest.groupBy("task").agg(F.min("first_key").alias("first"), F.max("last_key").alias("last")).orderBy("task").collect()
    ranges = spark.sparkContext.broadcast(([r.task for r in tasks], [bytes(r.first)[:DOC_BYTES] for r in tasks], [bytes(r.last)[:DOC_BYTES] for r in tasks]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, firsts, lasts = ranges.value
        for batch in batches:
            keys = [doc_key(d) for d in batch.column(0).to_pylist()]
            found = [(numbers[i], key) for key in keys for i in range(bisect_left(lasts, key), bisect_right(firsts, key))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())], names=["task", "key"])

    def find(group: pd.DataFrame) -> pd.DataFrame:
        store, path = open_store(group.path.iloc[0])
        with store.open_input_file(path) as source:
            shard = ShardReader(source)
            kind = f"<u{shard.footer['id_bytes']}"
            found = [(key_doc(bytes(k)), np.frombuffer(v, kind).astype("<u4").tobytes()) for k in sorted(group.key) for v in shard.copies(bytes(k))]
        return pd.DataFrame(found, columns=["doc_id", "ids"]).astype({"doc_id": "Int64"})

    wanted = doc_ids.select(F.col("doc_id").cast("long")).distinct().mapInArrow(deal, "task long, key binary")
    doc_part = lambda key: F.substring(key, 1, DOC_BYTES)
    shards = manifest.select("task", "path", doc_part("first_key").alias("first"), doc_part("last_key").alias("last"))
    wanted = wanted.join(shards, "task").filter("key between first and last")
    return wanted.select("path", "key").groupBy("path").applyInPandas(find, "doc_id long, ids binary")


def op6_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_shards(table(spark, sf_dir, "documents"), scratch(spark, "sst"), default_tokenizer())
    return read_shards(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op6_token_tables": op6_token_tables}
ORACLE_SQL: dict[str, str] = {}
