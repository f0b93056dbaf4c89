"""Operator 5: packing by bounded-space online best fit.

Each task keeps a fixed number of open windows. A document is tokenised; its full windows go out at once, and what
remains goes to the open window that it fills best. When none has room, the fullest is topped up with a cut of the
piece and goes out. What is open at the end of a task is merged with what other tasks left, by the same rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table, written
from ._tokens import encoder

#: Open windows of a task.
OPEN_WINDOWS = 32
#: A window short of fewer tokens than this goes out as it is, rather than with a snippet of a document.
LEAST_CUT = 4
#: Tasks whose leftovers are merged together: at most this many times OPEN_WINDOWS windows in one group.
MERGED_TASKS = 32
#: Rows of an output batch.
ROWS = 2000

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, task long, seq long, offset long, closed boolean"


class _Packer:
    """Open windows of `size` tokens. A piece is (doc_id, start, ids, doc_tokens); done gets (window number, pieces)."""

    def __init__(self, size: int, room: int):
        self.size, self.room = size, room
        self.open: list[list] = []  # [tokens, pieces]
        self.count = 0
        self.done: list[tuple[int, list]] = []

    def _emit(self, pieces: list) -> None:
        self.done.append((self.count, pieces))
        self.count += 1

    def add(self, pieces: list) -> None:
        """Places the pieces, less than a window together, into one window; cuts them only if none has room."""
        while pieces:
            need = sum(len(p[2]) for p in pieces)
            if need >= self.size:
                head, pieces = _cut(pieces, self.size)
                self._emit(head)
                continue
            fits = [w for w in self.open if w[0] + need <= self.size]
            if fits:
                best = max(fits, key=lambda w: w[0])
                best[0] += need
                best[1] += pieces
                if best[0] == self.size:
                    self.open.remove(best)
                    self._emit(best[1])
                return
            if len(self.open) < self.room:
                self.open.append([need, list(pieces)])
                return
            fullest = max(self.open, key=lambda w: w[0])
            self.open.remove(fullest)
            gap = self.size - fullest[0]
            if gap >= LEAST_CUT:
                head, pieces = _cut(pieces, gap)
                fullest[1] += head
            self._emit(fullest[1])

    def flush(self) -> None:
        """The open windows, one behind the other, cut where a sequence is full."""
        pieces = [p for w in sorted(self.open, key=lambda w: -w[0]) for p in w[1]]
        self.open = []
        while pieces:
            head, pieces = _cut(pieces, self.size)
            self._emit(head)

    def taken(self) -> list[tuple[int, list]]:
        done, self.done = self.done, []
        return done


def _cut(pieces: list, n: int) -> tuple[list, list]:
    """The first n tokens, and the rest."""
    head = []
    for i, (doc, start, ids, total) in enumerate(pieces):
        if len(ids) > n:
            head += [(doc, start, ids[:n], total)] if n else []
            return head, [(doc, start + n, ids[n:], total), *pieces[i + 1 :]]
        head.append((doc, start, ids, total))
        n -= len(ids)
    return head, []


def _rows(done: list, task: int, closed: bool) -> Iterator[tuple]:
    for seq, pieces in done:
        at = 0
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids), ids.tobytes(), total, task, seq, at, closed
            at += len(ids)


_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("task", pa.int64()), ("seq", pa.int64()), ("offset", pa.int64()), ("closed", pa.bool_())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 0, text: str = "text", doc_id: str = "doc_id", open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Every document is its token ids and then end_id. Null or empty text: end_id alone. A null doc_id stays null;
    repeated rows are packed each. Other columns of docs are left out. An empty table gives no rows. Each id lies in
    exactly one piece; sequences hold at most `size` ids and have no holes.
    """

    def online(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer, task, rows = encoder(tokenizer), _Packer(size, open_windows), TaskContext.get().partitionId(), []
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1)), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                packer.add([(doc, 0, ids, len(ids))])
                if packer.done:
                    rows += _rows(packer.taken(), task, True)
                if len(rows) >= ROWS:
                    yield _batch(rows)
                    rows = []
        left = [(packer.count + i, w[1]) for i, w in enumerate(packer.open)]
        rows += _rows(left, task, False)
        if rows:
            yield _batch(rows)
        pa.default_memory_pool().release_unused()

    def merge(key: tuple, left: pd.DataFrame) -> pd.DataFrame:
        packer = _Packer(size, open_windows)
        left = left.sort_values(["task", "seq", "offset"])
        waiting = [[(None if pd.isna(r.doc_id) else int(r.doc_id), r.start, np.frombuffer(r.ids, "<u4"), r.doc_tokens) for r in w.itertuples()] for _, w in left.groupby(["task", "seq"], sort=True)]
        for pieces in sorted(waiting, key=lambda w: -sum(len(p[2]) for p in w)):
            packer.add(pieces)
        packer.flush()
        out = pd.DataFrame(list(_rows(packer.taken(), int(key[0]), True)), columns=_ARROW.names)
        return out.astype({"doc_id": "Int64"})

    placed = written(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(online, PIECES), "packing")
    ready = placed.filter("closed").withColumn("sequence_id", F.shiftleft("task", 32) + F.col("seq"))
    group = F.floor(F.col("task") / MERGED_TASKS)
    merged = placed.filter("not closed").groupBy(group.alias("g")).applyInPandas(merge, PIECES)
    merged = merged.withColumn("sequence_id", F.shiftleft(F.col("task") + F.lit(1 << 30), 32) + F.col("seq"))
    keep = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    return ready.select(*keep).unionByName(merged.select(*keep))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"), default_tokenizer())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op5_packing": op5_packing}
ORACLE_SQL: dict[str, str] = {}
