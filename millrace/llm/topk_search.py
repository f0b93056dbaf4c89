"""Operator 3: exact top-k inner products by a bit-sliced index.

Vectors are quantised to integers and stored, block by block, as bitmaps: one per component and binary place. For a
query, the bitmaps that its own bits call for are added with carry-save full adders, whole bitmaps at a time; the sum
is again a row of bitmaps, one per binary place. The best rows are then selected from the most significant bitmap
downward, rows that tie at the boundary are resolved by their ids, and the scores are read from the sum's bitmaps.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import floor
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import sized_broadcast, table, written

#: Rows of a block of the index and of a block of queries, and the bytes of components beyond which a block has fewer.
BLOCK_ROWS, QUERY_ROWS, BLOCK_BYTES = 16_384, 2_048, 16 << 20
#: Bytes of the index that a task holds while all queries pass by. Queries are copied once for each such strip.
STRIP_BYTES = 64 << 20
#: Components of at most so many bits are indexed; vectors with larger ones are scored one by one, as integers of any size.
MOST_BITS = 24
#: Scores beyond 64 bits are given as the nearest 64-bit integer; ranks follow the true ones.
LEAST_LONG, MOST_LONG = -(1 << 63), (1 << 63) - 1

FOUND = pa.schema([("query_wide", pa.bool_()), *[(n, pa.int64()) for n in ("query_block", "place", "query_id", "vec_id", "score")], ("key", pa.binary())])
BLOCK = "dim long, wide boolean, block long, ids binary, low long, bits long, body binary"


def usable(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(vec_id, v array<double>) without null ids, null vectors and vectors with null or non-finite components."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= F.lit(float(np.finfo(np.float64).max))))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite)


def quantised(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers; of components too large for them, as Python's."""
    if not values.size or np.abs(values).max() * scale < 1 << 62:
        return np.floor(values * scale).astype(np.int64)
    return np.array([floor(Fraction(x) * scale) for x in values.ravel().tolist()], object).reshape(values.shape)


def blocks(vectors: DataFrame, rows: int, scale: int, sliced: bool) -> DataFrame:
    """usable() vectors of one length in blocks of about so many rows, fewer if they are long: ids, and the bitmaps or else the components.

    Vectors with very large components have blocks of their own (wide), which are never sliced.
    """
    wide = F.exists("v", lambda x: F.abs(x) * scale >= F.lit(float(1 << (MOST_BITS - 1))))
    counted = vectors.withColumns({"dim": F.size("v").cast("long"), "wide": wide})
    sizes = counted.groupBy("dim", "wide").agg(F.greatest(F.ceil(F.count("*") / F.least(F.lit(float(rows)), F.greatest(BLOCK_BYTES / (8.0 * F.greatest("dim", F.lit(1))), F.lit(1.0)))), F.lit(1)).alias("n_blocks"))
    dealt = counted.join(sized_broadcast(sizes), ["dim", "wide"]).withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.col("n_blocks")))

    def gather(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        # ascending ids, so that an earlier place in the block is a smaller id
        group = group.sort_values("vec_id", kind="stable")
        values = np.array(group.v.tolist(), np.float64).reshape(len(group), int(key[0]))
        low, bits, body = 0, 0, values
        if sliced and not key[1]:
            block = SlicedBlock.of(quantised(values, scale))
            low, bits, body = block.low, block.bits, block.slices
        return pd.DataFrame({"dim": [key[0]], "wide": [key[1]], "block": [key[2]], "ids": [group.vec_id.to_numpy(np.int64).tobytes()], "low": [low], "bits": [bits], "body": [body.tobytes()]})

    return dealt.groupBy("dim", "wide", "block").applyInPandas(gather, BLOCK)


def added(slices: list[np.ndarray]) -> np.ndarray:
    """The sum of weighted bitmaps: slices[w] are bitmaps of weight 2**w; the result has one bitmap for each weight."""
    out, w = [], 0
    while w < len(slices):
        rows = slices[w]
        carries = []
        while len(rows) > 1:
            if len(rows) == 2:
                carries.append(rows[:1] & rows[1:])
                rows = rows[:1] ^ rows[1:]
                break
            n = len(rows) // 3
            a, b, c, rest = rows[:n], rows[n : 2 * n], rows[2 * n : 3 * n], rows[3 * n :]
            half = a ^ b
            carries.append((a & b) | (c & half))
            rows = np.concatenate([half ^ c, rest]) if len(rest) else half ^ c
        if carries:
            if w + 1 == len(slices):
                slices.append(rows[:0])
            slices[w + 1] = np.concatenate([slices[w + 1], *carries])
        out.append(rows[0] if len(rows) else None)
        w += 1
    width = max((s.shape[1] for s in slices), default=0)
    return np.array([np.zeros(width, np.uint64) if r is None else r for r in out])


class SlicedBlock:
    """The bitmaps of a block of integer vectors. Places are made non-negative by subtracting the least component."""

    def __init__(self, rows: int, dim: int, low: int, bits: int, slices: np.ndarray):
        self.rows, self.dim, self.low, self.bits, self.words = rows, dim, low, bits, -(-rows // 64)
        self.slices = slices.reshape(bits, dim, self.words)
        self.live = np.packbits(np.arange(self.words * 64) < rows, bitorder="little").view(np.uint64)

    @classmethod
    def of(cls, values: np.ndarray) -> SlicedBlock:
        rows, dim = values.shape
        low = int(values.min()) if values.size else 0
        bits = max(1, int(int(values.max()) - low).bit_length()) if values.size else 1
        words = -(-rows // 64)
        padded = np.zeros((words * 64, dim), np.uint64)
        padded[:rows] = (values - low).astype(np.uint64)
        slices = np.empty((bits, dim, words), np.uint64)
        for b in range(bits):
            flags = ((padded >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)
            slices[b] = np.packbits(np.ascontiguousarray(flags.T), axis=1, bitorder="little").view(np.uint64)
        return cls(rows, dim, low, bits, slices)

    def sums(self, query: np.ndarray) -> tuple[np.ndarray, int]:
        """Bitmaps of the scores, and what is to be added to each. A negative factor q adds |q| times the complement."""
        size = np.abs(query).astype(np.uint64)
        minus = query < 0
        top = (1 << self.bits) - 1
        constant = int(query.sum()) * self.low - int(size[minus].sum()) * top
        flips = np.where(minus, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))[:, None]
        n = int(size.max()).bit_length() if size.size else 0
        slices: list[list[np.ndarray]] = [[] for _ in range(self.bits + n)]
        for j in range(n):
            chosen = np.flatnonzero((size >> np.uint64(j)) & np.uint64(1))
            if len(chosen):
                for b in range(self.bits):
                    slices[b + j].append(self.slices[b, chosen] ^ flips[chosen])
        empty = np.zeros((0, self.words), np.uint64)
        return added([np.concatenate(s) if s else empty for s in slices]), constant

    def top(self, sums: np.ndarray, k: int, without: np.ndarray) -> np.ndarray:
        """The k rows of the highest sums, from the most significant bitmap down; at the boundary, those of smaller place."""
        taken, open_ = np.zeros(self.words, np.uint64), self.live & ~without
        count = lambda x: int(np.bitwise_count(x).sum())
        need = min(k, count(open_))
        for s in sums[::-1]:
            ones = open_ & s
            n = count(ones)
            if n >= need:
                open_ = ones
            else:
                taken, open_, need = taken | ones, open_ & ~s, need - n
        places = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))
        return np.concatenate([places(taken), places(open_)[:need]])

    @staticmethod
    def scores(sums: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The sums of some rows, read from their bitmaps."""
        flags = (sums[:, rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)
        return (flags << np.arange(len(sums), dtype=np.uint64)[:, None]).sum(axis=0).astype(np.int64)


def _sort_key(score: int) -> bytes:
    """Bytes that sort as integers of any size do."""
    size = (abs(score).bit_length() + 7) // 8
    body = abs(score).to_bytes(size, "big")
    return b"\x01" + size.to_bytes(4, "big") + body if score >= 0 else b"\x00" + ((1 << 32) - 1 - size).to_bytes(4, "big") + bytes(255 - x for x in body)


def _best_in_block(index: NamedTuple, asked: NamedTuple, k: int, scale: int) -> list[tuple]:
    """(query place, query, candidate, score) of the k best of the block for each query."""
    ids, query_ids, dim = np.frombuffer(index.ids, np.int64), np.frombuffer(asked.ids, np.int64), int(index.dim)
    queries = quantised(np.frombuffer(asked.body, np.float64).reshape(len(query_ids), dim), scale)
    out = []
    if index.wide or asked.query_wide:
        values = np.frombuffer(index.body, np.float64).reshape(len(ids), dim) if index.wide else _restored(index, len(ids), dim)
        values = (quantised(values, scale) if index.wide else values).astype(object)
        for place, (q, query) in enumerate(zip(query_ids.tolist(), queries.astype(object), strict=True)):
            scores = values @ query if dim else [0] * len(ids)
            order = sorted((-int(s), i) for s, i in zip(scores, ids.tolist(), strict=True) if i != q)[:k]
            out += [(place, q, i, -s) for s, i in order]
        return out
    block = SlicedBlock(len(ids), dim, int(index.low), int(index.bits), np.frombuffer(index.body, np.uint64))
    for place, (q, query) in enumerate(zip(query_ids.tolist(), queries, strict=True)):
        own = np.zeros(block.words * 64, np.uint8)
        own[: block.rows] = ids == q
        sums, constant = block.sums(query)
        rows = block.top(sums, k, np.packbits(own, bitorder="little").view(np.uint64))
        out += [(place, q, int(ids[r]), int(s) + constant) for r, s in zip(rows, block.scores(sums, rows), strict=True)]
    return out


def _restored(index: NamedTuple, rows: int, dim: int) -> np.ndarray:
    """The integer components, from the bitmaps."""
    block = SlicedBlock(rows, dim, int(index.low), int(index.bits), np.frombuffer(index.body, np.uint64))
    values = np.full((dim, rows), block.low, np.int64)
    for b in range(block.bits):
        values += np.unpackbits(block.slices[b].view(np.uint8), axis=1, bitorder="little")[:, :rows].astype(np.int64) << b
    return values.T


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """For each query its k highest scores over all other rows of its length: query_id, rank (from 1), vec_id, score.

    Components are floor(scale * x). Ties go to the smaller vec_id. Rows with the query's vec_id are not its candidates;
    rows with a null vec_id, a null vector or null or non-finite components take no part. Repeated rows are candidates
    each; a query id of several rows is answered for each of them, with ranks of its own. Finite components of any size
    count exactly; a score beyond 64 bits is given as the nearest long. Queries with no candidate give no row, as an
    empty table does. A task holds a strip of the index while blocks of queries pass by one at a time, and gives k rows
    for each query.
    """
    index = written(blocks(usable(vectors, vector, vec_id), BLOCK_ROWS, scale, True), "index")
    asked = written(blocks(usable(queries, vector, vec_id), QUERY_ROWS, scale, False), "queries")
    tasks = vectors.sparkSession.sparkContext.defaultParallelism
    sizes = index.groupBy("dim", "wide").agg(F.max("block").alias("last"), F.max(F.length("body")).alias("most"))
    per_strip = F.greatest(F.least(F.floor(F.lit(STRIP_BYTES) / F.greatest("most", F.lit(1))), F.ceil((F.col("last") + 1) / tasks)), F.lit(1))
    sizes = written(sizes.withColumn("per_strip", per_strip), "strips")
    body = ["block", "ids", "low", "bits", "body"]
    held = index.join(sized_broadcast(sizes.select("dim", "wide", "per_strip")), ["dim", "wide"]).select("dim", "wide", F.floor(F.col("block") / F.col("per_strip")).alias("strip"), F.lit(False).alias("query_wide"), F.lit(-1).cast("long").alias("query_block"), *body)
    strips = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / F.col("per_strip")))).alias("strip")
    of_queries = asked.withColumnsRenamed({"wide": "query_wide", "block": "query_block"}).join(sized_broadcast(sizes), "dim")
    passing = of_queries.select("dim", "wide", strips, "query_wide", "query_block", F.lit(-1).cast("long").alias("block"), "ids", "low", "bits", "body")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, strip = None, []
        for batch in batches:
            for j in range(batch.num_rows):
                row = next(batch.slice(j, 1).to_pandas().itertuples(index=False))
                if at != (row.dim, row.wide, row.strip):
                    at, strip = (row.dim, row.wide, row.strip), []
                if row.query_block < 0:
                    strip.append(row)
                    continue
                best: dict[int, list[tuple]] = {}
                for block in strip:
                    for place, q, i, s in _best_in_block(block, row, k, scale):
                        best.setdefault(place, []).append((-s, i, q))
                rows = [(row.query_wide, row.query_block, place, q, i, min(MOST_LONG, max(LEAST_LONG, -s)), _sort_key(-s)) for place, found in best.items() for s, i, q in sorted(found)[:k]]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(FOUND.types)], schema=FOUND)

    # a strip comes before the queries that pass it
    dealt = held.unionByName(passing).repartition("dim", "wide", "strip").sortWithinPartitions("dim", "wide", "strip", "query_block", "block")
    found = dealt.mapInArrow(meet, "query_wide boolean, query_block long, place long, query_id long, vec_id long, score long, key binary")
    order = Window.partitionBy("query_id", "query_wide", "query_block", "place").orderBy(F.desc("key"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.filter("vec_id % 50 = 0"))


ORACLE = """
WITH q AS (
    SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
    SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(a.v, b.v)]) AS BIGINT) AS score
    FROM q a JOIN q b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

QUERIES = {"op3_topk_search": op3_topk_search}
ORACLE_SQL = {"op3_topk_search": ORACLE}
