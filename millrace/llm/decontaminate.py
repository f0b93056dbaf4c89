"""Operator 8: benchmark decontamination by greedy string tiling.

Documents and benchmark items that share a seed (a window of MIN_MATCH words) are joined. For each such pair the
longest common runs of unmarked words are marked again and again, found by running Karp-Rabin hashes. The
share of an item's words that the tiles cover decides, so passages in another order, or with insertions, count too.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import BROADCAST_BYTES, measured_bytes, row_ids, scan_ids, sized_broadcast, table, written
from ._words import chunks, mix, places, text_words, unicode_words, windows

#: Words of a seed, and of the shortest tile.
MIN_MATCH = 5
#: Items of fewer words are phrases that any text may hold.
LEAST_WORDS = 3
#: The share of an item's words from which a document counts as contaminated.
COVERAGE = 0.6


#: Fixed odd base of the running hashes, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Running:
    """Karp-Rabin hashes of all windows of a word sequence, of any size, from one row of running sums."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        one = np.ones(1, np.uint64)
        powers = np.cumprod(np.concatenate([one, np.full(n, _BASE, np.uint64)]))
        self.back = np.cumprod(np.concatenate([one, np.full(n, _INVERSE, np.uint64)]))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers[:n])])
        self.free = np.ones(n, bool)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of the windows of which no word is marked."""
        marked = np.concatenate([[0], np.cumsum(~self.free)])
        starts = np.flatnonzero(marked[size:] == marked[: len(marked) - size])
        return starts, (self.sums[starts + size] - self.sums[starts]) * self.back[starts]


def tiles(item: np.ndarray, text: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word sequences: (place in item, place in text, words), longest first.

    Of equally long matches, the first in the item, then in the text, is marked; what a mark cuts is looked at again.
    The length of the longest match that is left is found by bisection, as its parts match too.
    """
    one, two = _Running(item), _Running(text)
    found: list[tuple[int, int, int]] = []

    def shared(size: int) -> bool:
        return bool(np.isin(one.windows(size)[1], two.windows(size)[1]).any())

    most = min(len(item), len(text))
    while most >= min_match and shared(min_match):
        low, high = min_match, most
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if shared(middle) else (low, middle - 1)
        (starts_i, hash_i), (starts_t, hash_t) = one.windows(low), two.windows(low)
        order = np.argsort(hash_t, kind="stable")
        ranked = hash_t[order]
        hit = np.isin(hash_i, hash_t)
        waiting: dict[int, deque] = {}  # for a hash, the places in the text, in order; marked ones are of no use any more
        for i, h in zip(starts_i[hit].tolist(), hash_i[hit].tolist(), strict=True):
            if not one.free[i : i + low].all():
                continue
            if h not in waiting:
                a, b = np.searchsorted(ranked, [np.uint64(h)], "left")[0], np.searchsorted(ranked, [np.uint64(h)], "right")[0]
                waiting[h] = deque(starts_t[order[a:b]].tolist())
            places_t = waiting[h]
            while places_t and not two.free[places_t[0] : places_t[0] + low].all():
                places_t.popleft()
            for t in places_t:
                if two.free[t : t + low].all() and np.array_equal(item[i : i + low], text[t : t + low]):
                    one.free[i : i + low] = two.free[t : t + low] = False
                    found.append((i, t, low))
                    break
        most = low - 1
    return found


def near_seeds(item: np.ndarray, text: np.ndarray, min_match: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of text that lie in a window shared with item, and the words there, with a stop between runs.

    Tiles lie in such windows, so the rest of a long text need not be looked at.
    """
    if min(len(item), len(text)) < min_match:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    by = places(min_match)
    hashes = lambda v: sum(v[k : len(v) - min_match + 1 + k] * by[k] for k in range(min_match))
    hit = np.flatnonzero(np.isin(hashes(text), hashes(item)))
    near = np.zeros(len(text), bool)
    for k in range(min_match):
        near[hit + k] = True
    at = np.flatnonzero(near)
    breaks = np.flatnonzero(np.diff(at) > 1) + 1
    stops = mix(np.arange(len(breaks)) + (1 << 40))  # words of no item
    return np.insert(at, breaks, -1), np.insert(text[at], breaks, stops)


def _owned(column: pa.Array, sizes: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of the text, hash) of all windows of these sizes, run by run of texts."""
    for first, data, offsets in chunks(column):
        found = unicode_words(data, offsets)
        for size in sizes:
            hashes, bounds = windows(found, size)
            yield np.repeat(np.arange(first, first + len(bounds) - 1), np.diff(bounds)), hashes


def seed_table(items: DataFrame, min_match: int, least_words: int, text: str, item_id: str) -> DataFrame:
    """(iid, words, seed, n) for every distinct window of min_match words of the items; n: how often it occurs there.

    An item of fewer words, but least_words or more, is one window itself. words: those of the window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in chunks(batch.column(1)):
                found = unicode_words(data, offsets)
                counts = np.diff(found.bounds)
                for size in range(least_words, min_match + 1):
                    hashes, bounds = windows(found, size)
                    owner = np.repeat(np.arange(len(counts)), np.diff(bounds))
                    fit = (counts[owner] == size) if size < min_match else np.ones(len(owner), bool)
                    ids = batch.column(0).take(pa.array(first + owner[fit]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(ids), size), pa.int32()), pa.array(hashes[fit].view(np.int64))], names=["iid", "words", "seed"])

    rows = items.select(F.col(item_id).alias("iid"), F.col(text).alias("t")).mapInArrow(run, "iid long, words int, seed long")
    return rows.groupBy("iid", "words", "seed").agg(F.count("*").alias("n"))


def _likely_by_filter(docs: DataFrame, seeds: DataFrame, sizes: list[int], min_match: int, coverage: float) -> DataFrame:
    """(rid, iid) that share enough seeds. The seeds, whose size was checked, go to every task, where each text meets them alone."""
    found = seeds.select("seed", "iid", "n").toArrow().sort_by([("seed", "ascending"), ("iid", "ascending")])
    seed, iid, n = (found[c].to_numpy() for c in ("seed", "iid", "n"))
    items, at = np.unique(iid, return_inverse=True)
    total = np.bincount(at, n)
    known = docs.sparkSession.sparkContext.broadcast((seed, at, n, items, total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed, at, n, items, total = known.value
        for batch in batches:
            rows, hits = [], []
            for owner, hashes in _owned(batch.column(1), sizes):
                place = np.minimum(np.searchsorted(seed, hashes.view(np.int64)), len(seed) - 1)
                hit = seed[place] == hashes.view(np.int64)
                rows.append(owner[hit])
                hits.append(place[hit])
            rows, hits = np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.int64), *hits])
            pairs: list[tuple[int, int]] = []
            order = np.argsort(rows, kind="stable")
            rows, hits = rows[order], hits[order]
            for start, end in zip(*_groups(rows), strict=True):
                mine = np.unique(hits[start:end])
                until = np.searchsorted(seed, seed[mine], "right")
                postings = np.repeat(mine - (np.cumsum(until - mine) - (until - mine)), until - mine) + np.arange((until - mine).sum())
                which, inverse = np.unique(at[postings], return_inverse=True)
                enough = np.bincount(inverse, n[postings]) * min_match >= coverage * total[which]
                pairs += [(int(rows[start]), int(i)) for i in items[which[enough]]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([p[0] for p in pairs], pa.int64())), pa.array([p[1] for p in pairs], pa.int64())], names=["rid", "iid"])

    return docs.select("rid", "_text").mapInArrow(run, "rid long, iid long")


def _groups(rows: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and ends of the runs of equal numbers."""
    if not len(rows):
        return [], []
    cut = np.flatnonzero(np.diff(rows)) + 1
    return [0, *cut.tolist()], [*cut.tolist(), len(rows)]


def _likely_by_shuffle(docs: DataFrame, seeds: DataFrame, sizes: list[int], min_match: int, coverage: float) -> DataFrame:
    """(rid, iid) that share enough seeds; every window of every row meets the seeds by a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owner, hashes in _owned(batch.column(1), sizes):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(hashes.view(np.int64))], names=["rid", "seed"])

    shared = docs.select("rid", "_text").mapInArrow(run, "rid long, seed long").distinct().join(seeds, "seed")
    shared = shared.groupBy("rid", "iid").agg(F.sum("n").alias("shared"))
    total = seeds.groupBy("iid").agg(F.sum("n").alias("windows"))
    return shared.join(total, "iid").filter(F.col("shared") * min_match >= coverage * F.col("windows")).select("rid", "iid")


def matches(docs: DataFrame, items: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", broadcast_bytes: int = BROADCAST_BYTES, row_id: str | None = None, least_words: int = LEAST_WORDS) -> DataFrame:
    """Pairs with enough coverage: rid, doc_id, item_id, item_words, covered, coverage, tiles (item_start, doc_start, words).

    Words are runs of letters and digits, in any case; Han, kana and the like count character by character. An item
    with fewer than min_match words matches where all of them stand together; one with fewer than least_words never
    does, nor do null or empty texts. Repeated rows, of documents or items, are matched each. Empty tables give no rows.
    Seeds go to every task only while their measured size is under broadcast_bytes; else both sides are shuffled.
    row_id: a column of docs as scan_ids() makes it; without it, ids and texts are written once.
    """
    wanted = [F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")]
    docs = docs.select(*wanted, F.col(row_id).alias("rid")) if row_id else row_ids(docs.select(*wanted))
    items = row_ids(items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("item_text")), "iid")
    seeds = written(seed_table(items, min_match, least_words, "item_text", "iid"), "seeds")
    sizes = sorted(r.words for r in seeds.select("words").distinct().collect())  # min_match - least_words + 1 at most
    if not sizes:
        pairs = seeds.select(F.col("seed").alias("rid"), "iid")
    else:
        likely = _likely_by_filter if measured_bytes(seeds) <= broadcast_bytes else _likely_by_shuffle
        pairs = likely(docs, seeds, sizes, min_match, coverage)
    # a tile of k >= min_match words holds k - min_match + 1 >= k / min_match windows of the item, so what can reach the coverage shares enough
    pairs = written(pairs, "pairs")
    texts = docs.join(sized_broadcast(pairs), "rid").join(sized_broadcast(items), "iid")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = lambda id_type: pa.schema([("rid", pa.int64()), ("doc_id", id_type), ("item_id", pa.int64()), ("item_words", pa.int64()), ("covered", pa.int64()), ("tiles", pa.list_(pa.struct([("item_start", pa.int64()), ("doc_start", pa.int64()), ("words", pa.int64())])))])
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                item, body = text_words(row["item_text"], unicode_words), text_words(row["_text"], unicode_words)
                least = min(min_match, len(item))
                at, near = near_seeds(item, body, least)
                found = tiles(item, near, least)
                covered = sum(n for _, _, n in found)
                if len(item) and covered >= coverage * len(item):
                    out.append({"rid": row["rid"], "doc_id": row["doc_id"], "item_id": row["item_id"], "item_words": len(item), "covered": covered, "tiles": [{"item_start": i, "doc_start": int(at[t]), "words": n} for i, t, n in found]})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=fields(batch.schema.field("doc_id").type))

    kind = dict(docs.dtypes)["doc_id"]
    found = texts.select("rid", "doc_id", "_text", "item_id", "item_text").mapInArrow(tile, f"rid long, doc_id {kind}, item_id long, item_words long, covered long, tiles array<struct<item_start:long,doc_start:long,words:long>>")
    return found.withColumn("coverage", F.col("covered") / F.col("item_words"))


def clean(docs: DataFrame, items: DataFrame, row_id: str | None = None, **options) -> DataFrame:
    """docs without the rows that hold a benchmark item. row_id: as for matches(); it is kept."""
    own = row_id or "_rid"
    docs = docs if row_id else row_ids(docs, own)
    flagged = written(matches(docs, items, row_id=own, **options).select(F.col("rid").alias(own)).distinct(), "flagged")
    kept = docs.join(sized_broadcast(flagged), own, "left_anti")
    return kept if row_id else kept.drop(own)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), "row")
    found = matches(docs, table(spark, sf_dir, "benchmark"), row_id="row")
    return found.select("doc_id", "item_id", "item_words", "covered", F.round("coverage", 6).alias("coverage"), F.size("tiles").cast("long").alias("n_tiles"))


QUERIES = {"op8_decontaminate": op8_decontaminate}
ORACLE_SQL: dict[str, str] = {}
