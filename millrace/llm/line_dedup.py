"""Operator 1: fuzzy line deduplication over the whole corpus.

Lines are compared by their sets of character shingles: MinHash signatures with high-recall banding give candidates,
the exact Jaccard similarity decides, and of each component of similar lines the first occurrence stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._near import Sets, band_hashes, buckets_of, choose_bands, components, distinct_sets, links
from ._shared import BROADCAST_BYTES, measured_bytes, renamed, row_ids, scan_ids, sized_broadcast, table, written
from ._words import places

#: Runs of 5 characters recur in most lines of a language; bands of 6 hashes keep chance candidates few, and 18 of them the recall.
CHARACTERS, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.995, 108
#: Lines are handled in runs of about so many characters, and given out in lots of so many.
RUN, LOT = 1 << 18, 10_000


def normal(line: str) -> str:
    """The form in which lines are compared."""
    return line.strip().lower()


def line_shingles(lines: list[str], n: int = CHARACTERS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n characters of each normal line, and their bounds by line. A shorter line is one run."""
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    ends = np.cumsum(sizes)
    total = np.zeros(len(points), np.uint64)
    for k, factor in enumerate(places(n)):
        total[: len(points) - k] += points[k:] * factor
    counts = np.maximum(sizes - n + 1, 1)
    bounds = np.append(0, np.cumsum(counts))
    hashes = total[np.repeat(ends - sizes, counts) + np.arange(bounds[-1]) - np.repeat(bounds[:-1], counts)]
    for i in np.flatnonzero(sizes < n).tolist():
        hashes[bounds[i]] = np.uint64(sizes[i]) + (points[ends[i] - sizes[i] : ends[i]] * places(n)[: sizes[i]]).sum(dtype=np.uint64)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(31)
    hashes *= np.uint64(0x94D049BB133111EB)
    return hashes, bounds


def _runs(values: list[str]) -> Iterator[list[str]]:
    start = size = 0
    for i, value in enumerate(values):
        size += len(value)
        if size >= RUN:
            yield values[start : i + 1]
            start, size = i + 1, 0
    if start < len(values):
        yield values[start:]


def _keyed(docs: DataFrame, bands: int, rows: int, n: int) -> DataFrame:
    """(doc_id, rid, pos, key_a, key_b) and the band hashes b0, b1, ... for each line that is not blank; the two keys stand for the normal line."""

    def lot(batch: pa.RecordBatch, lines: list[tuple[int, int, str]]) -> pa.RecordBatch:
        at = pa.array([row for row, _, _ in lines])
        keys = np.frombuffer(b"".join([blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16).digest() for _, _, line in lines]), np.int64).reshape(-1, 2)
        found = np.concatenate([band_hashes(*line_shingles(run, n), bands, rows) for run in _runs([line for _, _, line in lines])]).view(np.int64)
        columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array([pos for _, pos, _ in lines], pa.int32()), pa.array(keys[:, 0]), pa.array(keys[:, 1])]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(found[:, k]) for k in range(bands))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = []
            for row, text in enumerate(batch.column(2)):
                for pos, line in enumerate((text.as_py() or "").split("\n")):
                    if line := normal(line):
                        lines.append((row, pos, line))
                if len(lines) >= LOT:
                    yield lot(batch, lines)
                    lines = []
            if lines:
                yield lot(batch, lines)
        pa.default_memory_pool().release_unused()

    names = ["doc_id", "rid", "pos", "key_a", "key_b", *(f"b{k}" for k in range(bands))]
    kinds = [dict(docs.dtypes)["doc_id"], "long", "int", *["long"] * (bands + 2)]
    return docs.select("doc_id", "rid", "_text").mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in zip(names, kinds, strict=True)))


def _sets(docs: DataFrame, lines: DataFrame):
    def of(nodes: DataFrame) -> DataFrame:
        places = lines.select("node", "rid", "pos").join(sized_broadcast(written(nodes, "nodes")), "node")
        wanted = written(places.groupBy("rid").agg(F.collect_list(F.struct("pos", "node")).alias("places")), "wanted")
        found = docs.select("rid", F.split("_text", "\n").alias("parts")).join(sized_broadcast(wanted), "rid")
        return found.select("parts", F.explode("places").alias("p")).select("p.node", F.element_at("parts", F.col("p.pos") + 1).alias("items"))

    return of


def _decoder(n: int):
    def decode(lines: pa.Array) -> Sets:
        parts = [distinct_sets(*line_shingles(run, n)) for run in _runs([normal(line) for line in lines.to_pylist()])]
        sizes = np.concatenate([np.zeros(0, np.int64), *(p.sizes for p in parts)])
        return Sets(np.concatenate([np.zeros(0, np.uint64), *(p.values for p in parts)]), np.append(0, np.cumsum(sizes)))

    return decode


def dropped_lines(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, characters: int = CHARACTERS) -> DataFrame:
    """(rid, dropped array<int>): places of lines that repeat an earlier one, in ascending order. docs: (rid, doc_id, _text)."""
    bands, rows = choose_bands(threshold, recall, MOST_HASHES)
    keys = ["key_a", "key_b"]
    signed = written(_keyed(docs, bands, rows, characters).withColumn("node", F.monotonically_increasing_id()), "lines", "lz4")
    # lines at more than one place, with one of them that stands for all; these are longs, so Spark counts them by hash
    repeated = signed.groupBy(*keys).agg(F.count("*").alias("n"), F.min("node").alias("first")).filter("n > 1").drop("n")
    repeated = written(repeated, "repeated")
    placed = signed.join(sized_broadcast(repeated), keys, "left")
    lines = placed.filter("first is null or first = node").select("node", "rid", "pos", *(f"b{k}" for k in range(bands)))
    lines = lines if measured_bytes(repeated) <= BROADCAST_BYTES else written(lines, "distinct", "lz4")
    buckets = buckets_of(lines, [f"b{k}" for k in range(bands)])
    roots = written(components(links(buckets, _sets(docs, lines), threshold, _decoder(characters))), "roots")
    # lines that have copies or similar ones, at all their places, and of each such group the first place, which stays
    placed = placed.select("doc_id", "rid", "pos", "first", F.coalesce("first", "node").alias("node")).join(sized_broadcast(roots), "node", "left")
    placed = written(placed.filter("first is not null or root is not null").select(F.coalesce("root", "node").alias("root"), "doc_id", "rid", "pos"), "placed")
    kept = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid", "pos")).alias("kept"))
    kept = written(kept.select("root", F.col("kept.rid").alias("kept_rid"), F.col("kept.pos").alias("kept_pos")), "kept")
    repeats = placed.select("root", "rid", "pos").join(sized_broadcast(kept), "root").filter("rid != kept_rid or pos != kept_pos")
    return repeats.groupBy("rid").agg(F.sort_array(F.collect_list("pos")).alias("dropped"))


def _less(docs: DataFrame, text: str) -> DataFrame:
    """docs with the lines of text at the places in _dropped taken out, and n_lines, n_dropped; without _dropped."""
    kept = [c for c in docs.columns if c not in ("_dropped", text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, gone = [], [], []
            for body, places in zip(batch.column(len(kept)), batch.column(len(kept) + 1), strict=True):
                body, places = body.as_py(), set(places.as_py() or ())
                lines = body.split("\n") if body is not None else []
                texts.append("\n".join([line for at, line in enumerate(lines) if at not in places]) if places else body)
                counts.append(len(lines))
                gone.append(len(places))
            columns = [*batch.columns[: len(kept)], pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, text, "n_lines", "n_dropped"])

    schema = docs.drop("_dropped").select(*kept, text, F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")).schema
    return docs.select(*kept, text, "_dropped").mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, text: str = "text", doc_id: str = "doc_id", row_id: str | None = None, characters: int = CHARACTERS) -> DataFrame:
    """docs with text less its repeated lines, and n_lines, n_dropped (such columns are replaced).

    Lines are parted by \n and compared without blanks at their ends, in lower case. Two are similar if the Jaccard
    similarity of their sets of 5-character runs is the threshold or more (shorter lines: if they are equal); of what
    similarity connects, the line of the least (doc_id, row, place) stays, null doc_ids last. Blank lines always stay.
    Null text stays null and has no lines; an empty one has one, blank. A repeated row loses all its lines to the first.
    An empty table gives an empty result. row_id: a column of docs as scan_ids() makes it; it is kept. Without it, the
    rows are written once with ids.
    """
    docs = docs.drop(*[c for c in ("n_lines", "n_dropped", "_rid", "_text", "_dropped") if c not in (text, doc_id, row_id)])
    own = row_id or "_rid"
    docs = docs if row_id else row_ids(docs, own)
    columns = [c for c in docs.columns if c != "_rid"]
    dropped = written(dropped_lines(docs.select(F.col(own).alias("rid"), F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), threshold, recall, characters), "dropped")
    found = docs.join(sized_broadcast(renamed(dropped, rid=own, dropped="_dropped")), own, "left")
    return _less(found, text).select(*columns, "n_lines", "n_dropped")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), "row")
    return dedup_lines(docs, row_id="row").select("doc_id", "n_lines", "n_dropped", "text")


QUERIES = {"op1_line_dedup": op1_line_dedup}
ORACLE_SQL: dict[str, str] = {}
