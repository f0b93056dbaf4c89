"""What near-duplicate operators share: MinHash bands, verification of candidates, and distributed union-find.

Candidates are rows that share a band bucket. Each row of a bucket is first compared with the bucket's leader (its
least row), which takes one pair a row however large the bucket is. Rows similar to the leader are in its component.
The Jaccard distance is a metric, so another row can be similar to one of those only if it is within twice the
largest distance of the leader. What the leader leaves open is compared block by block, with bounded blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import renamed, sized_broadcast, written
from ._words import mix

#: Rows of a block when open rows of one bucket, or members of one component, are compared.
BLOCK = 256
#: Rows that a task compares at once, in blocks; and likely pairs of a block above which all its sets are intersected at once.
LOT_ROWS, MANY = 1024, 2000
#: Places of a set's profile.
PLACES = 128
#: Columns of a matrix when the sets of two blocks are intersected.
COLUMNS = 4096


def choose_bands(threshold: float, recall: float, most_hashes: int = 96) -> tuple[int, int]:
    """(bands, rows of a band): the most rows for which pairs at the threshold meet with at least this probability."""
    best = (max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold))), 1)
    for rows in range(2, most_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows > most_hashes:
            break
        best = (bands, rows)
    return best


def band_hashes(hashes: np.ndarray, bounds: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A row of band hashes for each set; set i is hashes[bounds[i]:bounds[i + 1]], and must not be empty."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    factors = mix(np.arange(bands * rows) + 77).astype(np.uint32) | np.uint32(1)
    product = np.empty_like(short)
    out = np.empty((len(bounds) - 1, bands), np.uint64)
    for band in range(bands):
        total = np.full(len(bounds) - 1, band + 1, np.uint64)
        for factor in factors[band * rows : (band + 1) * rows]:
            np.multiply(short, factor, out=product)  # of hashes, an odd factor makes another order
            total = (total ^ total >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(product, bounds[:-1])
        out[:, band] = mix(total)
    return out


def _shared_buckets(bands: DataFrame, columns: list[str]) -> DataFrame:
    """(bucket) for those that occur in two rows at least, by array operations on either side of one shuffle.

    What repeats within a batch leaves it twice, however often it occurs, so that no bucket makes a task large.
    """

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, n = np.unique(np.concatenate([c.to_numpy() for c in batch.columns]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([values, values[n > 1]]))], names=["bucket"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # memory: the buckets of one partition of the shuffle, 8 bytes each
        parts = [batch.column(0).to_numpy() for batch in batches]
        if parts:
            values, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values[n > 1])], names=["bucket"])

    dealt = bands.select(*columns).mapInArrow(parted, "bucket long").repartition("bucket")
    return written(dealt.mapInArrow(joined, "bucket long"), "counts", "lz4")


def buckets_of(bands: DataFrame, columns: list[str]) -> DataFrame:
    """(bucket, node, leader, n) for buckets with two nodes at least, without buckets that hold just the nodes of another.

    bands: node, and a column of longs for each band; one row for each node. Counting buckets moves their hashes alone;
    only the few buckets with more than one node meet their rows again.
    """
    counts = _shared_buckets(bands, columns)
    rows = bands.select("node", F.explode(F.array(*columns)).alias("bucket"))
    shared = written(rows.join(sized_broadcast(counts), "bucket"), "shared")
    sets = shared.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"), F.min("node").alias("leader"))
    chosen = written(sets.groupBy("n", "s", "leader").agg(F.min("bucket").alias("bucket")).filter("n > 1"), "chosen")
    return written(shared.join(sized_broadcast(chosen.drop("s")), "bucket").select("bucket", "node", "leader", "n"), "buckets")


@dataclass
class Sets:
    """Sets one behind the other, each in ascending order without repeats: set i is values[bounds[i]:bounds[i + 1]]."""

    values: np.ndarray
    bounds: np.ndarray

    def __getitem__(self, i: int) -> np.ndarray:
        return self.values[self.bounds[i] : self.bounds[i + 1]]

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.bounds)


def listed_sets(lists: pa.Array) -> Sets:
    """Of arrays of longs without repeats, in ascending order as unsigned integers."""
    bounds = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
    return Sets(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), bounds)


def distinct_sets(hashes: np.ndarray, bounds: np.ndarray) -> Sets:
    """The sets of the leading 48 bits of hashes; there are fewer than 65536 sets."""
    owner = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))
    keys = np.sort(owner << np.uint64(48) | hashes >> np.uint64(16))
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    return Sets(keys & np.uint64((1 << 48) - 1), np.searchsorted(keys, np.arange(len(bounds), dtype=np.uint64) << np.uint64(48)))


def profiles(sets: Sets) -> np.ndarray:
    """How many elements of each set fall into each of PLACES places; PLACES bytes a set, 255 for more than 254."""
    owner = np.repeat(np.arange(len(sets.sizes)), sets.sizes)
    counts = np.bincount(owner * PLACES + (sets.values % np.uint64(PLACES)).astype(np.int64), minlength=len(sets.sizes) * PLACES)
    return np.minimum(counts, 255).astype(np.uint8).reshape(-1, PLACES)


def most_similar(profile_a: np.ndarray, profile_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """An upper bound of the Jaccard similarities of pairs of sets: in a place, no more can be shared than the lesser number."""
    shared = np.minimum(profile_a, profile_b).sum(axis=1, dtype=np.int64)
    full = (profile_a == 255).any(axis=1) | (profile_b == 255).any(axis=1)
    shared = np.minimum(np.where(full, size_a, shared), np.minimum(size_a, size_b))
    return shared / np.maximum(size_a + size_b - shared, 1)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of two blocks, by products of 0/1 matrices over runs of their elements."""
    sizes_l, sizes_r = [len(x) for x in left], [len(x) for x in right]
    values = np.concatenate([*left, *right]) if left or right else np.zeros(0, np.int64)
    owner_l, owner_r = np.repeat(np.arange(len(left)), sizes_l), np.repeat(np.arange(len(right)), sizes_r)
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    keep = count > 1  # an element of one set alone is in no intersection
    renumbered = np.cumsum(keep) - 1
    n = int(keep.sum())
    col_l, col_r = column[: len(owner_l)], column[len(owner_l) :]
    owner_l, owner_r = owner_l[keep[col_l]], owner_r[keep[col_r]]
    col_l, col_r = renumbered[col_l[keep[col_l]]], renumbered[col_r[keep[col_r]]]
    order_l, order_r = np.argsort(col_l, kind="stable"), np.argsort(col_r, kind="stable")
    total = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, n, COLUMNS):
        parts = []
        for order, col, owner, height in ((order_l, col_l, owner_l, len(left)), (order_r, col_r, owner_r, len(right))):
            low, high = np.searchsorted(col, [start, start + COLUMNS], sorter=order)
            chosen = order[low:high]
            part = np.zeros((height, min(COLUMNS, n - start)), np.float32)
            part[owner[chosen], col[chosen] - start] = 1
            parts.append(part)
        total += parts[0] @ parts[1].T
    return total


def similar(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which sets of two blocks have at least this Jaccard similarity."""
    both = intersections(left, right)
    union = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :] - both
    return both >= threshold * union - 1e-6 if both.size else np.zeros(both.shape, bool)


def _forest(pairs: list[tuple]) -> list[tuple]:
    """(node, root) for the components of the pairs; the root is the least node."""
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in parent if find(x) != x]


def paired_blocks(rows: DataFrame, keys: list[str], node: str, size: int = BLOCK) -> DataFrame:
    """Deals the rows of each key into blocks of about `size`, and each block to every pair that it is part of.

    Adds i <= j, the pair, and side, the block. rows needs a column n, the number of rows of the key.
    """
    blocks = F.ceil(F.col("n") / size).cast("int")
    own = F.pmod(F.xxhash64(node), blocks).cast("int")
    dealt = rows.withColumn("side", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")}).drop("other", "n")


def _with_profiles(items: DataFrame, decode: Callable[[pa.Array], Sets]) -> DataFrame:
    """Adds size and profile to (node, items)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), LOT_ROWS):
                part = batch.slice(start, LOT_ROWS)
                sets = decode(part.column(1))
                rows = pa.array([r.tobytes() for r in profiles(sets)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sets.sizes.astype(np.int64)), rows], names=["node", "items", "size", "profile"])

    kinds = dict(items.dtypes)
    return items.select("node", "items").mapInArrow(run, f"node {kinds['node']}, items {kinds['items']}, size long, profile binary")


def _bounded(pairs: DataFrame) -> DataFrame:
    """(node, leader, similarity), an upper bound, for pairs with size and profile, and the same of the leader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, PLACES) for c in (3, 5))
            bound = most_similar(one, two, batch.column(2).to_numpy(), batch.column(4).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bound)], names=["node", "leader", "similarity"])

    kind = dict(pairs.dtypes)["node"]
    return pairs.select("node", "leader", "size", "profile", "leader_size", "leader_profile").mapInArrow(run, f"node {kind}, leader {kind}, similarity double")


def _measured(pairs: DataFrame, decode: Callable[[pa.Array], Sets]) -> DataFrame:
    """(node, leader, similarity), exact, for pairs with items and leader_items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), LOT_ROWS):
                part = batch.slice(start, LOT_ROWS)
                one, two = decode(part.column(2)), decode(part.column(3))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([similarity(one[i], two[i]) for i in range(len(part))], pa.float64())], names=["node", "leader", "similarity"])

    kind = dict(pairs.dtypes)["node"]
    return pairs.select("node", "leader", "items", "leader_items").mapInArrow(run, f"node {kind}, leader {kind}, similarity double")


def _likely_pairs(blocks: list[tuple[int, int, int]], sizes: np.ndarray, rows: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the first and the other rows of each block that sizes and profiles do not keep under the threshold."""
    for start, middle, end in blocks:
        x, y = np.repeat(np.arange(start, middle), end - middle), np.tile(np.arange(middle, end), middle - start)
        near = np.minimum(sizes[x], sizes[y]) >= threshold * np.maximum(sizes[x], sizes[y]) - 1e-6
        x, y = x[near], y[near]
        near = most_similar(rows[x], rows[y], sizes[x], sizes[y]) >= threshold - 1e-9
        yield x[near], y[near]


def _similar_pairs(nodes: list, blocks: list[tuple[int, int, int]], sets: Sets, rows: np.ndarray, threshold: float) -> list[tuple]:
    """Similar pairs that connect what similar pairs of the blocks connect."""
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found = []
    for start, middle, end in blocks:
        [(x, y)] = _likely_pairs([(start, middle, end)], sets.sizes, rows, threshold)
        if exact := len(x) > MANY:
            near = similar([sets[i] for i in range(start, middle)], [sets[i] for i in range(middle, end)], threshold)[x - start, y - middle]
            x, y = x[near], y[near]
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            a, b = find(nodes[i]), find(nodes[j])
            if a != b and (exact or similarity(sets[i], sets[j]) >= threshold - 1e-9):
                parent[max(a, b)] = min(a, b)
                found.append((nodes[i], nodes[j]))
    return found


def _of(items: DataFrame, nodes: DataFrame) -> DataFrame:
    """The items of some nodes: few of them, as a rule, so that the others need not be shuffled."""
    return items.join(sized_broadcast(written(nodes.distinct(), "needed")), "node", "left_semi")


def links(buckets: DataFrame, sets: Callable[[DataFrame], DataFrame], threshold: float, decode: Callable[[pa.Array], Sets] = listed_sets) -> DataFrame:
    """(a, b), similar pairs that connect every component that similar pairs within buckets make.

    buckets: (bucket, node, leader, n). sets: gives (node, items) for given nodes; decode() turns items into sets.
    Pairs are first judged by the sizes and profiles of their sets, which give an upper bound; only those that may
    reach the threshold meet in full.
    """
    items = written(_with_profiles(sets(buckets.select("node").distinct()), decode), "sets")
    kind = dict(buckets.dtypes)["node"]
    small = items.select("node", "size", "profile")
    pairs = buckets.filter("node != leader").select("node", "leader").distinct()
    pairs = pairs.join(small, "node").join(small.toDF("leader", "leader_size", "leader_profile"), "leader")
    bounds = written(_bounded(pairs), "bounds")
    likely = bounds.filter(F.col("similarity") >= threshold - 1e-9).select("node", "leader")
    full = _of(items.select("node", "items"), likely.select("node").unionByName(likely.select(F.col("leader").alias("node"))))
    exact = written(_measured(likely.join(full, "node").join(full.toDF("leader", "leader_items"), "leader"), decode), "stars")
    linked = exact.filter(F.col("similarity") >= threshold - 1e-9).select(F.col("node").alias("a"), F.col("leader").alias("b"))

    # rows that the leader leaves open; with a row that may be within reach of the leader's own rows, those as well
    reach = 1 - 2 * (1 - threshold) - 1e-9
    known = bounds.filter(F.col("similarity") < threshold - 1e-9).unionByName(exact)
    judged = buckets.filter("node != leader").join(known, ["node", "leader"]).withColumn("open", F.col("similarity") < threshold - 1e-9)
    states = judged.filter("open").groupBy("bucket").agg(F.count("*").alias("n_open"), F.max("similarity").alias("best"))
    states = states.filter((F.col("n_open") > 1) | (F.col("best") >= reach)).select("bucket", "best")
    left = judged.join(sized_broadcast(written(states, "states")), "bucket").filter(F.col("open") | (F.col("best") >= reach))
    # what the leaders' links connect already needs no further comparing, nor do two buckets with the same open rows
    joined = written(components(linked), "joined")
    left = left.join(sized_broadcast(renamed(joined, root="known")), "node", "left").withColumn("known", F.coalesce("known", "node"))
    left = written(left.select("bucket", "node", "known", "open"), "open")
    counted = left.groupBy("bucket").agg(F.count("*").alias("n"), F.count(F.when(F.col("open"), 1)).alias("n_open"), F.sum(F.xxhash64("node", "open").cast("decimal(38,0)")).alias("s"), F.min("known").alias("k1"), F.max("known").alias("k2"))
    counted = counted.filter("n > 1 and k1 != k2").groupBy("n", "n_open", "s").agg(F.min("bucket").alias("bucket")).select("bucket", "n", "n_open")
    left = left.join(sized_broadcast(written(counted, "counted")), "bucket").drop("known")
    # open rows meet all; rows of the leader meet open ones only
    blocks_open, blocks_all = F.ceil(F.col("n_open") / BLOCK).cast("int"), F.ceil(F.col("n") / BLOCK).cast("int")
    rights = F.pmod(F.xxhash64("node"), blocks_all).cast("int")
    as_left = left.filter("open").select("bucket", "node", F.pmod(F.xxhash64("node"), blocks_open).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), blocks_all - 1)).alias("j"), F.lit(0).alias("side"))
    as_right = left.select("bucket", "node", F.explode(F.sequence(F.lit(0), blocks_open - 1)).alias("i"), rights.alias("j"), F.lit(1).alias("side"))

    def blocks_of(lot: pa.Table) -> tuple[pa.Table, list[tuple[int, int, int]], np.ndarray]:
        """The lot in order, its blocks (start, middle, end), and the profiles."""
        lot = lot.sort_by([("bucket", "ascending"), ("i", "ascending"), ("j", "ascending"), ("side", "ascending"), ("node", "ascending")]).combine_chunks()
        keys = np.stack([lot[c].to_numpy() for c in ("bucket", "i", "j")], axis=1)
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(lot)]
        lefts = np.append(0, np.cumsum(lot["side"].to_numpy() == 0)).tolist()
        blocks = [(a, a + lefts[b] - lefts[a], b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return lot, blocks, np.frombuffer(b"".join(lot["profile"].to_pylist()), np.uint8).reshape(-1, PLACES)

    def sift(lot: pa.Table) -> pa.Table:
        """The rows that may be similar to one of the other side of their block."""
        lot, blocks, rows = blocks_of(lot)
        keep = np.zeros(len(lot), bool)
        for x, y in _likely_pairs(blocks, lot["size"].to_numpy(), rows, threshold):
            keep[x] = keep[y] = True
        return lot.filter(pa.array(keep)).select(["bucket", "i", "j", "side", "node"])

    def compare(lot: pa.Table) -> pa.Table:
        lot, blocks, rows = blocks_of(lot)
        found = _similar_pairs(lot["node"].to_pylist(), blocks, decode(lot["items"].combine_chunks()), rows, threshold)
        return pa.table({"a": pa.array([p[0] for p in found], lot.schema.field("node").type), "b": pa.array([p[1] for p in found], lot.schema.field("node").type)})

    # pairs of blocks come in lots of about so many rows: most are small, and a group of Spark's costs more than they do.
    # First sizes and profiles alone meet; most rows end there, and only the others meet in full
    in_lots = lambda df, n: df.withColumn("lot", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(n)))
    rest = written(as_left.unionByName(as_right), "rest")
    rest = in_lots(rest.join(small, "node"), max(1, rest.count() // (4 * LOT_ROWS))).groupBy("lot").applyInArrow(sift, f"bucket long, i int, j int, side int, node {kind}")
    rest = written(rest, "sifted")
    rest = in_lots(rest.join(_of(items, rest.select("node")), "node"), max(1, rest.count() // LOT_ROWS)).groupBy("lot").applyInArrow(compare, f"a {kind}, b {kind}")
    return written(joined.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(rest), "links")


#: Rounds after which components() gives up with an error: far more than any graph of fewer than 2**64 nodes takes.
MOST_ROUNDS = 200


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of the edges (a, b), the least node of its component.

    Distributed union-find: each task joins the edges that it holds into trees; then, round by round, nodes are linked
    to the least neighbour of their parent, and the parents of a node to the least of them, until nothing changes.
    """
    kind = dict(edges.dtypes)["a"]

    def trees(frames):
        # memory: one Arrow batch's nodes at a time
        for frame in frames:
            yield pd.DataFrame(_forest(list(zip(frame.a.tolist(), frame.b.tolist(), strict=True))), columns=["a", "b"])

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    # an edge goes from a node a to a smaller one b
    edges = written(edges.mapInPandas(trees, f"a {kind}, b {kind}").distinct(), "trees")
    before = state(edges)
    for _ in range(MOST_ROUNDS):
        # large star: a node is linked to the least neighbour of each parent, or to the parent, if that has no smaller
        # one. A root with very many nodes has no row in `least`; that is stored, so the join can be dealt anew where keys are hot
        least = written(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
        large = edges.join(sized_broadcast(renamed(least, a="b")), "b", "left").select("a", F.coalesce("m", "b").alias("b"))
        # small star: a node and its parents, which are few, are linked to the least of them
        small = large.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = written(small.select("e.a", "e.b").filter("a != b").distinct(), "stars")
        now = state(edges)
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
