"""Operator 13: the prefix trie of conversations, from adaptive radix trees over turn ids.

A turn's id is a fixed number of bytes, so a conversation is a byte key. Keys are told apart once, dealt into ranges, and
each range goes into a radix tree of its own, whose compressed paths are cut again at whole turns to give the nodes of the
trie. Keys with a common start are neighbours: only nodes on the way to the first or the last key of a range may have
members in another range. These few are merged; all others are complete where they are built.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._radix import Node, Tree
from ._shared import sized_broadcast, table, written

#: Bytes of a turn's id: the start of its SHA-256.
ID_BYTES = 16
#: Bytes of keys (as rows of Spark) that one radix tree holds, and conversations of a run of ids.
TREE_BYTES, RUN_IDS = 8 << 20, 8192
#: Rows of the nodes that leave a task at once.
ROWS = 10_000

EMPTY = hashlib.sha256(b"").hexdigest()
RUN = "kid binary, key binary, sizes array<int>, first long, n long, ids binary"
PATH = "key binary, sizes array<int>, conv_id long, n_convs long, ends_sha256 string"
NODE = "node_id binary, parent_id binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, size long, ends_sha256 string, shared boolean"


def _id(column: Column) -> Column:
    return F.unhex(F.substring(F.sha2(column, 256), 1, 2 * ID_BYTES))


def turns(conversations: DataFrame, group: Column, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(group, conv_id, turns array<struct<id, size>>): the turns of each conversation in order; size is the text's code points.

    Turns are ordered by turn, null first; equal ones by their ids. Null roles and texts count as empty. Rows without
    conv_id belong to no conversation. Only ids and sizes are shuffled, by group, of which a conversation has one.
    """
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    # the role's length tells ("ab", "c") from ("a", "bc")
    rows = conversations.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.struct(F.col(turn).isNotNull().alias("has"), F.coalesce(F.col(turn).cast("long"), F.lit(0)).alias("turn"), _id(F.concat(F.length(by).cast("string"), F.lit(":"), by, said)).alias("id"), F.length(said).alias("size")).alias("t"),
    )
    dealt = rows.withColumn("group", group).repartition("group")
    return dealt.groupBy("group", "conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda x: F.struct(x.id.alias("id"), x["size"].alias("size"))).alias("turns"))


def _paths(conversations: DataFrame) -> DataFrame:
    """From (conv_id, turns) a row for each distinct sequence: key, sizes, least conv_id, n_convs, ends_sha256.

    The ids of one sequence may be a third of all: they are sorted by ranges, joined into texts of some thousand ids, and
    hashed as a stream of those.
    """
    key = F.aggregate("turns", F.lit(b""), lambda all, x: F.concat(all, x.id))
    rows = conversations.select("conv_id", key.alias("key"), F.transform("turns", lambda x: x["size"]).alias("sizes")).withColumn("kid", _id(F.col("key")))
    rows = written(rows, "conversations")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kid, ids, out, first = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [], 0
            for i in range(1, len(ids) + 1):
                if i == len(ids) or kid[i] != kid[first] or i - first == RUN_IDS:
                    out.append((first, i))
                    first = i
            firsts = pa.array([a for a, _ in out], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(firsts), batch.column(2).take(firsts), batch.column(3).take(firsts), batch.column(1).take(firsts), pa.array([b - a for a, b in out], pa.int64()), pa.array([",".join(map(str, ids[a:b])).encode() for a, b in out], pa.binary())],
                names=["kid", "key", "sizes", "first", "n", "ids"],
            )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None  # kid, key, sizes, first, n, hash
        fields = ["key", "sizes", "conv_id", "n_convs", "ends_sha256"]
        types = [pa.binary(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.string()]

        def rows_of(done: list) -> pa.RecordBatch:
            rows = [(key, sizes, first, n, seen.hexdigest()) for _, key, sizes, first, n, seen in done]
            return pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], types[i]) for i in range(5)], names=fields)

        for batch in batches:
            done = []
            for kid, key, sizes, first, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is not None and now[0] == kid:
                    now[5].update(b"," + ids)
                    now[4] += n
                    continue
                if now is not None:
                    done.append(now)
                now = [kid, key, sizes, first, n, hashlib.sha256(ids)]
            if done:
                yield rows_of(done)
        if now is not None:
            yield rows_of([now])

    sorted_rows = rows.select("kid", "conv_id", "key", "sizes").repartitionByRange("kid", "conv_id").sortWithinPartitions("kid", "conv_id")
    gathered = sorted_rows.mapInArrow(runs, RUN).repartition("kid").sortWithinPartitions("kid", "first")
    return written(gathered.mapInArrow(hashed, PATH), "paths")


class _Part:
    """The trie nodes of one radix tree. Of a tree node, own holds: byte depth, n_convs, least conv_id, key and sizes of a key below, points, shared."""

    def __init__(self, tree: Tree, first: bytes, last: bytes):
        self.root = tree.root
        shared = {id(node) for key in (first, last) for node in tree.way(key)}
        order, left = [], [(self.root, -1, 0)]
        while left:
            node, above, begin = left.pop()
            end = begin + len(node.path)
            order.append((node, above, end))
            left += [(below, end, end + 1) for _, below in node.items()]
        for node, above, end in reversed(order):
            self._sum(node, above, end, id(node) in shared)

    @staticmethod
    def _sum(node: Node, above: int, end: int, shared: bool) -> None:
        n = least = key = sizes = None
        tops = leaves = saved = 0
        if node.value is not None:
            key, sizes, least, n, _ = node.value
        for _, below in node.items():
            _, more, low, other, of, _, _, (up_tops, up_leaves, up_saved) = below.own
            n, least = (more, low) if n is None else (n + more, min(least, low))
            if key is None:
                key, sizes = other, of
            tops, leaves, saved = tops + up_tops, leaves + up_leaves, saved + up_saved
        points = []
        for depth in range(end // ID_BYTES, above // ID_BYTES, -1):
            if shared:  # what hangs here and nowhere else; the rest follows when ranges are merged
                points.append((depth, tops, leaves, saved))
                tops = leaves = saved = 0
            else:
                leaves = leaves if tops else 1
                saved += (n - 1) * (sizes[depth - 1] if depth else 0)
                points.append((depth, tops, leaves, saved))
                tops = 1
        node.own = (end, n, least, key, sizes, points[::-1], shared, (tops, leaves, saved))

    def rows(self) -> Iterator[tuple]:
        """In the columns of NODE."""
        left = [(self.root, hashlib.sha256(), None, None, False)]
        while left:
            node, seen, parent, parent_conv, parent_shared = left.pop()
            end, n, least, key, sizes, points, shared, _ = node.own
            for depth, tops, leaves, saved in points:
                if depth:
                    seen = seen.copy()
                    seen.update(key[(depth - 1) * ID_BYTES : depth * ID_BYTES])
                name = seen.digest()[:ID_BYTES]
                ends = node.value[4] if node.value is not None and depth * ID_BYTES == end else None
                yield name, parent, depth, least, None if parent_shared else parent_conv, n, tops, leaves, saved, sizes[depth - 1] if depth else 0, ends, shared
                parent, parent_conv, parent_shared = name, least, shared
            left += [(below, seen, parent, parent_conv, parent_shared) for _, below in node.items()]


def _nodes(paths: DataFrame) -> DataFrame:
    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, first, key = Tree(), None, None
        for batch in batches:
            for value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = value[0]
                first = key if first is None else first
                tree.put(key, value)
        if first is None:
            return
        types = [pa.binary(), pa.binary(), *[pa.int64()] * 8, pa.string(), pa.bool_()]
        rows: list[tuple] = []
        for row in _Part(tree, first, key).rows():
            rows.append(row)
            if len(rows) == ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=_names(NODE))
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=_names(NODE))

    trees = max(1, ceil(paths.stored_bytes / TREE_BYTES))
    return written(paths.repartitionByRange(trees, "key").sortWithinPartitions("key").mapInArrow(grow, NODE), "nodes")


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def _merged(nodes: DataFrame) -> DataFrame:
    """The nodes that several ranges may share, whole. There are at most two ways from the root for each range.

    Sums over subtrees go up by doubling: after i rounds a node has the sums of all nodes less than 2**i below it.
    """
    total = lambda c: F.sum(c).alias(c)
    same = [F.max(c).alias(c) for c in ("parent_id", "depth", "size", "ends_sha256")]
    found = written(nodes.filter("shared").groupBy("node_id").agg(F.min("conv_id").alias("conv_id"), *same, *map(total, ("n_convs", "n_children", "n_leaves", "saved_tokens"))), "shared")
    below = found.groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("more"))
    own = found.join(below, "node_id", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")
    own = own.withColumns({"n_leaves": F.col("n_leaves") + (F.col("n_children") == 0).cast("long"), "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("size"), "up": F.col("parent_id")})
    sums = written(own, "sums")
    deepest, step = sums.agg(F.max("depth")).first()[0] or 0, 1
    while step <= deepest:
        added = sums.filter("up IS NOT NULL").groupBy(F.col("up").alias("node_id")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        further = sums.select(F.col("node_id").alias("up"), F.col("up").alias("next"))
        sums = sums.join(added, "node_id", "left").join(further, "up", "left").withColumns({
            "n_leaves": F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0)), "saved_tokens": F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0)), "up": F.col("next"),
        })
        sums = written(sums.drop("more_leaves", "more_saved", "next"), "sums")
        step *= 2
    parents = sums.select(F.col("node_id").alias("parent_id"), F.col("conv_id").alias("parent_conv_id"))
    return sums.join(parents, "parent_id", "left")


def trie(conversations: DataFrame) -> DataFrame:
    """From (conv_id, turns), one row a conversation, the nodes of the trie of all their starts.

    A row a node: node_id and parent_id (by content), depth, conv_id (the smallest member), parent_conv_id, n_convs,
    n_children, n_leaves (childless nodes in the subtree), saved_tokens (summed over the subtree: (n_convs - 1) times the
    node's own size), ends_sha256 (of the sorted ids of conversations that end there). No conversations give no nodes;
    conversations without turns are members of the root alone. Other columns are not read.

    A third of all conversations may be the same, or start alike: sequences are told apart before they are dealt into
    ranges, so no range is larger for it. A tree holds about TREE_BYTES of keys, or one key, if that is larger.
    """
    nodes = _nodes(_paths(conversations))
    shared = written(_merged(nodes), "shared")
    parents = sized_broadcast(shared.select(F.col("node_id").alias("parent_id"), F.col("conv_id").alias("shared_conv")))
    inner = nodes.filter("NOT shared").join(parents, "parent_id", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "shared_conv"))
    columns = ["node_id", "parent_id", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    ends = F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")
    return inner.select(*columns, ends).unionByName(shared.select(*columns, ends))


def spliced(conversations: DataFrame) -> DataFrame:
    """From turns() by hundred: of each conversation c the first h turns are those of c - c % 100; h is crc32(c) % 6."""
    heads = conversations.filter(F.col("conv_id") == F.col("group")).select("group", F.slice("turns", 1, 5).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    head = F.coalesce(F.slice("head", F.lit(1), h), F.slice("turns", 1, 0))
    return conversations.join(heads, "group", "left").select("conv_id", F.concat(head, own).alias("turns"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_hundred = turns(table(spark, sf_dir, "conversations"), F.col("conv_id") - F.col("conv_id") % 100)
    return trie(spliced(by_hundred)).drop("node_id", "parent_id")


QUERIES = {"op13_prefix_trie": op13_prefix_trie}

#: The same by grouping all starts. The bits of CRC-32 are folded in, as DuckDB has no such function.
ORACLE_SQL = {
    "op13_prefix_trie": """
WITH said AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place,
        dense_rank() OVER (ORDER BY coalesce(role, ''), coalesce(text, '')) AS id, length(coalesce(text, '')) AS size
    FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, list({'id': id, 'size': size} ORDER BY place) AS turns FROM said GROUP BY conv_id),
bits AS (
    SELECT conv_id, list_concat([4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))) AS b
    FROM convs),
cuts AS (
    SELECT conv_id, CAST(xor(list_reduce(list_transform(b, lambda x: CAST(x AS BIGINT)), lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, (crc & 1) * 3988292384) END), 4294967295) % 6 AS BIGINT) AS h
    FROM bits),
rebuilt AS (
    SELECT c.conv_id, list_concat(coalesce(list_slice(b.turns, 1, h), []), list_slice(c.turns, h + 1, len(c.turns))) AS turns
    FROM convs c JOIN cuts USING (conv_id) LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 100),
starts AS (
    SELECT conv_id, depth, list_transform(list_slice(turns, 1, depth), lambda x: x.id) AS path, depth = len(turns) AS ends, coalesce(turns[depth].size, 0) AS size
    FROM rebuilt, range(0, len(turns) + 1) AS r(depth)),
nodes AS (
    SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM starts GROUP BY path, depth),
kids AS (SELECT list_slice(path, 1, depth - 1) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
whole AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (path)),
sums AS (
    SELECT list_slice(path, 1, k) AS path, CAST(count(*) FILTER (n_children = 0) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * size) AS BIGINT) AS saved_tokens
    FROM whole, range(0, depth + 1) AS r(k) GROUP BY 1)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
FROM whole w JOIN sums USING (path) LEFT JOIN nodes p ON w.depth > 0 AND p.path = list_slice(w.path, 1, w.depth - 1)""",
}
