"""Operator 12: centroid clustering with an incremental matrix of dot products.

Vectors are quantised to integers. Beside each vector its exact dot products with all centroids are stored. When centroids
move, only the components that changed are multiplied again and added; the nearest centroid then follows from the stored
products and the centroids' own squares, as |v - c|^2 = |v|^2 - 2 v.c + |c|^2. All of it is integer arithmetic.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ._shared import scratch, table
from .topk_search import quantised

LEAST_LONG, MOST_LONG = -(1 << 63), (1 << 63) - 1
#: Sums travel in pieces of so many bits, so that they are exact however large they grow.
PIECE_BITS = 62

SUMS = pa.schema([("cluster", pa.int32()), ("component", pa.int32()), ("piece", pa.int32()), ("total", pa.int64())])


def usable(vectors: DataFrame, dims: int, vector: str, vec_id: str) -> DataFrame:
    """(id, x array<double>) of the vectors with dims components, none null or non-finite."""
    rows = vectors.select(F.col(vec_id).alias("id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= F.lit(float(np.finfo(np.float64).max))))
    return rows.filter((F.size("x") == dims) & finite)


class _Integers:
    """Columns of integer arrays: 64-bit ones, or texts of digits where products may need more bits."""

    def __init__(self, wide: bool):
        self.wide, self.spark = wide, "array<string>" if wide else "array<long>"

    def matrix(self, column: pa.Array, width: int) -> np.ndarray:
        flat = column.flatten()
        values = np.array([int(x) for x in flat.to_pylist()], object) if self.wide else flat.to_numpy(zero_copy_only=False).astype(np.int64)
        return values.reshape(len(column), width)

    def column(self, matrix: np.ndarray) -> pa.Array:
        flat = pa.array([str(x) for x in matrix.ravel().tolist()], pa.string()) if self.wide else pa.array(matrix.ravel())
        return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]), flat)


def _moved(dots: np.ndarray, v: np.ndarray, before: list[list[int]], after: list[list[int]]) -> None:
    """Brings the dot products up to date: only components in which a centroid changed are read."""
    for k, (old, new) in enumerate(zip(before, after, strict=True)):
        changed = [j for j, (a, b) in enumerate(zip(old, new, strict=True)) if a != b]
        if changed:
            dots[:, k] += v[:, changed] @ np.array([new[j] - old[j] for j in changed], v.dtype)


def _totals(state: DataFrame, numbers: _Integers, dims: int) -> dict[int, list[int]]:
    """By cluster: the sums of its vectors' components, of their distances, and their number. A row a cluster leaves Spark."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            cluster = batch.column(0).to_numpy()
            values = np.concatenate([numbers.matrix(batch.column(1), dims), numbers.matrix(batch.column(2), 1), np.ones((len(batch), 1), np.int64)], axis=1)
            for k in np.unique(cluster).tolist():
                part = values[cluster == k].astype(object).sum(axis=0)
                sums[k] = part + sums.get(k, 0)
        rows = []
        for k, totals in sums.items():
            for component, total in enumerate(totals.tolist()):
                piece = 0
                while not -(1 << PIECE_BITS) <= total < 1 << PIECE_BITS:
                    total, low = total >> PIECE_BITS, total & ((1 << PIECE_BITS) - 1)
                    rows.append((k, component, piece, low))
                    piece += 1
                rows.append((k, component, piece, total))
        yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], SUMS.field(i).type) for i in range(4)], schema=SUMS)

    pieces = state.select("cluster", "v", "distance").mapInArrow(add, "cluster int, component int, piece int, total long")
    found: dict[int, list[int]] = {}
    for row in pieces.groupBy("cluster", "component", "piece").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        found.setdefault(row.cluster, [0] * (dims + 2))[row.component] += int(row.total) << (PIECE_BITS * row.piece)
    return found


def _gone(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3", vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """A row for each vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256, n_vectors.

    Vectors with other than dims components, or with null or non-finite ones, are left out. Centroids start as the k
    vectors with the least sha256 of `seed:vec_id` (null ids last; of equal ids, the least vector first), and move rounds
    times to the floor of their vectors' mean; a centroid without vectors stays. Of equally near centroids the smaller
    number counts. With fewer than k vectors there are fewer centroids; without any, there are no rows. Repeated rows are
    vectors of their own. Other columns are not read. Components of any size are exact; what does not fit a long is given
    as the nearest one. The centroids, k times dims integers, travel with the tasks.

    State (vectors and dot products) is a table in the shared folder, written anew each round; the one before it is then
    deleted, so that two of them exist at most and a lost executor costs its own tasks only.
    """
    spark = vectors.sparkSession
    kept = usable(vectors, dims, vector, vec_id)
    largest = kept.agg(F.max(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x"))))).first()[0] or 0.0
    bound = int(largest * scale) + 1 if largest * scale < 1e300 else 1 << 1100
    numbers = _Integers(4 * dims * bound * bound >= 1 << 62)
    kind, id_type = numbers.spark, kept.schema["id"].dataType

    chosen = kept.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).asc_nulls_last(), "x").limit(k).collect()
    centroids = [[int(x) for x in quantised(np.array(row.x, np.float64), scale)] for row in chosen]
    schema = StructType([StructField("id", id_type), *StructType.fromDDL(f"v {kind}, dots {kind}, cluster int, distance {kind}").fields])
    if not centroids:
        state = spark.createDataFrame([], schema)
        totals = {}
    before, path = [[0] * dims for _ in centroids], None

    def round_of(before: list[list[int]], after: list[list[int]], first: bool):
        dtype = object if numbers.wide else np.int64
        squares = np.array([sum(x * x for x in c) for c in after], dtype)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if first:
                    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), dims)
                    v, dots = quantised(x, scale).astype(dtype), np.zeros((len(batch), len(after)), dtype)
                else:
                    v, dots = numbers.matrix(batch.column(1), dims), numbers.matrix(batch.column(2), len(after))
                _moved(dots, v, before, after)
                distances = squares - 2 * dots + (v * v).sum(axis=1)[:, None]
                nearest = distances.argmin(axis=1)  # of equals the first
                least = distances[np.arange(len(v)), nearest][:, None]
                yield pa.RecordBatch.from_arrays([batch.column(0), numbers.column(v), numbers.column(dots), pa.array(nearest.astype(np.int32)), numbers.column(least)], names=schema.names)

        return run

    for number in range(rounds + 1 if centroids else 0):
        source = kept if path is None else spark.read.schema(schema).parquet(path).select("id", "v", "dots")
        last, path = path, scratch(spark, "clusters")
        source.mapInArrow(round_of(before, centroids, last is None), schema).write.option("compression", "zstd").parquet(path)
        if last is not None:
            _gone(spark, last)
        state = spark.read.schema(schema).parquet(path)
        totals = _totals(state, numbers, dims)
        if number < rounds:
            # Python's // is the exact floor
            moved = [[x // totals[c][dims + 1] for x in totals[c][:dims]] if c in totals else old for c, old in enumerate(centroids)]
            before, centroids = centroids, moved

    fits = lambda x: max(LEAST_LONG, min(MOST_LONG, x))
    by_cluster = lambda values, kind: F.element_at(F.array(*[F.lit(x).cast(kind) for x in values]).cast(f"array<{kind}>"), F.col("cluster") + 1)
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    own = [totals.get(c, [0] * (dims + 2)) for c in range(len(centroids))]
    distance = F.element_at("distance", 1)
    if numbers.wide:
        distance = F.coalesce(F.expr("try_cast(element_at(distance, 1) AS long)"), F.lit(MOST_LONG))
    return state.select(
        F.col("id").alias("vec_id"), "cluster", distance.alias("distance"),
        by_cluster([fits(t[dims]) for t in own], "long").alias("cluster_inertia"),
        F.lit(fits(sum(t[dims] for t in own))).cast(LongType()).alias("inertia"),
        by_cluster(hashes, "string").alias("centroid_sha256"),
        by_cluster([t[dims + 1] for t in own], "long").alias("n_vectors"),
    ).withColumn("cluster", F.col("cluster").cast(IntegerType()))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings")).drop("n_vectors")


def _sql(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """The same, plainly: all distances anew in each round."""
    steps = [f"""kept AS MATERIALIZED (
        SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
    parts AS MATERIALIZED (SELECT rid, j, v[j] AS x FROM kept, range(1, {dims + 1}) AS r(j)),
    first AS (SELECT rid, row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)), v) - 1 AS k FROM kept ORDER BY k LIMIT {k}),
    c0 AS MATERIALIZED (SELECT k, j, x FROM first JOIN parts USING (rid))"""]  # fmt: skip
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (
        SELECT rid, min_by(k, d * {k} + k) AS k, min(d) AS d
        FROM (SELECT rid, c.k, CAST(sum((p.x - c.x) * (p.x - c.x)) AS BIGINT) AS d FROM parts p JOIN c{n} c USING (j) GROUP BY rid, c.k) GROUP BY rid)""")
        if n < rounds:
            steps.append(f"""c{n + 1} AS MATERIALIZED (
        SELECT k, j, CAST((s - ((s % n + n) % n)) // n AS BIGINT) AS x
        FROM (SELECT k, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{n} JOIN parts USING (rid) GROUP BY k, j)
        UNION ALL SELECT k, j, x FROM c{n} WHERE k NOT IN (SELECT k FROM a{n}))""")
    return f"""WITH {", ".join(steps)},
    hashes AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
    SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
        CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
    FROM a{rounds} JOIN kept USING (rid) JOIN hashes USING (k)"""


QUERIES = {"op12_centroid_clusters": op12_centroid_clusters}
ORACLE_SQL = {"op12_centroid_clusters": _sql()}
