"""Tables in the shared scratch folder, where plans are cut, and broadcasts whose size was measured."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

#: A side is broadcast only if its measured size is under this.
BROADCAST_BYTES = 32 << 20
#: Rows of whole texts that go to a Python worker at once, where the session has no setting of its own.
ROWS_A_BATCH = 4000
#: Bytes of a batch, beyond which no row is added to it: texts of any length take about the same memory.
BATCH_BYTES = 4 << 20


def short_batches(spark: SparkSession) -> None:
    """Bounds the memory of batches of texts, in the JVM and in the workers; a session's own settings stay."""
    for key, usual, bound in (("maxRecordsPerBatch", "10000", ROWS_A_BATCH), ("maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key) == usual:  # Spark's default
            spark.conf.set(key, str(bound))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared checkpoint folder. Only a local session without that setting gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/millrace/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """The rows as a table in the shared folder: the lineage ends here, and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    seen = Observation()
    df.observe(seen, _row_bytes(df).alias("bytes")).write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_bytes = int(seen.get["bytes"] or 0)
    return out


def _width(column: Column, kind: DataType) -> Column:
    """The bytes of a value in Spark's row format, about."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + F.lit(16)
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, (StringType, BinaryType, ArrayType, StructType, MapType)):
            return F.coalesce(F.aggregate(column, F.lit(24).cast("long"), lambda total, x: total + _width(x, kind.elementType)), F.lit(24))
        return F.greatest(F.size(column), F.lit(0)) * F.lit(8) + F.lit(24)
    if isinstance(kind, StructType):
        return sum((_width(column[f.name], f.dataType) for f in kind.fields), F.lit(16))
    if isinstance(kind, MapType):
        return _width(F.map_keys(column), ArrayType(kind.keyType)) + _width(F.map_values(column), ArrayType(kind.valueType))
    return F.lit(8)


def _row_bytes(df: DataFrame) -> Column:
    """An aggregate: the size of the rows in Spark's row format, about."""
    widths = [_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    return F.sum(sum(widths, F.lit(8)).cast("long"))


def measured_bytes(df: DataFrame) -> int:
    """The size of the rows in Spark's row format, about: as it was counted when they were written, or by one pass over them."""
    stored = df.__dict__.get("stored_bytes")  # a column may have that name, too
    return (df.agg(_row_bytes(df)).first()[0] or 0) if stored is None else stored


def shuffled(df: DataFrame) -> DataFrame:
    """df with a hint that a join shuffles and sorts both sides. Spark would else broadcast by the size of files, and files of a few MB can hold millions of rows."""
    return df.hint("merge")


def many_tasks(spark: SparkSession) -> int:
    """Tasks for a join of few bytes that makes many rows: some for each core, whatever the bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def sized_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if the measured size of its rows is small; otherwise with that of shuffled()."""
    return F.broadcast(df) if measured_bytes(df) <= limit else shuffled(df)


def renamed(df: DataFrame, **names: str) -> DataFrame:
    """df with some columns renamed; what is known of its size stays known."""
    out = df.withColumnsRenamed(names)
    if "stored_bytes" in df.__dict__:
        out.stored_bytes = df.stored_bytes
    return out
