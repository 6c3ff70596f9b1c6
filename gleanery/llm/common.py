"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleanery.session import shared_path

#: Upper and lower case of the ASCII letters, for case folding that leaves every other letter alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df below the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Write df like `stored`, dealt into buckets of `key`, a key of single rows: joins by it move the other side alone.

    The catalogue only lends the table its buckets; its name is dropped again, the files stay where they are.
    """
    spark = df.sparkSession
    parts, path, label = partitions(spark), shared_path(spark, name), f"buckets_{uuid.uuid4().hex}"
    df.repartition(parts, key).write.format("parquet").bucketBy(parts, key).option("path", path).saveAsTable(label)
    found = spark.table(label)
    spark.sql(f"DROP TABLE {label}")
    return found


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions the session asks for, used where an operator must name a number."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`"), F.lit(""))


#: What drops each thing that workers remember from task to task.
_REMEMBERED: dict[str, Callable[[], None]] = {}


def remembered(name: str, drop: Callable[[], None]) -> None:
    _REMEMBERED[name] = drop


def give_back(keeps: str = "") -> None:
    """Drop what this worker remembers but for `keeps`, and return free memory to the machine.

    Workers live on through all stages of a job, so what one stage leaves would count for the next.
    """
    for name, drop in _REMEMBERED.items():
        if name != keeps:
            drop()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some systems have it
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20, keeps: str = "") -> Iterator[pa.RecordBatch]:
    """Cut batches so that the values of one column hold about `limit` bytes, one row at least."""
    give_back(keeps)
    yield from _cut(batches, column, limit)
    give_back(keeps)


def _cut(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(column)
        ends = np.cumsum(np.maximum(1, pa.compute.fill_null(pa.compute.binary_length(sizes), 0).to_numpy(zero_copy_only=False)))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over 64 output bits (wrapping arithmetic)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def random_words(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit words, the same on every machine."""
    return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * np.uint64(0x9E3779B97F4A7C15))


def numbered(df: DataFrame, order: list[Column], number: str, name: str) -> DataFrame:
    """df with the place of each row (from 0) in a total order, without gathering rows anywhere.

    Rows are dealt by range and sorted where they land; the table is stored, so the places stay what they
    are, and only one count per partition reaches the driver.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    kept = stored(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), name)
    before, starts = 0, []
    for row in kept.groupBy("_part").count().orderBy("_part").collect():
        starts.append((row._part, before))
        before += row["count"]
    offset = F.coalesce(*[F.when(F.col("_part") == p, F.lit(b)) for p, b in starts], F.lit(0)) if len(starts) < 64 else F.element_at(
        F.create_map(*[F.lit(x) for pair in starts for x in pair]), F.col("_part")
    )
    return kept.withColumn(number, (offset + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("_part", "_at")
