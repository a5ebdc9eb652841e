"""Helpers that several of the operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answergauge.operators.layout import materialised, ship_package

# A word of every operator: a run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body reads it (also inside lambdas)."""
    return F.transform(F.array(value), body)[0]


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; NULL for a NULL id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def ranked(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """Adds the 0-based position of each row in the order of ``order``, without putting all rows in one task.

    Rows are dealt out by range and numbered within their partition; only one count per partition meets
    in one place. The dealt rows are written first, so that both readings see the same partitions."""
    from pyspark.sql import Window

    dealt = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    dealt = materialised(dealt)
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col("_part").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (
        dealt.withColumn("_row", within)
        .join(offsets, F.col("_part") == F.col("_of"))
        .withColumn(name, F.col("_before") + F.col("_row") - 1)
        .drop("_part", "_of", "_before", "_row")
    )


def in_slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the values of ``column`` in one slice hold about ``most_bytes`` (one long value
    may stand alone). No row is left out; an empty batch gives nothing."""
    for batch in batches:
        start, held = 0, 0
        sizes = pc.binary_length(batch.column(column)).to_pylist()
        for i, size in enumerate(sizes):
            size = size or 0
            if i > start and held + size > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)
        del batch
        _trim()


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(_C, "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def give_back() -> None:
    """Hand memory that a task has freed back to the system. Spark uses Python workers again, so that without it each
    stage of a long job would add to what they hold."""
    gc.collect()
    _trim()


_C = ctypes.CDLL(None)


def schema_of(df: DataFrame, **changed: T.DataType) -> T.StructType:
    """The schema of ``df`` with some columns' types replaced or, at the end, added; all nullable."""
    fields = [T.StructField(f.name, changed.pop(f.name, f.dataType)) for f in df.schema.fields]
    return T.StructType(fields + [T.StructField(k, v) for k, v in changed.items()])


__all__ = ["SPACE", "WORD", "give_back", "id_remainder", "in_slices", "let", "materialised", "ranked", "schema_of", "ship_package", "table"]
