"""What the training-data operators share: lineage cuts, row identity and Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snapweave.functions.lineage import cut, new_folder, shared_folder

__all__ = ["NULL_ID", "cut", "doc_id", "forget", "identified", "identity", "kept", "new_folder", "partitions", "quoted", "running", "shared_folder", "small_batches", "steps", "trim", "trimmed", "utf8", "whole_row"]

#: Stands for a null doc_id inside joins, and so counts as the smallest id.
NULL_ID = -(2**63)
#: Bytes of text that one vectorised step takes; a longer text is a step of its own.
STEP_BYTES = 1 << 20


#: Bytes of rows that go to a Python worker at a time, where the session leaves it to Spark (64 MB, of which tasks hold several copies outside the heap).
BATCH_BYTES = 4 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound what tasks hold for Python workers by BATCH_BYTES, unless the session has a setting of its own. It holds for the session from now on."""
    if spark.conf.get(_BATCHES) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(_BATCHES, f"{BATCH_BYTES}b")


#: What a Python worker keeps from task to task: one thing, until another operator's task needs the room.
_KEPT: dict = {}


def kept(key: tuple, make: Callable):
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    _KEPT.clear()


def trim() -> None:
    """Give memory that a Python worker has freed back to the system, so that idle workers don't hold what their last task needed."""
    pa.default_memory_pool().release_unused()
    free = getattr(_LIBC, "malloc_trim", None)
    if free is not None:
        free(0)


_LIBC = ctypes.CDLL(None)


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, and trim() after the last."""
    yield from batches
    trim()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def identity() -> tuple[Column, Column]:
    """did is doc_id (NULL_ID for null); rid tells rows of one doc_id with different texts apart."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("rid")


def identified(docs: DataFrame) -> DataFrame:
    """(did, rid, text) of docs. Rows equal in doc_id and text share did and rid, and get the same result."""
    return docs.select(*identity(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def quoted(name: str) -> str:
    """A column's name as it must be written where names may hold dots or backticks."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one struct, so that columns added beside it can't clash with its own."""
    return F.struct(*(F.col(quoted(c)) for c in df.columns))


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with `place` (from 1) in an order that has no ties, and for each of sums what the rows before a row sum up to.

    Rows are dealt by ranges, so a task holds one range; what goes over borders is a row for each range.
    """
    dealt = cut(df.repartitionByRange(partitions(df.sparkSession), *order).select("*", F.spark_partition_id().alias("_range"), *(x.alias(f"_x_{k}") for k, x in sums.items())))
    totals = dealt.groupBy("_range").agg(F.count("*").alias("_n"), *(F.sum(f"_x_{k}").alias(f"_t_{k}") for k in sums))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("_range", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_n", *(f"_t_{k}" for k in sums))))
    inside = Window.partitionBy("_range").orderBy(*order)
    here = dealt.select("*", F.row_number().over(inside).alias("_place"), *(F.coalesce(F.sum(f"_x_{k}").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_b_{k}") for k in sums))
    return here.join(base, "_range").select(*df.columns, (F.col("_n") + F.col("_place")).alias("place"), *((F.col(f"_t_{k}") + F.col(f"_b_{k}")).alias(k) for k in sums))


def doc_id(column: str = "did"):
    """The doc_id of a did."""
    return F.when(F.col(column) != NULL_ID, F.col(column)).alias("doc_id")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows (one more than rows); a null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of at most limit bytes of text, or of one row, with utf8() of their text."""
    for batch in batches:
        data, off = utf8(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to
