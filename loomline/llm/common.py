"""What the training-data operators share: shipping, shared storage, Arrow helpers, text rules."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loomline.sources.tables import delete_at_exit, discard, shared_path, ship, sum_before, written

__all__ = ["KEPT", "by_bytes", "column_of", "delete_at_exit", "discard", "forget", "n_words_col", "numbered", "release", "shared_path", "ship", "small_table", "sum_before", "text_slices", "unused", "without", "words_col", "written"]

#: The white space of every contract here.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps; it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: What a Python worker keeps from task to task of a step, as encoders with the pieces they remember.
KEPT: dict = {}


def forget() -> None:
    """Free what another step left in this worker, as the steps use the same workers."""
    KEPT.clear()


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a table, by Arrow: a table of Python objects starts further Python workers on every executor."""
    kinds = StructType.fromDDL(schema)
    wanted = to_arrow_schema(kinds)
    columns = list(zip(*rows, strict=True)) or [()] * len(wanted)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, wanted, strict=True)], schema=wanted), kinds)


#: Slots of the filter that keeps rows which surely stay out of a join, so its size is bounded.
SLOTS = 1 << 18


def unused(docs: DataFrame, name: str) -> str:
    """name, or a longer one, that no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """(docs, row): docs with a column row that is unique and never null.

    doc_id itself serves where it tells the rows apart; else docs is written with a number for each row,
    as a second scan may number rows otherwise.
    """
    row, id_ = unused(docs, "_row"), F.col("doc_id").cast("long")
    if docs.groupBy(id_.alias("id")).count().where("count > 1 or id is null").isEmpty():
        return docs.withColumn(row, id_), row
    return written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def without(docs: DataFrame, row: str, dropped: DataFrame) -> DataFrame:
    """The rows of docs (row is unique) that dropped (one column) doesn't name, without that column.

    A filter of SLOTS slots, so of bounded size, passes most rows that stay as they are scanned; only
    the others are joined, each once.
    """
    at, gone_ = unused(docs, "_slot"), unused(docs, "_gone")
    slot = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(SLOTS)).cast("int")
    gone = dropped.toDF(gone_)
    slots = F.broadcast(gone.select(slot(gone_).alias(at)).distinct())
    hit = slot(row) == F.col(at)
    maybe = docs.join(slots, hit, "left_semi").join(gone, F.col(row) == F.col(gone_), "left_anti")
    return docs.join(slots, hit, "left_anti").unionByName(maybe).drop(row)


def words_col(text):
    """Array of the words of a text; null and blank texts give an empty array."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE + "+"))


def n_words_col(text):
    """Number of words, counted without building an array of them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def text_slices(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column with each row's begin and end in them; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        z = np.zeros(n, np.int64)
        return np.zeros(0, np.uint8), z, z
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    begin, end = at[:-1].copy(), at[1:].copy()
    if column.null_count:
        gone = ~np.asarray(column.is_valid())
        end[gone] = begin[gone]
    return raw, begin, end


def by_bytes(batches: Iterator[pa.RecordBatch], name: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """batches cut so that a text column holds about most bytes, or one row, in each."""
    for batch in batches:
        _, begin, end = text_slices(column_of(batch, name))
        i = 0
        while i < len(batch):
            j = max(i + 1, int(np.searchsorted(end, begin[i] + most, "right")))
            yield batch.slice(i, j - i)
            i = j


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
