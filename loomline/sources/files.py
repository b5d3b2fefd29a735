"""CSV and JSON-lines sources for message tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.sources.schemas import PARSED, RAW
from loomline.sources.tables import ranked

# Texts that a CSV cell stands for a missing value by.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def require_path(spark: SparkSession, path: str) -> None:
    if not exists(spark, path):
        raise FileNotFoundError(f"no dataset at {path}")


def require_columns(df: DataFrame, *names: str) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def with_seq(df: DataFrame, name: str = "seq", *order: str) -> DataFrame:
    """df with a row ordinal from 0: by the given key if there is one, else by scan order.

    Positions are counted a partition at a time and offset by the rows of the partitions before, so no
    task sees all rows.
    """
    if order:
        return ranked(df, name, *order)
    marked = df.withColumn("_k", F.monotonically_increasing_id())
    return _numbered(marked.withColumn("_p", F.shiftright("_k", 33)), name)


def _numbered(marked: DataFrame, name: str) -> DataFrame:
    """marked with its place from 0 as name: by its part _p, and there by the number _k, which goes up by one a row."""
    counts = marked.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_k").alias("_low"))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_p", (F.coalesce(before, F.lit(0)) - F.col("_low")).alias("_offset"))
    return marked.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_offset") + F.col("_k")).drop("_k", "_p", "_offset")


def read_csv(spark: SparkSession, path: str, schema: T.StructType = RAW, skip_long: bool = True, na: bool = True, place: bool = False) -> DataFrame:
    """Quoted, multi-line CSV with a header; rows of too many fields are skipped if skip_long, short ones are filled with nulls.

    An empty cell is a null, without na an empty one in quotes is an empty text. place adds the file as _p and the order in it as _k.
    """
    require_path(spark, path)
    wide = T.StructType([*schema.fields, T.StructField("_extra", T.StringType())]) if skip_long else schema
    reader = spark.read.schema(wide).option("header", True).option("enforceSchema", True).option("multiLine", True)
    reader = reader.option("quote", '"').option("escape", '"').option("charToEscapeQuoteEscaping", '"').option("mode", "PERMISSIVE")
    # Spark takes what it reads as this mark for a null, be it in quotes or not; it must not be a text, not the empty one either
    df = reader.option("nullValue", uuid.uuid4().hex).csv(path)
    if place:
        df = df.select("*", F.col("_metadata.file_path").alias("_p"))
    if skip_long:
        df = df.where(F.col("_extra").isNull()).drop("_extra")
    if place:
        df = df.withColumn("_k", F.monotonically_increasing_id())
    if na:
        text = {f.name for f in schema.fields if isinstance(f.dataType, T.StringType)}
        df = df.select(*[F.when(~F.col(c).isin(*NA_TOKENS), F.col(c)).alias(c) if c in text else F.col(c) for c in df.columns])
    return df


def preview(spark: SparkSession, path: str, rows: int = 5) -> DataFrame:
    return read_csv(spark, path).limit(rows)


def load_messages(spark: SparkSession, path: str) -> DataFrame:
    """Raw messages as filename, raw_text, id (position, in the order of the files' names) and seq."""
    df = read_csv(spark, path, place=True)
    require_columns(df, "file", "message")
    # a multi-line CSV is one task a file, so rows are dealt out before they are parsed
    rows = _numbered(df.withColumnsRenamed({"file": "filename", "message": "raw_text"}), "seq").withColumn("id", F.col("seq").cast("string"))
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "seq")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = PARSED) -> DataFrame:
    """JSON lines; lines that don't parse, blank ones too, are skipped. A failed message's empty headers are null."""
    require_path(spark, path)
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    if {"headers", "parsing_success"} <= set(df.columns):
        df = df.withColumn("headers", F.when(F.col("parsing_success"), F.col("headers")))
    return df


def count_bad_lines(spark: SparkSession, path: str, schema: T.StructType = PARSED) -> int:
    """Lines, blank ones too, that the schema can't be read from."""
    marked = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    row = F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return spark.read.text(path).where((F.trim("value") == "") | row["_bad"].isNotNull()).count()


def text_column(df: DataFrame, prefer: str = "message") -> str:
    """The column to analyse: the preferred one, else the last."""
    return prefer if prefer in df.columns else df.columns[-1]
