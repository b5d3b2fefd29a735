"""CSV, JSON-lines and report sinks, and the check of what they wrote."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def log_to(path: str | None = None, name: str = "loomline") -> logging.Logger:
    """A driver logger to stderr and, if a path is given, to a file."""
    log = logging.getLogger(name)
    log.setLevel(logging.INFO)
    for handler in [logging.StreamHandler(), *([logging.FileHandler(path)] if path else [])]:
        handler.setFormatter(logging.Formatter("%(asctime)s - %(levelname)s - %(message)s"))
        log.addHandler(handler)
    return log


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> str:
    """A CSV file a partition, each with a header; rows keep their order in it. Texts are quoted and nulls aren't, so both come back as they are.

    Spark's own CSV writer doesn't double the quotes of texts that begin and end with one, nor tell an empty text from a null.
    """
    rows = df.coalesce(1) if one_file else df
    return write_lines(rows, path, ",".join(map(_quoted, df.columns)), F.concat_ws(",", *[_cell(f) for f in df.schema]))


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"' if set(name) & set('",\r\n') or name != name.strip() else name


def _cell(field: T.StructField) -> Column:
    c = F.col("`" + field.name.replace("`", "``") + "`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.concat(F.lit('"'), F.replace(c.cast("string"), F.lit('"'), F.lit('""')), F.lit('"')), F.lit(""))
    return F.coalesce(F.to_csv(F.struct(c)), F.lit(""))


def write_lines(rows: DataFrame, path: str, header: str, line: Column) -> str:
    """The text line of each row, in a file a partition that begins with the header."""
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    text = rows.select(F.when(first, F.concat(F.lit(header + "\n"), line)).otherwise(line).alias("value"))
    text.write.mode("overwrite").option("maxRecordsPerFile", 0).text(path)
    spark = rows.sparkSession
    if not any(validate_outputs(spark, path).values()):  # no rows
        spark.range(1).select(F.lit(header).alias("value")).coalesce(1).write.mode("overwrite").text(path)
    return path


def write_jsonl(df: DataFrame, path: str) -> str:
    """One object a line; nulls are kept, text isn't escaped."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return path


def write_report(df: DataFrame, path: str) -> str:
    """A report of one row as one JSON file."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return path


def validate_outputs(spark: SparkSession, *paths: str) -> dict[str, bool]:
    """Whether each output exists and holds bytes."""
    out = {}
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        out[path] = bool(fs.exists(p)) and fs.getContentSummary(p).getLength() > 0
    return out
