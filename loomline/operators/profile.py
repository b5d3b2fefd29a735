"""Data-quality profiling: completeness, duplicates, encoding, row flags and the summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a quality report recommends.
RECOMMENDATIONS = ("Review fields with completeness < 90%", "Fix encoding issues before NLP processing", "Remove duplicates for unbiased statistics")


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("long"))


def types(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(df.dtypes, "field_name string, type string")


def inspect(df: DataFrame, rows: int = 3) -> dict[str, DataFrame]:
    """What a first look at a table shows."""
    return {"shape": shape(df), "types": types(df), "null_counts": null_counts(df), "duplicate_rows": duplicate_row_count(df), "head": df.limit(rows)}


def null_counts(df: DataFrame) -> DataFrame:
    """Columns that have nulls, with their number."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return one.unpivot([], df.columns, "field_name", "n_null").where("n_null > 0")


def duplicate_row_count(df: DataFrame) -> DataFrame:
    """Rows minus distinct rows; nulls are equal. Rows are counted by their digests, so no text is shuffled."""
    distinct = df.groupBy(_digest(df.columns).alias("key")).count()
    return distinct.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("n_duplicate_rows"))


def field_completeness(df: DataFrame) -> DataFrame:
    one = df.agg(*[F.round(F.avg(F.col(c).isNotNull().cast("int")) * 100, 6).alias(c) for c in df.columns])
    return one.unpivot([], df.columns, "field_name", "completeness_percentage")


def overall_completeness(df: DataFrame, compat: bool = False) -> DataFrame:
    """Percent of cells that aren't null; compat takes the nulls off the rows instead of off the cells."""
    nulls = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("long") for c in df.columns])
    one = df.agg(F.count(F.lit(1)).alias("n"), F.sum(nulls).alias("k"))
    cells = F.col("n") * len(df.columns)
    return one.select(F.round(((F.col("n") if compat else cells) - F.col("k")) / cells * 100, 6).alias("overall_completeness"))


def bad_encoding(column: Column) -> Column:
    """Whether bytes, or text, aren't valid UTF-8; nulls are fine."""
    return F.coalesce(~F.is_valid_utf8(column.cast("string")), F.lit(False))


def _digest(columns) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def _with_count(df: DataFrame, subset: tuple[str, ...]) -> DataFrame:
    """df with _n, the rows that agree with a row on the subset, nulls equal.

    Digests are counted before they are joined back, so a hot group costs a row a task, and the join
    splits its rows.
    """
    keyed = df.withColumn("_k", _digest(subset))
    return keyed.join(keyed.groupBy("_k").agg(F.count(F.lit(1)).alias("_n")), "_k").drop("_k")


def duplicates(df: DataFrame, *subset: str) -> DataFrame:
    """All rows of groups with several rows, nulls equal."""
    keyed = df.withColumn("_k", _digest(subset))
    return keyed.join(keyed.groupBy("_k").count().where("count > 1"), "_k", "left_semi").drop("_k")


def row_metrics(df: DataFrame, index: str = "seq", text: str = "message", subset: tuple[str, ...] = ("file", "message")) -> DataFrame:
    """Per row: number of nulls, encoding flag, duplicate flag."""
    nulls = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in df.columns if c != index])
    key = _digest(subset)
    flags = df.select(F.col(index).cast("long").alias("email_index"), nulls.alias("missing_field"), bad_encoding(F.col(text)).alias("has_encoding_issues"), key.alias("key"))
    return _with_count(flags, ("key",)).select("email_index", "missing_field", "has_encoding_issues", (F.col("_n") > 1).alias("is_duplicate"))


def summary(df: DataFrame, index: str = "seq", text: str = "message", subset: tuple[str, ...] = ("file", "message")) -> DataFrame:
    """One row: total, completeness by field, rows with encoding issues, duplicate rows, recommendations."""
    fields = [c for c in df.columns if c != index]
    complete = F.map_from_entries(F.array(*[F.struct(F.lit(c), F.round(F.avg(F.col(c).isNotNull().cast("int")) * 100, 6)) for c in fields]))
    counts = row_metrics(df, index, text, subset).agg(F.count_if("has_encoding_issues").alias("num_encoding_issues"), F.count_if("is_duplicate").alias("num_duplicates"))
    one = df.agg(F.count(F.lit(1)).alias("total_emails"), complete.alias("field_completeness"))
    return one.crossJoin(counts).withColumn("recommendations", F.array(*map(F.lit, RECOMMENDATIONS)))
