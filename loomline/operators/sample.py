"""Exact-size seeded sampling and its check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_exact(df: DataFrame, n: int, seed: int = 42, key: str = "seq", check: bool = True) -> DataFrame:
    """n rows without replacement, the same for every partitioning: the first by a seeded hash of the key."""
    if check and n > (rows := df.count()):
        raise ValueError(f"sample of {n} from {rows} rows")
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def verify_sample(sample: DataFrame, original: DataFrame, n: int) -> DataFrame:
    """One row: rows, columns as expected, rows that the original doesn't have."""
    extra = sample.exceptAll(original).agg(F.count(F.lit(1)).alias("extra_rows"))
    return sample.agg(F.count(F.lit(1)).alias("n_rows")).crossJoin(extra).select(
        "n_rows",
        (F.col("n_rows") == n).alias("size_ok"),
        F.lit(len(sample.columns)).cast("long").alias("n_columns"),
        F.lit(sample.columns == original.columns).alias("columns_ok"),
        "extra_rows",
    )


def head(df: DataFrame, n: int, key: str = "seq") -> DataFrame:
    return df.orderBy(key).limit(n)


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values; ties by value."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)
