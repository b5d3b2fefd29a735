"""Exploratory statistics: lengths, words, correspondents, times, and the summary over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import text as X

WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def length_stats(df: DataFrame, text: str, compat: bool = False) -> DataFrame:
    """Mean, median, min, max and sample deviation of characters and of tokens; null texts count only with compat."""
    rows = df.select(X.n_chars(F.col(text), compat).alias("chars"), X.n_tokens(F.col(text), compat).alias("tokens"))
    stats = []
    for c in ("chars", "tokens"):
        stats += [
            F.round(F.avg(c), 6).alias(f"{c}_mean"), F.round(F.median(c), 6).alias(f"{c}_median"), F.min(c).alias(f"{c}_min"),
            F.max(c).alias(f"{c}_max"), F.round(F.stddev_samp(c), 6).alias(f"{c}_std"),
        ]
    return rows.agg(*stats)


def histogram(df: DataFrame, value: Column, bins: int = 50) -> DataFrame:
    """Counts in bins of equal width between the least and the greatest value, the last one closed; empty bins have 0."""
    rows = df.select(value.cast("double").alias("x")).where("x is not null")
    ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = F.when(F.col("lo") == F.col("hi"), F.lit(1)).otherwise(F.least(F.floor((F.col("x") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))) + 1, F.lit(bins)))
    found = rows.crossJoin(ends).groupBy(at.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(1, bins + 1).withColumnRenamed("id", "bin")
    return every.join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def word_counts(df: DataFrame, text: str, *by: str) -> DataFrame:
    return df.select(*by, F.explode(X.words(F.col(text))).alias("word")).groupBy(*by, "word").agg(F.count(F.lit(1)).alias("n"))


def word_frequency(df: DataFrame, text: str, k: int = 20) -> DataFrame:
    """The k most frequent words; ties by word."""
    return word_counts(df, text).orderBy(F.desc("n"), "word").limit(k)


def top_words_by(df: DataFrame, text: str, by: str, k: int = 5) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "word"))
    return word_counts(df, text, by).withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def with_times(df: DataFrame, ts: Column) -> DataFrame:
    """Rows that have an instant, with hour, weekday and date_only."""
    out = df.withColumn("parsed_date", ts).where("parsed_date is not null")
    return out.withColumns({"hour": F.hour("parsed_date").cast("long"), "weekday": F.date_format("parsed_date", "EEEE"), "date_only": F.to_date("parsed_date")})


def hour_counts(times: DataFrame) -> DataFrame:
    return times.groupBy("hour").agg(F.count(F.lit(1)).alias("n")).orderBy("hour")


def weekday_counts(times: DataFrame) -> DataFrame:
    """All seven days in order, with 0 for days without rows."""
    days = times.sparkSession.createDataFrame(list(enumerate(WEEKDAYS)), "day_no long, weekday string")
    n = times.groupBy("weekday").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(days).join(n, "weekday", "left").select("day_no", "weekday", F.coalesce("n", F.lit(0)).alias("n")).orderBy("day_no")


def day_counts(times: DataFrame) -> DataFrame:
    return times.groupBy("date_only").agg(F.count(F.lit(1)).alias("n")).orderBy("date_only")


def peaks(times: DataFrame) -> DataFrame:
    """Most frequent hour and weekday; the smallest of equals."""
    return times.agg(F.mode("hour", True).alias("peak_hour"), F.mode("weekday", True).alias("peak_weekday"))


def date_range(times: DataFrame) -> DataFrame:
    day = lambda f: F.date_format(f("parsed_date"), "yyyy-MM-dd")
    return times.agg(day(F.min).alias("first_day"), day(F.max).alias("last_day"))


def distinct_counts(df: DataFrame, *columns: str, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[count(F.col(c)).alias(f"n_{c}") for c in columns])


def top_share(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """Rows that the k most frequent values hold together."""
    from loomline.operators.sample import top_values

    return top_values(df, column, k).agg(F.coalesce(F.sum("n"), F.lit(0)).alias(f"top_{column}_rows"))


def summary(messages: DataFrame, text: str, times: DataFrame, sender: str, recipient: str) -> DataFrame:
    """One row of everything: rows, lengths, top word, correspondents, times."""
    one = messages.agg(F.count(F.lit(1)).alias("n_messages")).crossJoin(length_stats(messages, text))
    word = word_frequency(messages, text, 1).select(F.col("word").alias("top_word"), F.col("n").alias("top_word_n"))
    day = lambda f: F.date_format(f("parsed_date"), "yyyy-MM-dd")
    known = times.agg(  # one pass over the times
        *[F.count_distinct(F.col(c)).alias(f"n_{c}") for c in (sender, recipient)],
        F.mode("hour", True).alias("peak_hour"), F.mode("weekday", True).alias("peak_weekday"), day(F.min).alias("first_day"), day(F.max).alias("last_day"),
    )
    for part in (word, known, top_share(times, sender), top_share(times, recipient)):
        one = one.crossJoin(part)
    return one
