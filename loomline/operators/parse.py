"""The parse stage: raw messages to structured records, thread hints and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import text as X
from loomline.functions.mime import PARSED, parse_messages
from loomline.sources.tables import written


def parse(raw: DataFrame, policy: str = "modern", lossy: bool = False, only: tuple[str, ...] = tuple(PARSED.names)) -> DataFrame:
    """id, seq, source_filename and the parsed columns (or only some) of raw (id, seq, filename, raw_text)."""
    rows = raw.select("id", "seq", F.col("filename").alias("source_filename"), "raw_text")
    return parse_messages(rows, "raw_text", policy, lossy, only)


def parse_native(raw: DataFrame, names: tuple[str, ...] = ("From", "To", "Subject", "Date", "Message-ID", "In-Reply-To", "References")) -> DataFrame:
    """Headers and plain body without leaving the JVM, for single-part messages."""
    block = raw.withColumn("_h", X.header_block(F.col("raw_text")))
    cols = [X.header(F.col("_h"), n).alias(n.lower().replace("-", "_")) for n in names]
    return block.select("id", "seq", *cols, X.plain_body(F.col("raw_text")).alias("body_text"))


def thread_hints(parsed: DataFrame) -> DataFrame:
    h = F.col("headers")
    return parsed.select("id", *[h[c].alias(c) for c in ("message_id", "in_reply_to", "references", "subject", "from", "date")], "source_filename")


def report(parsed: DataFrame) -> DataFrame:
    """One row: total, successes, failures and the rate; no rows give rate 0."""
    return _report(parsed, F.count_if("parsing_success"), F.count(F.lit(1)))


def _report(parsed: DataFrame, ok: Column, n: Column) -> DataFrame:
    return parsed.agg(n.alias("total_emails"), ok.alias("successful_parsing"), (n - ok).alias("failed_parsing"), F.coalesce(F.round(ok / F.nullif(n, F.lit(0)), 4), F.lit(0.0)).alias("success_rate"))


def error_distribution(parsed: DataFrame, k: int = 10, compat: bool = False) -> DataFrame:
    """The k most frequent errors; compat counts the first k failures alone."""
    failed = parsed.where(~F.col("parsing_success"))
    if compat:
        return failed.orderBy("seq").limit(k).groupBy("error").agg(F.count(F.lit(1)).alias("n"))
    return failed.groupBy("error").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "error").limit(k)


def full_report(parsed: DataFrame) -> DataFrame:
    """The report with the errors as a map; the messages are parsed once, as both are made from counts that are written first."""
    counts = written(parsed.groupBy("parsing_success", "error").agg(F.count(F.lit(1)).alias("n")), "outcomes")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    top = counts.where(~F.col("parsing_success")).orderBy(F.desc("n"), "error").limit(10)
    errors = top.agg(F.map_from_entries(F.collect_list(F.struct("error", "n"))).alias("error_distribution"))
    return _report(counts, total(F.when(F.col("parsing_success"), F.col("n"))), total("n")).crossJoin(errors)


def metadata(raw: DataFrame) -> DataFrame:
    """Lenient metadata, headers as written, with defaults for missing ones."""
    h = F.col("headers")
    default = lambda c, v: F.coalesce(h[c], F.lit(v))
    return parse(raw, policy="verbatim").select(
        "id", "seq", default("from", "Unknown").alias("sender"), default("to", "Unknown").alias("recipient"), default("subject", "No Subject").alias("subject"), default("date", "").alias("date_str")
    )
