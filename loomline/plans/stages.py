"""The stages end to end: from files to tables, JSON lines and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import text as X
from loomline.operators import content, eda, parse, profile, sample, threads
from loomline.sources import files, sinks
from loomline.sources.tables import written


@dataclass(frozen=True)
class Config:
    """Where a run reads and writes, and its parameters."""

    source: str
    out: str
    sample_size: int = 5_000
    seed: int = 42
    max_errors: int | None = None
    compat: bool = False

    def path(self, name: str) -> str:
        return f"{self.out.rstrip('/')}/{name}"


def run_sampling(spark: SparkSession, c: Config) -> DataFrame:
    """A sample of the raw CSV, written, read again and verified; the verification's row."""
    raw = files.with_seq(files.read_csv(spark, c.source, na=False))
    sinks.write_csv(sample.sample_exact(raw, c.sample_size, c.seed).drop("seq"), c.path("sample.csv"), one_file=True)
    return sample.verify_sample(files.read_csv(spark, c.path("sample.csv"), na=False), raw.drop("seq"), c.sample_size)


def run_profile(spark: SparkSession, c: Config) -> DataFrame:
    """The quality report's row; it and the rows' flags are written."""
    raw = files.with_seq(files.read_csv(spark, c.source))
    report = profile.summary(raw)
    sinks.write_report(report, c.path("data_quality_report.json"))
    sinks.write_jsonl(profile.row_metrics(raw), c.path("quality_metrics.jsonl"))
    return report


def run_parse(spark: SparkSession, c: Config) -> DataFrame:
    """Parsed messages, which JSON lines, hints and the report are written from."""
    parsed = written(parse.parse(files.load_messages(spark, c.source)), "parsed")
    sinks.write_jsonl(parsed, c.path("emails_parsed.jsonl"))
    sinks.write_jsonl(parse.thread_hints(parsed), c.path("thread_hints.jsonl"))
    report = parse.full_report(parsed).withColumns({"source_file": F.lit(c.source), "processing_timestamp": F.current_timestamp()})
    sinks.write_report(report, c.path("parsing_report.json"))
    return parsed


def run_threads(spark: SparkSession, c: Config) -> DataFrame:
    """Threads of the parsed messages, with their report."""
    records = threads.reference_records(files.with_seq(files.read_jsonl(spark, c.path("emails_parsed.jsonl"))), c.compat)
    found = written(threads.threads(records, c.compat), "threads")
    sinks.write_jsonl(found, c.path("conversation_threads.jsonl"))
    metrics = threads.quality_metrics(found).select(F.struct("*").alias("thread_quality_metrics"))
    summed = threads.summary(found, records).select(F.struct("*").alias("reconstruction_summary"))
    sinks.write_report(summed.join(metrics, how="left").withColumn("processing_timestamp", F.current_timestamp()), c.path("thread_reconstruction_report.json"))
    return found


def run_content(spark: SparkSession, c: Config) -> DataFrame:
    """Content records of the parsed messages, with fingerprints and the report; outputs are checked."""
    parsed = files.with_seq(files.read_jsonl(spark, c.path("emails_parsed.jsonl")))
    done = written(content.process(parsed, c.compat, max_errors=c.max_errors), "processed")
    outputs = [
        sinks.write_jsonl(done.drop("seq"), c.path("emails_processed.jsonl")),
        sinks.write_jsonl(content.fingerprints(done), c.path("content_fingerprints.jsonl")),
        sinks.write_report(content.report(done, parsed), c.path("content_processing_report.json")),
    ]
    missing = [p for p, ok in sinks.validate_outputs(spark, *outputs).items() if not ok]
    if missing:
        raise RuntimeError(f"nothing written to {', '.join(missing)}")
    return done


def run_eda(spark: SparkSession, c: Config) -> dict[str, DataFrame]:
    """Tables behind the charts, and the summary's row."""
    raw = files.load_messages(spark, c.source)
    meta = written(parse.metadata(raw), "metadata")
    times = eda.with_times(meta, X.date_timestamp(F.col("date_str")))
    return {
        "null_counts": profile.null_counts(raw),
        "length_stats": eda.length_stats(raw, "raw_text", c.compat),
        "length_histogram": eda.histogram(raw, X.n_chars(F.col("raw_text"), c.compat)),
        "token_histogram": eda.histogram(raw, X.n_tokens(F.col("raw_text"), c.compat)),
        "word_frequency": eda.word_frequency(raw, "raw_text"),
        "top_senders": sample.top_values(meta, "sender").withColumn("label", X.truncated(F.col("sender"))),
        "top_recipients": sample.top_values(meta, "recipient").withColumn("label", X.truncated(F.col("recipient"))),
        "hour_counts": eda.hour_counts(times),
        "weekday_counts": eda.weekday_counts(times),
        "day_counts": eda.day_counts(times),
        "summary": eda.summary(raw, "raw_text", times, "sender", "recipient").crossJoin(profile.overall_completeness(meta, c.compat)),
    }
