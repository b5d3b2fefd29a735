"""The content stage: clean bodies, quotes, normalised headers, fingerprints and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import mime
from loomline.functions import text as X
from loomline.sources.tables import sum_before


def normalized_headers(parsed: DataFrame, compat: bool = False) -> DataFrame:
    """parsed with n_from, n_to, n_date, n_subject, n_message_id.

    A header that is missing gives ''; with compat a missing subject or message id blanks all of them.
    """
    h = F.col("headers")
    text = lambda c: X.strip(F.coalesce(h[c], F.lit("")))
    out = parsed.withColumns(
        {
            "n_from": mime.address_col(h["from"]),
            "n_to": mime.address_list_col(h["to"], compat),
            "n_date": mime.iso_date_col(h["date"]),
            "n_subject": text("subject"),
            "n_message_id": text("message_id"),
        }
    )
    if compat:
        gone = h.isNotNull() & (h["subject"].isNull() | h["message_id"].isNull())
        blank = {c: F.when(gone, F.lit("")).otherwise(F.col(c)) for c in ("n_from", "n_to", "n_subject", "n_message_id")}
        out = out.withColumns(blank | {"n_date": F.when(~F.coalesce(gone, F.lit(False)), F.col("n_date"))})
    return out


def capped(rows: DataFrame, max_errors: int, batch: int = 100, failed: str = "failed") -> DataFrame:
    """Rows that a loop over batches keeps when it leaves a batch at each error beyond max_errors.

    rows have seq from 0 and the flag failed. Running errors are sums by batch and their prefix sums,
    so that no task numbers all rows.
    """
    b = rows.withColumn("_b", F.floor(F.col("seq") / batch).cast("long"))
    here = Window.partitionBy("_b").orderBy("seq")
    b = b.withColumn("_in", F.sum(F.col(failed).cast("long")).over(here))
    sums = b.groupBy("_b").agg(F.sum(F.col(failed).cast("long")).alias("_k"))
    per = sum_before(sums, "_b", "_k", "_before")
    first = per.where(F.col("_before") + F.col("_k") > max_errors).agg(F.min("_b").alias("_stop"))
    per = per.drop("_k")
    x = b.join(per, "_b").crossJoin(first)
    stop, run = F.col("_stop"), F.col("_before") + F.col("_in")
    keep = stop.isNull() | (F.col("_b") < stop) | ((F.col("_b") == stop) & (run <= max_errors)) | ((F.col("_b") > stop) & (F.col("_in") == 0))
    return x.where(keep & ~F.col(failed)).drop("_b", "_in", "_before", "_stop")


def capped_failures(rows: DataFrame, max_errors: int, batch: int = 100, failed: str = "failed") -> DataFrame:
    """One row: the errors that such a loop meets before it leaves its batches."""
    sums = rows.groupBy(F.floor(F.col("seq") / batch).cast("long").alias("_b")).agg(F.sum(F.col(failed).cast("long")).alias("_k"))
    per = sum_before(sums, "_b", "_k", "_before")
    stop = per.where(F.col("_before") + F.col("_k") > max_errors).agg(F.min("_b").alias("_stop"))
    met = F.when(F.col("_stop").isNull() | (F.col("_b") < F.col("_stop")), F.col("_k")).when(F.col("_b") == F.col("_stop"), max_errors + 1 - F.col("_before")).otherwise(F.least(F.col("_k"), F.lit(1)))
    return per.crossJoin(stop).agg(F.coalesce(F.sum(met), F.lit(0)).cast("long").alias("failed_processing"))


def process(parsed: DataFrame, compat: bool = False, html: str = "native", max_errors: int | None = None) -> DataFrame:
    """Messages with a body as records: headers, original and quoted body, content hash, metadata.

    html 'native' is the chain of replacements, 'parser' the standard library's parser. Messages
    without a body are left out (errors); max_errors gives the loop's cut-off.
    """
    source = F.when(X.strip(F.coalesce("body_html", F.lit(""))) != "", X.clean_text(mime.html_text_col(F.col("body_html")))).otherwise(X.body(F.lit(None).cast("string"), F.col("body_text")))
    rows = parsed.withColumn("plain", source if html == "parser" else X.body(F.col("body_html"), F.col("body_text")))
    if max_errors is None:
        rows = rows.where(F.length("plain") > 0)
    else:
        rows = capped(rows.withColumn("failed", F.length("plain") == 0), max_errors).drop("failed")
    rows = normalized_headers(rows.withColumn("split", X.quote_split(F.col("plain"))), compat)
    original, quoted = F.col("split.original"), F.col("split.quoted")
    return rows.select(
        "id", "seq",
        F.col("n_message_id").alias("message_id"), F.col("n_from").alias("from"), F.col("n_to").alias("to"), F.col("n_date").alias("date"), F.col("n_subject").alias("subject"),
        original.alias("body_original"), quoted.alias("body_quoted"),
        X.content_hash(F.col("n_from"), F.col("n_to"), F.col("n_subject"), original, F.col("n_date")).alias("content_hash"),
        "source_filename",
        F.struct(
            (F.coalesce("body_html", F.lit("")) != "").alias("html_stripped"),
            (quoted != "").alias("quotes_detected"),
            F.col("n_date").isNotNull().alias("timestamp_parsed"),
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("processed_at"),
            F.length("plain").cast("long").alias("original_length"),
            F.length(original).cast("long").alias("processed_length"),
        ).alias("processing_metadata"),
    )


def fingerprints(processed: DataFrame) -> DataFrame:
    return processed.select("id", "content_hash", "message_id")


def distinct_content(processed: DataFrame) -> DataFrame:
    """The first row of each content hash; hashes are combined before the join, which splits hot ones."""
    first = processed.groupBy("content_hash").agg(F.min("seq").alias("_first"))
    return processed.join(first, "content_hash").where(F.col("seq") == F.col("_first")).drop("_first")


def report(processed: DataFrame, parsed: DataFrame) -> DataFrame:
    """One row of counts and the rate."""
    m = F.col("processing_metadata")
    done = processed.agg(F.count(F.lit(1)).alias("ok"), F.count_if(m["quotes_detected"]).alias("quotes_detected"), F.count_if(m["html_stripped"]).alias("html_emails"))
    total = parsed.agg(F.count(F.lit(1)).alias("total_input"))
    rate = F.coalesce(F.round(F.col("ok") / F.nullif(F.col("total_input"), F.lit(0)), 6), F.lit(0.0))
    return total.crossJoin(done).select("total_input", F.col("ok").alias("successfully_processed"), (F.col("total_input") - F.col("ok")).alias("failed_processing"), rate.alias("success_rate"), "quotes_detected", "html_emails")
