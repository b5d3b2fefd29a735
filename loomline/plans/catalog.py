"""Registry of the message-analytics queries: name to Spark function, name to DuckDB SQL.

Each query applies operators to whole tables; SQL states the same result independently, over the
fields that the message view is made from where the query parses messages.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import mime
from loomline.functions import text as X
from loomline.operators import content, eda, parse, profile, sample, threads
from loomline.plans.fixtures import EMAILS_SQL as E
from loomline.plans.fixtures import emails, message_columns, multipart, raw_text, table
from loomline.sources import files, sinks
from loomline.sources.schemas import PARSED, RAW
from loomline.sources.tables import delete_at_exit, shared_path, written

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")


def _parsed(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    return parse.parse(emails(spark, sf_dir, **more))


LABELLED = "(SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
_FIELDS = ("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic")
_WS = r"[ \t\n\r\f\v]+"


def _sql_words(column: str = "text") -> str:
    out = f"lower(coalesce({column}, ''))"
    for label in X.HEADER_LABELS:
        out = rf"regexp_replace({out}, '{label}[^\n]*\n', '', 'g')"
    return rf"trim(regexp_replace(regexp_replace({out}, '[^a-zA-Z\s]', ' ', 'g'), '{_WS}', ' ', 'g'))"


_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)


def _sql_counts(by: str = "") -> str:
    pick = f"{by}, " if by else ""
    return f"SELECT {pick}word, count(*) AS n FROM (SELECT {pick}unnest(string_split({_sql_words()}, ' ')) AS word FROM documents) WHERE length(word) > 2 AND word NOT IN ({_STOP}) GROUP BY {pick}word"


# --- words and lengths ---------------------------------------------------------------------------------------


@query(f"SELECT * FROM ({_sql_counts()}) ORDER BY n DESC, word LIMIT 20")
def word_frequency(spark, sf_dir):
    return eda.word_frequency(_docs(spark, sf_dir), "text", 20)


@query(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM ({_sql_counts('lang')})) WHERE rank <= 5")
def top_words_by_lang(spark, sf_dir):
    return eda.top_words_by(_docs(spark, sf_dir), "text", "lang", 5)


_TOKENS = rf"CASE WHEN trim(text, E' \t\n\r\f\v') = '' THEN 0 ELSE len(regexp_split_to_array(trim(text, E' \t\n\r\f\v'), '{_WS}')) END"


def _sql_stats(c: str) -> str:
    return f"round(avg({c}), 6) AS {c}_mean, round(median({c}), 6) AS {c}_median, min({c}) AS {c}_min, max({c}) AS {c}_max, round(stddev_samp({c}), 6) AS {c}_std"


_STATS = f"SELECT {_sql_stats('chars')}, {_sql_stats('tokens')} FROM (SELECT length(text)::BIGINT AS chars, ({_TOKENS})::BIGINT AS tokens FROM documents)"


@query(_STATS)
def length_stats(spark, sf_dir):
    return eda.length_stats(_docs(spark, sf_dir), "text")


def _sql_histogram(value: str) -> str:
    return f"""
WITH x AS (SELECT ({value})::DOUBLE AS x FROM documents WHERE text IS NOT NULL), e AS (SELECT min(x) AS lo, max(x) AS hi FROM x),
b AS (SELECT CASE WHEN lo = hi THEN 1 ELSE least(floor((x - lo) * 50 / (hi - lo)) + 1, 50) END::BIGINT AS bin, count(*) AS n FROM x, e GROUP BY 1)
SELECT r.bin::BIGINT AS bin, coalesce(b.n, 0)::BIGINT AS n FROM range(1, 51) r(bin) LEFT JOIN b ON r.bin = b.bin"""


@query(_sql_histogram("length(text)"))
def length_histogram(spark, sf_dir):
    return eda.histogram(_docs(spark, sf_dir), X.n_chars(F.col("text")))


@query(_sql_histogram(_TOKENS))
def token_histogram(spark, sf_dir):
    return eda.histogram(_docs(spark, sf_dir), X.n_tokens(F.col("text")))


# --- sampling ------------------------------------------------------------------------------------------------


@query("SELECT * FROM documents ORDER BY md5('42:' || doc_id::VARCHAR), doc_id LIMIT 100")
def sample_exact(spark, sf_dir):
    return sample.sample_exact(_docs(spark, sf_dir), 100, key="doc_id")


@query("""
WITH s AS (SELECT * FROM documents ORDER BY md5('42:' || doc_id::VARCHAR), doc_id LIMIT 100), n AS (SELECT count(*) AS n_rows FROM s)
SELECT n_rows, n_rows = 100 AS size_ok, (SELECT count(*) FROM (DESCRIBE documents)) AS n_columns, (SELECT count(*) FROM (DESCRIBE documents)) = (SELECT count(*) FROM (DESCRIBE s)) AS columns_ok,
  (SELECT count(*) FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM documents)) AS extra_rows FROM n""")
def sample_verify(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return sample.verify_sample(sample.sample_exact(docs, 100, key="doc_id"), docs, 100)


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 5")
def head_rows(spark, sf_dir):
    return sample.head(_docs(spark, sf_dir), 5, "doc_id").select("doc_id", "lang")


@query("SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY n DESC, source LIMIT 10")
def top_sources(spark, sf_dir):
    return sample.top_values(_docs(spark, sf_dir), "source")


# --- profiling -----------------------------------------------------------------------------------------------


@query(f"SELECT count(*) AS n_rows, 7::BIGINT AS n_columns FROM {LABELLED}")
def table_shape(spark, sf_dir):
    return profile.shape(_labelled(spark, sf_dir))


@query(" UNION ALL ".join(f"SELECT '{c}' AS field_name, n_null FROM (SELECT count(*) - count({c}) AS n_null FROM {LABELLED}) WHERE n_null > 0" for c in _FIELDS))
def null_counts(spark, sf_dir):
    return profile.null_counts(_labelled(spark, sf_dir))


@query("SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS n_duplicate_rows FROM documents")
def duplicate_row_count(spark, sf_dir):
    return profile.duplicate_row_count(_docs(spark, sf_dir).select("text", "lang"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS field_name, round(avg(CASE WHEN {c} IS NULL THEN 0 ELSE 1 END) * 100, 6) AS completeness_percentage FROM {LABELLED}" for c in _FIELDS))
def field_completeness(spark, sf_dir):
    return profile.field_completeness(_labelled(spark, sf_dir))


_NULLS = " + ".join(f"({c} IS NULL)::INT" for c in _FIELDS)


@query(f"SELECT round((count(*) * 7 - sum({_NULLS})) / (count(*) * 7) * 100, 6) AS overall_completeness FROM {LABELLED}")
def overall_completeness(spark, sf_dir):
    return profile.overall_completeness(_labelled(spark, sf_dir))


@query("SELECT doc_id, lang FROM (SELECT *, count(*) OVER (PARTITION BY lang, text) AS c FROM documents) WHERE c > 1")
def duplicate_rows_keep_all(spark, sf_dir):
    return profile.duplicates(_docs(spark, sf_dir), "lang", "text").select("doc_id", "lang")


_ROW_NULLS = " + ".join(f"({c} IS NULL)::INT" for c in _FIELDS if c != "doc_id")


@query(f"SELECT doc_id AS email_index, ({_ROW_NULLS})::INT AS missing_field, false AS has_encoding_issues, count(*) OVER (PARTITION BY lang, text) > 1 AS is_duplicate FROM {LABELLED}")
def row_quality_metrics(spark, sf_dir):
    return profile.row_metrics(_labelled(spark, sf_dir), "doc_id", "text", ("lang", "text"))


@query(f"SELECT count(*) AS total_emails, 0::BIGINT AS num_encoding_issues, count(*) FILTER (WHERE c > 1) AS num_duplicates FROM (SELECT *, count(*) OVER (PARTITION BY lang, text) AS c FROM {LABELLED})")
def quality_summary(spark, sf_dir):
    return profile.summary(_labelled(spark, sf_dir), "doc_id", "text", ("lang", "text")).select("total_emails", "num_encoding_issues", "num_duplicates")


# --- parsing -------------------------------------------------------------------------------------------------

_BODY = rf"trim(concat(text, chr(10), quote), E' \t\n\r\f\v')"
# the modern header rules write dates anew, without comments
_WRITTEN = "regexp_replace(date, ' .UTC.$', '')"


def _sql_headers(date: str) -> str:
    return f"SELECT id, message_id, in_reply_to, sender AS \"from\", recipient AS \"to\", subject, {date} AS date, {_BODY} AS body_text FROM {E}"



@query(_sql_headers("date"))
def parse_headers_native(spark, sf_dir):
    return parse.parse_native(emails(spark, sf_dir)).select("id", "message_id", "in_reply_to", "from", "to", "subject", "date", "body_text")


@query(_sql_headers(_WRITTEN))
def parse_headers_mime(spark, sf_dir):
    h = F.col("headers")
    return _parsed(spark, sf_dir).select("id", *[h[c].alias(c) for c in ("message_id", "in_reply_to", "from", "to", "subject", "date")], "body_text")


@query(f"SELECT id, CASE WHEN turn > 0 THEN 8 ELSE 7 END::BIGINT AS n_headers, subject, '1.0' AS mime_version FROM {E}")
def parse_all_headers(spark, sf_dir):
    a = F.col("all_headers")
    return _parsed(spark, sf_dir).select("id", F.size(a).cast("long").alias("n_headers"), a["subject"].alias("subject"), a["mime-version"].alias("mime_version"))


@query(r"SELECT page_id::VARCHAR AS id, 'page ' || page_id || ' at ' || coalesce(url, '') AS body_text, trim(html, E' \t\n\r\f\v') AS body_html, true AS parsing_success FROM pages WHERE html IS NOT NULL")
def parse_multipart_bodies(spark, sf_dir):
    return parse.parse(multipart(spark, sf_dir)).select("id", "body_text", "body_html", "parsing_success")


_BAD = f"(SELECT *, seq % 50 <> 0 AS ok FROM {E})"


@query(f"SELECT count(*) AS total_emails, count(*) FILTER (WHERE ok) AS successful_parsing, count(*) FILTER (WHERE NOT ok) AS failed_parsing, round(count(*) FILTER (WHERE ok) / count(*), 4) AS success_rate FROM {_BAD}")
def parse_report(spark, sf_dir):
    return parse.report(_parsed(spark, sf_dir, bad_every=50))


@query(f"SELECT '{mime.NO_TEXT}' AS error, count(*) AS n FROM {_BAD} WHERE NOT ok HAVING count(*) > 0")
def parse_error_distribution(spark, sf_dir):
    return parse.error_distribution(_parsed(spark, sf_dir, bad_every=50))


@query(f"SELECT id, CASE WHEN ok THEN message_id END AS message_id, CASE WHEN ok THEN in_reply_to END AS in_reply_to, NULL::VARCHAR AS \"references\", CASE WHEN ok THEN subject END AS subject, CASE WHEN ok THEN sender END AS \"from\", CASE WHEN ok THEN {_WRITTEN} END AS date, 'box/' || id AS source_filename FROM {_BAD}")
def thread_hints(spark, sf_dir):
    return parse.thread_hints(_parsed(spark, sf_dir, bad_every=50))


@query(f"SELECT id, seq, CASE WHEN ok THEN sender ELSE 'Unknown' END AS sender, CASE WHEN ok THEN recipient ELSE 'Unknown' END AS recipient, CASE WHEN ok THEN subject ELSE 'No Subject' END AS subject, CASE WHEN ok THEN date ELSE '' END AS date_str FROM {_BAD}")
def message_metadata(spark, sf_dir):
    return parse.metadata(emails(spark, sf_dir, bad_every=50))


# --- headers, subjects, references ---------------------------------------------------------------------------

_BARE_SUBJECT = rf"lower(trim(regexp_replace(regexp_replace(trim(subject), '^(?i:re|fwd|fw):\s*', ''), '{_WS}', ' ', 'g')))"


@query(f"SELECT id, {_BARE_SUBJECT} AS normalized_subject FROM {E}")
def subject_normalize(spark, sf_dir):
    return parse.parse_native(emails(spark, sf_dir)).select("id", X.normalize_subject(F.col("subject")).alias("normalized_subject"))


@query(f"SELECT id, list_transform(range(0, turn), lambda t: 'c' || conv_id || '.' || t || '@ex.com')::VARCHAR AS reference_ids FROM {E}")
def references_list(spark, sf_dir):
    rows = parse.parse_native(emails(spark, sf_dir, refs=True))
    return rows.select("id", F.concat(F.lit("["), F.array_join(X.references(F.col("references")), ", "), F.lit("]")).alias("reference_ids"))


@query(f"SELECT id, lower(role) || ' <' || lower(role) || conv_id || '@ex.com>' AS sender, 'all' || conv_id || '@ex.com, Doe, Jo <jo' || turn || '@ex.com>' AS recipients FROM {E}")
def address_normalize(spark, sf_dir):
    rows = parse.parse_native(emails(spark, sf_dir))
    return rows.select("id", mime.address_col(F.col("from")).alias("sender"), mime.address_list_col(F.col("to")).alias("recipients"))


@query(f"SELECT id, iso AS iso_date, iso AS iso_native, strftime(timezone('UTC', iso::TIMESTAMPTZ), '%Y-%m-%d %H:%M:%S') AS utc FROM {E}")
def date_normalize(spark, sf_dir):
    rows = parse.parse_native(emails(spark, sf_dir))
    date = F.col("date")
    utc = F.date_format(F.to_utc_timestamp(X.date_timestamp(date), F.current_timezone()), "yyyy-MM-dd HH:mm:ss")
    return rows.select("id", mime.iso_date_col(date).alias("iso_date"), X.date_iso(date).alias("iso_native"), utc.alias("utc"))


# --- threads -------------------------------------------------------------------------------------------------


def _records(spark, sf_dir, refs=False):
    return threads.reference_records(_parsed(spark, sf_dir, refs=refs))


@query(f"SELECT 'c' || conv_id || '.' || turn || '@ex.com' AS message_id, seq AS first_seq, subject, {_BARE_SUBJECT} AS normalized_subject FROM {E}")
def thread_nodes(spark, sf_dir):
    return threads.nodes(_records(spark, sf_dir)).select("message_id", "first_seq", "subject", "normalized_subject")


@query(f"SELECT 'c' || a.conv_id || '.' || b.turn || '@ex.com' AS src, 'c' || a.conv_id || '.' || a.turn || '@ex.com' AS dst, 'reference' AS relationship FROM {E} a JOIN {E} b ON a.conv_id = b.conv_id AND b.turn < a.turn")
def thread_edges(spark, sf_dir):
    records = written(_records(spark, sf_dir, refs=True), "records")
    return threads.edges(records, threads.nodes(records))


@query(f"SELECT 'c' || conv_id || '.0@ex.com' AS message_id, seq AS first_seq FROM {E} WHERE turn = 0")
def thread_roots(spark, sf_dir):
    records = written(_records(spark, sf_dir), "records")
    nodes = threads.nodes(records)
    return threads.roots(nodes, threads.edges(records, nodes))


def _sql_threads(depth: str) -> str:
    return f"""
SELECT format('thread_{{:04d}}', row_number() OVER (ORDER BY conv_id)) AS thread_id, 'c' || conv_id || '.0@ex.com' AS root_message_id, count(*) AS message_count,
  '[' || string_agg('c' || conv_id || '.' || turn || '@ex.com', ', ' ORDER BY turn) || ']' AS message_ids, {depth}::BIGINT AS thread_depth, count(DISTINCT sender) AS n_participants,
  count(DISTINCT subject) AS n_subjects, min(iso::TIMESTAMPTZ) IS NOT NULL AS has_dates, 'topic ' || conv_id AS normalized_subject
FROM {E} GROUP BY conv_id"""


def _shown(t: DataFrame) -> DataFrame:
    return t.select(
        "thread_id", "root_message_id", "message_count", F.concat(F.lit("["), F.array_join("message_ids", ", "), F.lit("]")).alias("message_ids"), "thread_depth",
        F.size("participants").cast("long").alias("n_participants"), F.size("subject_variants").cast("long").alias("n_subjects"), F.col("date_range.start").isNotNull().alias("has_dates"), "normalized_subject",
    )


@query(_sql_threads("max(turn)"))
def thread_summary(spark, sf_dir):
    return _shown(threads.threads(_records(spark, sf_dir)))


@query(_sql_threads("least(max(turn), 1)"))
def thread_summary_fullrefs(spark, sf_dir):
    return _shown(threads.threads(_records(spark, sf_dir, refs=True)))


_PER_THREAD = f"(SELECT conv_id, count(*) AS n, max(turn) AS d, count(DISTINCT sender) AS p FROM {E} GROUP BY conv_id)"


@query(f"SELECT count(*) AS total_threads, sum(n)::BIGINT AS total_messages_threaded, round(avg(n), 6) AS avg_messages_per_thread, max(d) AS max_thread_depth, round(avg(d), 6) AS avg_thread_depth, round(avg(p), 6) AS avg_participants_per_thread, count(*) FILTER (WHERE n = 1) AS single_message_threads, count(*) FILTER (WHERE n >= 5) AS complex_threads FROM {_PER_THREAD}")
def thread_quality_metrics(spark, sf_dir):
    return threads.quality_metrics(threads.threads(_records(spark, sf_dir)))


@query("SELECT count(*) AS input_emails, count(DISTINCT conv_id) AS output_threads, round(count(*) / count(DISTINCT conv_id), 6) AS threading_efficiency, count(*) AS distinct_messages_threaded, 0::BIGINT AS dropped_messages FROM conversations")
def thread_report(spark, sf_dir):
    records = written(_records(spark, sf_dir), "records")
    return threads.summary(threads.threads(records), records)


# --- content -------------------------------------------------------------------------------------------------


def _sql_clean(x: str) -> str:
    one = rf"trim(regexp_replace(l, '{_WS}', ' ', 'g'))"
    return f"array_to_string(list_filter(list_transform(string_split({x}, chr(10)), lambda l: {one}), lambda l: l <> ''), chr(10))"


@query(f"SELECT doc_id, {_sql_clean('text')} AS clean FROM documents")
def clean_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.clean_text(F.col("text")).alias("clean"))


def _sql_html(x: str) -> str:
    out = rf"regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"
    for tag in ("script", "style"):
        out = rf"regexp_replace({out}, '(?is)<{tag}[^>]*>.*?</{tag}>', '', 'g')"
    out = rf"regexp_replace(regexp_replace({out}, '(?i)<br\s*/?>|</?p(?:\s[^>]*)?>', chr(10), 'g'), '<[^>]*>', '', 'g')"
    for name, value in X.ENTITIES.items():
        v = value.replace("'", "''")
        out = f"replace({out}, '&{name};', '{v}')"
    return out


@query(f"SELECT page_id, {_sql_clean(_sql_html('html'))} AS plain FROM pages")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.html_to_text(F.col("html")).alias("plain"))


@query(f"SELECT page_id, {_sql_clean(_sql_html('html'))} <> '' AS has_text FROM pages")
def html_to_text_parser(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", (X.clean_text(mime.html_text_col(F.col("html"))) != "").alias("has_text"))


_ORIGINAL, _QUOTED = _sql_clean("text"), f"trim({_sql_clean('quote')})"


@query(f"SELECT id, {_ORIGINAL} AS original, {_QUOTED} AS quoted FROM {E}")
def quote_split(spark, sf_dir):
    rows = parse.parse_native(emails(spark, sf_dir)).select("id", X.quote_split(X.clean_text(F.col("body_text"))).alias("q"))
    return rows.select("id", "q.original", "q.quoted")


_FROM = "lower(role) || ' <' || lower(role) || conv_id || '@ex.com>'"
_TO = "'all' || conv_id || '@ex.com, doe, jo <jo' || turn || '@ex.com>'"
_HASH = f"sha256({_FROM} || '|' || {_TO} || '|' || trim(subject) || '|' || {_ORIGINAL} || '|' || iso)"


@query(f"SELECT id, message_id, {_FROM} AS \"from\", iso AS date, subject, {_ORIGINAL} AS body_original, {_QUOTED} AS body_quoted, {_HASH} AS content_hash, 'box/' || id AS source_filename, turn > 0 AS quotes_detected, length({_ORIGINAL})::BIGINT AS processed_length FROM {E} WHERE {_ORIGINAL} || quote <> ''")
def content_records(spark, sf_dir):
    m = F.col("processing_metadata")
    done = content.process(_parsed(spark, sf_dir))
    return done.select("id", "message_id", "from", "date", "subject", "body_original", "body_quoted", "content_hash", "source_filename", m["quotes_detected"].alias("quotes_detected"), m["processed_length"].alias("processed_length"))


@query(f"SELECT doc_id, sha256(lower(source) || '||' || lang || '|' || trim(text, E' \\t\\n\\r\\f\\v') || '|') AS content_hash FROM documents")
def content_fingerprint(spark, sf_dir):
    c = F.col
    return _docs(spark, sf_dir).select("doc_id", X.content_hash(c("source"), F.lit(None).cast("string"), c("lang"), c("text"), F.lit(None).cast("string")).alias("content_hash"))


@query("SELECT min(doc_id) AS seq, sha256('|||' || trim(text, E' \\t\\n\\r\\f\\v') || '|') AS content_hash FROM documents GROUP BY 2")
def content_dedup(spark, sf_dir):
    none = F.lit(None).cast("string")
    hashed = _docs(spark, sf_dir).select(F.col("doc_id").alias("seq"), X.content_hash(none, none, none, F.col("text"), none).alias("content_hash"))
    return content.distinct_content(hashed)


_HAS_BODY = f"{_ORIGINAL} || quote <> ''"


@query(f"SELECT count(*) AS total_input, count(*) FILTER (WHERE {_HAS_BODY}) AS successfully_processed, count(*) FILTER (WHERE NOT ({_HAS_BODY})) AS failed_processing, round(count(*) FILTER (WHERE {_HAS_BODY}) / count(*), 6) AS success_rate, count(*) FILTER (WHERE turn > 0) AS quotes_detected, 0::BIGINT AS html_emails FROM {E}")
def content_stats(spark, sf_dir):
    parsed = written(_parsed(spark, sf_dir), "parsed")
    return content.report(content.process(parsed), parsed)


_CAP = """
WITH r AS (SELECT event_id AS seq, event_id % 7 = 3 AS failed, floor(event_id / 100)::BIGINT AS b FROM events),
x AS (SELECT *, sum(failed::INT) OVER (ORDER BY seq) AS g, sum(failed::INT) OVER (PARTITION BY b ORDER BY seq) AS k FROM r),
s AS (SELECT min(b) AS stop FROM x WHERE g > 50)
SELECT seq FROM x, s WHERE NOT failed AND (stop IS NULL OR b < stop OR (b = stop AND g <= 50) OR (b > stop AND k = 0))"""


@query(_CAP)
def error_cap(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), (F.col("event_id") % 7 == 3).alias("failed"))
    return content.capped(rows, 50).select("seq")


# --- correspondents and times --------------------------------------------------------------------------------


@query(f"SELECT sender, count(*) AS n FROM {E} GROUP BY sender ORDER BY n DESC, sender LIMIT 10")
def sender_counts(spark, sf_dir):
    return sample.top_values(parse.metadata(emails(spark, sf_dir)), "sender")


@query(f"SELECT recipient, count(*) AS n FROM {E} GROUP BY recipient ORDER BY n DESC, recipient LIMIT 10")
def recipient_counts(spark, sf_dir):
    return sample.top_values(parse.metadata(emails(spark, sf_dir)), "recipient")


@query(f"SELECT count(DISTINCT sender) AS n_sender, count(DISTINCT recipient) AS n_recipient FROM {E}")
def distinct_counts(spark, sf_dir):
    return eda.distinct_counts(parse.metadata(emails(spark, sf_dir)), "sender", "recipient")


@query("SELECT source, CASE WHEN length(t) > 30 THEN substr(t, 1, 30) || '...' ELSE t END AS label FROM (SELECT source, min(text) AS t FROM documents GROUP BY source)")
def truncated_labels(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("source").agg(F.min("text").alias("t")).select("source", X.truncated(F.col("t")).alias("label"))


def _times(spark, sf_dir):
    return eda.with_times(table(spark, sf_dir, "events"), F.col("ts"))


@query("SELECT hour(ts)::BIGINT AS hour, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1")
def hourly_activity(spark, sf_dir):
    return eda.hour_counts(_times(spark, sf_dir))


_DAYS = "(VALUES " + ", ".join(f"({i}, '{d}')" for i, d in enumerate(eda.WEEKDAYS)) + ") d(day_no, weekday)"


@query(f"SELECT d.day_no::BIGINT AS day_no, d.weekday, coalesce(e.n, 0)::BIGINT AS n FROM {_DAYS} LEFT JOIN (SELECT dayname(ts) AS weekday, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1) e ON d.weekday = e.weekday")
def weekday_activity(spark, sf_dir):
    return eda.weekday_counts(_times(spark, sf_dir))


@query("SELECT ts::DATE AS date_only, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1")
def daily_activity(spark, sf_dir):
    return eda.day_counts(_times(spark, sf_dir))


_PEAK = "(SELECT {0} FROM events WHERE ts IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query(f"SELECT {_PEAK.format('hour(ts)::BIGINT')} AS peak_hour, {_PEAK.format('dayname(ts)')} AS peak_weekday")
def peak_activity(spark, sf_dir):
    return eda.peaks(_times(spark, sf_dir))


_RANGE = "SELECT strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day FROM events"


@query(_RANGE)
def date_range(spark, sf_dir):
    return eda.date_range(_times(spark, sf_dir))


_SHARE = "(SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM events WHERE {0} IS NOT NULL GROUP BY {0} ORDER BY n DESC, {0} LIMIT 10))"


@query(f"SELECT {_SHARE.format('user_id')} AS top_user_id_rows")
def top_user_share(spark, sf_dir):
    return eda.top_share(table(spark, sf_dir, "events"), "user_id")


@query(f"""
SELECT (SELECT count(*) FROM documents) AS n_messages, s.*, w.word AS top_word, w.n AS top_word_n,
  (SELECT count(DISTINCT user_id) FROM events WHERE ts IS NOT NULL) AS n_user_id, (SELECT count(DISTINCT event_type) FROM events WHERE ts IS NOT NULL) AS n_event_type,
  {_SHARE.format('user_id')} AS top_user_id_rows, {_SHARE.format('event_type')} AS top_event_type_rows,
  {_PEAK.format('hour(ts)::BIGINT')} AS peak_hour, {_PEAK.format('dayname(ts)')} AS peak_weekday, r.*
FROM ({_STATS}) s, (SELECT * FROM ({_sql_counts()}) ORDER BY n DESC, word LIMIT 1) w, ({_RANGE}) r""")
def eda_summary(spark, sf_dir):
    return eda.summary(_docs(spark, sf_dir), "text", _times(spark, sf_dir), "user_id", "event_type")


# --- dates as they are written -------------------------------------------------------------------------------

#: Forms by event_id % 8: (pattern of Spark, what follows, format of ISO in DuckDB, offset in minutes or none).
_FORMS = (
    ("EEE, d MMM yyyy HH:mm:ss", " GMT", "%Y-%m-%dT%H:%M:%S", "+00:00", 0),
    ("d MMM yyyy HH:mm", " EST", "%Y-%m-%dT%H:%M:00", "-05:00", -300),
    ("EEE, d MMM yy HH:mm:ss", " +0530", "%Y-%m-%dT%H:%M:%S", "+05:30", 330),
    ("d MMM yyyy HH:mm:ss", "", "%Y-%m-%dT%H:%M:%S", "", 0),
    ("EEE, dd MMM yyyy HH:mm:ss", " -0000", "%Y-%m-%dT%H:%M:%S", "", 0),
    ("d MMM yy HH:mm", " PDT", "%Y-%m-%dT%H:%M:00", "-07:00", -420),
    ("EEE, d MMM yyyy H:mm:ss", " -0730 (XYZ)", "%Y-%m-%dT%H:%M:%S", "-07:30", -450),
)


def _case(value) -> str:
    return "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN {value(*form)}" for i, form in enumerate(_FORMS)) + " END"


@query(f"SELECT event_id, {_case(lambda p, z, iso, o, m: f"strftime(ts, '{iso}') || '{o}'")} AS iso, {_case(lambda p, z, iso, o, m: f"strftime(strptime(strftime(ts, '{iso}'), '%Y-%m-%dT%H:%M:%S') - to_minutes({m}), '%Y-%m-%d %H:%M:%S')")} AS utc FROM events WHERE ts IS NOT NULL")
def date_forms(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("ts is not null")
    form = F.lit("Thu, 99 Jam 2024, soon")
    for i, (pattern, zone, *_) in enumerate(_FORMS):
        form = F.when(F.col("event_id") % 8 == i, F.concat(F.date_format("ts", pattern), F.lit(zone))).otherwise(form)
    utc = F.date_format(F.to_utc_timestamp(X.date_timestamp(F.col("date")), F.current_timezone()), "yyyy-MM-dd HH:mm:ss")
    return rows.select("event_id", form.alias("date")).select("event_id", X.date_iso(F.col("date")).alias("iso"), utc.alias("utc"))


# --- sources and sinks ---------------------------------------------------------------------------------------


def _path(spark: SparkSession, name: str) -> str:
    return shared_path(spark, name)


@query("SELECT doc_id::VARCHAR AS file, text AS message FROM documents")
def csv_round_trip(spark, sf_dir):
    docs = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("file"), F.col("text").alias("message"))
    path = sinks.write_csv(docs, _path(spark, "round-trip.csv"))
    delete_at_exit(spark, path)
    return files.read_csv(spark, path, na=False)


_RAW = raw_text(message_columns())


@query(f"SELECT (row_number() OVER (ORDER BY seq) - 1)::VARCHAR AS id, 'box/' || id AS filename, md5({_RAW}) AS digest FROM (SELECT *, '' AS refs FROM {E})")
def csv_messages(spark, sf_dir):
    # ranges in order, a file each: no task sees all messages
    raw = emails(spark, sf_dir).repartitionByRange("seq").sortWithinPartitions("seq").select(F.col("filename").alias("file"), F.col("raw_text").alias("message"))
    path = sinks.write_csv(raw, _path(spark, "messages.csv"))
    delete_at_exit(spark, path)
    return files.load_messages(spark, path).select("id", "filename", F.md5("raw_text").alias("digest"))


@query("SELECT 'f' || event_id AS file, CASE WHEN event_id % 5 > 2 THEN 'm' || event_id || ', \"' || event_type || '\"' END AS message FROM events WHERE event_id % 5 > 0")
def csv_odd_rows(spark, sf_dir):
    """Rows of too many fields, of too few, and with a mark for a missing value."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 5
    name = F.concat(F.lit("f"), F.col("event_id"))
    whole = F.concat(name, F.lit(',"m'), F.col("event_id"), F.lit(', ""'), F.col("event_type"), F.lit('"""'))
    line = F.when(k == 0, F.concat(name, F.lit(",a,b"))).when(k == 1, name).when(k == 2, F.concat(name, F.lit(",NA"))).otherwise(whole)
    path = sinks.write_lines(e, _path(spark, "odd.csv"), "file,message", line)
    delete_at_exit(spark, path)
    return files.read_csv(spark, path, RAW)


@query(f"SELECT id, message_id, subject, {_BODY} AS body_text, true AS parsing_success FROM {E}")
def jsonl_round_trip(spark, sf_dir):
    path = sinks.write_jsonl(_parsed(spark, sf_dir), _path(spark, "parsed.jsonl"))
    delete_at_exit(spark, path)
    h = F.col("headers")
    return files.read_jsonl(spark, path).select("id", h["message_id"].alias("message_id"), h["subject"].alias("subject"), "body_text", "parsing_success")


@query("SELECT count(*) FILTER (WHERE event_id % 4 > 1) AS n_read, count(*) FILTER (WHERE event_id % 4 <= 1) AS n_bad FROM events")
def jsonl_bad_lines(spark, sf_dir):
    """Broken and blank lines are skipped, and counted."""
    k, name = F.col("event_id") % 4, F.col("event_id").cast("string")
    line = F.when(k == 0, F.lit(" ")).when(k == 1, F.concat(F.lit('{"id": "'), name)).otherwise(F.concat(F.lit('{"id": "'), name, F.lit('", "body_text": "x", "parsing_success": true}')))
    path = _path(spark, "odd.jsonl")
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    delete_at_exit(spark, path)
    read = files.read_jsonl(spark, path, PARSED).agg(F.count("id").alias("n_read"))
    return read.withColumn("n_bad", F.lit(files.count_bad_lines(spark, path, PARSED)).cast("long"))


@query("SELECT true AS all_written, count(*) AS n_messages FROM conversations")
def outputs_validated(spark, sf_dir):
    path = sinks.write_report(parse.full_report(parse.parse(emails(spark, sf_dir), only=("parsing_success", "error"))), _path(spark, "report.json"))
    delete_at_exit(spark, path)
    found = sinks.validate_outputs(spark, path)
    missing = sinks.validate_outputs(spark, f"{path}-missing")
    return spark.read.json(path).select(F.lit(all(found.values()) and not any(missing.values())).alias("all_written"), F.col("total_emails").cast("long").alias("n_messages"))


# --- graphs that mail archives have --------------------------------------------------------------------------

#: By event_id % 10: the message's id, what it replies to, what it refers to. 2 replies to itself, 3 and 4 to each other, 5 to a
#: message that isn't there, 6 has two roots, 7 has the id of 1.
_ODD_REPLY = {1: 0, 2: 2, 3: 4, 4: 3, 5: 99, 6: 0, 7: 6, 9: 8}
_ODD_REFS = {6: (5, 0, 6)}


def _odd_records(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    group, k = F.floor(F.col("event_id") / 10).cast("long").cast("string"), F.col("event_id") % 10
    name = lambda x: F.concat(F.lit("g"), group, F.lit("."), x.cast("string"))
    pick = lambda table_, default: reduce(lambda c, kv: F.when(k == kv[0], kv[1]).otherwise(c), table_, default)
    reply = pick([(a, name(F.lit(b))) for a, b in _ODD_REPLY.items()], F.lit(""))
    refs = pick([(a, F.array(*[name(F.lit(b)) for b in bs])) for a, bs in _ODD_REFS.items()], F.array().cast("array<string>"))
    return e.select(
        F.col("event_id").alias("seq"), name(F.when(k == 7, F.lit(1)).otherwise(k)).alias("message_id"), reply.alias("in_reply_to"), refs.alias("references"),
        F.concat(F.lit("S"), k.cast("string")).alias("subject"), F.concat(F.lit("s"), k.cast("string")).alias("normalized_subject"), F.lit(None).cast("string").alias("date"), F.concat(F.lit("u"), k.cast("string")).alias("from"),
    )


_ODD_SQL = f"""
r AS (SELECT event_id AS seq, 'g' || event_id // 10 || '.' AS g, event_id % 10 AS k FROM events),
rec AS (SELECT seq, g || CASE k WHEN 7 THEN 1 ELSE k END AS m, CASE k {' '.join(f"WHEN {a} THEN g || {b}" for a, b in _ODD_REPLY.items())} ELSE '' END AS reply,
  CASE k {' '.join(f"WHEN {a} THEN [{', '.join(f'g || {b}' for b in bs)}]" for a, bs in _ODD_REFS.items())} ELSE [] END AS refs FROM r),
n AS (SELECT m, min(seq) AS first_seq FROM rec GROUP BY m),
x AS (SELECT reply AS src, m AS dst, 'reply' AS relationship, 0 AS phase, seq FROM rec UNION ALL
  SELECT src, m, 'reference', 1, seq FROM (SELECT unnest(refs) AS src, m, seq FROM rec) WHERE src <> m),
e AS (SELECT src, dst, arg_max(relationship, seq * 10 + phase) AS relationship FROM x WHERE src IN (SELECT m FROM n) GROUP BY src, dst),
roots AS (SELECT * FROM n WHERE m NOT IN (SELECT dst FROM e))"""


@query(f"WITH {_ODD_SQL} SELECT src, dst, relationship FROM e")
def thread_odd_edges(spark, sf_dir):
    records = written(_odd_records(spark, sf_dir), "records")
    return threads.edges(records, threads.nodes(records))


@query(f"""
WITH RECURSIVE {_ODD_SQL},
walk AS (SELECT m AS root, m AS node, 0 AS depth FROM roots UNION SELECT root, dst, depth + 1 FROM walk JOIN e ON node = src WHERE src <> dst AND depth < 12),
reached AS (SELECT root, node, min(depth) AS depth FROM walk GROUP BY root, node),
numbered AS (SELECT m, format('thread_{{:04d}}', row_number() OVER (ORDER BY first_seq, m)) AS thread_id FROM roots)
SELECT thread_id, root AS root_message_id, count(*) AS message_count, string_agg(node, ', ' ORDER BY first_seq) AS message_ids, max(depth)::BIGINT AS thread_depth
FROM reached JOIN n ON node = n.m JOIN numbered ON root = numbered.m GROUP BY thread_id, root""")
def thread_odd_graphs(spark, sf_dir):
    found = threads.threads(_odd_records(spark, sf_dir))
    return found.select("thread_id", "root_message_id", "message_count", F.array_join("message_ids", ", ").alias("message_ids"), "thread_depth")


@query(f"WITH {_ODD_SQL} SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM roots) AS n_roots, (SELECT count(*) FROM n WHERE m IN (SELECT src FROM e WHERE src = dst)) AS n_self_replies")
def thread_odd_nodes(spark, sf_dir):
    records = written(_odd_records(spark, sf_dir), "records")
    n = written(threads.nodes(records), "nodes")
    e = written(threads.edges(records, n), "edges")
    return n.agg(F.count(F.lit(1)).alias("n_nodes")).crossJoin(threads.roots(n, e).agg(F.count(F.lit(1)).alias("n_roots"))).crossJoin(e.agg(F.count_if(F.col("src") == F.col("dst")).alias("n_self_replies")))


# --- literal behaviour, and flags that are set ----------------------------------------------------------------


def _without_subject(spark, sf_dir):
    raw = emails(spark, sf_dir)
    return raw.withColumn("raw_text", F.when(F.col("seq") % 3 == 0, F.regexp_replace("raw_text", "Subject: [^\n]*\n", "")).otherwise(F.col("raw_text")))


@query(f"SELECT id, CASE WHEN seq % 3 = 0 THEN '' ELSE 'c' || conv_id || '.' || turn END AS message, CASE WHEN seq % 3 = 0 THEN '' ELSE {_FROM} END AS sender, CASE WHEN seq % 3 <> 0 THEN iso END AS date FROM {E}")
def compat_blank_headers(spark, sf_dir):
    """A missing subject blanks the other headers too."""
    rows = content.normalized_headers(parse.parse(_without_subject(spark, sf_dir)), compat=True)
    return rows.select("id", F.regexp_extract("n_message_id", "<(.*)@", 1).alias("message"), F.col("n_from").alias("sender"), F.col("n_date").alias("date"))


@query(f"SELECT id, 'c' || conv_id || '.' || turn AS message, {_FROM} AS sender, iso AS date FROM {E}")
def kept_headers(spark, sf_dir):
    """Without compat they stay."""
    rows = content.normalized_headers(parse.parse(_without_subject(spark, sf_dir)))
    return rows.select("id", F.regexp_extract("n_message_id", "<(.*)@", 1).alias("message"), F.col("n_from").alias("sender"), F.col("n_date").alias("date"))


@query(f"SELECT '{mime.NO_TEXT}' AS error, least(10, count(*))::BIGINT AS n FROM {_BAD} WHERE NOT ok HAVING count(*) > 0")
def compat_first_errors(spark, sf_dir):
    return parse.error_distribution(_parsed(spark, sf_dir, bad_every=50), compat=True)


@query("SELECT event_id, event_id % 4 = 0 AS has_encoding_issues FROM events")
def encoding_flags(spark, sf_dir):
    """Bytes that aren't UTF-8, others that are, and missing ones."""
    k = F.col("event_id") % 4
    data = F.when(k == 0, F.unhex(F.lit("41FF42"))).when(k == 1, F.encode(F.lit("é"), "utf-8")).when(k == 3, F.encode(F.lit("abc"), "utf-8"))
    return table(spark, sf_dir, "events").select("event_id", profile.bad_encoding(data).alias("has_encoding_issues"))
