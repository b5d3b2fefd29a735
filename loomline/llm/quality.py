"""Quality rules: a threshold table compiled into one Spark projection.

The measures of a text (lengths, symbols, stop words, lines, repeated five-word windows) and
every threshold of the table become columns of a single projection of built-in functions; no
user function runs and nothing is shuffled, so it scales with the scan. Work per text is
O(n log n) at most: repeated windows are found by 64-bit hashes of the windows, compared as
hashes first and sorted only in texts that hold a repeat.

The table rejects no language by kind. Stop words have an upper bound alone, for texts of hardly anything but
stop words: a lower one would reject every language that the list doesn't know. Words may be long where
under half of a text's word characters are ASCII letters, as scripts without spaces have long ones.
Length has no upper bound.

Defined results: a null text counts as a text without words, so it fails the base rule; rows
that repeat are judged each on its own; an empty table gives an empty table. Only doc_id and
text are read by ``quality``; ``keep_good`` returns all columns of its input unchanged, and
its own working columns live in one struct whose name cannot clash.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import SPACE, SPACE_CHARS

#: Frequent function words of the four languages of the tables.
STOP_WORDS = (
    "the of and to in is that it for on with as by at this be are from or an "
    "der die das und zu den von mit ist für auf ein eine im dem nicht des sich "
    "le la les de un une en du que qui au pour par sur dans est pas et "
    "el los las y una por con para del se es al lo"
).split()
SYMBOLS = "#*$%&|<>"
ASCII_LETTERS = string.ascii_letters
WINDOW = 5


@dataclass(frozen=True)
class Threshold:
    """A measure must lie in [low, high]; texts of fewer than min_words, or with a smaller part of ASCII letters than min_ascii, are exempt."""

    measure: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0
    min_ascii: float = 0.0


#: The production table: measures are ratios of the columns of measures().
TABLE = (
    Threshold("mean_word_chars", low=2.0, high=15.0, min_ascii=0.5),
    Threshold("symbols_per_word", high=0.3),
    Threshold("stop_word_ratio", high=0.8, min_words=20),
    Threshold("dup_line_ratio", high=0.5, min_words=20),
)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _n_repeat_words(words: Column) -> Column:
    """Words that lie in a five-word window found twice or more."""

    def of_hashes(hashes: Column) -> Column:
        def of_sorted(rows: Column) -> Column:
            twin = lambda r, i: ((i > 0) & (F.get(rows, i - 1)["h"] == r["h"])) | ((i < F.size(rows) - 1) & (F.get(rows, i + 1)["h"] == r["h"]))
            starts = F.sort_array(F.transform(F.filter(rows, twin), lambda r: r["at"]))

            def covered(at: Column) -> Column:
                # each start covers its window up to the next start
                gaps = F.transform(at, lambda a, i: F.when(i == F.size(at) - 1, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), F.get(at, i + 1) - a)))
                return F.aggregate(gaps, F.lit(0), lambda s, x: s + x)

            return _let(starts, covered)

        rows = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(rows, of_sorted))

    def of_words(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
        return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(_let(windows, of_hashes))

    return _let(words, of_words)


def _n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    return F.when(F.instr(text, "\n") == 0, F.lit(0)).otherwise(_let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))))


def measures(text: Column) -> Column:
    """Struct of the counts of a text; a null text has no words."""
    text = F.coalesce(text, F.lit(""))
    bare = F.btrim(text, F.lit(SPACE_CHARS))

    def counted(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(text, SPACE_CHARS, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            _n_dup_lines(text).cast("long").alias("n_dup_lines"),
            _n_repeat_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            (F.length(text) - F.length(F.translate(text, ASCII_LETTERS, ""))).cast("long").alias("n_ascii"),
            (F.length(text) - F.length(F.translate(text, "\n", "")) + 1).cast("long").alias("n_lines"),
        )

    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE + "+"))
    return _let(words, counted)


def ratios(m: Column) -> dict[str, Column]:
    n = F.greatest(m["n_words"], F.lit(1)).cast("double")
    return {
        "mean_word_chars": m["word_chars"] / n,
        "symbols_per_word": m["n_symbols"] / n,
        "stop_word_ratio": m["n_stop_words"] / n,
        "dup_line_ratio": m["n_dup_lines"] / F.greatest(m["n_lines"], F.lit(1)).cast("double"),
        "ascii_ratio": m["n_ascii"] / F.greatest(m["word_chars"], F.lit(1)).cast("double"),
    }


def verdict(m: Column, table=TABLE) -> Column:
    """True where a text passes every threshold of the table."""
    value = ratios(m)
    passes = F.lit(True)
    for t in table:
        inside = F.lit(True)
        if t.low is not None:
            inside &= value[t.measure] >= t.low
        if t.high is not None:
            inside &= value[t.measure] <= t.high
        passes &= inside | (m["n_words"] < t.min_words) | (value["ascii_ratio"] < t.min_ascii)
    return passes


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def quality(docs: DataFrame, table=TABLE) -> DataFrame:
    """One row per row of docs: doc_id, the counts, base_failed and kept."""
    m = F.col("m")
    return docs.select("doc_id", measures(F.col("text")).alias("m")).select(
        "doc_id",
        *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed(m).alias("base_failed"),
        (~base_failed(m) & verdict(m, table)).alias("kept"),
    )


def keep_good(docs: DataFrame, table=TABLE) -> DataFrame:
    """The rows of docs whose text passes the base rule and the table."""
    good = _let(measures(docs["text"]), lambda m: ~base_failed(m) & verdict(m, table))
    return docs.where(good)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_table(table=TABLE) -> str:
    n = "greatest(n_words, 1)::DOUBLE"
    value = {
        "mean_word_chars": f"word_chars / {n}",
        "symbols_per_word": f"n_symbols / {n}",
        "stop_word_ratio": f"n_stop_words / {n}",
        "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)::DOUBLE",
        "ascii_ratio": "n_ascii / greatest(word_chars, 1)::DOUBLE",
    }
    rules = []
    for t in table:
        bounds = [f"{value[t.measure]} >= {t.low}"] * (t.low is not None) + [f"{value[t.measure]} <= {t.high}"] * (t.high is not None)
        rules.append(f"(({' AND '.join(bounds)}) OR n_words < {t.min_words} OR {value['ascii_ratio']} < {t.min_ascii})")
    return " AND ".join(rules)


def oracle_measures(source: str) -> str:
    """DuckDB SELECT of doc_id, the measures and verdicts of the rows of source, with all its columns as d."""
    stop = ", ".join(f"'{x}'" for x in STOP_WORDS)
    return rf"""
WITH base AS (SELECT d, d.doc_id AS doc_id, coalesce(d.text, '') AS t FROM {source} d),
worded AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM base),
windowed AS (
  SELECT *, CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) ELSE [] END AS win FROM worded),
numbered AS (SELECT row_number() OVER () AS rid, * FROM windowed),
starts AS (
  SELECT rid, s, count(*) OVER (PARTITION BY rid, x) AS c FROM (
    SELECT rid, unnest(win) AS x, unnest(range(1, len(win) + 1)) AS s FROM numbered)),
covered AS (
  SELECT rid, count(DISTINCT s + k) AS n FROM starts, range(0, 5) r(k) WHERE c > 1 GROUP BY rid),
counted AS (
  SELECT d, doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
     - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(w, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words,
    (length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')))::BIGINT AS n_ascii, len(string_split(t, chr(10)))::BIGINT AS n_lines
  FROM numbered LEFT JOIN covered USING (rid)),
judged AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM counted)
SELECT *, (NOT base_failed AND {_sql_table()}) AS kept FROM judged"""


QUERIES = {"op6_quality_rules": op6_quality_rules}
SQL = {
    "op6_quality_rules": f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM ({oracle_measures('documents')})"
}
