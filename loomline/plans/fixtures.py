"""Message tables made from the test tables, by expressions that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PREFIX = ("", "Re: ", "FW: ", "fwd: ", "RE:", "Re: Re: ")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def message_columns(refs: bool = False) -> dict[str, str]:
    """SQL of each field of the message view over (conv_id, turn, role, text, prior), valid in Spark and DuckDB."""
    number = "cast(conv_id as string)"
    day = "lpad(cast(1 + conv_id % 28 as string), 2, '0')"
    clock = "concat(lpad(cast((conv_id * 7 + turn) % 24 as string), 2, '0'), ':', lpad(cast(turn % 60 as string), 2, '0'), ':00')"
    weekday = "substr('MonTueWedThuFriSatSun', cast(1 + 3 * (conv_id % 28 % 7) as int), 3)"
    prefix = "case turn % 6 " + " ".join(f"when {i} then '{p}'" for i, p in enumerate(_PREFIX)) + " end"
    return {
        "id": f"concat({number}, '.', cast(turn as string))",
        "message_id": f"concat('<c', {number}, '.', cast(turn as string), '@ex.com>')",
        "in_reply_to": f"case when turn > 0 then concat('<c', {number}, '.', cast(turn - 1 as string), '@ex.com>') end",
        "sender": f"concat(role, ' <', upper(role), {number}, '@Ex.com>')",
        "recipient": f"concat('all', {number}, '@Ex.com, \"Doe, Jo\" <JO', cast(turn as string), '@ex.com>')",
        "subject": f"concat({prefix}, 'Topic  ', {number})",
        "date": f"concat({weekday}, ', ', {day}, ' Jan 2024 ', {clock}, case when turn % 2 = 0 then ' +0000 (UTC)' else ' -0730' end)",
        "iso": f"concat('2024-01-', {day}, 'T', {clock}, case when turn % 2 = 0 then '+00:00' else '-07:30' end)",
        "own": "text",
        "quote": f"case when turn > 0 then concat('On Monday ', {number}, ' wrote:', chr(10), '> ', prior) else '' end",
    }


_PRIOR = "coalesce(lag(text) over (partition by conv_id order by turn), '')"
_FIRST_LINE = "split_part({}, chr(10), 1)"


def raw_text(c: dict[str, str]) -> str:
    """SQL of the message itself from the fields' SQL."""
    line = lambda name, value: f"'{name}: ', {value}, chr(10)"
    reply = f"case when turn > 0 then concat('In-Reply-To: ', {c['in_reply_to']}, chr(10)) else '' end"
    head = ", ".join([line("Message-ID", c["message_id"]), reply, "refs", line("From", c["sender"]), line("To", c["recipient"]), line("Subject", c["subject"]), line("Date", c["date"])])
    return f"concat({head}, 'MIME-Version: 1.0', chr(10), 'Content-Type: text/plain; charset=\"utf-8\"', chr(10), chr(10), text, chr(10), {c['quote']})"


def emails(spark: SparkSession, sf_dir: str, refs: bool = False, bad_every: int = 0) -> DataFrame:
    """id, seq, filename, raw_text: one message a turn, each a reply to the turn before.

    refs adds References to all turns before; every bad_every-th message is null.
    """
    c = message_columns()
    rows = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    # the number is given so that small inputs still use every core for parsing; the window reuses the exchange
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id")
    rows = rows.withColumn("prior", F.expr(_PRIOR)).withColumn("prior", F.expr(_FIRST_LINE.format("prior")))
    ids = F.array_join(F.transform(F.sequence(F.lit(0), F.col("turn").cast("int") - 1), lambda t: F.concat(F.lit("<c"), F.col("conv_id").cast("string"), F.lit("."), t.cast("string"), F.lit("@ex.com>"))), " ")
    rows = rows.withColumn("refs", F.when(F.col("turn") > 0, F.concat(F.lit("References: "), ids, F.lit("\n"))).otherwise(F.lit("")) if refs else F.lit(""))
    seq = (F.col("conv_id") * 1000 + F.col("turn")).cast("long")
    out = rows.select(F.expr(c["id"]).alias("id"), seq.alias("seq"), F.concat(F.lit("box/"), F.expr(c["id"])).alias("filename"), F.expr(raw_text(c)).alias("raw_text"))
    if bad_every:
        out = out.withColumn("raw_text", F.when(F.col("seq") % bad_every != 0, F.col("raw_text")))
    return out


#: DuckDB relation of the fields of the message view.
EMAILS_SQL = (
    "(SELECT conv_id, turn, role, conv_id * 1000 + turn AS seq, text, prior, "
    + ", ".join(f"{sql} AS {name}" for name, sql in message_columns().items())
    + f" FROM (SELECT *, {_FIRST_LINE.format('p')} AS prior FROM (SELECT *, {_PRIOR} AS p FROM (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations))))"
)

_BOUNDARY = "frontier-0451"


def multipart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, seq, filename, raw_text: each page as an HTML part, a plain part in base64 and an attachment."""
    pages = table(spark, sf_dir, "pages").where("html is not null").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "page_id")
    plain = F.concat(F.lit("page "), F.col("page_id").cast("string"), F.lit(" at "), F.coalesce("url", F.lit("")))
    part = lambda kind, more, body: [F.lit(f"--{_BOUNDARY}\nContent-Type: {kind}; charset=\"utf-8\"\n{more}\n"), body, F.lit("\n")]
    raw = F.concat(
        F.lit("Message-ID: <p"), F.col("page_id").cast("string"), F.lit("@ex.com>\nFrom: web@ex.com\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=\"" + _BOUNDARY + "\"\n\n"),
        *part("text/plain", "Content-Transfer-Encoding: base64\n", F.base64(F.encode(plain, "utf-8"))),
        *part("text/html", "Content-Transfer-Encoding: 8bit\n", F.col("html")),
        *part("text/plain", "Content-Disposition: attachment; filename=\"a.txt\"\n", F.lit("left out")),
        F.lit(f"--{_BOUNDARY}--\n"),
    )
    return pages.select(F.col("page_id").cast("string").alias("id"), F.col("page_id").cast("long").alias("seq"), F.concat(F.lit("web/"), F.col("page_id").cast("string")).alias("filename"), raw.alias("raw_text"))
