"""Native column functions over message and text columns.

Every function takes and returns a Column made of built-in expressions, so Catalyst sees through
it and whole-stage code generation covers it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str methods have it: Unicode's, with the four information separators.
SPACE = r"[\s\x1c-\x1f]"
LINE_END = r"\R|[\x1c-\x1e]"

# The words that frequency counts leave out.
STOPWORDS = (
    "the a an and or but in on at to for of with by from up about into through during before after above below "
    "out off over under again further then once here there when where why how all any both each few more most other some "
    "such no nor not only own same so than too very s t can will just don should now i you he she it we they "
    "them their what which who whom this that these those am is are was were be been being have has had do does did "
    "get got make made go went come came"
).split()

# The lines that begin quoted content, in any case.
QUOTE_STARTS = (
    r"^\s*>",
    r"On\s+.+\s+wrote:",
    r"From:\s+.+",
    r"Sent:\s+.+",
    r"To:\s+.+",
    r"Subject:\s+.+",
    r"-----Original Message-----",
    r"________________________________",
)

# Header labels that text preparation deletes up to the end of the line, in this order.
HEADER_LABELS = ("message-id:", "from:", "to:", "subject:", "date:")

#: Entities that the native HTML chain decodes; the ampersand comes last.
ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "#39": "'", "middot": "·", "copy": "©", "amp": "&"}


def strip(c: Column) -> Column:
    """White space off both ends."""
    return F.regexp_replace(c, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def collapse(c: Column) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(c, rf"(?U){SPACE}+", " ")


def lines(c: Column) -> Column:
    return F.split(c, LINE_END)


def clean_text(c: Column) -> Column:
    """Lines stripped and collapsed, blank ones dropped; null gives ''."""
    return F.coalesce(F.array_join(F.filter(F.transform(lines(c), lambda x: collapse(strip(x))), lambda x: x != ""), "\n"), F.lit(""))


def html_to_text(c: Column) -> Column:
    """Tags off by a chain of replacements: comments, script and style go, breaks and paragraphs end lines, entities are decoded."""
    out = F.regexp_replace(c, r"(?s)<!--.*?-->", "")
    for tag in ("script", "style"):
        out = F.regexp_replace(out, rf"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</?p(?:\s[^>]*)?>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for name, value in ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(value))
    return clean_text(out)


def body(html: Column, text: Column) -> Column:
    """The HTML part as text if it isn't blank, else the plain part, else ''."""
    return F.when(strip(F.coalesce(html, F.lit(""))) != "", html_to_text(html)).when(strip(F.coalesce(text, F.lit(""))) != "", clean_text(text)).otherwise(F.lit(""))


def quote_split(c: Column) -> Column:
    """Struct (original, quoted): the first line that begins a quote and all after it are quoted."""
    start = "(?iU)" + "|".join(QUOTE_STARTS)

    def of(rows: Column) -> Column:
        at = F.array_position(F.transform(rows, lambda x: F.rlike(x, F.lit(start))), True)
        first = F.when(at == 0, F.size(rows)).otherwise(at - 1).cast("int")
        joined = lambda part: strip(F.array_join(part, "\n"))
        return F.struct(
            joined(F.slice(rows, F.lit(1), first)).alias("original"),
            F.when(at == 0, F.lit("")).otherwise(joined(F.slice(rows, first + 1, F.size(rows)))).alias("quoted"),
        )

    return F.element_at(F.transform(F.array(lines(F.coalesce(c, F.lit("")))), of), 1)


def strip_brackets(c: Column) -> Column:
    return F.btrim(c, F.lit("<>"))


def message_id(c: Column, compat: bool = False) -> Column:
    """A message id without brackets; white space goes first unless compat."""
    return strip_brackets(c if compat else strip(c))


def reply_id(c: Column, compat: bool = False) -> Column:
    """The id an In-Reply-To names: its first bracketed one; compat takes the header as one id."""
    if compat:
        return strip_brackets(c)
    first = F.regexp_extract(c, r"<([^>]+)>", 1)
    return F.when(first != "", strip(first)).otherwise(strip_brackets(strip(c)))


def references(c: Column) -> Column:
    """Bracketed ids in order, trimmed, empty ones dropped."""
    return F.coalesce(F.filter(F.transform(F.regexp_extract_all(c, F.lit("<([^>]+)>"), 1), strip), lambda x: x != ""), F.array().cast("array<string>"))


def normalize_subject(c: Column) -> Column:
    """One reply or forward prefix off, white space collapsed, lower case; null gives ''."""
    bare = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), rf"(?iU)\A(?:re|fwd|fw):{SPACE}*", "")
    return F.lower(strip(collapse(bare)))


def content_hash(sender: Column, recipients: Column, subject: Column, original: Column, date: Column) -> Column:
    """SHA-256 of the normalised headers, the original body and the date."""
    text = lambda c: F.coalesce(c, F.lit(""))
    parts = [F.lower(strip(text(sender))), F.lower(strip(text(recipients))), strip(text(subject)), strip(text(original)), text(date)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def prepare_words(c: Column) -> Column:
    """Lower case, header-like lines and all but letters off, spaces single; null gives ''."""
    out = F.lower(F.coalesce(c, F.lit("")))
    for label in HEADER_LABELS:
        out = F.regexp_replace(out, rf"(?d){label}.*?\n", "")
    return strip(collapse(F.regexp_replace(out, rf"(?U)[^a-zA-Z\s\x1c-\x1f]", " ")))


def words(c: Column, stopwords=STOPWORDS, longer_than: int = 2) -> Column:
    """Array of the prepared words that count."""
    return F.filter(F.split(prepare_words(c), " "), lambda w: (F.length(w) > longer_than) & ~w.isin(list(stopwords)))


def n_chars(c: Column, compat: bool = False) -> Column:
    """Code points; with compat a null counts as the text 'nan'."""
    return F.length(F.coalesce(c, F.lit("nan")) if compat else c).cast("long")


def n_tokens(c: Column, compat: bool = False) -> Column:
    """Runs between white space."""
    text = strip(F.coalesce(c, F.lit("nan")) if compat else c)
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, rf"(?U){SPACE}+"))).cast("long")


def truncated(c: Column, most: int = 30, mark: str = "...") -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit(mark))).otherwise(c)


# Months, and offsets of the named zones of RFC 5322.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
ZONES = {
    "UT": "+0000", "UTC": "+0000", "GMT": "+0000", "Z": "+0000", "AST": "-0400", "ADT": "-0300", "EST": "-0500", "EDT": "-0400",
    "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}
_DATE = rf"(?i)(?:^|[\s,])(\d{{1,2}})[\s-]+({'|'.join(MONTHS)})[a-z]*[\s,-]+(\d{{4}}|\d{{2}})[\s,]+(\d{{1,2}}):(\d{{2}})(?::(\d{{2}}))?(?:\s*([+-]\d{{4}})|\s+([A-Za-z]+))?(?![\d:])"


def _date_parts(c: Column) -> tuple[Column, Column]:
    """(local time as yyyy-MM-dd HH:mm:ss, offset as +HHMM or null where it is missing, unknown or -0000); nulls where c holds no date."""
    part = lambda i: F.regexp_extract(c, _DATE, i)
    number = F.lpad((F.floor(F.instr(F.lit(" ".join(MONTHS).lower()), F.lower(part(2))) / 4) + 1).cast("string"), 2, "0")
    two = part(3).try_cast("int")
    # years of two digits up to 68 are of this century
    year = F.when(F.length(part(3)) == 4, part(3)).otherwise((two + F.when(two > 68, 1900).otherwise(2000)).cast("string"))
    second = F.when(part(6) == "", F.lit("00")).otherwise(part(6))
    local = F.concat(year, F.lit("-"), number, F.lit("-"), F.lpad(part(1), 2, "0"), F.lit(" "), F.lpad(part(4), 2, "0"), F.lit(":"), part(5), F.lit(":"), second)
    names = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])
    offset = F.when(part(7) != "", F.nullif(part(7), F.lit("-0000"))).otherwise(names[F.upper(part(8))])
    return F.when(part(1) != "", local), offset


def date_timestamp(c: Column) -> Column:
    """Instant of an RFC 5322 date, with or without seconds, weekday and zone (a date without one is UTC); null where it isn't one."""
    local, offset = _date_parts(c)
    return F.try_to_timestamp(F.concat(local, F.lit(" "), F.coalesce(offset, F.lit("+0000"))), F.lit("yyyy-MM-dd HH:mm:ss Z"))


def date_iso(c: Column) -> Column:
    """ISO text of such a date with its own offset; none where it has none."""
    local, offset = _date_parts(c)
    zone = F.when(offset.isNull(), F.lit("")).otherwise(F.concat(F.left(offset, F.lit(3)), F.lit(":"), F.right(offset, F.lit(2))))
    return F.when(date_timestamp(c).isNotNull(), F.concat(F.replace(local, F.lit(" "), F.lit("T")), zone))


def header_block(c: Column) -> Column:
    """The lines before the first blank one, folded lines joined."""
    block = F.regexp_extract(c, r"(?s)\A(.*?)(?:\r?\n\r?\n|\z)", 1)
    return F.regexp_replace(block, r"\r?\n[ \t]+", " ")


def header(block: Column, name: str) -> Column:
    """First value of a header in a block; null where it is missing."""
    form = rf"(?im)^{name}:[ \t]*([^\r\n]*)$"
    return F.when(F.rlike(block, F.lit(form)), F.regexp_extract(block, form, 1))


def plain_body(c: Column) -> Column:
    """What follows the first blank line, stripped."""
    return strip(F.regexp_replace(c, r"(?s)\A.*?(?:\r?\n\r?\n|\z)", ""))
