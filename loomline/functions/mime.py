"""Arrow functions over the standard library's message grammar: MIME, addresses, dates, HTML.

Only what has a grammar leaves the JVM; each function takes a batch and returns structs once.
"""

from __future__ import annotations

import email
import email.policy
from collections.abc import Iterator
from email.utils import getaddresses, parseaddr, parsedate_to_datetime
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.sources.tables import ship

NO_TEXT = "message without text"
HEADERS = ("from", "to", "cc", "bcc", "date", "subject", "message_id", "in_reply_to", "references")
PARSED = pa.schema(
    [
        ("headers", pa.struct([(h, pa.string()) for h in HEADERS])),
        ("all_headers", pa.map_(pa.string(), pa.string())),
        ("body_text", pa.string()),
        ("body_html", pa.string()),
        ("parsing_success", pa.bool_()),
        ("error", pa.string()),
    ]
)


def _clean(text: str | None) -> str | None:
    """Without lone surrogates, which no column can hold."""
    return None if text is None else text.encode("utf-8", "replace").decode("utf-8")


def _payload(part, lossy: bool) -> str:
    data = part.get_payload(decode=True)
    return "" if data is None else data.decode("utf-8", "replace")


def parse_message(raw: str | None, policy: str = "modern", lossy: bool = False) -> dict:
    """One message as a row of PARSED; what goes wrong is data.

    policy 'modern' unfolds and decodes headers, 'verbatim' keeps them as written. lossy
    reads the text itself instead of its bytes, which spoils single-part bodies beyond ASCII.
    """
    try:
        if raw is None:
            raise ValueError(NO_TEXT)
        rules = email.policy.default if policy == "modern" else email.policy.compat32
        msg = email.message_from_string(raw, policy=rules) if lossy else email.message_from_bytes(raw.encode("utf-8"), policy=rules)
        shown = lambda v: None if v is None else _clean(str(v))
        named = {h: shown(msg.get(h.replace("_", "-"))) for h in HEADERS}
        every = {k.lower(): shown(v) for k, v in msg.items()}
        bodies = {"text/plain": [], "text/html": []}
        parts = [p for p in msg.walk() if not p.is_multipart()] if msg.is_multipart() else [msg]
        for part in parts:
            kind = part.get_content_type()
            if kind in bodies and not (msg.is_multipart() and "attachment" in str(part.get("Content-Disposition", ""))):
                bodies[kind].append(_payload(part, lossy))
        text, html = ("".join(bodies[k]).strip() for k in ("text/plain", "text/html"))
        return {"headers": named, "all_headers": list(every.items()), "body_text": text, "body_html": html, "parsing_success": True, "error": None}
    except Exception as e:  # noqa: BLE001  a message that can't be read is a failed row
        return {"headers": None, "all_headers": None, "body_text": "", "body_html": "", "parsing_success": False, "error": str(e)}


def parse_messages(df: DataFrame, text: str = "raw_text", policy: str = "modern", lossy: bool = False, only: tuple[str, ...] = tuple(PARSED.names)) -> DataFrame:
    """df without its text column, with the columns of PARSED, or only some: one pass over Arrow batches. What isn't asked for isn't sent back."""
    ship(df.sparkSession)
    given = pa.schema([f for f in PARSED if f.name in only])
    keep = [c for c in df.columns if c != text]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [parse_message(x, policy, lossy) for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            made = [pa.array([r[f.name] for r in rows], f.type) for f in given]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), *made], [*keep, *given.names])

    from pyspark.sql.pandas.types import from_arrow_schema

    schema = df.select(*keep).schema
    for field in from_arrow_schema(given):
        schema = schema.add(field)
    return df.mapInArrow(batches, schema)


def address(raw: str | None) -> str:
    """'Name <addr>' with the address in lower case; without an address the text, stripped."""
    if not raw:
        return ""
    name, addr = parseaddr(raw)
    if not addr:
        return raw.strip()
    addr = addr.lower().strip()
    return f"{name.strip()} <{addr}>" if name else addr


def address_list(raw: str | None, naive: bool = False) -> str:
    """Addresses of a list in order; naive cuts at every comma, quoted ones too."""
    if not raw:
        return ""
    pairs = [parseaddr(x.strip()) for x in raw.split(",")] if naive else getaddresses([raw])
    return ", ".join(f"{name.strip()} <{addr.lower()}>" if name else addr.lower() for name, addr in pairs if addr)


def iso_date(raw: str | None) -> str | None:
    if not raw:
        return None
    try:
        return parsedate_to_datetime(raw).isoformat()
    except Exception:  # noqa: BLE001  any date that can't be read is null
        return None


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag in ("br", "p"):
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "p":
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def html_text(raw: str | None) -> str:
    """Text of an HTML page by a real parser; lines end at breaks and paragraphs."""
    if raw is None:
        return ""
    parser = _Text()
    parser.feed(raw)
    parser.close()
    return "".join(parser.out)


def _series(f, kind: str = "string"):
    ship(SparkSession.active())

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: f(None if x is None or x is pd.NA else x), na_action=None).astype(object)

    return run


def address_col(c: Column) -> Column:
    return _series(address)(c)


def address_list_col(c: Column, naive: bool = False) -> Column:
    return _series(lambda x: address_list(x, naive))(c)


def iso_date_col(c: Column) -> Column:
    return _series(iso_date)(c)


def html_text_col(c: Column) -> Column:
    return _series(html_text)(c)
