"""Column functions and parsers on edge cases, against the standard library where it defines them."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.functions import mime
from loomline.functions import text as X
from pyspark.sql import functions as F

ODD = ["", "  a \t b ", "one\r\ntwo\r\n", "a\x0bb\x0cc", "a\x1cb\x1dc\x1ed\x1fe", "nel\x85x", "\xa0nb\xa0sp\xa0", "ls ps x", "　wide　", "\n\n x \n\n", "é ü"]


def one(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def clean(t):
    return "\n".join(x for x in (re.sub(r"\s+", " ", line.strip()) for line in t.splitlines()) if x)


def test_strip_and_clean(spark):
    assert one(spark, ODD, X.strip) == [x.strip() for x in ODD]
    assert one(spark, ODD, X.clean_text) == [clean(x) for x in ODD]
    assert one(spark, [None], X.clean_text) == [""]
    once = one(spark, ODD, X.clean_text)
    assert one(spark, once, X.clean_text) == once
    assert one(spark, ODD, X.n_tokens) == [len(x.split()) for x in ODD]
    assert one(spark, ["ab", None], lambda c: X.n_chars(c, True)) == [2, 3]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 :<>")), max_size=30))
def test_clean_any(spark, t):
    assert one(spark, [t], X.clean_text) == [clean(t)]


def test_subject(spark):
    cases = {None: "", "": "", " Re:  Hello   World ": "hello world", "RE:RE: x": "re: x", "re : y": "re : y", "FWD: a": "a", "Fw:b": "b", "Fwdx: c": "fwdx: c"}
    assert one(spark, list(cases), X.normalize_subject) == list(cases.values())


def test_ids_and_references(spark):
    assert one(spark, ["<a@b>", " <a@b>  ", "a@b"], X.message_id) == ["a@b"] * 3
    assert one(spark, ["<a@b> "], lambda c: X.message_id(c, True)) == ["a@b> "]
    assert one(spark, ["<x@y>  <z@w>", "plain", ""], X.reply_id) == ["x@y", "plain", ""]
    assert one(spark, ["<x@y>  <z@w>"], lambda c: X.reply_id(c, True)) == ["x@y>  <z@w"]
    assert one(spark, ["<a> x < b > <a> < >", None], X.references) == [["a", "b", "a"], []]


@pytest.mark.parametrize(
    ("text", "original", "quoted"),
    [
        ("hi\n> old\nmore", "hi", "> old\nmore"),
        ("on Monday Jo wrote:\nx", "", "on Monday Jo wrote:\nx"),
        ("a\nb", "a\nb", ""),
        ("it derived from: x", "", "it derived from: x"),
        ("a\n-----original message-----\nb", "a", "-----original message-----\nb"),
        ("a\n________________________________\nb", "a", "________________________________\nb"),
        (None, "", ""),
        ("  \n ", "", ""),
    ],
)
def test_quotes(spark, text, original, quoted):
    assert tuple(one(spark, [text], X.quote_split)[0]) == (original, quoted)


def test_quote_lines_are_kept(spark):
    t = "a\nb\n> c\n\nd"
    got = one(spark, [t], X.quote_split)[0]
    assert (got.original + "\n" + got.quoted).split("\n") == t.split("\n")


def test_prepare_words(spark):
    t = "From: jo@x.y\r\nHello, World 42!\nDATE: today\nthe end don't"
    assert one(spark, [t, None], X.prepare_words) == ["hello world the end don t", ""]
    assert one(spark, [t], X.words) == [["hello", "world", "end"]]
    assert len(set(X.STOPWORDS)) == 105


def test_dates(spark):
    cases = ["Mon, 1 Jan 2024 10:00:00 -0700 (PDT)", "01 Feb 2024 01:02:03 +0530", "x", "", None, "Mon, 1 Jan 2024 10:00:00 -0000"]
    assert one(spark, cases, mime.iso_date_col) == ["2024-01-01T10:00:00-07:00", "2024-02-01T01:02:03+05:30", None, None, None, "2024-01-01T10:00:00"]
    assert one(spark, cases, X.date_iso) == one(spark, cases, mime.iso_date_col)
    assert one(spark, cases[:3], lambda c: X.date_timestamp(c).cast("string")) == ["2024-01-01 17:00:00", "2024-01-31 19:32:03", None]


def test_addresses():
    assert mime.address("Jo Doe <JO@X.Y>") == "Jo Doe <jo@x.y>"
    assert mime.address("JO@X.Y") == "jo@x.y" and mime.address(None) == "" and mime.address(" ") == ""
    assert mime.address_list('"Doe, Jo" <j@x>, B <B@y>') == "Doe, Jo <j@x>, B <b@y>"
    assert mime.address_list('"Doe, Jo" <j@x>', naive=True) != mime.address_list('"Doe, Jo" <j@x>')


def test_parse_message():
    raw = "Subject: =?utf-8?q?caf=C3=A9?=\nTo: a@b,\n c@d\nX-A: 1\nx-a: 2\nContent-Type: text/plain\n\nhéllo\n"
    got = mime.parse_message(raw)
    assert got["headers"]["subject"] == "café" and got["headers"]["to"] == "a@b, c@d" and got["headers"]["cc"] is None
    assert dict(got["all_headers"])["x-a"] == "2" and got["body_text"] == "héllo" and got["parsing_success"]
    assert "?q?" in mime.parse_message(raw, policy="verbatim")["headers"]["subject"]
    assert mime.parse_message(raw, lossy=True)["body_text"] != "héllo"
    bad = mime.parse_message(None)
    assert not bad["parsing_success"] and bad["headers"] is None and bad["error"]
    assert mime.parse_message("Content-Type: image/png\n\nx")["body_text"] == ""


def test_html(spark):
    page = "<html><script>var a='<p>';</script><p>One<br>two &amp; three<p>Four</p><!-- no --><style>x</style></html>"
    assert one(spark, [page], X.html_to_text) == ["One\ntwo & three\nFour"]
    assert clean(mime.html_text(page)) == "One\ntwo & three\nFour"


def test_native_headers(spark):
    raw = "From: a@b\nSubject: x\n  folded\nsubject: second\n\nFrom: body"
    block = one(spark, [raw], X.header_block)
    assert one(spark, block, lambda c: X.header(c, "Subject")) == ["x folded"]
    assert one(spark, block, lambda c: X.header(c, "Cc")) == [None]
    assert one(spark, [raw], X.plain_body) == ["From: body"]


def test_dates_equal_the_standard_library(spark):
    from email.utils import mktime_tz, parsedate_to_datetime, parsedate_tz

    forms = [
        "Mon, 1 Jan 2024 10:00:00 GMT", "1 Jan 2024 10:00 EST", "Tue, 2 Jan 24 10:00:05 +0530", "2 Feb 99 23:59 PDT", "3 Mar 68 01:02:03 MST", "3 Mar 69 01:02:03 Z",
        "Thu, 29 Feb 2024 9:05:07 -0000", "5 December 2023 10:11:12 UT", "5-Dec-2023 10:11:12 +0000", "Fri,  8 Nov 2002 01:02:03 -0800 (PST)", "8 Nov 2002 01:02:03", "8 Nov 2002 01:02:03 CDT (x)",
    ]
    bad = ["", None, "soon", "31 Feb 2024 10:00:00 GMT", "1 Jan 2024", "1 Jan 2024 25:00 GMT"]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(forms + bad)], "i int, d string").select("i", X.date_iso(F.col("d")).alias("iso"), X.date_timestamp(F.col("d")).cast("long").alias("at"))
    got = {r.i: (r.iso, r.at) for r in rows.collect()}
    for i, d in enumerate(forms):
        parsed = parsedate_tz(d)
        assert got[i] == (parsedate_to_datetime(d).isoformat(), mktime_tz((*parsed[:9], parsed[9] or 0))), d
    assert all(got[i] == (None, None) for i in range(len(forms), len(forms) + len(bad)))
