import json
import random

import pytest
from pyspark.sql import functions as F

from loomline.operators import content, eda, parse, profile, sample, threads
from loomline.plans import catalog
from loomline.sources import files, sinks
from loomline.streaming import messages as stream
from tests.conftest import SMALL


def records(spark, rows):
    """(seq, id, reply, references, subject, sender, date) as reference records."""
    full = [(s, m, r, refs, subj, (subj or "").lower(), d, who) for s, m, r, refs, subj, who, d in rows]
    return spark.createDataFrame(full, "seq long, message_id string, in_reply_to string, references array<string>, subject string, normalized_subject string, date string, `from` string")


def test_graph_edge_cases(spark):
    rows = [
        (0, "a", "", [], "S", "x", None),
        (1, "b", "a", ["a"], "Re: S", "y", "Mon, 1 Jan 2024 10:00:00 +0000"),
        (2, "self", "self", [], "T", "z", None),
        (3, "c1", "c2", [], "U", "x", None),
        (4, "c2", "c1", [], "U", "x", None),
        (5, "two", "", ["a", "r2", "two"], "V", None, None),
        (6, "r2", "", [], "W", "w", "Tue, 2 Jan 2024 10:00:00 -0100"),
        (7, "lost", "nowhere", [], "X", "x", None),
        (8, "", "a", [], "none", "x", None),
        (9, "b", "two", [], "Last", "y", None),
        (10, "deep", "b", [], "Re: S", "y", None),
    ]
    rec = records(spark, rows)
    n = threads.nodes(rec)
    e = threads.edges(rec, n)
    found = {(r.src, r.dst): r.relationship for r in e.collect()}
    assert found == {("a", "b"): "reference", ("self", "self"): "reply", ("c2", "c1"): "reply", ("c1", "c2"): "reply", ("a", "two"): "reference", ("r2", "two"): "reference", ("two", "b"): "reply", ("b", "deep"): "reply"}
    by = {r.message_id: r for r in n.collect()}
    assert by["b"].first_seq == 1 and by["b"].subject == "Last" and "" not in by
    t = threads.threads(rec)
    got = {r.root_message_id: r for r in t.collect()}
    assert list(sorted(got)) == ["a", "lost", "r2"]
    assert [got[k].thread_id for k in ("a", "r2", "lost")] == ["thread_0001", "thread_0002", "thread_0003"]
    assert got["a"].message_ids == ["a", "b", "two", "deep"] and got["a"].thread_depth == 2
    assert got["r2"].message_ids == ["b", "two", "r2", "deep"] and got["r2"].thread_depth == 3
    assert set(got["a"].participants) == {"x", "y", None}
    assert got["r2"].date_range.start == "2024-01-02T10:00:00-01:00"
    again = {r.root_message_id: (r.message_ids, r.thread_depth) for r in threads.threads(rec.repartition(5)).collect()}
    assert again == {k: (v.message_ids, v.thread_depth) for k, v in got.items()}
    s = threads.summary(t, rec).first()
    assert (s.output_threads, s.distinct_messages_threaded, s.dropped_messages, s.input_emails) == (3, 6, 3, 9)
    q = threads.quality_metrics(t).first()
    assert q.total_messages_threaded == 9 and q.max_thread_depth == 3 and q.complex_threads == 0 and q.single_message_threads == 1
    assert threads.quality_metrics(t.limit(0)).count() == 0


def nearest(roots, edges):
    """Brute force: {(root, node): depth}."""
    out = {}
    for root in roots:
        depth, queue = {root: 0}, [root]
        for node in queue:
            for a, b in edges:
                if a == node and b not in depth:
                    depth[b] = depth[node] + 1
                    queue.append(b)
        out |= {(root, node): d for node, d in depth.items()}
    return out


def test_reach_against_brute_force(spark, monkeypatch):
    rounds = []
    kept = threads.written
    monkeypatch.setattr(threads, "written", lambda df, name: rounds.append(name) or kept(df, name))

    def check(names, edges):
        roots = sorted(set(names) - {b for _, b in edges})
        r = spark.createDataFrame([(x, 0) for x in roots], "message_id string, first_seq long")
        e = spark.createDataFrame(sorted(edges), "src string, dst string")
        found = [tuple(x) for x in threads.reach(r, e).select("root", "node", "depth").collect()]
        assert len(found) == len({x[:2] for x in found})
        assert {x[:2]: x[2] for x in found} == nearest(roots, edges)

    draw = random.Random(5)
    for many in (1.0, 1.6):
        names = [f"n{i}" for i in range(40)]
        edges = {(names[draw.randrange(max(0, i - 6), i)], names[i]) for i in range(3, 40) for _ in range(2 if draw.random() < many - 1 else 1)}
        edges |= {(draw.choice(names), draw.choice(names)) for _ in range(int(30 * (many - 1)))}
        check(names, edges)
    check(["a", "b", "c", "d", "self", "e"], {("b", "c"), ("c", "b"), ("c", "d"), ("self", "self"), ("self", "e")})
    check([], set())
    rounds.clear()
    chain = [f"c{i:03}" for i in range(200)]
    check(chain, set(zip(chain, chain[1:], strict=False)))
    assert rounds.count("trees") <= 9 and "level" not in rounds


def loop_cap(flags, cap, batch=100):
    kept, errors, failed = [], 0, 0
    for b in range(0, len(flags), batch):
        for i in range(b, min(b + batch, len(flags))):
            if flags[i]:
                errors += 1
                failed += 1
                if errors > cap:
                    break
            else:
                kept.append(i)
    return kept, failed


@pytest.mark.parametrize("step", [2, 3, 7, 50, 1000])
def test_error_cap(spark, step):
    flags = [i % step == 1 for i in range(700)]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(flags)], "seq long, failed boolean")
    kept, failed = loop_cap(flags, 20)
    assert sorted(r.seq for r in content.capped(df, 20).collect()) == kept
    assert content.capped_failures(df, 20).first()[0] == failed


def parsed_rows(spark):
    raw = [
        ("0", 0, "f0", "From: Jo <JO@x.y>\nTo: a@b\nSubject: Hi\nMessage-ID: <1@x>\nDate: Mon, 1 Jan 2024 10:00:00 +0000\n\nbody\n> old"),
        ("1", 1, "f1", "From: Jo <JO@x.y>\nTo: a@b\nMessage-ID: <2@x>\n\nno subject"),
        ("2", 2, "f2", "Subject: empty\n\n"),
        ("3", 3, "f3", None),
        ("4", 4, "f4", "Subject: page\nMessage-ID: <3@x>\nContent-Type: text/html\n\n<p>One</p>two"),
    ]
    return parse.parse(spark.createDataFrame(raw, "id string, seq long, filename string, raw_text string"))


def test_content_stage(spark):
    parsed = parsed_rows(spark)
    done = {r.id: r for r in content.process(parsed).collect()}
    assert sorted(done) == ["0", "1", "4"]
    assert (done["0"].body_original, done["0"].body_quoted, done["0"]["from"]) == ("body", "> old", "Jo <jo@x.y>")
    assert done["0"].processing_metadata.timestamp_parsed and not done["1"].processing_metadata.timestamp_parsed
    assert done["1"]["from"] == "Jo <jo@x.y>" and done["4"].body_original == "One\ntwo"
    compat = {r.id: r for r in content.process(parsed, compat=True).collect()}
    assert compat["1"]["from"] == "" and compat["0"].content_hash == done["0"].content_hash
    assert {r.body_original for r in content.process(parsed, html="parser").collect()} == {"body", "no subject", "One\ntwo"}
    r = content.report(content.process(parsed), parsed).first()
    assert (r.total_input, r.successfully_processed, r.failed_processing, r.quotes_detected, r.html_emails, r.success_rate) == (5, 3, 2, 1, 1, 0.6)
    assert content.fingerprints(content.process(parsed)).columns == ["id", "content_hash", "message_id"]
    assert content.process(parsed, max_errors=50).count() == 3


def test_parse_reports(spark):
    parsed = parsed_rows(spark)
    r = parse.full_report(parsed).first()
    assert (r.total_emails, r.failed_parsing, r.success_rate) == (5, 1, 0.8) and sum(r.error_distribution.values()) == 1
    assert parse.report(parsed.limit(0)).first().success_rate == 0
    assert parse.error_distribution(parsed, compat=True).count() == 1
    h = {x.id: x for x in parse.thread_hints(parsed).collect()}
    assert h["3"].message_id is None and h["0"].message_id == "<1@x>"


def test_csv_rules(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text('file,message\na,"one\ntwo ""q"""\nb,x,too many\nc\nd,NA\n"e,1",é\n', encoding="utf-8")
    rows = {r.filename: r for r in files.load_messages(spark, str(p)).collect()}
    assert sorted(rows) == ["a", "c", "d", "e,1"]
    assert rows["a"].raw_text == 'one\ntwo "q"' and rows["c"].raw_text is None and rows["d"].raw_text is None
    assert sorted(r.seq for r in rows.values()) == [0, 1, 2, 3] and rows["a"].id == "0"
    assert files.preview(spark, str(p), 2).count() == 2
    with pytest.raises(FileNotFoundError):
        files.read_csv(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError, match="other"):
        files.require_columns(spark.range(1), "other")
    assert files.text_column(spark.createDataFrame([(1, 2)], "a int, b int")) == "b"


def test_jsonl_and_sinks(spark, tmp_path):
    parsed = parsed_rows(spark)
    out = sinks.write_jsonl(parsed, f"{tmp_path}/p")
    lines = [json.loads(x) for f in (tmp_path / "p").glob("*.json") for x in f.read_text(encoding="utf-8").splitlines()]
    assert len(lines) == 5 and all("error" in x for x in lines)
    (tmp_path / "p" / "more.json").write_text("{broken\n\n", encoding="utf-8")
    back = files.read_jsonl(spark, out)
    assert back.count() == 5 and back.where("headers is null").count() == 1
    assert files.count_bad_lines(spark, out) >= 1
    sinks.write_report(parse.report(parsed), f"{tmp_path}/r")
    csv = sinks.write_csv(parsed.select("id", "body_text"), f"{tmp_path}/c", one_file=True)
    assert sinks.validate_outputs(spark, out, csv, f"{tmp_path}/none") == {out: True, csv: True, f"{tmp_path}/none": False}
    assert len(list((tmp_path / "c").glob("part-*"))) == 1
    sinks.log_to(str(tmp_path / "log"), "t").info("x")
    assert "INFO - x" in (tmp_path / "log").read_text()


def test_sampling(spark):
    df = spark.range(500).withColumnRenamed("id", "seq")
    a = [r.seq for r in sample.sample_exact(df, 50).collect()]
    assert len(set(a)) == 50 and a == [r.seq for r in sample.sample_exact(df.repartition(9), 50).collect()]
    assert a != [r.seq for r in sample.sample_exact(df, 50, seed=1).collect()]
    with pytest.raises(ValueError):
        sample.sample_exact(df, 501)


def test_profile(spark):
    df = spark.createDataFrame([(0, "a", None), (1, "a", None), (2, "b", "x"), (3, None, None)], "seq long, file string, message string")
    assert {r.field_name: r.n_null for r in profile.null_counts(df).collect()} == {"file": 1, "message": 3}
    assert {r.seq for r in profile.duplicates(df, "file", "message").collect()} == {0, 1}
    m = {r.email_index: (r.missing_field, r.is_duplicate) for r in profile.row_metrics(df).collect()}
    assert m == {0: (1, True), 1: (1, True), 2: (0, False), 3: (2, False)}
    s = profile.summary(df).first()
    assert s.total_emails == 4 and s.field_completeness == {"file": 75.0, "message": 25.0} and len(s.recommendations) == 3
    assert profile.overall_completeness(df).first()[0] == round(8 / 12 * 100, 6)
    bad = spark.createDataFrame([(b"ok",), (b"\xff\xfe",), (None,)], "b binary")
    assert [r[0] for r in bad.select(profile.bad_encoding(F.col("b"))).collect()] == [False, True, False]
    assert profile.duplicate_row_count(df.drop("seq")).first()[0] == 1
    seen = profile.inspect(df)
    assert seen["types"].count() == 3 and seen["head"].count() == 3 and seen["shape"].first().n_rows == 4


def test_histogram_and_modes(spark):
    df = spark.createDataFrame([(x,) for x in (0, 1, 9, 10, 10)], "x int")
    assert [r.n for r in eda.histogram(df, F.col("x"), 5).orderBy("bin").collect()] == [2, 0, 0, 0, 3]
    assert eda.histogram(df.where("x = 1"), F.col("x"), 5).where("n = 1").first().bin == 1
    assert eda.histogram(df.limit(0), F.col("x"), 5).agg(F.sum("n")).first()[0] == 0
    times = eda.with_times(spark.sql("select timestamp'2024-01-01 05:00:00' as t union all select timestamp'2024-01-02 03:00:00' union all select null"), F.col("t"))
    assert tuple(eda.peaks(times).first()) == (3, "Monday") and eda.weekday_counts(times).count() == 7


def test_streams(spark, tmp_path):
    raw = tmp_path / "in"
    raw.mkdir()
    (raw / "a.json").write_text(json.dumps({"id": "0", "seq": 0, "filename": "f", "raw_text": "Subject: s\nMessage-ID: <1@x>\n\nbody\n> q"}) + "\n")
    q = stream.processed_stream(stream.parsed_stream(stream.read_raw(spark, str(raw)))).writeStream.format("memory").queryName("done").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.subject, r.body_original) for r in spark.table("done").collect()] == [("s", "body")]
    ev = tmp_path / "ev"
    spark.sql("select timestamp'2024-01-01 05:10:00' as ts union all select timestamp'2024-01-01 05:50:00' union all select timestamp'2024-01-01 23:00:00'").write.parquet(str(ev))
    live = spark.readStream.schema("ts timestamp").parquet(str(ev))
    q = stream.hourly_counts(live).writeStream.format("memory").queryName("hours").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(str(r.hour_start), r.n) for r in spark.table("hours").collect()] == [("2024-01-01 05:00:00", 2)]


def test_csv_gives_odd_texts_back(spark, tmp_path):
    draw = random.Random(3)
    atoms = ['"', '""', ",", "\n", "\r", "\r\n", " ", "\t", "a", "bc", "\\", '\\"', "é", "\U0001f600", "\x00", "\x0b", "\u2028", "\x85", "#", "\ufeff", "'"]
    rows = [(str(i), "".join(draw.choice(atoms) for _ in range(draw.randint(0, 6)))) for i in range(2000)]
    rows += [(None, None), (None, "x"), ("y", None), ("", ""), ("NA", "null")]
    df = spark.createDataFrame(rows, "file string, message string").repartition(3)
    back = files.read_csv(spark, sinks.write_csv(df, f"{tmp_path}/c"), na=False)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(rows, key=repr)
    none = sinks.write_csv(df.limit(0), f"{tmp_path}/none")
    assert sinks.validate_outputs(spark, none)[none] and files.read_csv(spark, none).count() == 0
    typed = spark.sql("select 1 as n, 'a,b' as `t,u`, cast(null as double) as d")
    sinks.write_csv(typed, f"{tmp_path}/t")
    assert next((tmp_path / "t").glob("part-*")).read_text() == 'n,"t,u",d\n1,"a,b",\n'


def test_messages_are_numbered_by_the_order_of_files(spark, tmp_path):
    rows = [(f"f{i:03}", f"m{i}," + "x" * (i % 100 if i < 200 else 500)) for i in range(300)]
    ranges = spark.createDataFrame(rows, "file string, message string").repartitionByRange(3, "file").sortWithinPartitions("file")
    path = sinks.write_csv(ranges, f"{tmp_path}/m")
    assert len(list((tmp_path / "m").glob("part-*"))) == 3
    back = sorted((r.seq, r.id, r.filename, r.raw_text) for r in files.load_messages(spark, path).collect())
    assert back == [(i, str(i), *r) for i, r in enumerate(rows)]


def test_message_file_is_not_written_by_one_task(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "_path", lambda s, name: f"{tmp_path}/{name}")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        catalog.queries()["csv_messages"](spark, SMALL)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "messages.csv").glob("part-*"))) > 1


def test_full_report_parses_once(spark, tmp_path):
    seen = tmp_path / "seen"

    @F.udf("string")
    def read(x):
        with seen.open("a") as f:
            f.write(".")
        return x

    raw = spark.createDataFrame([(str(i), i, "f", None if i % 3 == 0 else "Subject: s\n\nb") for i in range(30)], "id string, seq long, filename string, raw_text string")
    raw = raw.withColumn("raw_text", read.asNondeterministic()("raw_text"))
    whole = parse.parse(raw)
    r = parse.full_report(whole).first()
    assert seen.read_text() == "." * 30
    assert (r.total_emails, r.successful_parsing, r.failed_parsing, r.success_rate) == (30, 20, 10, 0.6667) and list(r.error_distribution.values()) == [10]
    assert parse.full_report(parse.parse(raw, only=("parsing_success", "error"))).first() == r
    assert parse.full_report(whole.limit(0)).first().asDict() == {"total_emails": 0, "successful_parsing": 0, "failed_parsing": 0, "success_rate": 0.0, "error_distribution": {}}


def test_odd_rows_are_written_as_they_are_read(spark, tmp_path, monkeypatch):
    events = spark.read.parquet(f"{SMALL}/events.parquet").repartition(3)
    events.write.parquet(f"{tmp_path}/in/events.parquet")
    monkeypatch.setattr(catalog, "_path", lambda s, name: f"{tmp_path}/{name}")
    rows = catalog.queries()["csv_odd_rows"](spark, f"{tmp_path}/in").collect()
    parts = [p.read_text().splitlines() for p in (tmp_path / "odd.csv").glob("part-*")]
    assert len(parts) == 3 and all(p[0] == "file,message" for p in parts) and sum(len(p) - 1 for p in parts) == 10_000
    assert len(rows) == 8_000 and all(r.file != "file" for r in rows)
