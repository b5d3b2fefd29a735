import json

from loomline.plans import stages
from loomline.plans.fixtures import emails
from loomline.sources import sinks


def _lines(path):
    return [json.loads(x) for f in path.glob("*.json") for x in f.read_text(encoding="utf-8").splitlines()]


def test_all_stages(spark, tmp_path):
    raw = emails(spark, "/root/testdata/sf0.001", bad_every=9).selectExpr("filename as file", "raw_text as message")
    sinks.write_csv(raw, f"{tmp_path}/raw.csv", one_file=True)
    n = raw.count()
    c = stages.Config(f"{tmp_path}/raw.csv", f"{tmp_path}/out", sample_size=20)
    v = stages.run_sampling(spark, c).first()
    assert v.size_ok and v.columns_ok and v.extra_rows == 0
    assert stages.run_profile(spark, c).first().total_emails == n
    parsed = stages.run_parse(spark, c)
    assert parsed.count() == n
    report = _lines(tmp_path / "out" / "parsing_report.json")[0]
    assert report["total_emails"] == n and report["failed_parsing"] == raw.where("message is null").count() > 0
    threads = stages.run_threads(spark, c)
    told = _lines(tmp_path / "out" / "thread_reconstruction_report.json")[0]
    assert told["thread_quality_metrics"]["total_threads"] == threads.count() == told["reconstruction_summary"]["output_threads"]
    done = stages.run_content(spark, c)
    told = _lines(tmp_path / "out" / "content_processing_report.json")[0]
    assert told["successfully_processed"] == done.count() == len(_lines(tmp_path / "out" / "content_fingerprints.jsonl"))
    tables = {k: t.collect() for k, t in stages.run_eda(spark, c).items()}
    assert len(tables["length_histogram"]) == 50 and len(tables["weekday_counts"]) == 7 and len(tables["summary"]) == 1
    assert sum(r.n for r in tables["hour_counts"]) == raw.where("message is not null").count()
