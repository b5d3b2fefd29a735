"""The pipeline's stages, each against a brute-force version of it on its own input."""

import re

import corpus_pipeline
import __spark_entry__
from loomline.llm import mixing, quality
from tests.llm.test_jaccard import brute
from tests.llm.test_tokens import check_pieces

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    before, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        held, kept = _rows(before), _rows(after)
        if name != names[-1]:
            assert after.columns == columns
        if name == "quality_rules":
            assert set(kept) == {r.doc_id for r in quality.quality(before).where("kept").collect()}
        elif name == "exact_dedup":
            first = {}
            for i in sorted(held):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", held[i].text or ""), i)
            assert set(kept) == set(first.values())
        elif name == "jaccard_join":
            assert set(kept) == {c for _, _, c in brute([(i, r.text) for i, r in held.items()])}
        elif name == "mixing":
            taken = {r.doc_id: r.taken for r in mixing.mix(before).collect()}
            words = {}
            for r in after.collect():
                words[r.doc_id] = words.get(r.doc_id, 0) + len(WORD.findall(r.text))
            assert words == {i: n for i, n in taken.items() if n}
        else:
            check_pieces([(r.doc_id, r.text) for r in before.collect()], after.collect())
        if name not in ("mixing", "packing"):
            assert all(kept[i] == held[i] for i in kept)
        before = after


def test_run_is_the_stages_in_order(spark):
    first = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert first and first == sorted(map(tuple, __spark_entry__.queries()["pipeline"](spark, SF).collect()))


def test_every_operator_is_registered():
    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert "pipeline" in __spark_entry__.queries()
