import contextlib
import re
import zlib
from pathlib import Path

import numpy as np
import psutil
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.llm import jaccard_join, kd_sharding, mixing, token_count, token_files
from loomline.llm.common import small_table
from tests.llm.conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1000), st.integers(0, 60)), min_size=1, max_size=12), st.integers(0, 300))
def test_apportionment_is_by_highest_quotients(parties, seats):
    weights, most = np.array([w for w, _ in parties]), np.array([m for _, m in parties])
    out = mixing.sainte_lague(weights, seats, most)
    assert (out <= most).all() and (out >= 0).all()
    usable = int(most[weights > 0].sum())
    assert out.sum() == min(seats, usable)
    served = [w / (2 * k - 1) for w, k in zip(weights, out, strict=True) if k > 0]
    waiting = [w / (2 * k + 1) for w, k, m in zip(weights, out, most, strict=True) if k < m and w > 0]
    assert not served or not waiting or min(served) >= max(waiting) * (1 - 1e-9)


def test_targets():
    t = mixing.targets([("a", 100), ("b", 1000), ("c", 1000), (None, 50)])
    assert abs(sum(t.values()) - 1.5 * 2150) < 1e-6
    assert t["a"] == 200 and all(t[s] <= 2 * n + 1e-9 for s, n in [("a", 100), ("b", 1000), ("c", 1000), (None, 50)])
    assert mixing.targets([]) == {}


def test_mix(spark, docs, texts):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(texts)
    by = {}
    source = {r.doc_id: r.source for r in docs.collect()}
    for r in rows:
        assert r.size == len(WORD.findall(texts[r.doc_id])) and 0 <= r.taken <= 2 * r.size
        by.setdefault(source[r.doc_id], []).append(r)
    want = mixing.targets([(s, sum(r.size for r in rs)) for s, rs in by.items()])
    for s, rs in by.items():
        assert abs(rs[0].target - want[s]) < 1e-6 and rs[0].source_size == sum(r.size for r in rs)
        assert abs(sum(r.taken for r in rs) / want[s] - 1) < 0.02
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_large_sources_of_short_and_empty_texts_get_their_targets(spark):
    n = 60_000
    short = spark.range(n).selectExpr("id AS doc_id", "'word' AS text", "'a' AS source")
    empty = spark.range(n, 2 * n).selectExpr("id AS doc_id", "if(id % 10 = 0, 'word', if(id % 2 = 0, '', null)) AS text", "'b' AS source")
    got = mixing.mix(short.unionByName(empty), weights=(10, 1), share=1.4).selectExpr("doc_id < 60000 AS a", "taken", "target").groupBy("a").agg({"taken": "sum", "target": "max"}).collect()
    assert len(got) == 2
    for r in got:
        assert abs(r["sum(taken)"] / r["max(target)"] - 1) < 0.01, r


def test_mixed_rows_hold_what_was_taken(docs):
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    words = {}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert {k: v for k, v in taken.items() if v} == words


def test_a_tiny_source_does_not_shrink_the_blocks_of_others(spark, docs):
    assert [mixing.block_of(t) for t in (0, 60, 199, 200, 450, 6_399, 6_400, 10**9)] == [1, 1, 1, 2, 4, 32, 64, 64]
    tiny = spark.createDataFrame([(10**6, "word " * 40, "en", "0tiny", 200)], docs.schema)
    alone = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    both = {r.doc_id: r for r in mixing.mix(docs.unionByName(tiny)).collect()}
    assert abs(both[10**6].taken / both[10**6].target - 1) < 0.05
    assert len(both) == len(alone) + 1


def test_parts_are_passages_of_their_text(docs, texts):
    parts = [r for r in mixing.mixed(docs).collect() if r.text != texts[r.doc_id]]
    assert parts and all(r.text in texts[r.doc_id] for r in parts)


def _most_of_a_worker() -> int:
    """The most MB that one of the session's Python workers ever held."""
    most = 0
    for p in psutil.Process().children(recursive=True):
        with contextlib.suppress(OSError, psutil.Error):
            if "pyspark.daemon" in " ".join(p.cmdline()):
                most = max(most, int(re.search(r"VmHWM:\s+(\d+)", Path(f"/proc/{p.pid}/status").read_text())[1]) >> 10)
    return most


def test_a_long_text_is_cut_without_a_copy_of_it_for_each_passage(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(300_000)), "a", 0), (2, "x " * 900, "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    out = mixing.mixed(docs).collect()
    assert 0 < _most_of_a_worker() < 1000  # with a copy for each it was over 2 GB
    words, texts = {}, {i: t for i, t, _, _ in rows}
    for r in out:
        assert r.text in texts[r.doc_id]
        words[r.doc_id] = words.get(r.doc_id, 0) + len(WORD.findall(r.text))
    assert words == {i: n for i, n in taken.items() if n} and len(out) > 500


def test_small_tables_need_no_python_worker(spark):
    schema = "name string, no int, part double"
    for rows in ([("a", 1, 0.5), (None, 2, None)], []):
        made, wanted = small_table(spark, rows, schema), spark.createDataFrame(rows, schema)
        assert made.schema == wanted.schema and made.collect() == wanted.collect()
        assert "PythonRDD" not in made._jdf.queryExecution().toRdd().toDebugString()
    assert "PythonRDD" in spark.createDataFrame([("a", 1, 0.5)], schema)._jdf.queryExecution().toRdd().toDebugString()


def test_a_worker_forgets_the_encoder_when_another_step_begins():
    path = token_count.tokenizer_path("byte_bpe_50k.json")
    enc = token_files.encoder(path, True)
    assert token_files.encoder(path, True) is enc
    steps = [
        lambda: list(jaccard_join.set_batches(iter(()), np.zeros(0, np.uint64))),
        lambda: list(jaccard_join.frequent_batches(iter(()))),
        lambda: mixing._quotas(pa.table({"shard": pa.array([0], pa.int32()), "source_no": pa.array([0], pa.int32()), "blocks": [1], "before": [0], "ratio": [1.0], "block": [64]})),
    ]
    for step in steps:
        enc = token_files.encoder(path, True)
        step()
        assert token_files.encoder(path, True) is not enc


def test_ties_of_id_and_size_do_not_depend_on_the_order(spark):
    rows = [(i % 5, f"w{i} x{i} y{i} z{i % 3} " * 9, "a" if i % 2 else "b") for i in range(300)]
    a = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    b = mixing.mixed(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(5))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_mix_of_odd_rows(odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD) and all(r.taken <= 2 * r.size for r in rows)
    assert all(r.size == 0 and r.taken == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert mixing.mixed(odd).columns == odd.columns and mixing.mixed(odd).count() > 0
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


def _check_shards(rows, got, shards=8):
    want = sorted((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows if d is not None)
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got if r.doc_id is not None) == want and len(got) == len(rows)
    for s in {r.shard for r in got}:
        assert 0 <= s < shards and sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert {(r.law, r.grown_shard) for r in got} <= {("bytes", None)}


def test_shards(docs, texts):
    got = kd_sharding.shard(docs).collect()
    _check_shards(list(texts.items()), got)
    size = [sum(r["size"] for r in got if r.shard == s) for s in range(8)]
    assert max(size) < 1.06 * sum(size) / 8
    together = {}
    for r in got:
        together.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert max(map(len, together.values())) == 1


def _tree(points, shards, first=0):
    """Shards of points (key, weight, values, coordinates) by the definition: cut the widest dimension at the weighted median."""
    scale = _tree.scale
    if shards == 1 or not points:
        return {p[0]: first for p in points}
    widths = [(max(p[2][i] for p in points) - min(p[2][i] for p in points)) / scale[i] if scale[i] else 0.0 for i in range(3)]
    axis = widths.index(max(widths))
    _tree.axes.append(axis)
    points = sorted(points, key=lambda p: p[3][axis])
    goal, seen, at = sum(p[1] for p in points) * (shards // 2) / shards, 0, 0
    while at < len(points) and seen + points[at][1] <= goal:
        seen += points[at][1]
        at += 1
    if at < len(points) and goal - seen > seen + points[at][1] - goal:
        at += 1
    return _tree(points[:at], shards // 2, first) | _tree(points[at:], shards - shards // 2, first + shards // 2)


def test_shards_are_those_of_the_tree(spark):
    rows = [(i, f"text {i} " * (1 + i * i % 97), "abc"[i % 3], f"s{i * 7 % 11}") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    cut, groups = kd_sharding.placed_groups(kd_sharding._rows(docs), 8)
    points = [((bytes(g.digest), g.piece), g.weight, (g.v0, g.v1, g.v2), (g.x0, g.x1, g.x2)) for g in groups.collect()]
    _tree.scale = [max(p[2][i] for p in points) - min(p[2][i] for p in points) for i in range(3)]
    _tree.axes = []
    want = _tree(points, 8)
    assert _tree.axes[0] == 0 and set(_tree.axes) == {0, 1, 2}
    number = {r.doc_id: (bytes(r.digest), r.piece) for r in cut.collect()}
    assert {r.doc_id: r.shard for r in kd_sharding.shard(docs).collect()} == {i: want[k] for i, k in number.items()}


def test_shards_do_not_depend_on_the_partitioning(docs):
    a, b = (sorted(map(tuple, kd_sharding.shard(d).collect()), key=str) for d in (docs, docs.repartition(7)))
    assert a == b


def test_hot_group_is_cut(spark):
    rows = [(i, "copy of one text " * 5) for i in range(400)] + [(1000 + i, f"text number {i} " * 5) for i in range(600)]
    got = kd_sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    _check_shards(rows, got)
    size = [sum(r["size"] for r in got if r.shard == s) for s in range(8)]
    assert max(size) < 1.15 * sum(size) / 8


def test_shards_of_odd_rows(odd, empty):
    _check_shards([(r[0], r[1]) for r in ODD], kd_sharding.shard(odd).collect())
    assert kd_sharding.shard(empty).count() == 0


def test_sharding_is_native(docs):
    plan = kd_sharding.shard(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
