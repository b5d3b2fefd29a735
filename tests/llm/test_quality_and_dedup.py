import hashlib
import re
from collections import Counter

from loomline.llm import exact_dedup, quality
from loomline.llm.exact_dedup import PerfectHash
from tests.llm.conftest import ODD, PROSE, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_measures_of_odd_rows(odd):
    rows = quality.quality(odd).collect()
    assert len(rows) == len(ODD)
    for r, (doc_id, text, *_) in zip(rows, ODD, strict=True):
        text = text or ""
        w = WORD.findall(text)
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r.doc_id, r.n_words, r.word_chars) == (doc_id, len(w), sum(map(len, w)))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text))
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == len(covered)
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (r.kept and r.base_failed)


def test_keeps_prose_and_drops_symbols(spark):
    docs = spark.createDataFrame([(1, PROSE), (2, " ".join(f"{w}###" for w in PROSE.split())), (3, prose(5, 200))], "doc_id long, text string")
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == {1, 3}


OTHER = {
    "it": "Ogni mattina il vecchio maestro saliva sulla collina con due libri sotto braccio e guardava le barche che tornavano piano verso il porto, mentre sua figlia preparava il pane fresco nella cucina piccola. Quando pioveva restava dentro casa, scriveva lunghe lettere agli amici lontani e ascoltava il vento, perché diceva che ogni tempesta porta una storia nuova da raccontare ai ragazzi dopo cena, prima che la notte scenda sopra il paese tranquillo.",
    "ru": "Каждое утро старый учитель поднимался на холм с двумя книгами под рукой и смотрел, как лодки медленно возвращались в гавань, пока его дочь пекла свежий хлеб в маленькой кухне. Когда шёл дождь, он оставался дома, писал длинные письма далёким друзьям и слушал ветер, потому что говорил, что каждая буря приносит новую историю, которую можно рассказать детям после ужина, прежде чем ночь опустится над тихим посёлком.",
    "pl": "Każdego ranka stary nauczyciel wchodził na wzgórze z dwiema książkami pod pachą i patrzył, jak łodzie powoli wracały do portu, podczas gdy jego córka piekła świeży chleb w małej kuchni. Kiedy padało, zostawał w domu, pisał długie listy przyjaciołom i słuchał wiatru, ponieważ mówił, że każda burza przynosi nową opowieść, którą można opowiedzieć dzieciom po kolacji, zanim noc zapadnie nad cichą wioską.",
    "th": " ".join("ทุกเช้าครูชราจะเดินขึ้นเนินเขาพร้อมหนังสือสองเล่ม" + str(i) for i in range(30)),
}


def test_keeps_prose_in_any_language_and_of_any_length(spark):
    rows = [*OTHER.items(), ("long", " ".join(prose(i, 1000) for i in range(900)))]
    assert len(rows[-1][1]) > 5_000_000
    kept = quality.quality(spark.createDataFrame([(k, t) for k, t in rows], "doc_id string, text string")).collect()
    assert all(r.kept for r in kept), [r for r in kept if not r.kept]
    salad = "the of and to in is that it for on with as by at this be are from or an " * 1
    words = salad.split()
    import random

    mixed = " ".join(random.Random(3).sample(words * 3, 60))
    assert not quality.quality(spark.createDataFrame([(1, mixed)], "doc_id long, text string")).first().kept


def test_keep_good_keeps_columns(odd):
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.quality(odd).where("kept").collect()}


def test_plan_is_native(odd):
    plan = quality.quality(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_empty(empty):
    assert quality.quality(empty).count() == 0
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.keep_first(empty).count() == 0


def test_perfect_hash():
    import numpy as np

    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64))
    mph = PerfectHash.loads(PerfectHash.build(keys).dumps())
    assert sorted(mph.slots(keys).tolist()) == list(range(len(keys)))


def _expected(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        groups.setdefault(hashlib.sha256(norm.encode()).hexdigest(), []).append(doc_id)
    return groups


def test_exact_dedup_of_odd_rows(odd):
    groups = _expected(ODD)
    rows = exact_dedup.exact_dedup(odd).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == min((x for x in ids if x is not None), default=None)
    assert sum(r.kept for r in rows) == len(groups)
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns
    held = {tuple(r) for r in odd.collect()}
    assert kept.count() == len(groups) and all(tuple(r) in held for r in kept.collect())


def test_keep_first_keeps_the_row_that_the_groups_name(spark):
    rows = [(7, "a b", "x"), (3, "a  b", "y"), (3, "a\tb", "z"), (None, "a b", "u"), (9, "c", "v"), (None, "d", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _keep_digest2 string").repartition(3)
    kept = sorted(map(str, exact_dedup.keep_first(docs).collect()))
    assert len(kept) == 3 and "'c'" in str(kept) and "'d'" in str(kept) and "doc_id=3" in str(kept)
    unique = spark.createDataFrame([(i, f"t{i % 300}", "x") for i in range(1, 2_000)], "doc_id long, text string, _row string")
    assert sorted(r.doc_id for r in exact_dedup.keep_first(unique).collect()) == list(range(1, 301))


def test_history_is_half_of_the_rows_whatever_their_ids(spark):
    rows = exact_dedup.digested(spark.createDataFrame([(i if i < 999 else 10**15, f"t{i % 400}") for i in range(1000)], "doc_id long, text string"))
    got = exact_dedup.dedup_rows(rows).collect()
    assert len(got) == 1000 and sum(r.kept for r in got) == 400 and {r.group_size for r in got} == {2, 3}
    hot = exact_dedup.dedup_rows(exact_dedup.digested(spark.createDataFrame([(i, "one" if i % 3 else f"t{i}") for i in range(3000)], "doc_id long, text string")))
    assert hot.where("group_size = 2000 and keep_id = 1").count() == 2000 and hot.where("kept").count() == 1001


def test_history_members_and_nonmembers(spark):
    docs = spark.createDataFrame([(i, f"text {i % 7}" if i < 90 else f"new {i % 3}") for i in range(100)], "doc_id long, text string")
    rows = exact_dedup.exact_dedup(docs).collect()
    assert {r.keep_id for r in rows} == {*range(7), 90, 91, 92}
    assert {r.doc_id for r in rows if r.kept} == {*range(7), 90, 91, 92}


def test_bucketed_index(spark):
    rows = exact_dedup.digested(spark.createDataFrame([(i, f"t{i % 400}") for i in range(1000)], "doc_id long, text string"))
    index = exact_dedup.build_index(rows.where("doc_id < 300"), 5)
    found = exact_dedup.lookup(rows.where("doc_id >= 300"), index, 5).collect()
    assert len(found) == 400 and sum(r.member for r in found) == 300
    assert {r.keep_id for r in found} == set(range(400))
