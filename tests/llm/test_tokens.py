import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.llm import packing, token_count, token_files
from loomline.llm.token_files import SeekableReader, SeekableWriter
from tests.llm.conftest import ODD

PIECES = ["a", "B", "Σ", "ς", " ", "  ", "\n", "\t", "\xa0", "　", "é", "é", "́", "1", "٣", "'s", "'LL", "<|endoftext|>", "#", "日", "İ", "ß", "\x1c", "\x85", "ﬁ", "😀", "word", " Word.", "élan,", "ŉ", "\nThe"]
mixed = st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=3)), max_size=14).map("".join).map(lambda s: s.encode("utf-8", "ignore").decode())


def _tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_count.tokenizer_path(name))


WORDS, BYTES = _tokenizer("word_bpe_49k.json"), _tokenizer("byte_bpe_50k.json")


@settings(max_examples=400, deadline=None)
@given(mixed)
def test_any_text_counts_and_encodes_as_the_library(text):
    ids = WORDS.encode(text, add_special_tokens=False).ids
    assert token_count.merger(token_count.tokenizer_path("word_bpe_49k.json")).count(text) == len(ids)
    enc = token_files.encoder(token_count.tokenizer_path("word_bpe_49k.json"), keep_space=False)
    assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == ids
    enc = token_files.encoder(token_count.tokenizer_path("byte_bpe_50k.json"), keep_space=True)
    assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == BYTES.encode(text, add_special_tokens=False).ids


def test_every_simple_character_between_letters_encodes_as_the_library():
    for name, keep_space, library in (("word_bpe_49k.json", False, WORDS), ("byte_bpe_50k.json", True, BYTES)):
        enc = token_files.encoder(token_count.tokenizer_path(name), keep_space)
        for c in map(chr, (9, 10, 13, *range(0x20, 0x7F), *range(0xC0, 0x250))):
            for text in (f"a{c}b", f"{c}li {c}", f"Word {c}{c}auna"):
                assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_counts(odd, docs, texts):
    for df, rows in ((odd, [(r[0], r[1]) for r in ODD]), (docs, list(texts.items()))):
        got = sorted(map(tuple, token_count.token_counts(df).collect()), key=str)
        want = []
        for doc_id, text in rows:
            n = len(WORDS.encode(text or "", add_special_tokens=False).ids)
            want.append((doc_id, len((text or "").encode()), n, n > 2048))
        assert got == sorted(want, key=str)


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def _check_files(rows, got):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [WORDS.encode(t or "", add_special_tokens=False).ids + [2] for _, t in rows]
    starts = np.cumsum([0, *map(len, ids)])[:-1].tolist()
    got = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in got] == [d for d, _ in rows]
    assert [r.start for r in got] == starts or len({d for d, _ in rows}) < len(rows)
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((d or 0, len(x), _crc(x)) for (d, _), x in zip(rows, ids, strict=True))


def test_files(spark, odd, docs, texts, tmp_path):
    files = token_files.write_tokens(odd, f"file://{tmp_path}/a", file_bytes=60_000)
    assert files.count() > 1
    _check_files([(r[0], r[1]) for r in ODD], token_files.read_tokens(spark, files).collect())
    files = token_files.write_tokens(docs, f"file://{tmp_path}/b", file_bytes=1 << 20)
    _check_files(list(texts.items()), token_files.read_tokens(spark, files).collect())


def test_seeking_reads_few_frames_and_checks_them(tmp_path):
    path = str(tmp_path / "x" / "f.zst")
    w = SeekableWriter(path, np.dtype("<u2"), frame_ids=100)
    rng = np.random.default_rng(0)
    held = [rng.integers(0, 60_000, n).astype("<u2") for n in rng.integers(0, 350, 200)]
    for i, x in enumerate(held):
        w.add(i * 2, x.tobytes())
    assert w.close() == sum(map(len, held))
    r = SeekableReader(path)
    for i in (0, 7, 199, 3):
        assert r.find(i * 2) == [i] and r.document(i).tolist() == held[i].tolist()
    assert r.frames_read < 20 < len(r.sums) and r.find(1) == []
    assert all(r.document(i).tolist() == x.tolist() for i, x in enumerate(held))
    r.close()
    import zstandard

    with open(path, "rb") as f:  # any zstandard reader skips the tables
        whole = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    assert whole == b"".join(x.tobytes() for x in held)
    data = bytearray(open(path, "rb").read())
    data[20] ^= 1
    open(path, "wb").write(bytes(data))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        SeekableReader(path).document(0)


def test_nothing(spark, empty, tmp_path):
    files = token_files.write_tokens(empty, f"file://{tmp_path}/c")
    assert files.count() == 0 and token_files.read_tokens(spark, files).count() == 0
    assert token_count.token_counts(empty).count() == 0
    assert packing.pack(empty).count() == 0


def check_pieces(rows, pieces):
    """Pieces cut each document's ids once, and fill sequences without gaps."""
    ids = [(d, BYTES.encode(t or "", add_special_tokens=False).ids + [1]) for d, t in rows]
    left = {}
    for d, x in ids:
        left.setdefault((d, len(x)), []).append(x)
    assert sum(p.length for p in pieces) == sum(len(x) for _, x in ids)
    for p in pieces:
        assert any(_crc(x[p.start : p.start + p.length]) == p.ids_crc32 for x in left[p.doc_id, p.doc_tokens])
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append(p)
    for s in by.values():
        s.sort(key=lambda p: p.offset)
        assert [p.offset for p in s] == np.cumsum([0, *(p.length for p in s)])[:-1].tolist()
        n = sum(p.length for p in s)
        assert n <= 2048 and (n == 2048 or n & (n - 1) == 0)
    spans = {}
    for p in pieces:
        spans.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, p.length))
    for (d, n), cuts in spans.items():
        assert sum(k for _, k in cuts) == n * len(left[d, n])
    return by


def test_packing(odd, docs, texts):
    check_pieces([(r[0], r[1]) for r in ODD], packing.pack(odd).collect())
    by = check_pieces(list(texts.items()), packing.pack(docs).collect())
    assert sum(sum(p.length for p in s) == 2048 for s in by.values()) > 0.98 * len(by)


def test_windows_follow_token_shares_or_given_ones(spark):
    """Sources of as many bytes but unlike tokens a byte."""
    plain, odd_ = "the city of the people and the old letters " * 40, "żółć ğış ŧŋđ ħłĸ " * 67
    rows = [(i, plain, "a") for i in range(150)] + [(1000 + i, odd_, "b") for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    n = {s: len(BYTES.encode(t, add_special_tokens=False).ids) + 1 for t, s in ((plain, "a"), (odd_, "b"))}
    assert n["b"] > 1.5 * n["a"]
    for targets, want in ((None, n["a"] / (n["a"] + n["b"])), ({"a": 1.0, "b": 9.0}, 0.1)):
        by = check_pieces([r[:2] for r in rows], packing.pack(df, targets=targets).collect())
        part = [sum(p.length for p in by[k] if p.doc_id < 1000) / 2048 for k in sorted(by) if sum(p.length for p in by[k]) == 2048]
        until = len(part) - 2 if targets is None else len(part) // 2
        assert all(abs(sum(part[:k]) - want * k) * 2048 <= 2 * packing.LEAST + 2 for k in range(1, until)), (targets, part)


def test_windows_follow_the_shares():
    queued = np.array([60_000, 30_000, 10_000])
    share = queued / queued.sum()
    served = np.zeros(3)
    for k, window in enumerate(packing.fill(queued, share, np.zeros(3)), 1):
        for s, n in window:
            served[s] += n
        if k * 2048 < 95_000:
            assert np.abs(served - share * k * 2048).max() <= 2 * packing.LEAST + 2
    assert (served == queued).all()


def test_credit_is_carried():
    even = packing.fill(np.array([5000, 5000]), np.array([0.5, 0.5]), np.array([0.0, 1500.0]))
    assert sum(n for s, n in even[0] if s == 1) > sum(n for s, n in even[0] if s == 0) + 1000
    assert packing.sequence_lengths(5000) == [2048, 2048, 512, 256, 128, 8]


def test_schemes_that_hadoop_and_pyarrow_name_otherwise():
    assert token_files.known_uri("s3a://box/a/b") == "s3://box/a/b" and token_files.known_uri("gcs://box/a") == "gs://box/a"
    assert token_files.known_uri("hdfs://host:1/a") == "hdfs://host:1/a" and token_files.known_uri("/tmp/s3a") == "/tmp/s3a"
    assert token_files.filesystem("file:///tmp/a")[1] == "/tmp/a"


def test_a_file_with_other_rules_is_left_to_the_library(tmp_path):
    import json

    with open(token_count.tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    assert token_files.encoder(token_count.tokenizer_path("byte_bpe_50k.json"), True).known_rules
    assert token_files.encoder(token_count.tokenizer_path("word_bpe_49k.json"), False).known_rules
    spec["pre_tokenizer"]["add_prefix_space"] = True
    spec["added_tokens"].append({**spec["added_tokens"][0], "id": 50257, "content": "[[mark]]"})
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    from tokenizers import Tokenizer

    library, enc = Tokenizer.from_file(path), token_files.PieceEncoder(path, True)
    for text in ("Some words", " some [[mark]] words", "", "é 12"):
        assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("keep_space", [True, False])
def test_many_pieces_are_encoded_once(keep_space):
    """A worker remembers the words of a large text, and gives the library's ids for each."""
    enc = token_files.PieceEncoder(token_count.tokenizer_path("byte_bpe_50k.json" if keep_space else "word_bpe_49k.json"), keep_space)
    letters = "abcdefghij"
    words = [letters[i // 100_000 % 10] + "".join(letters[int(c)] for c in f"{i:06d}") for i in range(200_000)]
    text, asked = " ".join(words), []
    model = enc.by_model.encode
    enc.by_model.encode = lambda piece: asked.append(piece) or model(piece)
    first = enc.encode(text)
    assert enc.encode(text) == first and len(asked) == len(set(asked))
    some = " ".join(words[::100] + ["1234", "don't", "a1b2", "É", "_x_", "  ", "end"])
    assert np.frombuffer(enc.encode(some), enc.dtype).tolist() == enc.tokenizer.encode(some, add_special_tokens=False).ids
