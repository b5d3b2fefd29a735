import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = (
    "The city library opened a new room for the old maps and the letters of the people who lived in the valley. "
    "It is a quiet place with tall windows, and on most days there are only a few readers at the long tables. "
    "The keeper of the room told us that the oldest of the maps was drawn by hand in the year of the great flood. "
)


def prose(n: int, k: int = 40) -> str:
    """Distinct invented prose, by number."""
    import random

    r = random.Random(n)
    parts = ["an", "ther", "ing", "ou", "el", "mo", "sti", "ra", "ne", "ko", "la", "vi"]
    stop = ["the", "of", "and", "to", "in", "is"]
    words = [r.choice(stop) if r.random() < 0.3 else "".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(k)]
    return " ".join(words) + "."


ODD = [
    (None, PROSE, "en", "a", 1),
    (1, None, "en", "a", None),
    (2, "", None, None, 0),
    (3, " \t\n\x0b ", "en", None, 5),
    (4, PROSE, "en", "a", 9),
    (4, PROSE, "en", "a", 9),
    (5, PROSE.replace(" ", "\n\t "), "en", "b", 9),
    (6, "un deux trois", "fr", "b", 13),
    (7, "word " * 30_000, "en", "a", 150_000),
    (8, prose(1, 20_000), "en", "a", 1),
    (9, "Ünïcode 日本語 \U0001f600 <|endoftext|> x\x1cy ǅ İ é", "de", "c", 1),
    (10, "12345 678", "en", "c", 9),
    (-3, prose(2), "es", "z", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties and repeated rows, with extra columns whose names operators use."""
    names = "kept size n digest row shard piece bucket ids credit h s v p d m slot word m_ _row _slot _gone _mix_size _mix_no _mix_key _keep_digest2 _one_id _one_row body".split()
    rows = [(*r, *[f"{c}{i}" for c in names]) for i, r in enumerate(ODD)]
    return spark.createDataFrame(rows, SCHEMA + "".join(f", {c} string" for c in names))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}
