"""Mixture-controlled packing of token ids into sequences of at most 2048.

Documents are dealt by hash into buckets of about BUCKET_BYTES of text. In a bucket each source's
documents form a queue of ids; windows of 2048 are filled by deficit round-robin: every window gives
each source with ids left its share of the window as credit, and the source with the most credit
is served first, at least LEAST ids at a time. Shares are the sources' true parts of all ids, or those given;
a source that a given share asks more of than it has ends early, as every id is packed once. Credit is
carried from window to window; a bucket starts with the credit that the buckets before it leave, known
from the ids of each source in them, up to a window's ids either way: as a bucket packs its own documents, more
could only push a source to its begin or end, whose windows would then hold few sources. Documents are cut freely, so all windows but a bucket's last are full; the last is split into sequences of
powers of two, which need no padding.

Encoding uses the tokenizers library (see token_files.PieceEncoder), each document once.

Scale: a scan counts bytes, the next encodes into a table of ids, whose counts give shares and credit,
and one shuffle deals ids to buckets; a bucket is all that a task holds, and sources of any size spread evenly over buckets, as a document's bucket doesn't depend on its
source. The carried credit is a blocked prefix sum over one row a bucket and source.

Defined results: null text counts as empty and gives the end id alone; null source is a source;
rows that share a doc_id are documents of their own (each starts at 0); an empty table gives an
empty table; only doc_id, text and source are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import by_bytes, column_of, ship, sum_before, written
from loomline.llm.token_count import tokenizer_path
from loomline.llm.token_files import encoder

LENGTH = 2048
END_ID = 1
BUCKET_BYTES = 8 << 20
#: Ids that a source is served at once at least, while it and the window have them.
LEAST = 256
_SCHEMA = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def fill(queued: np.ndarray, share: np.ndarray, credit: np.ndarray, length: int = LENGTH, least: int = LEAST) -> list[list[tuple[int, int]]]:
    """Windows as lists of (source, ids served); all full but the last. queued: ids of each source."""
    left, share, credit = queued.astype(np.int64).copy(), share.astype(float), credit.astype(float).copy()
    windows = []
    while (alive := left > 0).any():
        part = np.where(alive, share, 0.0)
        part = part / part.sum() if part.sum() > 0 else alive / alive.sum()
        credit += part * length
        room, window = length, []
        while room and alive.any():
            s = int(np.argmax(np.where(alive, credit, -np.inf)))
            n = int(min(left[s], room, max(least, int(credit[s]))))
            window.append((s, n))
            left[s] -= n
            credit[s] -= n
            room -= n
            alive[s] = left[s] > 0
        windows.append(window)
    return windows


def sequence_lengths(total: int, length: int = LENGTH) -> list[int]:
    """Lengths of the sequences that total ids fill: full windows, then powers of two."""
    out = [length] * (total // length)
    rest = total % length
    return out + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, source, bucket) with ids and their number in place of the text."""
    enc = encoder(path, keep_space=True)
    end = np.array([end_id], enc.dtype).tobytes()
    for batch in by_bytes(batches, most=1 << 20):
        ids = [enc.encode(text.as_py()) + end for text in column_of(batch, "text")]
        n = pa.array([len(x) // enc.dtype.itemsize for x in ids], pa.int64())
        yield pa.RecordBatch.from_arrays([*(column_of(batch, c) for c in ("doc_id", "source", "bucket")), pa.array(ids, pa.binary()), n], ["doc_id", "source", "bucket", "ids", "n"])


def pack_bucket(docs: pa.Table, credits: pa.Table, path: str, targets: dict[str | None, float] | None = None) -> pa.Table:
    if not len(docs):
        return _SCHEMA.empty_table()
    dtype = encoder(path, keep_space=True).dtype
    docs = docs.sort_by([("doc_id", "ascending"), ("ids", "ascending")])
    names = column_of(docs, "source").to_pylist()
    order = {s: i for i, s in enumerate(sorted(set(names), key=lambda s: (s is None, s or "")))}
    share, credit = np.zeros(len(order)), np.zeros(len(order))
    queues: list[list[tuple[int | None, np.ndarray]]] = [[] for _ in order]
    for doc_id, ids, s in zip(column_of(docs, "doc_id"), column_of(docs, "ids"), names, strict=True):
        queues[order[s]].append((doc_id.as_py(), np.frombuffer(ids.as_py(), dtype).astype("<u4")))
    queued = np.array([sum(len(x) for _, x in q) for q in queues], np.int64)
    for s, a, b in zip(*(column_of(credits, c).to_pylist() for c in ("source", "share", "credit")), strict=True):
        if s in order:
            share[order[s]], credit[order[s]] = a if targets is None else targets.get(s, 0.0), b
    bucket = column_of(docs, "bucket")[0].as_py()
    lengths = sequence_lengths(int(queued.sum()))
    out: list[tuple] = []
    at = [[0, 0] for _ in order]  # of each queue: document, ids of it served
    seq, room = 0, lengths[0]
    for window in fill(queued, share, credit):
        for s, n in window:
            while n:
                k, done = at[s]
                doc_id, ids = queues[s][k]
                m = min(n, len(ids) - done, room)
                out.append((doc_id, done, m, zlib.crc32(memoryview(ids[done : done + m]).cast("B")), len(ids), bucket << 32 | seq, lengths[seq] - room))
                at[s] = [k, done + m] if done + m < len(ids) else [k + 1, 0]
                n -= m
                room -= m
                if not room:
                    seq += 1
                    room = lengths[seq] if seq < len(lengths) else 0
    return pa.Table.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)], schema=_SCHEMA)


def pack(docs: DataFrame, path: str | None = None, name: str = "byte_bpe_50k.json", end_id: int = END_ID, targets: dict[str | None, float] | None = None) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. targets: weights of the sources, their ids by default."""
    ship(docs.sparkSession)
    path = path or tokenizer_path(name)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("source").cast("string").alias("source"))
    size = F.octet_length("text") + 1
    n_bytes = rows.agg(F.sum(size.cast("long"))).first()[0] or 0
    buckets = max(1, -(-n_bytes // BUCKET_BYTES))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(buckets)).cast("int"))
    coded = written(rows.mapInArrow(lambda it: encode_batches(it, path, end_id), "doc_id long, source string, bucket int, ids binary, n long"), "ids")
    held = written(coded.groupBy("bucket", "source").agg(F.sum("n").alias("n")), "held")
    parts = held.groupBy(F.col("source").alias("name")).agg(F.sum("n").alias("whole"))
    total = held.agg(F.sum("n")).first()[0] or 0
    known = sum_before(held, "bucket", "n", "before", by=("source",)).join(parts, F.col("source").eqNullSafe(F.col("name")))
    owed = F.col("whole") * F.col("bucket") / float(buckets) - F.col("before")
    owed = F.greatest(F.least(owed, F.lit(float(LENGTH))), F.lit(-float(LENGTH)))
    credits = known.select("bucket", "source", (F.col("whole") / float(max(total, 1))).alias("share"), owed.alias("credit"))
    return coded.drop("n").groupBy("bucket").cogroup(credits.groupBy("bucket")).applyInArrow(lambda a, b: pack_bucket(a, b, path, targets), ", ".join(f"{c} long" for c in _SCHEMA.names))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_packing": op3_packing}
SQL: dict[str, str] = {}
