"""Exact dedup by a minimal perfect hash over the distinct digests of a history.

``build_index`` groups a history's rows by the SHA-256 of the normalised text, deals the distinct
digests into buckets by their first bytes and builds in each bucket a minimal perfect hash
(levels of bit arrays; a key's slot is the rank of its bit). A slot holds the full digest and the
locator of the winner: its doc_id, row number and group size. ``lookup`` sends the distinct
digests of new rows to their bucket and compares all 32 bytes of the slot's digest, so a key
that is not a member never matches. Members are repeats of the history's winner; nonmembers
keep the winner of their own group.

Scale: rows of one digest are combined before each shuffle, so a group that holds a third of all
rows costs one row a task. A bucket holds about PER_BUCKET distinct digests, as the number of buckets
follows from the number of rows. Winners of digests with many rows (HOT_PART of all, so at most so many
digests) are broadcast, so that no key of the join of winners to rows is hot. Texts are hashed
once. ``exact_dedup`` shuffles digests alone; ``keep_first`` also joins those rows whose number falls into a slot
of a dropped one, in a filter of bounded size, and passes all others as they are scanned.

Defined results: null text counts as empty; of equal texts the row with the smallest doc_id
stays, null doc_ids come last, and of rows that also share the doc_id exactly one stays; an
empty table gives an empty table. Clashing extra columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import SPACE, column_of, discard, forget, numbered, ship, without, written

DIGEST = 32
#: Distinct digests a bucket holds about; it bounds the memory of one index build.
PER_BUCKET = 5_000
#: A digest with more than this part of all rows is hot.
HOT_PART = 1_000
_LEVELS = 64
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def normalised(text):
    """The text with each run of white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " ")


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: slot of a key is the rank of its bit over all levels."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.offsets = np.cumsum([0, *(int(x.sum()) for x in levels)])
        self.ranks = [np.cumsum(x) - x for x in levels]

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(keys):
            if len(levels) == _LEVELS:
                raise ValueError("the keys are not distinct")
            size = max(1, int(len(keys) * gamma))
            at = _mix(keys, len(levels)) % np.uint64(size)
            counts = np.bincount(at.astype(np.int64), minlength=size)
            levels.append(counts == 1)
            keys = keys[counts[at.astype(np.int64)] != 1]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot for each key, -1 where no level has its bit; keys that are not members may get any slot."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(left):
                break
            at = (_mix(keys[left], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = self.offsets[level] + self.ranks[level][at[hit]]
            left = left[~hit]
        return out

    def dumps(self) -> bytes:
        head = np.array([len(self.levels), *(len(x) for x in self.levels)], np.int64)
        return head.tobytes() + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def loads(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        sizes = np.frombuffer(data, np.int64, n, 8)
        at, levels = 8 * (n + 1), []
        for size in sizes.tolist():
            k = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, k, at), count=size).astype(bool))
            at += k
        return cls(levels)


def _digests(table: pa.Table) -> np.ndarray:
    """(n, 32) bytes."""
    return np.frombuffer(b"".join(column_of(table, "digest").to_pylist()), np.uint8).reshape(-1, DIGEST)


def _keys(digests: np.ndarray) -> np.ndarray:
    # the first four bytes choose the bucket, the next eight the slot
    return np.ascontiguousarray(digests[:, 4:12]).view(np.uint64).ravel()


def _build_bucket(table: pa.Table) -> pa.Table:
    forget()
    digests = _digests(table)
    winners = np.stack([column_of(table, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("keep_id", "keep_row", "n")], 1)
    gone = ~np.asarray(column_of(table, "keep_id").is_valid())
    winners[gone, 0] = 0
    keys = _keys(digests)
    # keys that share eight bytes can't be told apart by the hash; they overflow into a list of their own
    _, first = np.unique(keys, return_index=True)
    alone = np.zeros(len(keys), bool)
    alone[first] = True
    mph = PerfectHash.build(keys[alone])
    slots = mph.slots(keys[alone])
    order = np.empty(len(slots), np.int64)
    order[slots] = np.flatnonzero(alone)
    order = np.concatenate([order, np.flatnonzero(~alone)])
    return pa.table(
        {
            "bucket": column_of(table, "bucket").slice(0, 1),
            "mph": pa.array([mph.dumps()], pa.binary()),
            "digests": pa.array([digests[order].tobytes()], pa.binary()),
            "winners": pa.array([winners[order].tobytes()], pa.binary()),
            "null_ids": pa.array([gone[order].tobytes()], pa.binary()),
        }
    )


def _lookup_bucket(new: pa.Table, index: pa.Table) -> pa.Table:
    forget()
    digests = _digests(new)
    keep_id = column_of(new, "keep_id").to_pylist()
    keep_row, n = (column_of(new, c).to_numpy(zero_copy_only=False).astype(np.int64).copy() for c in ("keep_row", "n"))
    member = np.zeros(len(digests), bool)
    if len(index) and len(digests):
        get = lambda c: column_of(index, c)[0].as_py()
        mph = PerfectHash.loads(get("mph"))
        held = np.frombuffer(get("digests"), np.uint8).reshape(-1, DIGEST)
        winners = np.frombuffer(get("winners"), np.int64).reshape(-1, 3)
        nulls = np.frombuffer(get("null_ids"), bool)
        slot = mph.slots(_keys(digests))
        hit = np.flatnonzero(slot >= 0)
        member[hit] = (held[slot[hit]] == digests[hit]).all(1)
        for i, row in enumerate(held[int(mph.offsets[-1]) :], int(mph.offsets[-1])):
            twin = (digests == row).all(1)
            member |= twin
            slot[twin] = i
        for i in np.flatnonzero(member).tolist():
            keep_id[i] = None if nulls[slot[i]] else int(winners[slot[i], 0])
        keep_row[member] = winners[slot[member], 1]
        n[member] += winners[slot[member], 2]
    return pa.table({"digest": column_of(new, "digest"), "keep_id": pa.array(keep_id, pa.int64()), "keep_row": keep_row, "n": n, "member": member})


def digested(docs: DataFrame, row: str | None = None) -> DataFrame:
    """Table of doc_id, row (unique; the column of that name, or a number) and digest of every row; written, as it is read more than once."""
    sha = F.sha2(normalised(F.col("text").cast("string")), 256)
    number = F.col(row) if row else F.monotonically_increasing_id()
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(sha).alias("digest"), number.alias("row")), "digests")


def _grouped(rows: DataFrame, buckets: int) -> DataFrame:
    """One row a distinct digest with its winner, combined before the shuffle."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("row").alias("row")))
    return (
        rows.groupBy("digest")
        .agg(first.alias("w"), F.count(F.lit(1)).alias("n"))
        .select("digest", F.col("w.id").alias("keep_id"), F.col("w.row").alias("keep_row"), "n", F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(buckets)).cast("int").alias("bucket"))
    )


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """Rows of history (doc_id, row, digest) as one row a bucket: mph, digests, winners, null_ids."""
    return _grouped(history, buckets).groupBy("bucket").applyInArrow(_build_bucket, "bucket int, mph binary, digests binary, winners binary, null_ids binary")


def lookup(new: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """One row a distinct digest of new: digest, keep_id, keep_row, n, member."""
    return (
        _grouped(new, buckets)
        .groupBy("bucket")
        .cogroup(index.groupBy("bucket"))
        .applyInArrow(_lookup_bucket, "digest binary, keep_id long, keep_row long, n long, member boolean")
    )


def dedup_rows(rows: DataFrame) -> DataFrame:
    """rows (doc_id, row, digest) with keep_id, group_size and kept.

    The history is the half of the rows with the smaller doc_ids: what was there first. The rest is looked up.
    """
    middle, total = rows.agg(F.percentile_approx("doc_id", 0.5, 10_000), F.count(F.lit(1))).first()
    buckets = max(1, -(-total // PER_BUCKET))
    old = F.coalesce(F.col("doc_id") <= F.lit(middle).cast("long"), F.lit(False))
    index = written(build_index(rows.where(old), buckets), "index")
    looked = lookup(rows.where(~old), index, buckets)
    # members take the history's winner; of digests that only the history has, it is their group's
    past = _grouped(rows.where(old), buckets).select("digest", "keep_id", "keep_row", "n", F.lit(True).alias("member"))
    winners = (
        past.unionByName(looked)
        .groupBy("digest")
        .agg(F.max("n").alias("group_size"), F.min(F.struct(F.col("keep_id").isNull().alias("no"), F.col("keep_id").alias("id"), F.col("keep_row").alias("row"))).alias("w"))
        .select("digest", "group_size", F.col("w.id").alias("keep_id"), F.col("w.row").alias("keep_row"))
    )
    winners = written(winners, "winners")
    discard(index)
    many = F.col("group_size") > max(1, total // HOT_PART)
    hot = F.broadcast(winners.where(many))
    few = rows.join(hot.select("digest"), "digest", "left_anti").join(winners.where(~many), "digest")
    both = few.unionByName(rows.join(hot, "digest").select(*few.columns))
    return both.select("doc_id", "row", "digest", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row a row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    ship(docs.sparkSession)
    return dedup_rows(digested(docs)).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    ship(docs.sparkSession)
    rows, row = numbered(docs)
    return without(rows, row, written(dedup_rows(digested(rows, row)).where("not kept").select("row"), "dropped"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_GROUPS = r"""
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)"""

QUERIES = {"op5_exact_dedup": op5_exact_dedup}
SQL = {"op5_exact_dedup": ORACLE_GROUPS}
