"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Every source gets a target number of words. A source's documents are dealt into shards by hash
(about DOCS_PER_SHARD each); in a shard they are laid end to end in seeded order and cut into blocks
of equal words: BLOCK, or a smaller power of two for a source whose target is below 100 blocks, whatever
the other sources' sizes are. In each shard the seats, as many blocks as the shard's part of the targets makes, go to
its sources of the same block by the highest quotients weight / (2 k + 1), at most two seats a block. A source's weight is its
blocks there times target / size, so a part-filled last block counts by the words of the shard's mean
block, plus what rounding left of its weights in the shards before; over all shards a source's seats are
thus within one of its weight. The integer quota then selects blocks by a seeded permutation: all blocks as often as it covers them whole, then
the first ones of the permutation. A document takes the words it has in selected blocks.

Scale: one pass over the texts counts words into a compact table (``mix``) or into sums by shard (``mixed``); the driver
sees one row a source. One shuffle deals rows to shards of bounded size, so a hot source is many small
groups; quotas of a shard are computed apart from all others, as what is left before it is known from
blocked prefix sums over one row a shard and source.

Defined results: a null text has size 0 and takes nothing; the null source is a source of its
own, last in order; a source without words has target 0; rows that repeat are rows of their own, and rows
that share a doc_id are ordered by size and by a hash of the text; an empty table gives an empty table.
Reruns agree whatever the partitioning. ``mixed`` carries all columns of its input in one struct, so no name can clash.
"""

from __future__ import annotations

import heapq
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import WORD, column_of, forget, n_words_col, ship, small_table, sum_before, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = 17
DOCS_PER_SHARD = 500
#: Words in a block; a power of two below it where a source's target is under 100 blocks.
BLOCK = 64
#: Rows of the table of sources up to which it is broadcast.
BROADCAST_ROWS = 10_000
_WORDS = re.compile(WORD)


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Target words of each source: share of all sizes by weight, most times its size at most, the excess shared anew."""
    order = sorted((s for s, _ in sizes if s is not None)) + [None] * any(s is None for s, _ in sizes)
    size = dict(sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(size.values()), list(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * size[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = most * size[s]
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in out]
    return out


def sainte_lague(weights: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by the highest quotients weight / (2 k + 1), at most most[i] for party i; ties go to the first party."""
    seats = min(int(seats), int(most.sum()))
    at = lambda d: np.minimum(np.floor(weights / d + 0.5), most).astype(np.int64)
    out = np.zeros(len(weights), np.int64)
    if seats <= 0 or not (weights > 0).any():
        return out
    low, high = 0.0, float(weights.max()) * 2 + 1  # a divisor that gives too many or enough, and one that gives too few
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if at(mid).sum() > seats:
            low = mid
        else:
            high = mid
    out = at(high)
    heap = [(-w / (2 * k + 1), i) for i, (w, k) in enumerate(zip(weights.tolist(), out.tolist(), strict=True)) if w > 0 and k < most[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(out.sum())):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < most[i]:
            heapq.heappush(heap, (-weights[i] / (2 * int(out[i]) + 1), i))
    return out


def _quotas(rows: pa.Table) -> pa.Table:
    """Rows (shard, source_no, blocks, before, ratio, block) of one shard and block with the source's quota of blocks.

    before: the source's blocks in the shards before this one; ratio: seats a block.
    """
    forget()
    rows = rows.sort_by("source_no")
    blocks, before, ratio, block = (column_of(rows, c).to_numpy() for c in ("blocks", "before", "ratio", "block"))
    # the shards before have got the nearest whole number of seats, as the quotients of 1/2 and more are the highest ones
    weight = np.maximum(ratio * (before + blocks) - np.floor(ratio * before + 0.5), 0)
    quota = sainte_lague(weight, int(np.floor(weight + 0.5).sum()), 2 * blocks)
    return pa.table({"shard": column_of(rows, "shard"), "source_no": column_of(rows, "source_no"), "quota": quota, "block": block})


def _taken(order_key: np.ndarray, size: np.ndarray, tie: np.ndarray, quota: int, block: int, seed: list[int]):
    """(whole times, extra words, order, selected blocks, begin of each document) of the documents of one source in one shard."""
    order = np.lexsort((tie, size, order_key))
    begin = np.empty(len(size), np.int64)
    ends = np.cumsum(size[order])
    begin[order] = ends - size[order]
    total = int(ends[-1]) if len(ends) else 0
    blocks = -(-total // block)
    whole, rest = divmod(quota, blocks) if blocks else (0, 0)
    selected = np.zeros(blocks + 1, np.int64)
    selected[np.random.default_rng(seed).permutation(blocks)[:rest]] = 1
    before = np.concatenate([[0], np.cumsum(selected)])
    words_before = lambda x: before[x // block] * block + selected[x // block] * (x % block)
    return whole, words_before(begin + size) - words_before(begin), selected, begin


def _seed(seed: int, source_no: int, shard: int) -> list[int]:
    return [seed, source_no, shard]


def block_of(target: float) -> int:
    """Words of a source's blocks: BLOCK, or the power of two that makes 100 blocks of its target or more."""
    return min(BLOCK, 1 << max(0, int(target // 100).bit_length() - 1))


def _sources(docs: DataFrame, seed: int) -> tuple[DataFrame, dict[str | None, int]]:
    """docs with key, shard and tie, and the number of rows of each source."""
    rows = dict(map(tuple, docs.groupBy("source").count().collect()))
    shards = [(s, max(1, math.ceil(n / DOCS_PER_SHARD))) for s, n in rows.items()]
    table = _small(small_table(docs.sparkSession, shards, "name string, shards int"))
    dealt = docs.join(table, docs["source"].eqNullSafe(table["name"])).drop("name").withColumn("key", F.xxhash64(F.coalesce("doc_id", F.xxhash64("text")), F.lit(seed)))
    return dealt.withColumn("shard", F.pmod(F.xxhash64("key", F.lit(1)), F.col("shards")).cast("int")).drop("shards"), rows


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _quotas_of(held: DataFrame, weights, share, most) -> tuple[DataFrame, DataFrame]:
    """From words by source and shard: the sources (name, source_no, target, total), and the quotas by source_no and shard."""
    spark = held.sparkSession
    size = {s: n or 0 for s, n in map(tuple, held.groupBy("source").agg(F.sum("words")).collect())}
    target = targets(list(size.items()), weights, share, most)
    order = sorted((s for s in target if s is not None)) + [None] * (None in target)
    rows = [(s, i, float(target[s]), int(size[s]), block_of(target[s])) for i, s in enumerate(order)]
    table = _small(small_table(spark, rows, "name string, source_no int, target double, total long, block long"))
    parts = held.join(table, held["source"].eqNullSafe(table["name"])).where("total > 0")
    parts = parts.select("shard", "source_no", F.ceil(F.col("words") / F.col("block")).cast("long").alias("blocks"), (F.col("target") / F.col("total")).alias("ratio"), "block")
    parts = sum_before(parts, "shard", "blocks", "before", by=("source_no",))
    quotas = parts.groupBy("shard", "block").applyInArrow(_quotas, "shard int, source_no int, quota long, block long")
    return table, quotas


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """One row a row of docs: doc_id, size, source_size, target, taken."""
    ship(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text.alias("text"))
    dealt, _ = _sources(rows, seed)
    compact = written(dealt.select("doc_id", "source", "shard", "key", n_words_col(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")), "sizes")
    table, quotas = _quotas_of(written(compact.groupBy("source", "shard").agg(F.sum("size").alias("words")), "words"), weights, share, most)

    def taken(rows: pa.Table, quota: pa.Table) -> pa.Table:
        size = column_of(rows, "size").to_numpy()
        out = np.zeros(len(rows), np.int64)
        if len(quota) and len(rows):
            n, block, no, shard = (column_of(quota, c)[0].as_py() for c in ("quota", "block", "source_no", "shard"))
            whole, extra, _, _ = _taken(column_of(rows, "key").to_numpy(), size, column_of(rows, "tie").to_numpy(), n, block, _seed(seed, no, shard))
            out = whole * size + extra
        return pa.table({"doc_id": column_of(rows, "doc_id"), "size": size, "source_size": column_of(rows, "total"), "target": column_of(rows, "target"), "taken": out})

    known = compact.join(table, compact["source"].eqNullSafe(table["name"])).drop("name", "source", "block")
    return known.groupBy("source_no", "shard").cogroup(quotas.groupBy("source_no", "shard")).applyInArrow(taken, "doc_id long, size long, source_size long, target double, taken long")


def _runs(text: str, selected: np.ndarray, begin: int, block: int) -> list[str]:
    """The passages of a text that lie in selected blocks: each run of neighbouring words is one, as it stands in the text."""
    runs: list[list[int]] = []
    last = None
    for i, m in enumerate(_WORDS.finditer(text)):
        if selected[(begin + i) // block]:
            if last == i - 1:
                runs[-1][1] = m.end()
            else:
                runs.append([m.start(), m.end()])
            last = i
    return [text[a:b] for a, b in runs]


def _parts(body: pa.Table, of: np.ndarray, selected: np.ndarray, begin: np.ndarray, block: int) -> pa.Table:
    """A row for each passage of the documents of (numbers of rows). A long text has many, so none gets the whole text first."""
    held = [_runs(t.as_py(), selected, int(begin[i]), block) for t, i in zip(body["text"].take(of), of.tolist(), strict=True)]
    at = np.repeat(of, list(map(len, held)))
    texts = [x for runs in held for x in runs]
    new = {"text": texts, "n_chars": list(map(len, texts))}
    columns = [pa.array(new[f.name], f.type) if f.name in new else c.take(at) for f, c in zip(body.schema, body.columns, strict=True)]
    return pa.Table.from_arrays(columns, schema=body.schema)


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """The mix itself, with the columns of docs: a row each time a document is taken whole, and one for each passage where a part is."""
    ship(docs.sparkSession)
    names, schema = docs.columns, docs.schema
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("body"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text.alias("text"))
    dealt, _ = _sources(rows, seed)
    held = written(dealt.groupBy("source", "shard").agg(F.sum(n_words_col(F.col("text"))).alias("words")), "words")
    table, quotas = _quotas_of(held, weights, share, most)

    def rows_taken(rows: pa.Table, quota: pa.Table) -> pa.Table:
        forget()
        held = column_of(rows, "body").combine_chunks()
        held = held if isinstance(held, pa.StructArray) else held.chunk(0)
        body = pa.Table.from_arrays(held.flatten(), names=names)
        if not len(quota) or not len(rows):
            return body.slice(0, 0)
        size = column_of(rows, "size").to_numpy()
        n, block, no, shard = (column_of(quota, c)[0].as_py() for c in ("quota", "block", "source_no", "shard"))
        whole, extra, selected, begin = _taken(column_of(rows, "key").to_numpy(), size, column_of(rows, "tie").to_numpy(), n, block, _seed(seed, no, shard))
        times = np.where(size > 0, whole + (extra == size), 0)
        partly = np.flatnonzero((extra > 0) & (extra < size))
        out = [body.take(np.repeat(np.arange(len(size)), times))]
        if len(partly):
            out.append(_parts(body, partly, selected, begin, block))
        return pa.concat_tables(out)

    numbered = _small(table.select("name", "source_no"))
    known = dealt.select("body", "key", "shard", "source", n_words_col(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    known = known.join(numbered, known["source"].eqNullSafe(numbered["name"])).drop("source", "name")
    return known.groupBy("source_no", "shard").cogroup(quotas.groupBy("source_no", "shard")).applyInArrow(rows_taken, schema)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_mixing": op2_mixing}
#: Seeded permutations of numpy select the blocks; tests hold the results against their definition.
SQL: dict[str, str] = {}
