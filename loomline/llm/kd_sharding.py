"""K-d tree sharding: recursive splits at weighted medians along the widest metadata dimension.

Rows of equal texts are one group and stay together, unless a group alone is larger than PIECE of a
shard; then it is cut into pieces by hash of the doc_id. A group's weight is the bytes of its rows, and its
place has the dimensions language, source and length of its first row (by doc_id). Languages and sources are
numbered in the order of their code points, null first; length is the logarithm of the bytes. The width of a
node along a dimension is the span of its values there over the span of all. A node of k shards
is cut along its widest dimension (the first of equal ones) where the weight below is floor(k/2)/k of it. Groups of
one value are told apart by a hash of their digest, which is no dimension: it only places a cut that falls
within a value. A leaf is a shard: the law is ``bytes``.

The weighted medians are distributed: two histograms of BINS bins a node, the second inside the bin that
the first one points to, so the driver sees levels x nodes x BINS sums and no row, and a cut is
within 1/BINS**2 of the exact one.

Scale: groups shuffle as digests, combined before; texts are never shuffled. Digests with many bytes or rows
are few by their definition (shards / PIECE and HOT_PART at most), so their joins are broadcast and no
key of the others is hot. Names of languages and sources are ranked by range partitions. Slots are numbered in
sub-buckets of bounded size with offsets summed over the sub-buckets, not in one window a
shard. All of it is built-in functions.

Defined results: a null text has size 1 and joins the empty texts' group; null languages and sources are
values of their own; rows that repeat keep a slot each; an empty table gives an empty table. The result does not
depend on the partitioning, but for rows without doc_id, which are dealt as they come. Only
doc_id, text, lang and source are read, lang and source only where they exist.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.llm.common import discard, written
from loomline.sources.tables import ranked

SHARDS = 8
BINS = 512
#: Part of a shard that a group of equal texts may hold before it is cut.
PIECE = 0.1
#: Rows of a sub-bucket in which slots are numbered, about.
SLOT_ROWS = 4_000
#: A digest with more than this part of all rows is hot.
HOT_PART = 1_000
#: Rows of a table of names up to which it is broadcast.
BROADCAST_ROWS = 10_000
NAMES = ("lang", "source")
#: Coordinates that are cut, and the values whose spans are widths.
DIMENSIONS = ("x0", "x1", "x2")
VALUES = ("v0", "v1", "v2")


def _unit(*columns):
    """A hash of the columns in [0, 1)."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)).cast("double") / float(1 << 40)


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = lambda c: (F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")).alias(c)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("digest"), name("lang"), name("source"),
    ).withColumn("row", F.monotonically_increasing_id())


def _literal_map(values: dict[int, float]):
    return F.create_map(*[F.lit(x) for k, v in values.items() for x in (int(k), float(v))])


def widest(spans: list[float], scale: list[float]) -> int:
    """The dimension with the widest span for its scale; the first of equal ones."""
    widths = [s / w if w else 0.0 for s, w in zip(spans, scale, strict=True)]
    return widths.index(max(widths))


def _histogram(groups: DataFrame, axis: dict[int, int], low: dict[int, float], high: dict[int, float]) -> dict[int, list[float]]:
    """Weight by node and bin of its axis between low and high; bin -1 is what lies below."""
    x = F.element_at(F.array(*[F.col(d) for d in DIMENSIONS]), F.element_at(_literal_map(axis), F.col("node")).cast("int") + 1)
    lo, hi = F.element_at(_literal_map(low), F.col("node")), F.element_at(_literal_map(high), F.col("node"))
    b = F.when(x < lo, F.lit(-1)).when(x >= hi, F.lit(BINS)).otherwise(F.least(F.floor((x - lo) / (hi - lo) * BINS), F.lit(BINS - 1))).cast("int")
    found = groups.where(F.col("node").isin(list(axis))).groupBy("node", b.alias("bin")).agg(F.sum("weight").alias("w")).collect()
    out = {n: [0.0] * (BINS + 2) for n in axis}
    for n, b, w in ((r[0], r[1], r[2]) for r in found):
        out[n][b + 1] += w
    return out


def leaves(groups: DataFrame, shards: int) -> DataFrame:
    """groups (weight, v0..v2, x0..x2) with the shard of each; cuts are literals of one projection a level."""
    whole = groups.agg(*[f(d) for d in VALUES for f in (F.min, F.max)]).first()
    scale = [float(whole[2 * i + 1] - whole[2 * i]) if whole[2 * i] is not None else 0.0 for i in range(len(VALUES))]
    groups = groups.withColumn("node", F.lit(0))
    nodes = {0: (0, shards)}  # node -> first shard, number of shards
    fresh = 1
    while any(k > 1 for _, k in nodes.values()):
        open_ = {n: v for n, v in nodes.items() if v[1] > 1}
        spans = groups.where(F.col("node").isin(list(open_))).groupBy("node").agg(*[f(d) for d in (*VALUES, *DIMENSIONS) for f in (F.min, F.max)]).collect()
        axis, low, high = {}, {}, {}
        for r in spans:
            i = widest([r[2 + 2 * i] - r[1 + 2 * i] for i in range(len(VALUES))], scale)
            at = 1 + 2 * (len(VALUES) + i)
            axis[r[0]], low[r[0]], high[r[0]] = i, float(r[at]), float(r[at + 1]) + 1e-9
        cut: dict[int, float] = {n: 0.0 for n in open_ if n not in axis}
        axis |= {n: 0 for n in cut}
        for n in cut:
            low[n], high[n] = 0.0, 1.0
        for _ in range(2):
            for n, w in _histogram(groups, axis, low, high).items():
                first, k = open_[n]
                goal, seen, b = sum(w) * (k // 2) / k, w[0], 0
                while b < BINS - 1 and seen + w[b + 1] <= goal:
                    seen += w[b + 1]
                    b += 1
                width = (high[n] - low[n]) / BINS
                low[n], high[n] = low[n] + b * width, low[n] + (b + 1) * width
                # the nearer end of the bin
                cut[n] = low[n] if goal - seen <= seen + w[b + 1] - goal else high[n]
        x = F.element_at(F.array(*[F.col(d) for d in DIMENSIONS]), F.element_at(_literal_map(axis), F.col("node")).cast("int") + 1)
        right = {n: float(fresh + 2 * i + 1) for i, n in enumerate(open_)}
        left = {n: float(fresh + 2 * i) for i, n in enumerate(open_)}
        below = x < F.element_at(_literal_map(cut), F.col("node"))
        moved = F.when(below, F.element_at(_literal_map(left), F.col("node"))).otherwise(F.element_at(_literal_map(right), F.col("node"))).cast("int")
        before, groups = groups, written(groups.withColumn("node", F.when(F.col("node").isin(list(open_)), moved).otherwise(F.col("node"))), "nodes")
        discard(before)
        for n, (first, k) in open_.items():
            del nodes[n]
            nodes[int(left[n])] = (first, k // 2)
            nodes[int(right[n])] = (first + k // 2, k - k // 2)
        fresh += 2 * len(open_)
    shard = F.element_at(_literal_map({n: first for n, (first, _) in nodes.items()}), F.col("node")).cast("int")
    return groups.withColumn("shard", shard).drop("node")


def _ranks(groups: DataFrame, name: str, place: str) -> tuple[DataFrame, int]:
    """(groups with the place of their name in order from 0, the number of names)."""
    names = written(ranked(groups.select(F.col(name).alias("_name")).distinct(), "_place", "_name"), "names")
    n = names.count()
    names = F.broadcast(names) if n <= BROADCAST_ROWS else names
    return groups.join(names, F.col(name).eqNullSafe(F.col("_name"))).drop("_name").withColumnRenamed("_place", place), n


def placed_groups(rows: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """(rows with the piece of their group and whether it is hot, groups (digest, piece, hot, weight, v0..v2, x0..x2))."""
    total, count = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    most = max(1.0, PIECE * (total or 0) / shards)
    sizes = rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    hot = sizes.where((F.col("bytes") > most) | (F.col("n") > max(1, count // HOT_PART))).select("digest", F.greatest(F.lit(1), F.ceil(F.col("bytes") / most)).cast("int").alias("pieces"))
    number = F.xxhash64(F.coalesce("doc_id", "row"))
    cut = rows.join(F.broadcast(written(hot, "hot")), "digest", "left").withColumns({"hot": F.col("pieces").isNotNull(), "piece": F.coalesce(F.pmod(number, F.col("pieces")), F.lit(0)).cast("int")}).drop("pieces")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", *NAMES, "size"))
    groups = cut.groupBy("digest", "piece", "hot").agg(F.sum("size").alias("weight"), first.alias("f")).select("digest", "piece", "hot", "weight", *[f"f.{c}" for c in NAMES], "f.size")
    groups = written(groups, "groups")
    jitter = _unit("digest", "piece", F.lit(0))
    for i, name in enumerate(NAMES):
        groups, n = _ranks(groups, name, f"v{i}")
        groups = groups.withColumn(f"x{i}", (F.col(f"v{i}") + jitter) / max(1, n))
    return cut, groups.withColumns({"v2": F.log2("size"), "x2": F.log2(F.col("size") + jitter) / 64}).drop(*NAMES, "size")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row a row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = written(_rows(docs), "rows")
    cut, groups = placed_groups(rows, shards)
    found = leaves(written(groups, "places"), shards).select("digest", "piece", "hot", "shard")
    key, wanted = ["digest", "piece"], ["doc_id", "size", "text_crc32", "digest", "row", "shard"]
    few = cut.where("not hot").join(found.where("not hot").drop("hot"), key).select(*wanted)
    many = cut.where("hot").join(F.broadcast(found.where("hot").drop("hot")), key).select(*wanted)
    # rows that share a doc_id and a text give the same row of the result whichever slot they have
    number = F.when(F.col("doc_id").isNull(), F.col("row")).otherwise(F.xxhash64("doc_id", "digest"))
    count = rows.count()
    placed = written(few.unionByName(many).withColumn("sub", F.pmod(F.xxhash64(number, F.lit(5)), F.lit(max(1, -(-count // (SLOT_ROWS * shards))))).cast("int")), "placed")
    discard(rows)
    subs = placed.groupBy("shard", "sub").agg(F.count(F.lit(1)).alias("n"))
    offsets = subs.select("shard", "sub", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "sub").orderBy("doc_id", "digest", "row")) - 1
    numbered = placed.withColumn("rank", rank).join(offsets, ["shard", "sub"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op8_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_kd_sharding": op8_kd_sharding}
#: DuckDB has no CRC-32, and cuts depend on the hash; tests hold the law and the groups.
SQL: dict[str, str] = {}
