"""Reply graph and threads.

Nodes and edges are tables. Chains of single parents are shortened first: pointers to parents are doubled until each
node knows the head it hangs from, so a deep thread takes a number of rounds logarithmic in its depth. Where nodes of several parents
are heads too, shortest paths between heads are found level by level: a round joins the frontier with the weighted links
and keeps pairs that got nearer, so cycles end. A round's table is written to the shared folder and no plan grows with the
rounds; all shuffles are on node, head or (root, head).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions import text as X
from loomline.sources.tables import discard, ranked, written


def reference_records(parsed: DataFrame, compat: bool = False) -> DataFrame:
    """seq, message_id, in_reply_to, references, subject, normalized_subject, date, from."""
    h = F.col("headers")
    text = lambda c: F.coalesce(h[c], F.lit(""))
    return parsed.select(
        "seq",
        X.message_id(text("message_id"), compat).alias("message_id"),
        X.reply_id(text("in_reply_to"), compat).alias("in_reply_to"),
        X.references(text("references")).alias("references"),
        h["subject"].alias("subject"),
        X.normalize_subject(h["subject"]).alias("normalized_subject"),
        h["date"].alias("date"),
        h["from"].alias("from"),
    )


def nodes(records: DataFrame) -> DataFrame:
    """One row a message id that isn't empty: place of its first message, attributes of its last."""
    last = F.max_by(F.struct("subject", "normalized_subject", "date", F.col("from").alias("sender")), "seq").alias("a")
    return records.where("message_id <> ''").groupBy("message_id").agg(F.min("seq").alias("first_seq"), last).select("message_id", "first_seq", "a.*")


def edges(records: DataFrame, nodes_: DataFrame) -> DataFrame:
    """(src, dst, relationship), one a pair; of several the last one set counts. References to oneself are left out, replies are not."""
    known = nodes_.select(F.col("message_id").alias("src"))
    own = records.where("message_id <> ''")
    replies = own.select(F.col("in_reply_to").alias("src"), F.col("message_id").alias("dst"), F.lit("reply").alias("relationship"), F.struct("seq", F.lit(0).alias("phase"), F.lit(0).alias("pos")).alias("at"))
    refs = own.select("seq", "message_id", F.posexplode("references").alias("pos", "src")).where("src <> message_id")
    refs = refs.select("src", F.col("message_id").alias("dst"), F.lit("reference").alias("relationship"), F.struct("seq", F.lit(1).alias("phase"), "pos").alias("at"))
    found = replies.unionByName(refs).join(known, "src", "left_semi")
    return found.groupBy("src", "dst").agg(F.max_by("relationship", "at").alias("relationship"))


def roots(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    """Nodes that no edge leads to."""
    return nodes_.join(edges_.select(F.col("dst").alias("message_id")), "message_id", "left_anti").select("message_id", "first_seq")


def _trees(roots_: DataFrame, steps: DataFrame) -> DataFrame:
    """(head, node, hops): the head a node hangs from by single parents, and how far.

    Heads are the roots and the nodes of two or more parents, each at 0 from itself. Pointers to parents are doubled, so
    rounds are as many as the binary logarithm of the longest chain. A round that settles no node was the last: what is left
    hangs from a cycle or from no root.
    """
    parents = written(steps.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("src")), "parents")
    heads = roots_.select(F.col("message_id").alias("node")).unionByName(parents.where("n > 1").select("node"))
    own = heads.select("node", F.col("node").alias("up"), F.lit(0).cast("long").alias("hops"), F.lit(True).alias("settled"))
    single = parents.where("n = 1").join(heads.select(F.col("node").alias("head")), F.col("src") == F.col("head"), "left")
    found = written(own.unionByName(single.select("node", F.col("src").alias("up"), F.lit(1).cast("long").alias("hops"), F.col("head").isNotNull().alias("settled"))), "trees")
    discard(parents)
    before = -1
    while True:
        settled, left = found.agg(F.count_if("settled"), F.count_if(~F.col("settled"))).first()
        if not left or settled == before:
            return found.where("settled").select(F.col("up").alias("head"), "node", "hops")
        before = settled
        above = found.select(F.col("node").alias("at"), F.col("up").alias("top"), F.col("hops").alias("more"), F.col("settled").alias("ended"))
        moved = found.where("not settled").join(above, F.col("up") == F.col("at"))
        moved = moved.select("node", F.col("top").alias("up"), (F.col("hops") + F.col("more")).alias("hops"), F.col("ended").alias("settled"))
        after = written(found.where("settled").unionByName(moved), "trees")
        discard(found)
        found = after


def reach(roots_: DataFrame, edges_: DataFrame) -> DataFrame:
    """(root, node, depth) of all that each root reaches, itself at 0; edges_ has a pair once."""
    spark = roots_.sparkSession
    steps = written(edges_.select("src", "dst").where("src <> dst"), "edges")
    trees = _trees(roots_, steps)
    joints = trees.where("hops = 0").select(F.col("node").alias("joint"))
    hung = steps.join(joints, F.col("dst") == F.col("joint")).join(trees, F.col("src") == F.col("node"))
    links = written(hung.groupBy("head", "joint").agg(F.min(F.col("hops") + 1).alias("weight")), "links")
    discard(steps)
    start = roots_.select(F.col("message_id").alias("root"), F.col("message_id").alias("head"), F.lit(0).cast("long").alias("depth"))
    if links.isEmpty():
        return start.join(trees, "head").select("root", "node", F.col("hops").alias("depth"))
    levels = [written(start, "level")]
    while True:
        seen = spark.read.schema(levels[0].schema).parquet(*[x._loomline_path for x in levels])
        known = seen.select(F.col("root").alias("of"), F.col("head").alias("at"), F.col("depth").alias("best"))
        after = levels[-1].join(links, "head").groupBy("root", F.col("joint").alias("head")).agg(F.min(F.col("depth") + F.col("weight")).alias("depth"))
        level = written(after.join(known, (F.col("root") == F.col("of")) & (F.col("head") == F.col("at")) & (F.col("best") <= F.col("depth")), "left_anti"), "level")
        if level.isEmpty():
            reached = seen.groupBy("root", "head").agg(F.min("depth").alias("depth"))
            return reached.join(trees, "head").select("root", "node", (F.col("depth") + F.col("hops")).alias("depth"))
        levels.append(level)


def threads(records: DataFrame, compat: bool = False) -> DataFrame:
    """One row a root: id, messages, depth, participants, dates and subjects of its thread."""
    records = written(records, "records")
    n = written(nodes(records), "nodes")
    e = written(edges(records, n), "edges")
    r = roots(n, e)
    numbered = ranked(r, "place", "first_seq", "message_id").select("message_id", F.format_string("thread_%04d", F.col("place") + 1).alias("thread_id"))
    members = reach(r, e).join(n, F.col("node") == F.col("message_id"))
    stamp = X.date_timestamp(F.col("date"))
    iso = lambda f: F.lit(None).cast("string") if compat else X.date_iso(f("date", stamp))
    built = members.groupBy("root").agg(
        F.count(F.lit(1)).alias("message_count"),
        F.transform(F.array_sort(F.collect_list(F.struct("first_seq", "node"))), lambda x: x["node"]).alias("message_ids"),
        F.max("depth").alias("thread_depth"),
        F.transform(F.array_sort(F.collect_set(F.struct("sender"))), lambda x: x["sender"]).alias("participants"),
        F.struct(iso(F.min_by).alias("start"), iso(F.max_by).alias("end")).alias("date_range"),
        F.transform(F.array_sort(F.collect_set(F.struct("subject"))), lambda x: x["subject"]).alias("subject_variants"),
        F.max(F.when(F.col("node") == F.col("root"), F.col("normalized_subject"))).alias("normalized_subject"),
    )
    named = built.join(numbered, F.col("root") == F.col("message_id"))
    return named.select(
        "thread_id", F.col("root").alias("root_message_id"), "message_count", "message_ids", "thread_depth", "participants", "date_range", "subject_variants", "normalized_subject"
    )


def quality_metrics(threads_: DataFrame) -> DataFrame:
    """One row over all threads; no threads give no row."""
    m = F.col("message_count")
    rounded = lambda c: F.round(F.avg(c), 6)
    return threads_.agg(
        F.count(F.lit(1)).alias("total_threads"),
        F.sum(m).alias("total_messages_threaded"),
        rounded(m).alias("avg_messages_per_thread"),
        F.max("thread_depth").alias("max_thread_depth"),
        rounded("thread_depth").alias("avg_thread_depth"),
        rounded(F.size("participants")).alias("avg_participants_per_thread"),
        F.count_if(m == 1).alias("single_message_threads"),
        F.count_if(m >= 5).alias("complex_threads"),
    ).where("total_threads > 0")


def summary(threads_: DataFrame, records: DataFrame) -> DataFrame:
    """One row of the reconstruction.

    input_emails counts a message once for each thread it is in; distinct_messages_threaded counts it
    once, and dropped_messages are those that no root reaches.
    """
    held = threads_.select(F.explode("message_ids").alias("m")).agg(F.count_distinct("m").alias("distinct_messages_threaded"), F.count(F.lit(1)).alias("input_emails"))
    n = nodes(records).agg(F.count(F.lit(1)).alias("_nodes"))
    t = threads_.agg(F.count(F.lit(1)).alias("output_threads"))
    return held.crossJoin(n).crossJoin(t).select(
        "input_emails", "output_threads", F.round(F.col("input_emails") / F.greatest("output_threads", F.lit(1)), 6).alias("threading_efficiency"),
        "distinct_messages_threaded", (F.col("_nodes") - F.col("distinct_messages_threaded")).alias("dropped_messages"),
    )
