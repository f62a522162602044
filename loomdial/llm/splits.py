"""Splits that keep related records together: frontier breadth-first components, then split by component hash order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomdial.functions.text import id_key
from loomdial.session import cut, discard


#: Rounds that the seeds expand on each level. In the order of hashes 98 of 100 nodes have a seed that near; the others wait for the next level.
ROUNDS = 2


def _expand(adjacency: DataFrame) -> DataFrame:
    """node, label of every node: the label of a nearest seed; seeds are the nodes that come before all their neighbours.

    All seeds expand at once: each round joins the frontier to the adjacency lists, hash-partitioned by node. Where several seeds
    reach a node in one round the first of them wins; the collision shows as an edge between different labels later. A node that no
    seed has reached after the last round keeps its own label.
    """
    least = adjacency.groupBy("node").agg(F.min("other").alias("_least"))
    start = labels = cut(least.select("node", F.when(F.col("node") < F.col("_least"), F.col("node")).alias("label")))
    frontier = start.where("label is not null")
    for _ in range(ROUNDS):
        reached = adjacency.join(frontier, "node").groupBy(F.col("other").alias("node")).agg(F.min("label").alias("_new"))
        labels = labels.join(reached, "node", "left")
        frontier = labels.where("label is null and _new is not null").select("node", F.col("_new").alias("label"))
        labels = labels.select("node", F.coalesce("label", "_new").alias("label"))
    labels = cut(labels.select("node", F.coalesce("label", "node").alias("label")))
    discard(start)
    return labels


def components(edges: DataFrame, trace: list | None = None) -> DataFrame:
    """node, component of an undirected graph given as rows (a, b); component is the smallest node of it.

    Nodes are put in the order of their hashes. Each level contracts what a seed reached to that seed; colliding labels are the edges of the
    next, smaller graph, which is solved in the same distributed way until no edge is left. A node has no seed before its label where it was
    reached, so the seeds around a hub, however many, come after the hub's new label and are gone in the next level; on chains about a third of the
    nodes is left of each level. Nothing is collected. A level writes three checkpoints and deletes those it no longer needs. Rows with a null end and
    loops give no edge; an empty table gives an empty result. trace takes the number of edges, both ways, of each level.
    """
    e = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    place = lambda c: F.struct(F.xxhash64(F.lit(5), c).alias("h"), F.col(c).alias("n"))  # noqa: E731  orders the nodes
    both = e.select(place("a").alias("node"), place("b").alias("other")).unionByName(e.select(place("b").alias("node"), place("a").alias("other")))
    adjacency, levels = cut(both.distinct()), []
    while not adjacency.isEmpty():
        labels = _expand(adjacency)
        if trace is not None:
            trace.append(adjacency.count())
        levels.append(labels)
        crossing = (
            adjacency.join(labels.withColumnRenamed("label", "_a"), "node")
            .join(labels.select(F.col("node").alias("other"), F.col("label").alias("_b")), "other")
            .where("_a <> _b")
            .select(F.col("_a").alias("node"), F.col("_b").alias("other"))
        )
        smaller = cut(crossing.distinct())
        discard(adjacency)
        adjacency = smaller
    discard(adjacency)
    if not levels:
        return e.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    result = levels[-1]
    for labels in reversed(levels[:-1]):
        up = result.select(F.col("node").alias("label"), F.col("label").alias("_up"))
        result = labels.join(up, "label", "left").select("node", F.coalesce("_up", "label").alias("label"))
    named = result.groupBy("label").agg(F.min("node.n").alias("component"))
    found = cut(result.join(named, "label").select(F.col("node.n").alias("node"), "component"))
    discard(*levels)
    return found


def conversation_topics(flat_rows: DataFrame) -> DataFrame:
    """Distinct (conv, topic) keys; the topic is the one in the metadata."""
    topic = F.try_element_at("single_turn_metadata", F.lit("topic_id"))
    return flat_rows.select(id_key(F.col("conv_id")).alias("conv"), id_key(topic).alias("topic")).distinct()


def topic_components(conv_topics: DataFrame) -> DataFrame:
    """topic, component of the topics that share a conversation with another topic.

    A conversation of k topics gives k - 1 edges to its smallest one, so a conversation that holds a third of all rows gives no pairs of its topics.
    """
    both = conv_topics.where("conv is not null and topic is not null")
    least = both.groupBy("conv").agg(F.min("topic").alias("a"), F.max("topic").alias("_b")).where("a <> _b").select("conv", "a")
    edges = both.join(least, "conv").where("topic <> a").select("a", F.col("topic").alias("b")).distinct()
    return components(edges).withColumnRenamed("node", "topic")


def linked_topics(flat_rows: DataFrame, topics: DataFrame) -> DataFrame:
    """topic_a < topic_b: the pairs of topics, written as in topics, that must share a split."""
    found = topic_components(conversation_topics(flat_rows))
    named = found.join(topics.select(id_key(F.col("topic_id")).alias("topic"), "topic_id").where("topic is not null").groupBy("topic").agg(F.min("topic_id").alias("topic_id")), "topic")
    a, b = named.select("component", F.col("topic_id").alias("topic_a")), named.select("component", F.col("topic_id").alias("topic_b"))
    return a.join(b, "component").where("topic_a < topic_b").select("topic_a", "topic_b")


SPLITS = (("train", 0.9), ("validation", 0.05), ("test", 0.05))
_BUCKETS = 4096


def assign_splits(groups: DataFrame, splits=SPLITS) -> DataFrame:
    """Add split to rows (group, n): groups in hash order fill the splits in turn by their size.

    The running size is taken over hash buckets and within a bucket, never over all groups in one task; a group goes where its middle falls, so one
    group of a third of all rows fits as well as it can.
    """
    h = F.shiftrightunsigned(F.xxhash64(F.lit(41), F.col("group")), 1)
    g = groups.withColumn("_h", h).withColumn("_bucket", F.shiftright("_h", 63 - 12))
    per = g.groupBy("_bucket").agg(F.sum("n").alias("_n"))  # at most _BUCKETS rows
    before = per.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    inside = Window.partitionBy("_bucket").orderBy("_h", "group")
    placed = g.join(F.broadcast(before), "_bucket").withColumn("_at", (F.col("_before") + F.sum("n").over(inside) - F.col("n") / 2.0) / F.col("_all"))
    choice, upto = None, 0.0
    for name, share in splits[:-1]:
        upto += share
        choice = F.when(F.col("_at") < upto, name) if choice is None else choice.when(F.col("_at") < upto, name)
    choice = F.lit(splits[-1][0]) if choice is None else choice.otherwise(splits[-1][0])
    return placed.withColumn("split", choice).drop("_h", "_bucket", "_before", "_all", "_at")


def split_records(flat_rows: DataFrame, sessions: DataFrame, splits=SPLITS) -> DataFrame:
    """table_name, row_no, group, split of every row of flat_rows and every session, each once.

    A row belongs to the component of its topic, without one to that of its conversation; a conversation without any topic, and a
    row with neither, is a group of its own. Null row numbers are left out.
    """
    conv_topics = cut(conversation_topics(flat_rows))
    linked = topic_components(conv_topics)
    topic_of = conv_topics.where("conv is not null and topic is not null").groupBy("conv").agg(F.min("topic").alias("_conv_topic"))
    f = flat_rows.where("row_no is not null").select(
        F.lit("flat_rows").alias("table_name"), "row_no", id_key(F.col("conv_id")).alias("conv"), id_key(F.try_element_at("single_turn_metadata", F.lit("topic_id"))).alias("topic")
    )
    f = f.groupBy("table_name", "row_no").agg(F.first("conv").alias("conv"), F.first("topic").alias("topic"))
    hot_safe = f.where("topic is not null").withColumn("_conv_topic", F.lit(None).cast("string")).unionByName(f.where("topic is null").join(topic_of, "conv", "left"))
    s = sessions.where("session_no is not null").select(F.lit("sessions").alias("table_name"), F.col("session_no").alias("row_no"), id_key(F.col("topic_id")).alias("topic"))
    s = s.dropDuplicates(["row_no"]).withColumn("conv", F.lit(None).cast("string")).withColumn("_conv_topic", F.lit(None).cast("string"))
    rows = hot_safe.unionByName(s).withColumn("topic", F.coalesce("topic", "_conv_topic"))
    own = F.coalesce(F.concat(F.lit("topic:"), F.col("topic")), F.concat(F.lit("conv:"), F.col("conv")), F.concat_ws(":", F.lit("row"), "table_name", F.col("row_no").cast("string")))
    rows = cut(rows.select("table_name", "row_no", own.alias("own")))
    sizes = rows.groupBy("own").agg(F.count("*").alias("n"))  # pre-aggregated: hot topics are one row from here on
    groups = sizes.join(linked.select(F.concat(F.lit("topic:"), "topic").alias("own"), F.concat(F.lit("topic:"), "component").alias("component")), "own", "left").withColumn("group", F.coalesce("component", "own"))
    placed = assign_splits(groups.groupBy("group").agg(F.sum("n").alias("n")), splits).select("group", "split")
    table = cut(groups.select("own", "group").join(placed, "group"))
    return rows.join(table, "own").select("table_name", "row_no", "group", "split")
