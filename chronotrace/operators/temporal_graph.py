"""Per-entity time graphs: nodes, edges with physical totals, roll-ups and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronotrace.operators.intervals import range_totals
from chronotrace.operators.ordered import Lane, join_on, neighbours, number_rows
from chronotrace.params import GraphParams

EDGE_BUCKET = 24.0


def number_nodes(nodes: DataFrame, lane: Lane) -> DataFrame:
    """Sequence number from 0 in time order and the ``E<entity>_N<seq>`` identifier."""
    n = number_rows(nodes, lane, "_n").withColumn("seq", F.col("_n") - 1).drop("_n")
    return n.withColumn("node_id", F.format_string("E%d_N%d", F.col("entity_id"), F.col("seq")))


def latest_nodes(nodes: DataFrame, keys: tuple[str, ...], limit: int, *newest_first: str) -> DataFrame:
    """Newest ``limit`` nodes per entity. The rank filter runs before the shuffle as well."""
    w = W.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in newest_first])
    return nodes.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit).drop("_r")


def node_energy(nodes: DataFrame, trace: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Kinetic energy and box of the trace row at the node's frame; the latest wins, 0 if none."""
    t = trace.groupBy(*keys, "frame_idx").agg(F.max_by(F.struct("energy", "x", "y", "w", "h"), F.struct("t", "event_id")).alias("_tr"))
    j = join_on(nodes, t, (*keys, "frame_idx"), "left")
    return j.withColumn("kinetic", F.coalesce("_tr.energy", F.lit(0.0))).withColumn("bbox", F.struct(*[F.col(f"_tr.{c}").alias(c) for c in "xywh"])).drop("_tr")


def linked_nodes(nodes: DataFrame, lane: Lane, *carry: str) -> DataFrame:
    """Nodes with their sequence number from 0 and the time, frame and action of the one before; ``carry``
    names further columns to keep."""
    prev = {f"src_{c}": F.col(c) for c in ("t", "frame_idx", "action")}
    slim = nodes.select(*dict.fromkeys([*lane.keys, *lane.order, "event_id", "t", "frame_idx", "action", *carry]))
    return neighbours(slim, lane, previous=prev, number="seq")


def link_nodes(nodes: DataFrame, lane: Lane) -> DataFrame:
    """One row per consecutive pair of nodes of an entity."""
    return node_links(linked_nodes(nodes, lane), lane)


def node_links(linked: DataFrame, lane: Lane) -> DataFrame:
    """``link_nodes`` from nodes that ``linked_nodes`` has numbered."""
    node_id = lambda q: F.format_string("E%d_N%d", F.col("entity_id"), q)
    return linked.filter("seq > 0").select(
        *lane.keys, F.col("event_id").alias("edge_key"), node_id(F.col("seq") - 1).alias("source"), node_id(F.col("seq")).alias("target"), (F.col("seq") - 1).alias("src_seq"), "src_t",
        F.col("t").alias("dst_t"), "src_frame_idx", F.col("frame_idx").alias("dst_frame_idx"),
        F.col("src_action").alias("action_from"), F.col("action").alias("action_to"), (F.col("t") - F.col("src_t")).alias("duration"),
    )


def add_trace_totals(edges: DataFrame, trace: DataFrame, keys: tuple[str, ...], stride: int = 1, bucket: float = EDGE_BUCKET) -> DataFrame:
    """Energy, count and missing frames of the trace rows between both ends (inclusive). Frames rise with
    time, so the first and the last trace row of an edge have its lowest and highest frame."""
    j = range_totals(
        edges, trace, keys, ("edge_key",), "t", F.col("src_t"), F.col("dst_t"), bucket, {"kinetic_integral": F.col("energy")}, "n_trace", {"frame": F.col("frame_idx")}
    )
    missing = F.greatest(F.lit(0), F.floor((F.col("last_frame") - F.col("first_frame")) / stride) - F.col("n_trace"))
    return (
        j.withColumn("missing_frames", F.when(F.col("n_trace") >= 2, missing).otherwise(0).cast("long"))
        .withColumn("kinetic_integral", F.coalesce("kinetic_integral", F.lit(0.0)))
        .drop("first_frame", "last_frame")
    )


def add_frame_energy(edges: DataFrame, frame_energy: DataFrame, bucket: float = 720.0) -> DataFrame:
    """Sum and mean of recording-level frame energies between both frames (inclusive)."""
    j = range_totals(
        edges, frame_energy, ("video_id",), ("edge_key",), "frame_idx", F.col("src_frame_idx"), F.col("dst_frame_idx"), bucket, {"energy_integral": F.col("frame_energy")}, "_n"
    )
    total = F.coalesce("energy_integral", F.lit(0.0))
    return j.withColumn("energy_avg", F.when(F.col("_n") > 0, total / F.col("_n")).otherwise(0.0)).withColumn("energy_integral", total).drop("_n")


def edge_ids(edges: DataFrame) -> DataFrame:
    return edges.withColumn("edge_id", F.concat(F.lit("E"), F.col("entity_id").cast("string"), F.lit("_"), F.col("source"), F.lit("_"), F.col("target"))).withColumn(
        "action_transition", F.concat_ws(" → ", "action_from", "action_to")
    )


def weighted_edges(edges: DataFrame, action_score: Column, p: GraphParams = GraphParams()) -> DataFrame:
    """Edges whose gap is positive and bounded, weighted by appearance and action plausibility."""
    e = edges.filter((F.col("duration") > 0) & (F.col("duration") <= p.max_edge_gap)).withColumn("action_score", action_score)
    return e.withColumn("weight", F.lit(p.portrait_weight * p.portrait_similarity) + F.lit(p.action_weight) * F.col("action_score"))


def entity_rollup(nodes: DataFrame, edges: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Life span, danger and counts per entity; energy totals run over every edge ever made."""
    n = nodes.groupBy(*keys).agg(
        F.min("t").alias("birth_time"), F.max("t").alias("last_time"), F.max("danger").alias("max_danger"), F.bool_or("suspicious").alias("has_suspicious"),
        F.count(F.lit(1)).alias("num_nodes"),
    )
    e = edges.groupBy(*keys).agg(F.sum(F.round("kinetic_integral", 4)).alias("total_kinetic"), F.count(F.lit(1)).alias("num_edges"))
    j = join_on(n, e, keys, "left")
    return j.withColumns(
        {
            "duration": F.col("last_time") - F.col("birth_time"),
            "total_kinetic": F.coalesce("total_kinetic", F.lit(0.0)),
            "num_edges": F.coalesce("num_edges", F.lit(0)).cast("long"),
        }
    )


PAGE = 1000  # nodes that one nested row holds; longer sequences go on in the next page


def sequence_text(nodes: DataFrame, lane: Lane, value: str, sep: str = " → ", page: int = PAGE) -> DataFrame:
    """All values of an entity in lane order as an array and one text, a row per ``page`` of them."""
    n = number_rows(nodes, lane, "_n").withColumn("page", F.floor((F.col("_n") - 1) / page))
    g = n.groupBy(*lane.keys, "page").agg(F.array_sort(F.collect_list(F.struct("_n", F.col(value).cast("string").alias("_v")))).alias("_s"))
    return g.select(*lane.keys, "page", F.transform("_s", lambda s: s["_v"]).alias("sequence")).withColumn("text", F.array_join("sequence", sep))


def graph_stats(nodes: DataFrame, edges: DataFrame, keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    per = nodes.groupBy(*keys, "entity_id").agg(F.count(F.lit(1)).alias("_len"))
    p = per.groupBy(*keys).agg(
        F.sum("_len").alias("num_nodes"), F.count(F.lit(1)).alias("num_entities"), F.avg("_len").alias("avg_path_length"), F.max("_len").alias("max_path_length")
    )
    e = edges.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_edges"), F.avg("weight").alias("avg_edge_weight"), F.min("weight").alias("min_edge_weight"),
        F.sum("energy_integral").alias("total_energy"), F.avg("energy_integral").alias("avg_energy"),
    )
    return join_on(p, e, keys, "left").na.fill(0)


def nested_graphs(nodes: DataFrame, edges: DataFrame, rollup: DataFrame, keys: tuple[str, ...], page: int = PAGE) -> DataFrame:
    """Nested, rounded nodes of an entity and the edges that start at them, a row per ``page`` nodes."""
    n = nodes.groupBy(*keys, F.floor(F.col("seq") / page).alias("page")).agg(
        F.array_sort(
            F.collect_list(F.struct("seq", "node_id", F.round("t", 3).alias("timestamp"), "action", "suspicious", F.round("danger", 3).alias("danger"), F.round("energy", 4).alias("kinetic")))
        ).alias("nodes")
    )
    e = edges.groupBy(*keys, F.floor(F.col("src_seq") / page).alias("page")).agg(
        F.array_sort(
            F.collect_list(
                F.struct("src_seq", "source", "target", F.round("duration", 3).alias("duration"), F.round("kinetic_integral", 4).alias("kinetic_integral"), "action_transition", "missing_frames")
            )
        ).alias("edges")
    )
    return join_on(join_on(rollup, n, keys), e, (*keys, "page"), "left")


def trigger_rows(nodes: DataFrame, lane: Lane) -> DataFrame:
    """All nodes of a recording as one time-ordered trigger list with a running id."""
    return number_rows(nodes, lane, "trigger_id")
