"""Narrative text of an entity or a recording from its nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotrace.operators.ordered import join_on
from chronotrace.operators.temporal_graph import PAGE


def _node_line(n) -> Column:
    obj = F.when(~n["action_object"].isin("", "none"), F.concat(F.lit(" ("), n["action_object"], F.lit(")"))).otherwise("")
    return F.concat(
        F.format_string("T=%.1fs: ", n["t"]), n["action"], obj, F.lit(", posture="), n["posture"], F.format_string(", kinetic=%.4f []", n["energy"]),
        F.when(n["suspicious"], " [flagged]").otherwise(""), F.lit("  (trigger: "), n["rule"], F.lit(")"),
    )


def _edge_line(n) -> Column:
    miss = F.when(n["missing"] > 0, F.format_string(" | missing_frames=%d", n["missing"])).otherwise("")
    line = F.concat(F.lit("  ↓ "), n["transition"], F.format_string(" | duration=%.1fs | kinetic_integral=%.4f []", n["gap"], n["integral"]), miss)
    return F.when(n["transition"].isNotNull(), line)


def _hints(nodes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Line with the guesses about an entity and how often each was made, in order of their first node."""
    g = nodes.filter(~F.col("guess").isin("", "none", "unknown")).groupBy(*keys, "guess").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("at"))
    g = g.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "guess", "n"))).alias("_g"))
    hints = F.array_join(F.transform("_g", lambda x: F.concat(F.lit("'"), x["guess"], F.lit("': "), x["n"].cast("string"))), ", ")
    return g.select(*keys, F.concat(F.lit("\n\nAnomaly hints: {"), hints, F.lit("}")).alias("_hints"))


def narrative_pages(nodes: DataFrame, edges: DataFrame, rollup: DataFrame, keys: tuple[str, ...], page: int = PAGE) -> DataFrame:
    """``page, text`` of the narratives of entities: header on the first page, one line per node and per edge
    to the next node, hints and the summary line on the last. Joined by line breaks they are the whole.
    Counts and hints are those of the entity."""
    e = edges.select(*keys, F.col("src_seq").alias("seq"), F.col("action_transition").alias("transition"), F.col("duration").alias("gap"), F.col("kinetic_integral").alias("integral"), F.col("missing_frames").alias("missing"))
    n = join_on(nodes, e, (*keys, "seq"), "left").withColumn("page", F.floor(F.col("seq") / page))
    line = F.struct("seq", F.concat_ws("\n", _node_line(_Row()), _edge_line(_Row())).alias("line"))
    g = n.groupBy(*keys, "page").agg(F.array_sort(F.collect_list(line)).alias("_n"), F.min_by("scene", "seq").alias("scene"))
    j = join_on(join_on(g, rollup, keys), _hints(nodes, keys), keys, "left")
    header = F.concat(F.lit("Entity #"), F.col("entity_id").cast("string"), F.format_string(" | Duration: %.1fs | Observations: %d | Scene: ", F.col("duration"), F.col("num_nodes")), F.col("scene"), F.lit("\n\n"))
    summary = F.concat(
        F.format_string("\n\nSummary: total_kinetic=%.4f, max_danger=%.2f, suspicious=", F.col("total_kinetic"), F.col("max_danger")), F.initcap(F.col("has_suspicious").cast("string")), F.lit(", physics_warning=False"),
    )
    last = F.col("page") == F.floor((F.col("num_nodes") - 1) / page)
    body = F.array_join(F.transform("_n", lambda x: x["line"]), "\n")
    text = F.concat(F.when(F.col("page") == 0, header).otherwise(""), body, F.when(last, F.concat(F.coalesce("_hints", F.lit("")), summary)).otherwise(""))
    return j.select(*keys, "page", text.alias("text"))


class _Row:
    """A node's columns by name, as the line functions ask for them."""

    def __getitem__(self, name: str) -> Column:
        return F.col(name)


def entity_narratives(nodes: DataFrame, edges: DataFrame, rollup: DataFrame, keys: tuple[str, ...], page: int = PAGE, max_chars: int | None = None) -> DataFrame:
    """``narrative`` of each entity: its pages joined to one text, cut at ``max_chars`` on request. For
    entities whose text is too long for a row, ``narrative_pages`` gives the parts."""
    g = narrative_pages(nodes, edges, rollup, keys, page).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("_p"))
    text = F.array_join(F.transform("_p", lambda x: x["text"]), "\n")
    if max_chars is not None:
        text = F.when(F.length(text) > max_chars, F.concat(F.left(text, F.lit(max_chars)), F.lit("\n...[truncated]"))).otherwise(text)
    return g.select(*keys, text.alias("narrative"))


def overview_lines(nodes: DataFrame, rollup: DataFrame, keys: tuple[str, ...], max_actions: int | None = None) -> DataFrame:
    """One line per entity of a recording: span, observations, danger and actions (the first
    ``max_actions`` where that is given).
    Lines carry the sort values; the overview text is their ordered concatenation."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy("seq")
    first = nodes.withColumn("_r", F.row_number().over(w))
    if max_actions is not None:
        first = first.filter(F.col("_r") <= max_actions + 1)
    first = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_r", "action"))).alias("_a"))
    acts = F.array_join(F.transform(F.col("_a") if max_actions is None else F.slice("_a", 1, max_actions), lambda x: x["action"]), " → ")
    j = join_on(rollup, first, keys)
    line = F.concat(
        F.lit("  Entity #"), F.col("entity_id").cast("string"), F.format_string(": %.1fs, %d obs, max_danger=%.2f, actions=[", F.col("duration"), F.col("num_nodes"), F.col("max_danger")), acts,
        F.lit("") if max_actions is None else F.when(F.size("_a") > max_actions, " → ...").otherwise(""), F.lit("]"), F.when(F.col("has_suspicious"), " [flagged]").otherwise(""),
    )
    return j.select(*keys, "max_danger", line.alias("line"))
