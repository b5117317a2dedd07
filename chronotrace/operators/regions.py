"""Region filters, level tables, document checks, and fusion of two box sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronotrace.functions.boxes import box_iou
from chronotrace.functions.text import errors_of
from chronotrace.params import BoxFusionParams
from chronotrace.session import cut

# Upper bounds and names of energy levels (text reports, painted labels).
ENERGY_LEVELS = [(0.05, "very low"), (0.15, "low"), (0.35, "moderate"), (0.60, "elevated"), (0.85, "high"), (1.01, "very high (surge)")]
PAINT_LEVELS = [(0.01, "still"), (0.03, "low"), (0.08, "medium"), (0.2, "high")]


def keep_regions(
    df: DataFrame, min_area: int, min_side: int, min_energy: float, min_confidence: float, confidence: Column, exempt: tuple[str, ...], class_name: Column
) -> DataFrame:
    """Regions large enough, confident enough, and energetic enough unless a detector saw an
    exempt class."""
    free = F.col("source").isin("yolo", "fused") & class_name.isin(*exempt)
    return df.filter((F.col("w") * F.col("h") >= min_area) & (F.least("w", "h") >= min_side) & (free | (F.col("energy") >= min_energy)) & (confidence >= min_confidence))


# Statuses and fields of a result document.
STATUSES = ["Anomaly Detected", "Normal", "Error"]
RESULT_FIELDS = ["status", "anomaly_segments", "cinematic_filter"]
SEGMENT_FIELDS = ["start", "end", "confidence", "reason"]


def _lacks(items: Column, field: str) -> Column:
    return F.exists(items, lambda x: x[field].isNull())


def result_errors(js: Column) -> Column:
    """Messages about a result document: missing keys, unknown status, contradictions."""
    g = lambda k: F.get_json_object(js, f"$.{k}")
    segs = F.json_array_length(g("anomaly_segments"))
    parsed = F.from_json(g("anomaly_segments"), "array<struct<" + ",".join(f"{f}:string" for f in SEGMENT_FIELDS) + ">>")
    status = g("status")
    return errors_of(
        *[(g(f).isNull(), f"missing {f}") for f in RESULT_FIELDS],
        (status.isNotNull() & (status != "") & ~status.isin(*STATUSES), "invalid status"),
        (g("anomaly_segments").isNotNull() & segs.isNull(), "anomaly_segments is not a list"),
        *[(_lacks(parsed, f), f"segment without {f}") for f in SEGMENT_FIELDS],
        ((status == "Anomaly Detected") & (F.coalesce(segs, F.lit(0)) == 0), "anomaly without segments"),
        ((status == "Normal") & (segs > 0), "normal with segments"),
    )


# Fields of a snapshot document and their kinds.
SNAPSHOT_REQUIRED = ["entities"]
SNAPSHOT_KINDS = {
    "frame_id": "int", "timestamp": "number", "entities": "list", "scene": "object", "motion_energy": "number", "is_cinematic": "bool", "visual_danger_score": "number",
}
SCENE_KINDS = {"type": "text", "zones": "list", "crowd_density": "text"}
ENTITY_REQUIRED = ["portrait", "action"]
ENTITY_OPTIONAL = ["action_object", "location", "posture"]
KIND_PREFIXES = {
    "int": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL", "FLOAT"], "text": ["STRING"], "list": ["ARRAY"], "object": ["OBJECT"], "bool": ["BOOLEAN"],
}


def _wrong_kind(doc: Column, path: str, kind: str) -> Column:
    """True where the value at ``path`` is present, not null and of another kind."""
    got = F.schema_of_variant(F.try_variant_get(doc, path, "variant"))
    return F.coalesce(~got.rlike(f"^({'|'.join(['VOID$', *KIND_PREFIXES[kind]])})"), F.lit(False))


def _absent(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "variant").isNull()


def snapshot_errors(js: Column) -> Column:
    """Messages about a snapshot document: required fields, kinds, ranges, entities. The document is
    parsed once; a plain column of it would be parsed anew for every test."""
    return F.transform(F.array(F.try_parse_json(js)), _document_errors)[0]


def _document_errors(doc: Column) -> Column:
    danger = F.try_variant_get(doc, "$.visual_danger_score", "double")
    ents = F.try_variant_get(doc, "$.entities", "array<variant>")

    def entity_bad(e: Column) -> Column:
        out = F.lit(False)
        for f in ENTITY_REQUIRED:
            out = out | _absent(e, f"$.{f}") | _wrong_kind(e, f"$.{f}", "text")
        for f in ENTITY_OPTIONAL:
            out = out | _wrong_kind(e, f"$.{f}", "text")
        return out

    return errors_of(
        (doc.isNull(), "snapshot is not a document"),
        *[(doc.isNotNull() & _absent(doc, f"$.{f}"), f"missing {f}") for f in SNAPSHOT_REQUIRED],
        *[(_wrong_kind(doc, f"$.{f}", k), f"{f} is not {k}") for f, k in SNAPSHOT_KINDS.items()],
        *[(_wrong_kind(doc, f"$.scene.{f}", k), f"scene.{f} is not {k}") for f, k in SCENE_KINDS.items()],
        (F.exists(ents, entity_bad), "bad entity"),
        ((danger < 0) | (danger > 1), "visual_danger_score out of range"),
    )


def compact_results(verdicts: DataFrame) -> DataFrame:
    """Status, number of flagged intervals and film marker per recording."""
    g = verdicts.groupBy("video_id").agg(F.bool_or("is_anomaly").alias("_a"), F.sum(F.col("is_anomaly").cast("long")).alias("n_segments"))
    return g.select("video_id", F.when(F.col("_a"), "Anomaly Detected").otherwise("Normal").alias("status"), "n_segments", F.lit("N/A").alias("cinematic_filter"))


def _on_grid(boxes: DataFrame, keys: tuple[str, ...], tag: str, cell: float) -> DataFrame:
    """Each box in every cell of a uniform grid that it touches."""
    c = lambda v: F.floor(v / F.lit(float(cell))).cast("long")
    span = lambda at, size: F.sequence(c(F.col(at)), c(F.col(at) + F.greatest(F.col(size), F.lit(0))))
    g = boxes.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("w").isNotNull() & F.col("h").isNotNull())
    g = g.select("*", F.explode(span("x", "w")).alias("_cx")).select("*", F.explode(span("y", "h")).alias("_cy"))
    return g.select(*keys, "_cx", "_cy", F.col("region_idx").alias(f"{tag}i"), *[F.col(n).alias(f"{tag}{n}") for n in "xywh"])


def overlapping_boxes(motion: DataFrame, detected: DataFrame, keys: tuple[str, ...], least: float, cell: float = 64.0) -> DataFrame:
    """``keys, mi, di, iou`` of the pairs of a frame that overlap by at least ``least`` > 0. Boxes meet in the
    cells of a grid; a pair that shares several is kept in the one where their overlap begins."""
    j = _on_grid(motion, keys, "m", cell).join(_on_grid(detected, keys, "d", cell), [*keys, "_cx", "_cy"])
    owner = lambda a, b, at: F.floor(F.greatest(a, b) / F.lit(float(cell))).cast("long") == F.col(at)
    j = j.filter(owner("mx", "dx", "_cx") & owner("my", "dy", "_cy"))
    j = j.withColumn("iou", box_iou(*[F.col(f"m{n}") for n in "xywh"], *[F.col(f"d{n}") for n in "xywh"]))
    return j.filter(F.col("iou") >= least).select(*keys, "mi", "di", "iou")


def match_best_first(pairs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The pairs that a greedy choice takes, best overlap first, then lower ``mi``, lower ``di``, each box once.

    A pair that is the best of both its boxes is in the greedy choice whatever the others are. All such
    pairs are taken at once and their boxes put aside, until no pair is left: a few rounds, without any
    frame or group of boxes in one task.
    """
    rank = F.struct((-F.col("iou")).alias("i"), "mi", "di")
    left, taken = cut(pairs), None
    while not left.isEmpty():
        best = lambda box: F.min("_r").over(W.partitionBy(*keys, box))
        r = left.withColumn("_r", rank).withColumn("_m", best("mi")).withColumn("_d", best("di"))
        now = cut(r.filter((F.col("_r") == F.col("_m")) & (F.col("_r") == F.col("_d"))).select(*pairs.columns))
        taken = now if taken is None else taken.unionByName(now)
        for box in ("mi", "di"):
            left = left.join(now.select(*keys, box), [*keys, box], "left_anti")
        left = cut(left.select(*pairs.columns))
    return pairs.limit(0) if taken is None else taken


def fuse_boxes(motion: DataFrame, detected: DataFrame, keys: tuple[str, ...], p: BoxFusionParams = BoxFusionParams(), cell: float = 64.0) -> DataFrame:
    """Greedy one-to-one match of motion and detector boxes of a frame, best overlap first, at or above the
    merge threshold. Unmatched boxes stay if confident or energetic enough; boxes without a place match none."""
    matched = match_best_first(overlapping_boxes(motion, detected, keys, p.merge_iou, cell), keys)
    d_all = detected.select(*keys, F.col("region_idx").alias("di"), *"xywh", "class_name", "confidence")
    m_all = motion.select(*keys, F.col("region_idx").alias("mi"), *"xywh", "energy")
    hit_d = d_all.join(matched.select(*keys, "mi", "di"), [*keys, "di"], "left").join(m_all.select(*keys, "mi", "energy"), [*keys, "mi"], "left")
    from_d = hit_d.filter(F.col("mi").isNotNull() | (F.col("confidence") >= p.detector_only_conf)).select(
        *keys, *"xywh", F.coalesce("energy", F.lit(0.0)).alias("energy"), "class_name", "confidence", F.when(F.col("mi").isNotNull(), "fused").otherwise("yolo").alias("source")
    )
    from_m = m_all.join(matched.select(*keys, "mi"), [*keys, "mi"], "left_anti").filter(F.col("energy") >= p.motion_only_energy).select(
        *keys, *"xywh", "energy", F.lit("").alias("class_name"), F.lit(0.0).alias("confidence"), F.lit("motion").alias("source")
    )
    return from_d.unionByName(from_m)
