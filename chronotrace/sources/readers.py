"""Readers for annotation, manifest, score and result files. All of them are projections
over Spark's own text, CSV and JSON sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronotrace.operators.ordered import join_on

# Anomaly categories, as they prefix recording names.
CATEGORIES = [
    "Abuse", "Arrest", "Arson", "Assault", "Burglary", "Explosion", "Fighting", "RoadAccidents", "Robbery", "Shooting", "Shoplifting", "Stealing", "Vandalism",
]


def read_interval_pairs(spark: SparkSession, path: str, absent: str = "negative") -> DataFrame:
    """``video category s1 e1 s2 e2`` lines; shorter lines are skipped. A pair is dropped when
    it holds a negative value, or (``absent='minus_one'``) when either side is exactly -1."""
    p = F.split(F.trim("value"), r"\s+")
    at = lambda i: p[i].try_cast("int")
    pairs = F.array(*[F.struct(at(i).alias("s"), at(i + 1).alias("e")) for i in (2, 4)])
    keep = (lambda x: (x["s"] >= 0) & (x["e"] >= 0)) if absent == "negative" else (lambda x: (x["s"] != -1) & (x["e"] != -1))
    d = spark.read.text(path).filter(F.size(p) >= 6)
    return d.select(p[0].alias("video"), p[1].alias("category"), F.filter(pairs, keep).alias("intervals")).withColumn("is_anomaly", F.col("category") != "Normal")


def read_interval_list(spark: SparkSession, path: str) -> DataFrame:
    """``video s1 e1 s2 e2 ...`` lines with any number of pairs; pairs with s < e are kept."""
    p = F.split(F.trim("value"), r"\s+")
    n = F.floor((F.size("_p") - 1) / 2).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("_p", 1 + 2 * i).try_cast("int").alias("s"), F.get("_p", 2 + 2 * i).try_cast("int").alias("e")))
    d = spark.read.text(path).select(p.alias("_p")).filter(F.size("_p") >= 3)
    return d.select(F.col("_p")[0].alias("video"), F.filter(pairs, lambda x: x["s"] < x["e"]).alias("intervals"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``path start end`` lines; lines with fewer fields are skipped."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.size(p) >= 3).select(p[0].alias("path"), p[1].try_cast("bigint").alias("start_frame"), p[2].try_cast("bigint").alias("end_frame"))


def read_scored_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``path start end score`` lines with the recording name derived from the path."""
    p = F.split(F.trim("value"), r"\s+")
    d = spark.read.text(path).filter(F.size(p) >= 4)
    d = d.select(p[0].alias("path"), p[1].try_cast("bigint").alias("start_frame"), p[2].try_cast("bigint").alias("end_frame"), p[3].try_cast("double").alias("score"))
    return d.withColumn("video", recording_of(F.col("path")))


def read_annotated_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated manifest with a header and a 0/1 anomaly flag; malformed lines are dropped."""
    schema = "segment_path string, start_frame bigint, end_frame bigint, category string, contains_anomaly int, overlap_ratio double"
    d = spark.read.csv(path, sep="\t", header=True, schema=schema, mode="DROPMALFORMED")
    return d.withColumn("contains_anomaly", F.col("contains_anomaly") == 1)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Score CSV with quoted free text; a row that did not succeed scores -1."""
    schema = "path string, score double, status string, summary string, reasoning string"
    d = spark.read.csv(path, header=True, schema=schema, quote='"', escape='"', multiLine=True)
    return d.withColumn("score", F.when(F.col("status") == "success", F.col("score")).otherwise(-1.0))


RUN_DETAIL = (
    "struct<filename:string,page:bigint,category:string,gt_anomaly:boolean,pred_anomaly:boolean,pred_score:double,iou_soft:double,total_frames:bigint,fps:double,"
    "entity_verdicts:array<struct<entity_id:bigint,is_anomaly:boolean,confidence:double,reason:string,anomaly_start_sec:double,anomaly_end_sec:double>>>"
)


def read_run(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per record of run files ``{metrics, details}``: one document per file, or with
    ``lines`` one document per line (which splits across tasks). A recording with very many entities may
    have several records, numbered by ``page``; its verdict and score stand in each."""
    d = spark.read.schema(f"details array<{RUN_DETAIL}>").option("multiLine", not lines).json(path)
    return d.select(F.inline("details"))


def resolve_by_precedence(sources: list[DataFrame], key: str) -> DataFrame:
    """One row per key, from the first source that has it."""
    tagged = None
    for i, s in enumerate(sources):
        s = s.withColumn("source_rank", F.lit(i))
        tagged = s if tagged is None else tagged.unionByName(s)
    w = W.partitionBy(key).orderBy("source_rank")
    return tagged.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def recording_results(details: DataFrame) -> DataFrame:
    """One row per recording, whatever its number of records: verdict, score, entities and their
    confidence together."""
    total = F.aggregate("entity_verdicts", F.lit(0.0), lambda t, x: t + x["confidence"])
    return details.groupBy("filename").agg(
        F.bool_or("pred_anomaly").alias("pred_anomaly"), F.max("pred_score").alias("pred_score"), F.sum(F.size("entity_verdicts").cast("long")).alias("n_entities"), F.sum(total).alias("total_confidence")
    )


def canonical_result(details: DataFrame) -> DataFrame:
    """Run detail rows in the shape of a single-recording result, one row per recording; the records of a
    recording are joined in order of their pages."""
    flagged = F.filter("entity_verdicts", lambda x: x["is_anomaly"])
    line = F.transform(flagged, lambda x: F.concat(F.lit("Entity #"), x["entity_id"].cast("string"), F.lit(": "), F.coalesce(x["reason"], F.lit(""))))
    part = F.struct(F.coalesce("page", F.lit(0)).alias("page"), F.transform(flagged, lambda x: x["entity_id"]).alias("ids"), F.array_join(line, "; ").alias("text"))
    g = details.groupBy("filename").agg(
        F.max(F.round(F.coalesce("total_frames", F.lit(0)) / F.greatest(F.coalesce("fps", F.lit(30.0)), F.lit(1.0)), 2)).alias("duration_sec"),
        F.bool_or("pred_anomaly").alias("is_anomaly"), F.max("pred_score").alias("confidence"), F.coalesce(F.max("category"), F.lit("unknown")).alias("scene_type"), F.array_sort(F.collect_list(part)).alias("_p"),
    )
    texts = F.array_join(F.filter(F.transform("_p", lambda x: x["text"]), lambda t: t != ""), "; ")
    ids = F.flatten(F.transform("_p", lambda x: x["ids"]))
    return g.select("filename", "duration_sec", "is_anomaly", "confidence", "scene_type", ids.alias("anomaly_entity_ids"), F.when(F.size(ids) > 0, texts).otherwise("No anomaly detected.").alias("summary"))


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files under a folder by name pattern; contents are never read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return d.select("path", "length", "modificationTime")


def pending(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return join_on(inputs, done.select(key), [key], "left_anti")


# --- names and paths ------------------------------------------------------------------------
def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def recording_of(path: Column, ext: str = ".mp4") -> Column:
    """Recording name of a segment path: its folder without the segment suffix."""
    return F.concat(F.regexp_replace(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1), "_segments", ""), F.lit(ext))


def category_of(path: Column, categories: list[str] = CATEGORIES) -> Column:
    """First category that prefixes the file name; Normal by name or path; else Unknown."""
    name = base_name(path)
    out = None
    for c in categories:
        out = F.when(F.startswith(name, F.lit(c)), c) if out is None else out.when(F.startswith(name, F.lit(c)), c)
    return out.otherwise(F.when(F.contains(name, F.lit("Normal")) | F.contains(F.lower(path), F.lit("normal")), "Normal").otherwise("Unknown"))


def split_role(path: Column, categories: list[str] = CATEGORIES) -> Column:
    """train/test x anomaly/normal from the name prefix and path tokens."""
    name, parent = base_name(path), F.element_at(F.split(path, "/"), -2)
    anomaly = F.exists(F.array(*[F.lit(c) for c in categories]), lambda c: F.startswith(name, c))
    training = F.contains(path, F.lit("Training")) | parent.isin(*categories)
    return F.when(anomaly, F.when(training, "train_anomaly").otherwise("test_anomaly")).otherwise(F.when(F.contains(path, F.lit("Testing")), "test_normal").otherwise("train_normal"))


def label_of(name: Column) -> Column:
    """Primary label of ``..._label_A-B-C`` names: the part up to the first dash."""
    return F.split(F.regexp_extract(name, r"_label_(.+?)(?:\.[A-Za-z0-9]+)?$", 1), "-")[0]


def output_dir(path: Column, in_base: str, out_base: str) -> Column:
    """Folder for the results of an input file: same relative place, name without extension."""
    return F.regexp_replace(F.regexp_replace(path, "^" + in_base, out_base), r"\.[^./]+$", "")
