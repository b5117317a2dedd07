"""Results of recordings with many entities and of entities with many nodes do not depend on page sizes."""

from pyspark.sql import functions as F

from chronotrace.functions import narrative as nv
from chronotrace.operators import audit, temporal_graph as tg
from chronotrace.operators.ordered import Lane
from chronotrace.sources import readers as rd, sinks as sk

K = ("video_id", "entity_id")
LANE = Lane(K, ("t", "event_id"), 100.0)


def test_one_verdict_for_1200_entities(spark, tmp_path):
    """Only the last entity is flagged: every page of the run file says so, and so does the one result."""
    n = 1200
    for page in (500, 7, 5000):
        ver = spark.range(n).select(
            F.floor(F.col("id") / page).alias("page"), F.struct(F.col("id").alias("entity_id"), (F.col("id") == n - 1).alias("is_anomaly"), (F.col("id") / n).alias("confidence"), F.lit("why").alias("reason"), F.lit(0.0).alias("anomaly_start_sec"), F.lit(1.0).alias("anomaly_end_sec")).alias("e")
        )
        docs = ver.groupBy("page").agg(F.array_sort(F.collect_list("e")).alias("entity_verdicts")).select(
            F.array(F.struct(F.lit("v1.mp4").alias("filename"), "page", F.lit(True).alias("pred_anomaly"), F.lit(0.9).alias("pred_score"), F.lit(300).alias("total_frames"), F.lit(30.0).alias("fps"), "entity_verdicts")).alias("details")
        )
        run = rd.read_run(spark, sk.write_json_rows(docs, str(tmp_path / f"run{page}")), lines=True)
        (r,) = rd.recording_results(run).collect()
        assert (r.pred_anomaly, r.pred_score, r.n_entities, round(r.total_confidence, 6)) == (True, 0.9, n, round(sum(i / n for i in range(n)), 6))
        (c,) = rd.canonical_result(run).collect()
        assert c.anomaly_entity_ids == [n - 1] and c.summary == f"Entity #{n - 1}: why" and c.duration_sec == 10.0


def test_run_files_without_pages_read_as_before(spark, tmp_path):
    (tmp_path / "run.json").write_text('{"metrics": {}, "details": [{"filename": "a.mp4", "pred_anomaly": false, "pred_score": 0.1, "total_frames": 60, "fps": 30.0, "entity_verdicts": []}]}')
    (c,) = rd.canonical_result(rd.read_run(spark, str(tmp_path / "run.json"))).collect()
    assert (c.filename, c.is_anomaly, c.summary, c.anomaly_entity_ids) == ("a.mp4", False, "No anomaly detected.", [])


def test_one_summary_for_1200_entities(spark):
    v = spark.range(1200).select((F.col("id") % 2).alias("video_id"), F.col("id").alias("entity_id"), (F.col("id") % 2 == 0).alias("is_anomaly"), F.lit(False).alias("film_false_alarm"), (F.col("id") / 1200).alias("confidence"), F.lit(1.0).alias("start_sec"), F.lit(2.0).alias("end_sec"), F.lit("why").alias("reason"))
    want = None
    for page in (500, 7):
        rows = {r.video_id: r for r in audit.verdict_summary(v, page).collect()}
        assert len(rows) == 2 and rows[1].summary == "No anomaly detected." and rows[1].entity_ids == ""
        parts = rows[0].summary.split("; ")
        assert len(parts) == 600 and parts[0].startswith("Entity #1198: why") and parts[-1].startswith("Entity #0: why")
        assert rows[0].entity_ids == ",".join(str(i) for i in range(0, 1200, 2))
        want = want or rows[0].summary
        assert rows[0].summary == want


def test_one_narrative_for_2500_nodes(spark):
    n = 2500
    rows = [(1, 1, i, float(i), i * 30, f"act{i % 3}", "none", "standing", "street", i == 2400, "birth", "fighting" if i in (3, 2400) else "running" if i == 2 else "none", 0.1, 0.2) for i in range(n)]
    nodes = spark.createDataFrame(rows, "video_id long, entity_id long, event_id long, t double, frame_idx long, action string, action_object string, posture string, scene string, suspicious boolean, rule string, guess string, energy double, danger double")
    trace = nodes.select(*K, "frame_idx", "t", "event_id", "energy").limit(5)
    e = tg.edge_ids(tg.add_trace_totals(tg.link_nodes(nodes, LANE), trace, K))
    numbered, rollup = tg.number_nodes(nodes, LANE), tg.entity_rollup(nodes, e, K)
    (whole,) = nv.entity_narratives(numbered, e, rollup, K).collect()
    (one,) = nv.entity_narratives(numbered, e, rollup, K, page=10_000).collect()
    assert whole.narrative == one.narrative
    lines = whole.narrative.split("\n")
    assert lines[0] == "Entity #1 | Duration: 2499.0s | Observations: 2500 | Scene: street" and sum(x.startswith("Entity #1 |") for x in lines) == 1
    assert sum(x.startswith("T=") for x in lines) == n and sum(x.startswith("  ↓") for x in lines) == n - 1
    assert "Anomaly hints: {'running': 1, 'fighting': 2}" in whole.narrative and "suspicious=True" in lines[-1]
    pages = nv.narrative_pages(numbered, e, rollup, K).orderBy("page").collect()
    assert [p.page for p in pages] == [0, 1, 2] and "\n".join(p.text for p in pages) == whole.narrative
