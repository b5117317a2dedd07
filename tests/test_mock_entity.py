"""The five-node, 140-row mock entity, with hand-checked results."""

from pyspark.sql import functions as F

from chronotrace.functions.narrative import entity_narratives
from chronotrace.operators import temporal_graph as tg
from chronotrace.operators.ordered import Lane

LANE = Lane(("video_id", "entity_id"), ("t", "event_id"), 5.0)
K = ("video_id", "entity_id")
NODES = [
    (0, 1, 1, 30, 1.0, "walking", "none", "standing", False, 0.0, "none", "birth"),
    (0, 1, 2, 120, 4.0, "walking", "none", "standing", False, 0.0, "none", "heartbeat"),
    (0, 1, 3, 240, 8.0, "approaching another person aggressively", "person", "lunging", True, 0.6, "fighting", "change_point"),
    (0, 1, 4, 330, 11.0, "punching", "person", "crouching", True, 0.9, "fighting", "change_point"),
    (0, 1, 5, 420, 14.0, "running away", "none", "running", True, 0.7, "fighting", "change_point"),
]


def tables(spark):
    cols = "video_id long, entity_id long, event_id long, frame_idx long, t double, action string, action_object string, posture string, suspicious boolean, danger double, guess string, rule string"
    nodes = spark.createDataFrame(NODES, cols).withColumn("scene", F.lit("parking lot"))
    tr = [(0, 1, f, f, f / 30.0, 0.06 if f < 200 else 0.40 if f < 350 else 0.20, 100 + f // 20, 80, 70, 90) for f in range(30, 450, 3)]
    trace = spark.createDataFrame(tr, "video_id long, entity_id long, event_id long, frame_idx long, t double, energy double, x long, y long, w long, h long")
    return nodes, trace


def test_graph(spark):
    nodes, trace = tables(spark)
    assert trace.count() == 140
    e = tg.edge_ids(tg.add_trace_totals(tg.link_nodes(nodes, LANE), trace, K, bucket=2.0))
    got = [(round(r.duration, 3), round(r.kinetic_integral, 4), r.n_trace, r.missing_frames) for r in e.orderBy("src_seq").collect()]
    tr = [(f, 0.06 if f < 200 else 0.40 if f < 350 else 0.20) for f in range(30, 450, 3)]
    want = []
    for a, b in ((30, 120), (120, 240), (240, 330), (330, 420)):
        hit = [(f, x) for f, x in tr if a <= f <= b]
        want.append(((b - a) / 30, round(sum(x for _, x in hit), 4), len(hit), max(0, hit[-1][0] - hit[0][0] - len(hit))))
    assert got == want and [g[0] for g in got] == [3, 4, 3, 3]
    r = tg.entity_rollup(nodes, e, K).first()
    assert (r.num_nodes, r.num_edges, r.duration, r.max_danger, r.has_suspicious) == (5, 4, 13.0, 0.9, True)


def test_node_energy(spark):
    nodes, trace = tables(spark)
    got = [(round(r.kinetic, 2), r.bbox.x) for r in tg.node_energy(nodes, trace, K).orderBy("t").collect()]
    assert got == [(0.06, 101), (0.06, 106), (0.4, 112), (0.4, 116), (0.2, 121)]


def test_narrative(spark):
    nodes, trace = tables(spark)
    e = tg.edge_ids(tg.add_trace_totals(tg.link_nodes(nodes, LANE), trace, K))
    n = tg.number_nodes(tg.node_energy(nodes, trace, K).withColumn("energy", F.col("kinetic")), LANE)
    text = entity_narratives(n, e, tg.entity_rollup(nodes, e, K), K).first().narrative
    lines = text.split("\n")
    assert lines[0] == "Entity #1 | Duration: 13.0s | Observations: 5 | Scene: parking lot"
    assert lines[2] == "T=1.0s: walking, posture=standing, kinetic=0.0600 []  (trigger: birth)"
    assert lines[3].startswith("  ↓ walking → walking | duration=3.0s | kinetic_integral=1.8600 [] | missing_frames=59")
    assert lines[6] == "T=8.0s: approaching another person aggressively (person), posture=lunging, kinetic=0.4000 [] [flagged]  (trigger: change_point)"
    assert "Anomaly hints: {'fighting': 3}" in text
    assert lines[-1].startswith("Summary: total_kinetic=") and lines[-1].endswith("max_danger=0.90, suspicious=True, physics_warning=False")
    short = entity_narratives(n, e, tg.entity_rollup(nodes, e, K), K, max_chars=50).first().narrative
    assert short == text[:50] + "\n...[truncated]"
