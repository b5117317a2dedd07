"""Free-text parsers, action rules, readers and narratives."""

import json

import pytest
from pyspark.sql import functions as F

from chronotrace.operators import regions as rg
from chronotrace.functions import actions as ac, narrative as nv, text as tx
from chronotrace.sources import readers as rd


def one(spark, fn, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(fn(*[F.col(f"c{i}") for i in range(len(values))]).alias("r")).first().r


@pytest.mark.parametrize(
    "text,want",
    [
        ('{"a": 1}', {"a": 1}),
        ('```json\n{"a": 1}\n```', {"a": 1}),
        ('Sure! {"a": {"b": 2}} ok', {"a": {"b": 2}}),
        ('{"a": [1, 2,], }', {"a": [1, 2]}),
        ("{'a': 'x'}", {"a": "x"}),
        ('{"a": 1, "b": "cut he', {"a": 1}),
        ('{"a": 1, "l": [1, 2', {"a": 1, "l": [1, 2]}),
        ('{"a": 1,', {"a": 1}),
        ('{"break_timestamp": 01:01.33}', {"break_timestamp": "01:01.33"}),
        ('{"a": "it\'s", "b": {"c": [1, {"d": 2}, {"e": "cu', {"a": "it's", "b": {"c": [1, {"d": 2}]}}),
        ("{'a': 'say \"x\"', }", {"a": 'say "x"'}),
        ("", None),
        ("nothing here", None),
    ],
)
def test_json_ladder(spark, text, want):
    got = one(spark, tx.json_in_text, text)
    assert (json.loads(got) if got else None) == want


def test_cut_inside_string(spark):
    assert json.loads(one(spark, tx.json_string_cut, '{"a": "cut he')) == {"a": "cut he"}


@pytest.mark.parametrize("text,want", [('{"score": [0.7]}', 0.7), ("score: 0.7", 0.7), ("Score 5 but 0.25", 0.25), ("", -1.0), ('{"score": 3} then 1.0', 1.0)])
def test_unit_score(spark, text, want):
    assert one(spark, tx.unit_score, text).score == want


@pytest.mark.parametrize("text,want", [("7/10", 0.7), ("Score: 12", 1.0), ("8 out of 10", 0.8), ("9", 0.9), ("about 4 cars", 0.4), ("300 cars", 0.3), ("none", 0.3)])
def test_ten_point_score(spark, text, want):
    assert abs(one(spark, tx.ten_point_score, text) - want) < 1e-12


def test_clock(spark):
    for text, want in (("00:15.5", 15.5), ("01:12.3", 72.3), ("1:00:05", 3605.0), ("12.5", 12.5), ("x", 0.0), ("1:x", 0.0)):
        assert abs(one(spark, tx.parse_clock, text) - want) < 1e-9
    assert spark.range(1).select(tx.format_clock(F.lit(185.25)), tx.format_clock(F.lit(-3.0))).first()[1] == "00:00.0"


@pytest.mark.parametrize(
    "a,b,want",
    [("holding", "running", 0.2), ("running", "holding", 0.2), ("Walking ", "walking", 0.95), ("slowly walking", "running fast", 0.6), ("jumping", "jumping", 0.9), ("jumping", "singing", 0.5)],
)
def test_transition_score(spark, a, b, want):
    assert one(spark, ac.transition_score, a, b) == want


def test_action_similarity_matches_helper(spark):
    words = ["walking", "strolling", "walk", "running", "rushing out", "paying", "checkout", "sat down", "dancing", "walking away"]
    rows = [(a, b) for a in words for b in words]
    df = spark.createDataFrame(rows, "a string, b string")
    groups = {w: [k for k, ws in ac.SYNONYMS.items() if any(x in w for x in [k, *ws])] for w in words}
    like = ac._Likeness()
    for r in df.select("a", "b", ac.action_similarity(F.col("a"), F.col("b")).alias("s")).collect():
        assert r.s == like[r.a, r.b]
        kin = groups[r.a] and groups[r.b] and groups[r.a][-1] == groups[r.b][-1]
        assert r.s == (1.0 if r.a == r.b else 0.85 if r.a in r.b or r.b in r.a else 0.8 if kin else 0.0)


def test_alignment_and_best_template(spark):
    df = spark.createDataFrame([(["walking", "standing still", "walking"], "street"), (["qq", "zz", "xx"], "street"), ([], "")], "seq array<string>, scene string")
    got = df.select(ac.best_template(ac.template_scores()("seq"), F.col("scene")).alias("b")).collect()
    assert got[0].b.name == "waiting_crossing" and abs(got[0].b.score - 1.0) < 1e-9
    assert got[1].b is None and got[2].b is None
    # By hand: both actions match two of three steps, one step is skipped.
    hit = lambda seq, want: [[float(a == w) for w in want] for a in seq]
    assert abs(ac.align(hit("xz", "xyz"), [0, 1, 2], [False] * 2) - (2 - 0.1) / 2) < 1e-12
    assert abs(ac.align(hit("xqz", "xz"), [0, 1], [False, True, False]) - (2 - 0.05) / 2) < 1e-12
    assert ac.align([], [0], []) == 0.0


def test_rules_for_blank_scene(spark):
    rules = {"default": ["d"], "store": ["s"], "shop": ["p"]}
    assert one(spark, lambda c: ac.matching_rules(c, rules), "") == ["s", "p"]
    assert one(spark, lambda c: ac.matching_rules(c, rules), "street") == ["d"]


def test_readers(spark, tmp_path):
    (tmp_path / "ann.txt").write_text("A1.mp4  Robbery  135  1950  -1  -1\nB.mp4 Shooting 4005 4230 4760 5088\nshort line\nN.mp4 Normal -1 -1 -1 -1\n")
    got = {r.video: (r.is_anomaly, [tuple(x) for x in r.intervals]) for r in rd.read_interval_pairs(spark, str(tmp_path / "ann.txt")).collect()}
    assert got == {"A1.mp4": (True, [(135, 1950)]), "B.mp4": (True, [(4005, 4230), (4760, 5088)]), "N.mp4": (False, [])}
    (tmp_path / "xd.txt").write_text("clip_label_B4-0-0 1 5 9 7 10 20\n")
    r = rd.read_interval_list(spark, str(tmp_path / "xd.txt")).select("*", rd.label_of(F.col("video")).alias("l")).first()
    assert [tuple(x) for x in r.intervals] == [(1, 5), (10, 20)] and r.l == "B4"
    (tmp_path / "run.json").write_text(json.dumps({"metrics": {}, "details": [{"filename": "a.mp4", "pred_anomaly": True, "entity_verdicts": []}, {"filename": "b.mp4"}]}, indent=2))
    assert [x.filename for x in rd.read_run(spark, str(tmp_path / "run.json")).collect()] == ["a.mp4", "b.mp4"]


def test_film_names(spark):
    for stem, want in (("Salt.2010__#00", True), ("Deadpool.2.2018__#1", True), ("v=abc.2010__#1", False), ("clip", False)):
        assert one(spark, tx.is_film_name, stem) is want


def test_orthogonal_projection(spark):
    import numpy as np

    from chronotrace.functions import vectors as vec

    q = vec.orthogonal_basis(2, 128, 42)
    assert np.allclose(np.array(q) @ np.array(q).T, np.eye(2))
    got = spark.createDataFrame([([3.0, -4.0],)], "v array<double>").select(vec.project(F.col("v"), q).alias("p")).first().p
    assert np.allclose(got, np.array([3.0, -4.0]) @ np.array(q))


def test_file_listing(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.mp4").write_bytes(b"12345")
    (tmp_path / "y.txt").write_bytes(b"1")
    got = [(r.path.split("/")[-1], r.length) for r in rd.list_files(spark, str(tmp_path), "*.mp4").collect()]
    assert got == [("x.mp4", 5)]


def test_user_templates(spark):
    mine = [ac.PathTemplate("pay", ["*"], ["paying"]), ac.PathTemplate("wait", ["shop"], ["waiting"])]
    df = spark.createDataFrame([(["waiting"], "shop"), (["waiting"], "street"), (["paying"], "street")], "seq array<string>, scene string")
    got = [r.b and r.b.name for r in df.select(ac.best_template(ac.template_scores(mine)("seq"), F.col("scene"), mine).alias("b")).collect()]
    assert got == ["wait", None, "pay"]


def test_texts_and_actions_are_whole_unless_limits_are_given(spark):
    long = "p" * 300
    js = json.dumps({"entities": [{"portrait": long, "action": long}], "scene": {"type": long, "crowd_density": long}})
    whole, short = one(spark, tx.snapshot_fields, js), one(spark, lambda c: tx.snapshot_fields(c, 200, 100, 50), js)
    assert [whole.entities[0].portrait, whole.entities[0].action, whole.scene_type, whole.crowd_density] == [long] * 4
    assert [len(x) for x in (short.entities[0].portrait, short.entities[0].action, short.scene_type, short.crowd_density)] == [200, 100, 100, 50]
    assert one(spark, tx.unit_score, long).status.endswith(" " + long)
    nodes = spark.createDataFrame([(1, i, f"a{i}") for i in range(14)], "entity_id long, seq long, action string")
    rollup = spark.createDataFrame([(1, 5.0, 14, 0.5, False)], "entity_id long, duration double, num_nodes long, max_danger double, has_suspicious boolean")
    line = lambda **k: nv.overview_lines(nodes, rollup, ("entity_id",), **k).first().line
    assert "actions=[" + " → ".join(f"a{i}" for i in range(14)) + "]" in line()
    assert "a9 → ...]" in line(max_actions=10) and "a10" not in line(max_actions=10)


def test_snapshot_is_parsed_once(spark):
    docs = ['{"timestamp": 1, "entities": [{"portrait": "p", "action": "a"}], "scene": null}', '{"timestamp": "x", "entities": [{"portrait": 1}], "visual_danger_score": 2}', "{", None, "[]"]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, d string").select("i", rg.snapshot_errors(F.col("d")).alias("e"))
    assert df._jdf.queryExecution().optimizedPlan().toString().lower().replace("_", "").count("parsejson") == 1
    got = {r.i: r.e for r in df.collect()}
    assert got == {0: [], 1: ["timestamp is not number", "bad entity", "visual_danger_score out of range"], 2: ["snapshot is not a document"], 3: ["snapshot is not a document"], 4: ["missing entities"]}
