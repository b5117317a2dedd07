"""Registered queries: similarity graphs, propagation and segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronotrace.operators import similarity as sim
from chronotrace.params import SegmentationParams
from chronotrace.plans import views as v
from chronotrace.plans.registry import query

SMALL = SegmentationParams(block=20)


def _pairs(block: int) -> str:
    return f"""n AS (SELECT video_id, count(*) AS n FROM frames GROUP BY ALL),
u AS (SELECT video_id, frame_idx, mot, list_transform(app, lambda x: x / (sqrt(list_inner_product(app, app)) + CAST(1e-6 AS DOUBLE))) AS a FROM frames),
pw AS (SELECT x.video_id, x.frame_idx AS i, y.frame_idx AS j, (0.8 * list_inner_product(x.a, y.a) + 0.2 * exp(-sqrt(greatest(0, list_inner_product(x.mot, x.mot) + list_inner_product(y.mot, y.mot) - 2 * list_inner_product(x.mot, y.mot)))))
 / (1 + CAST(0.05 AS DOUBLE) * abs(x.frame_idx - y.frame_idx)) AS w FROM u x JOIN u y USING (video_id)),
rk AS (SELECT pw.*, row_number() OVER (PARTITION BY video_id, i, j // {block} ORDER BY w DESC, j) AS r, greatest(3, 5 - ((i // {block}) * {block}) // greatest(n // 10, 1)) AS k FROM pw JOIN n USING (video_id)),
ge AS (SELECT video_id, least(i, j) AS src, greatest(i, j) AS dst, max(w) AS weight FROM rk WHERE r <= k AND i <> j AND w > 0 GROUP BY ALL)"""


@query("g01_decayed_similarity_graph", f"WITH {_pairs(20)} SELECT video_id, src, dst, round(weight, 5) AS weight FROM ge", "frames")
def decayed_graph(spark, d):
    return sim.decayed_similarity_graph(v.frames(spark, d), SMALL).withColumn("weight", F.round("weight", 5))


@query("j22_top_k_similarity", f"WITH {_pairs(20)}, g AS (SELECT *, row_number() OVER (PARTITION BY video_id, i ORDER BY w DESC, j) AS gr FROM pw WHERE i <> j AND w > 0) SELECT video_id, least(i, j) AS src, greatest(i, j) AS dst, round(max(w), 5) AS weight FROM g WHERE gr <= 4 GROUP BY ALL", "frames")
def top_k_graph(spark, d):
    return sim.top_similar(v.frames(spark, d), 4, SMALL).withColumn("weight", F.round("weight", 5))


BAND = """u AS (SELECT video_id, frame_idx, list_transform(feat, lambda x: x / (sqrt(list_inner_product(feat, feat)) + CAST(1e-6 AS DOUBLE))) AS a FROM frames),
bw AS (SELECT x.video_id, x.frame_idx AS i, y.frame_idx AS j, list_inner_product(x.a, y.a) AS w FROM u x JOIN u y ON x.video_id = y.video_id AND y.frame_idx BETWEEN x.frame_idx - 10 AND x.frame_idx + 10),
br AS (SELECT *, row_number() OVER (PARTITION BY video_id, i ORDER BY w DESC, j) AS r FROM bw), ge AS (SELECT video_id, least(i, j) AS src, greatest(i, j) AS dst, max(w) AS weight FROM br WHERE r <= 6 AND i <> j AND w > 0 GROUP BY ALL)"""


@query("j23_band_self_join", f"WITH {BAND} SELECT video_id, src, dst, round(weight, 5) AS weight FROM ge", "frames")
def band_join(spark, d):
    return sim.band_graph(v.frames(spark, d), "feat").withColumn("weight", F.round("weight", 5))


@query("g02_local_window_graph", f"WITH {BAND} SELECT video_id, src AS node, count(*) AS degree, round(sum(weight), 5) AS strength FROM (SELECT video_id, src, weight FROM ge UNION ALL SELECT video_id, dst, weight FROM ge) GROUP BY ALL", "frames")
def local_window(spark, d):
    e = sim.band_graph(v.frames(spark, d), "feat")
    b = e.select("video_id", F.col("src").alias("node"), "weight").unionByName(e.select("video_id", F.col("dst").alias("node"), "weight"))
    return b.groupBy("video_id", "node").agg(F.count(F.lit(1)).alias("degree"), F.round(F.sum("weight"), 5).alias("strength"))


PROP = """bo AS (SELECT video_id, src, dst, weight FROM ge UNION ALL SELECT video_id, dst, src, weight FROM ge), dg AS (SELECT video_id, src, sum(weight) AS deg FROM bo GROUP BY ALL),
ex AS (SELECT video_id, frame_idx, unnest(range(1, 65)) AS pos, unnest(feat) AS x FROM frames),
ms AS (SELECT bo.video_id, bo.src AS frame_idx, pos, sum(weight * x) / (any_value(deg) + CAST(1e-6 AS DOUBLE)) AS m FROM bo JOIN dg USING (video_id, src) JOIN ex ON ex.video_id = bo.video_id AND ex.frame_idx = bo.dst GROUP BY bo.video_id, bo.src, pos),
pr AS (SELECT video_id, frame_idx, pos, 0.5 * x + 0.5 * coalesce(m, 0) AS x FROM ex LEFT JOIN ms USING (video_id, frame_idx, pos)),
pv AS (SELECT video_id, frame_idx, list(x ORDER BY pos) AS feat FROM pr GROUP BY ALL)"""


@query("g03_propagation", f"WITH {BAND}, {PROP} SELECT video_id, frame_idx, round(feat[1], 5) AS f1, round(feat[33], 5) AS f33, round(feat[64], 5) AS f64, round(list_inner_product(feat, feat), 5) AS sq FROM pv", "frames")
def propagation(spark, d):
    f = v.frames(spark, d)
    p = sim.propagate(f, sim.band_graph(f, "feat"), "feat")
    at = lambda i: F.round(F.element_at("feat", i), 5)
    return p.select("video_id", "frame_idx", at(1).alias("f1"), at(33).alias("f33"), at(64).alias("f64"), F.round(F.aggregate("feat", F.lit(0.0), lambda s, x: s + x * x), 5).alias("sq"))


SEGMENT = """ch AS (SELECT video_id, frame_idx - 1 AS i, list_inner_product(feat, feat) + list_inner_product(pf, pf) - 2 * list_inner_product(feat, pf)
 + 1 - list_inner_product(feat, pf) / (sqrt(list_inner_product(feat, feat)) * sqrt(list_inner_product(pf, pf)) + CAST(1e-6 AS DOUBLE)) AS c FROM (SELECT *, lag(feat) OVER (PARTITION BY video_id ORDER BY frame_idx) AS pf FROM pv) WHERE pf IS NOT NULL),
sz AS (SELECT video_id, count(*) AS n FROM ch GROUP BY ALL HAVING count(*) >= 10), bs AS (SELECT video_id, i, least(greatest(i - 2, 0), n - 5) AS b FROM ch JOIN sz USING (video_id)),
sm AS (SELECT bs.video_id, bs.i, sum(ch.c * (0.2 + (bs.i - b - 2) * (ch.i - b - 2) / CAST(10 AS DOUBLE) + (pow(bs.i - b - 2, 2) - 2) * (pow(ch.i - b - 2, 2) - 2) / CAST(14 AS DOUBLE))) AS s FROM bs JOIN ch ON ch.video_id = bs.video_id AND ch.i BETWEEN b AND b + 4 GROUP BY ALL),
ra AS (SELECT * FROM (SELECT video_id, i, s / (avg(s) OVER w + CAST(1e-6 AS DOUBLE)) AS r, count(*) OVER w AS c FROM sm WINDOW w AS (PARTITION BY video_id ORDER BY i ROWS 4 PRECEDING)) WHERE c = 5),
md AS (SELECT video_id, median(r) AS med FROM ra GROUP BY ALL), th AS (SELECT video_id, any_value(med) + 3.0 * median(abs(r - med)) AS thr FROM ra JOIN md USING (video_id) GROUP BY ALL),
pt AS (SELECT video_id, i - 4 + 2 AS p FROM ra JOIN th USING (video_id) WHERE r > thr),
fl AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY video_id ORDER BY p) < 4 THEN 0 ELSE 1 END AS nb FROM pt), gg AS (SELECT *, sum(nb) OVER (PARTITION BY video_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS g FROM fl),
mg AS (SELECT video_id, max(p) AS p FROM gg GROUP BY video_id, g), tt AS (SELECT video_id, count(*) AS n FROM frames GROUP BY ALL),
sp AS (SELECT mg.video_id, p / CAST(2 AS DOUBLE) AS s, least(coalesce(lead(p) OVER (PARTITION BY mg.video_id ORDER BY p) / CAST(2 AS DOUBLE), p / CAST(2 AS DOUBLE) + 2), n / CAST(2 AS DOUBLE)) AS e FROM mg JOIN tt USING (video_id)),
fr AS (SELECT tt.video_id, n, CAST(round_even(s * 2, 0) AS BIGINT) AS a, least(CAST(round_even(e * 2, 0) AS BIGINT), n - 1) AS b FROM tt LEFT JOIN sp ON sp.video_id = tt.video_id AND e > s),
en AS (SELECT video_id, any_value(n) AS n, min(a) FILTER (b - a > 1) AS f, coalesce(max(b) FILTER (b - a > 1), 0) AS l FROM fr GROUP BY ALL)
SELECT video_id, a AS start_frame, b AS end_frame FROM fr WHERE b - a > 1 UNION ALL SELECT video_id, 0, f FROM en WHERE f > 0 UNION ALL SELECT video_id, l, n - 1 FROM en WHERE l < n - 1"""


@query("g04_segmentation", f"WITH {_pairs(500)}, {PROP}, {SEGMENT}", "frames")
def segmentation(spark, d):
    return sim.segment_recordings(v.frames(spark, d), 2.0)


@query("g04_segmentation_band", f"WITH {BAND}, {PROP}, {SEGMENT}", "frames")
def segmentation_band(spark, d):
    return sim.segment_recordings(v.frames(spark, d), 2.0, graph="band")
