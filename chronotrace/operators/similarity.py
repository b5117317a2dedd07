"""Similarity graphs over feature rows, propagation on them, and segmentation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronotrace.functions.vectors import dot, normalise, weighted_sum
from chronotrace.operators import blocks, intervals as iv, signals as sg
from chronotrace.operators.ordered import Lane, bounded_window, join_on
from chronotrace.params import SegmentationParams
from chronotrace.session import cut


def undirected(edges: DataFrame) -> DataFrame:
    """One row per unordered pair with the larger weight."""
    return edges.groupBy("video_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("weight").alias("weight"))


def _block_best(p: SegmentationParams, k_of: Callable[[pd.DataFrame, int], int]) -> Callable:
    """Cogroup function: best k columns of one block for every row of another."""

    def best(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if len(a) == 0 or len(b) == 0:
            return pd.DataFrame({"video_id": [], "src": [], "dst": [], "weight": []})
        ia, ib = a["frame_idx"].to_numpy(), b["f2"].to_numpy()
        xa, xb = np.stack(a["app"].to_numpy()).astype(float), np.stack(b["app2"].to_numpy()).astype(float)
        ma, mb = np.stack(a["mot"].to_numpy()).astype(float), np.stack(b["mot2"].to_numpy()).astype(float)
        xa /= np.linalg.norm(xa, axis=1, keepdims=True) + 1e-6
        xb /= np.linalg.norm(xb, axis=1, keepdims=True) + 1e-6
        gap = np.sqrt(np.maximum((ma**2).sum(1)[:, None] + (mb**2).sum(1)[None, :] - 2 * ma @ mb.T, 0))
        w = (p.appearance_weight * (xa @ xb.T) + p.motion_weight * np.exp(-gap)) / (1 + p.time_decay * np.abs(ia[:, None] - ib[None, :]))
        k = min(k_of(a, int(key[1])), len(ib))
        rank = np.lexsort((np.broadcast_to(ib, w.shape), -w), axis=1)[:, :k]
        rows, wv = np.repeat(np.arange(len(ia)), k), np.take_along_axis(w, rank, 1).ravel()
        src, dst = ia[rows], ib[rank.ravel()]
        ok = (src != dst) & (wv > 0)
        return pd.DataFrame({"video_id": int(key[0]), "src": src[ok], "dst": dst[ok], "weight": wv[ok]})

    return best


EDGE_SCHEMA = "video_id bigint, src bigint, dst bigint, weight double"


def _match_blocks(rows: DataFrame, columns: DataFrame, best: Callable) -> DataFrame:
    """Run ``best`` on each (row block, column block) pair named by ``rows.bj``. A column block
    is sent only to the row blocks that ask for it."""
    wanted = rows.select("video_id", "blk", "bj").distinct()
    right = join_on(wanted, columns.select("video_id", F.col("blk").alias("bj"), F.col("frame_idx").alias("f2"), F.col("app").alias("app2"), F.col("mot").alias("mot2")), ("video_id", "bj"))
    right = right.select(F.col("video_id").alias("vid2"), F.col("blk").alias("blk2"), F.col("bj").alias("bj2"), "f2", "app2", "mot2")
    pairs = rows.groupBy("video_id", "blk", "bj").cogroup(right.groupBy("vid2", "blk2", "bj2"))
    return pairs.applyInPandas(best, EDGE_SCHEMA)


def _blocked(frames: DataFrame, p: SegmentationParams, more: list[str] | None = None) -> DataFrame:
    n = frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    f = join_on(frames.select("video_id", "frame_idx", "app", "mot", *(more or [])), n, ("video_id",))
    return f.withColumn("blk", F.floor(F.col("frame_idx") / p.block).cast("long")).withColumn("last_blk", F.floor((F.col("n") - 1) / p.block).cast("long"))


def _weights(a: pd.DataFrame, b: pd.DataFrame, p: SegmentationParams) -> np.ndarray:
    """Time-decayed similarity of every row of one set with every row of another."""
    xa, xb = (np.stack(s["app"].to_numpy()).astype(float) for s in (a, b))
    ma, mb = (np.stack(s["mot"].to_numpy()).astype(float) for s in (a, b))
    xa /= np.linalg.norm(xa, axis=1, keepdims=True) + 1e-6
    xb /= np.linalg.norm(xb, axis=1, keepdims=True) + 1e-6
    gap = np.sqrt(np.maximum((ma**2).sum(1)[:, None] + (mb**2).sum(1)[None, :] - 2 * ma @ mb.T, 0))
    apart = np.abs(a["frame_idx"].to_numpy()[:, None] - b["frame_idx"].to_numpy()[None, :])
    return (p.appearance_weight * (xa @ xb.T) + p.motion_weight * np.exp(-gap)) / (1 + p.time_decay * apart)


def _best_of_blocks(w: np.ndarray, cols: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Which columns are among a row's ``k`` best of their block; of equal ones the lower column."""
    best = np.zeros(w.shape, dtype=bool)
    ends = [0, *(np.flatnonzero(np.diff(cols)) + 1).tolist(), len(cols)]
    for lo, hi in zip(ends[:-1], ends[1:]):
        most = min(int(k.max()), hi - lo)
        rank = np.argsort(-w[:, lo:hi], axis=1, kind="stable")[:, :most]
        np.put_along_axis(best[:, lo:hi], rank, np.arange(most)[None, :] < k[:, None], 1)
    return best


def _pair_weights(key, rows: pd.DataFrame, p: SegmentationParams) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray]:
    """Two chunks of a recording and the weights of the edges between their rows, 0 where there is none.
    Of a chunk with itself the weights stand above the diagonal, each pair of rows once."""
    rows = rows.sort_values("frame_idx")
    a, b = (rows[rows["c"] == c] for c in key[1:])
    w = _weights(a, b, p)
    take = _best_of_blocks(w, b["blk"].to_numpy(), a["k"].to_numpy()) | _best_of_blocks(w.T, a["blk"].to_numpy(), b["k"].to_numpy()).T
    take &= w > 0
    if key[1] == key[2]:
        take = np.triu(take | take.T, 1)
    return a, b, np.where(take, w, 0.0)


def _chunk_pair(p: SegmentationParams) -> Callable:
    """Edges between the rows of two chunks of a recording, or within one, each pair of rows once."""

    def edges(key, rows: pd.DataFrame) -> pd.DataFrame:
        a, b, w = _pair_weights(key, rows, p)
        r, c = np.nonzero(w)
        return pd.DataFrame({"video_id": int(key[0]), "src": a["frame_idx"].to_numpy()[r], "dst": b["frame_idx"].to_numpy()[c], "weight": w[r, c]})

    return edges


def _chunk_sums(p: SegmentationParams, vec: str) -> Callable:
    """Weighted sums of the neighbours that the rows of two chunks have in the other one."""

    def sums(key, rows: pd.DataFrame) -> pd.DataFrame:
        a, b, w = _pair_weights(key, rows, p)
        xa, xb = (np.stack(s[vec].to_numpy()).astype(float) for s in (a, b))
        out = []
        for rows_, m, x in ((a, w, xb), (b, w.T, xa)):
            deg = m.sum(axis=1)
            has = deg > 0
            out.append(pd.DataFrame({"video_id": int(key[0]), "frame_idx": rows_["frame_idx"].to_numpy()[has], "_s": pd.Series(list((m @ x)[has]), dtype=object), "_deg": deg[has]}))
        return pd.concat(out, ignore_index=True)

    return sums


CHUNK_ROWS = 512
#: Where sums of neighbours leave a pair of chunks, not edges, wider chunks cost no more and are copied less often.
SUM_CHUNK_ROWS = 2000


def _chunk_pairs(frames: DataFrame, p: SegmentationParams, chunk_rows: int, vec: str | None = None):
    """The rows of each pair of chunks of a recording, grouped. Whole blocks are joined to chunks, and each
    pair of chunks is its own task unit: its rows meet in one matrix product that serves both directions."""
    wide = p.block * max(1, chunk_rows // p.block)
    tenth = F.greatest(F.floor(F.col("n") / 10), F.lit(1))
    k = F.greatest(F.lit(p.min_k), F.lit(p.first_k) - F.floor(F.col("blk") * p.block / tenth)).cast("long")
    chunk = lambda e: F.floor(e / wide).cast("long")
    more = [vec] if vec else []
    f = cut(_blocked(frames, p, more).select("video_id", "frame_idx", "app", "mot", *more, "blk", k.alias("k"), chunk(F.col("frame_idx")).alias("c"), chunk(F.col("n") - 1).alias("last")))
    n = int(f.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, here, other = ("video_id", "c1", "c2"), F.col("c"), F.col("other")
    rows = f.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    rows = rows.select("video_id", F.least(here, other).alias("c1"), F.greatest(here, other).alias("c2"), "c", "frame_idx", "app", "mot", *more, "blk", "k")
    return rows.repartition(n, *part).groupBy(*part)


def decayed_similarity_graph(frames: DataFrame, p: SegmentationParams = SegmentationParams()) -> DataFrame:
    """Time-decayed similarity edges: the best k columns of every column block per row.

    Every edge comes out once, of the task that has both its chunks, and no list of pairs or edges is
    shuffled. The graph keeps edges to every block, so its size is quadratic by definition;
    :func:`top_similar` and :func:`band_graph` are not.
    """
    return _chunk_pairs(frames, p, CHUNK_ROWS).applyInPandas(_chunk_pair(p), EDGE_SCHEMA)


def propagate_decayed(frames: DataFrame, vec: str, p: SegmentationParams = SegmentationParams(), chunk_rows: int = SUM_CHUNK_ROWS) -> DataFrame:
    """:func:`propagate` on the graph of :func:`decayed_similarity_graph`, whose edges never leave the task
    that finds them: a pair of chunks gives one weighted sum per row with a neighbour in the other chunk."""
    cur = frames
    for i in range(p.propagation_steps):
        sums = _chunk_pairs(cur, p, chunk_rows, vec).applyInPandas(_chunk_sums(p, vec), "video_id bigint, frame_idx bigint, _s array<double>, _deg double")
        agg = cut(sums.groupBy("video_id", "frame_idx").agg(weighted_sum("_s").alias("_s"), F.sum("_deg").alias("_deg")))
        now = _mixed(cur.select("video_id", "frame_idx", F.transform(vec, lambda x: x.cast("double")).alias("_v")), agg, agg.select("video_id").distinct())
        now = now.withColumnRenamed("_v", vec)
        cur = now if i + 1 == p.propagation_steps else cut(join_on(frames.drop(vec), now, ("video_id", "frame_idx")))
    return cur.select("video_id", "frame_idx", vec)


def top_similar(frames: DataFrame, k: int, p: SegmentationParams = SegmentationParams()) -> DataFrame:
    """The k best time-decayed neighbours of every row in its whole recording, exactly.

    Similarities are at most 1, so a pair at distance g weighs at most 1 / (1 + decay * g).
    Each row first meets its own and the adjacent blocks; its k-th best weight there bounds
    how far a better partner can be, and only blocks within that reach are visited. Cost
    follows the reach, not the square of the recording.
    """
    f = cut(_blocked(frames, p))
    best = _block_best(p, lambda a, blk: k + 1)
    near = f.withColumn("bj", F.explode(F.sequence(F.greatest(F.lit(0), F.col("blk") - 1).cast("long"), F.least(F.col("last_blk"), F.col("blk") + 1))))
    w = W.partitionBy("video_id", "src").orderBy(F.col("weight").desc(), "dst")
    close = cut(_match_blocks(near, f, best))
    kth = close.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == k).select("video_id", F.col("src").alias("frame_idx"), F.col("weight").alias("_kth"))
    top = p.appearance_weight + p.motion_weight
    reach = F.when(F.col("_kth").isNotNull(), F.ceil((top / F.col("_kth") - 1) / p.time_decay) + 1).otherwise(F.col("n"))
    r = join_on(f, kth, ("video_id", "frame_idx"), "left").withColumn("_reach", reach)
    lo = F.greatest(F.lit(0), F.floor((F.col("frame_idx") - F.col("_reach")) / p.block)).cast("long")
    hi = F.least(F.col("last_blk"), F.floor((F.col("frame_idx") + F.col("_reach")) / p.block)).cast("long")
    far = r.withColumn("bj", F.explode(F.sequence(lo, hi))).filter(F.abs(F.col("bj") - F.col("blk")) > 1).drop("_kth", "_reach")
    e = close.unionByName(_match_blocks(far, f, best))
    return undirected(e.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r"))


def band_graph(frames: DataFrame, vec: str, p: SegmentationParams = SegmentationParams()) -> DataFrame:
    """Edges to the most similar frames within a fixed band; cost is linear in the rows."""
    f = frames.select("video_id", "frame_idx", normalise(F.col(vec), 1e-6).alias("_u"))
    d = bounded_window(f, ("video_id",), "frame_idx", p.band, p.band, lambda w: [F.collect_list(F.struct("frame_idx", "_u")).over(w).alias("_near")])
    sims = F.transform("_near", lambda o: F.struct((-dot(F.col("_u"), o["_u"])).alias("neg"), o["frame_idx"].alias("dst")))
    top = F.slice(F.array_sort(sims), F.lit(1), F.least(F.lit(p.band_k), F.size("_near") - 1) + 1)
    e = d.select("video_id", F.col("frame_idx").alias("src"), F.explode(top).alias("_t"))
    e = e.select("video_id", "src", F.col("_t.dst").alias("dst"), (-F.col("_t.neg")).alias("weight")).filter("src <> dst and weight > 0")
    return undirected(e)


def _mixed(cur: DataFrame, sums: DataFrame, linked: DataFrame) -> DataFrame:
    """Half the vector ``_v`` and half the mean of its neighbours, from their weighted sum and degree.
    Vectors of recordings that are not ``linked`` stay as they are."""
    mean = sums.select("video_id", "frame_idx", F.transform("_s", lambda x: x / (F.col("_deg") + 1e-6)).alias("_m"))
    j = join_on(join_on(cur, mean, ("video_id", "frame_idx"), "left"), linked.withColumn("_linked", F.lit(True)), ("video_id",), "left")
    mixed = F.when(F.col("_m").isNotNull(), F.zip_with("_v", "_m", lambda a, b: 0.5 * a + 0.5 * b)).otherwise(F.transform("_v", lambda a: 0.5 * a))
    return j.select("video_id", "frame_idx", F.when(F.col("_linked"), mixed).otherwise(F.col("_v")).alias("_v"))


def propagate(vertices: DataFrame, edges: DataFrame, vec: str, steps: int = 1) -> DataFrame:
    """Mix each vector with the degree-normalised mean of its neighbours, half and half.

    Neighbour sums are one vector aggregate, so they combine before the shuffle
    and a hub vertex is no heavier than any other. Without any edge in a recording its
    vectors stay as they are.
    """
    both = edges.select("video_id", "src", "dst", "weight").unionByName(edges.select("video_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    linked = edges.select("video_id").distinct()
    cur = vertices.select("video_id", "frame_idx", F.transform(vec, lambda x: x.cast("double")).alias("_v"))
    for i in range(steps):
        msg = join_on(both, cur.select("video_id", F.col("frame_idx").alias("dst"), F.col("_v").alias("_nv")), ("video_id", "dst"))
        agg = msg.groupBy("video_id", F.col("src").alias("frame_idx")).agg(weighted_sum("_nv", F.col("weight")).alias("_s"), F.sum("weight").alias("_deg"))
        cur = _mixed(cur, agg, linked)
        if i + 1 < steps:
            cur = cut(cur)
    return cur.withColumnRenamed("_v", vec)


def smoothing_window(fps: float, seconds: float) -> int:
    w = max(3, int(fps * seconds))
    return w + 1 if w % 2 == 0 else w


def segment_boundaries(features: DataFrame, vec: str, fps: float, p: SegmentationParams = SegmentationParams()) -> DataFrame:
    """Change points of a feature sequence as [start, end) seconds."""
    w = smoothing_window(fps, p.smooth_seconds)
    lane = Lane(("video_id",), ("frame_idx",), 4096)
    ch = sg.change_score(features, lane, vec).select("video_id", (F.col("frame_idx") - 1).alias("i"), "change")
    sm = cut(blocks.quadratic_smooth(ch, ("video_id",), "i", "change", w, "smooth"))
    ra = cut(sg.trailing_ratio(sm, ("video_id",), "i", "smooth", w).select("video_id", "i", "ratio"))
    th = sg.robust_threshold(ra, ("video_id",), "ratio", p.mad_multiplier)
    pts = join_on(ra, th, ("video_id",)).filter("ratio > threshold").select("video_id", (F.col("i") - (w - 1) + w // 2).alias("point"))
    pl = Lane(("video_id",), ("point",), 4096)
    merged = iv.merge_close_points(pts, pl, int(p.min_gap_seconds * fps))
    n = features.groupBy("video_id").agg((F.count(F.lit(1)) / fps).alias("total"))
    spans = iv.points_to_intervals(merged, pl, p.min_gap_seconds, F.lit(float("inf")), fps)
    j = join_on(spans, n, ("video_id",))
    return j.select("video_id", "start_sec", F.least("end_sec", "total").alias("end_sec")).filter("end_sec > start_sec")


def segment_recordings(frames: DataFrame, fps: float, p: SegmentationParams = SegmentationParams(), graph: str = "decayed") -> DataFrame:
    """Similarity graph, propagation, change points, and segments that cover each recording."""
    f = cut(frames)
    feats = cut(propagate_decayed(f, "feat", p) if graph == "decayed" else propagate(f, cut(band_graph(f, "feat", p)), "feat", p.propagation_steps))
    spans = segment_boundaries(feats, "feat", fps, p)
    totals = f.groupBy("video_id").agg(F.count(F.lit(1)).alias("total_frames"))
    return iv.fill_gaps(spans, totals, fps)
