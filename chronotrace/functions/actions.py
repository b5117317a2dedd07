"""Actions of entities: plausibility of transitions, similarity, and alignment of action
sequences with path templates. Tables are fixed values and can be replaced by the caller."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Plausibility of going from one action to the next.
TRANSITION_SCORES = [
    ("browsing", "picking up", 0.9),
    ("picking up", "holding", 0.95),
    ("holding", "walking", 0.9),
    ("walking", "handing over", 0.8),
    ("handing over", "paying", 0.9),
    ("paying", "leaving", 0.9),
    ("holding", "putting down", 0.85),
    ("standing still", "walking", 0.95),
    ("walking", "standing still", 0.95),
    ("walking", "running", 0.6),
    ("standing still", "sitting", 0.85),
    ("sitting", "standing still", 0.85),
    ("holding", "running", 0.2),
    ("picking up", "running", 0.15),
    ("standing still", "running", 0.3),
    ("walking", "fighting", 0.1),
    ("standing still", "fighting", 0.1),
    ("holding", "threatening", 0.1),
    ("holding", "attacking", 0.05),
    ("walking", "attacking", 0.05),
    ("running", "attacking", 0.1),
    ("threatening", "attacking", 0.3),
    ("fighting", "running", 0.3),
    ("fighting", "falling", 0.4),
    ("walking", "walking", 0.95),
    ("running", "running", 0.85),
    ("standing still", "standing still", 0.98),
    ("sitting", "sitting", 0.98),
    ("holding", "holding", 0.9),
]
SAME_ACTION_SCORE = 0.9
UNKNOWN_TRANSITION_SCORE = 0.5

# Words for the same action; the last group that matches decides.
SYNONYMS = {
    "walking": ["moving", "strolling", "pacing"],
    "running": ["sprinting", "rushing", "dashing", "fleeing"],
    "standing still": ["stationary", "idle", "waiting", "standing"],
    "picking up": ["grabbing", "taking", "grasping", "snatching"],
    "putting down": ["placing", "setting down", "dropping"],
    "holding": ["carrying", "gripping"],
    "handing over": ["giving", "passing", "delivering", "transferring"],
    "paying": ["checkout", "purchasing", "buying"],
    "browsing": ["looking", "examining", "inspecting", "viewing"],
    "entering": ["coming in", "arriving"],
    "leaving": ["exiting", "departing", "going out", "walking away"],
    "sitting": ["seated", "sat down"],
    "fighting": ["attacking", "hitting", "punching", "assaulting"],
    "threatening": ["menacing", "intimidating", "brandishing"],
}


@dataclass(frozen=True)
class PathTemplate:
    name: str
    scenes: list[str]
    actions: list[str]
    optional: list[str] = field(default_factory=list)


# Ordinary courses of events per kind of scene ("*" = any scene).
_SHOP = ["retail store", "supermarket", "convenience store", "shop"]
PATH_TEMPLATES = [
    PathTemplate("normal_shopping", _SHOP, ["entering", "walking", "browsing", "picking up", "holding", "walking", "handing over", "paying", "leaving"], ["putting down", "standing still", "looking at"]),
    PathTemplate("quick_purchase", _SHOP, ["entering", "walking", "picking up", "holding", "paying", "leaving"], ["standing still"]),
    PathTemplate("browsing_only", _SHOP, ["entering", "walking", "browsing", "walking", "leaving"], ["standing still", "looking at"]),
    PathTemplate("normal_pedestrian", ["street", "sidewalk", "road", "crosswalk"], ["walking", "walking", "walking"], ["standing still", "looking at", "crossing"]),
    PathTemplate("waiting_crossing", ["street", "crosswalk", "intersection"], ["walking", "standing still", "walking"], ["looking at"]),
    PathTemplate("parking_normal", ["parking lot", "garage", "parking"], ["walking", "approaching vehicle", "opening door", "entering vehicle", "driving"], ["standing still", "holding", "putting down"]),
    PathTemplate("standing_conversation", ["*"], ["standing still", "talking", "standing still"], ["gesturing", "nodding"]),
    PathTemplate("sitting_activity", ["*"], ["walking", "sitting", "sitting", "standing still", "walking"], ["eating", "drinking", "reading", "using phone"]),
]

# Likeness of actions that are not the same, and alignment costs.
WITHIN, SAME_GROUP = 0.85, 0.8
SKIP_ACTION, SKIP_OPTIONAL, SKIP_TEMPLATE, LEADING_ACTION, LEADING_TEMPLATE = 0.15, 0.05, 0.1, 0.2, 0.1


def _within(a: Column, b: Column) -> Column:
    """One text contains the other (the empty text is contained in all)."""
    return F.contains(a, b) | F.contains(b, a)


def transition_score(action_from: Column, action_to: Column, table: list[tuple[str, str, float]] = TRANSITION_SCORES) -> Column:
    """Plausibility of a transition: listed pair, its reverse, the first listed pair whose
    names overlap, the same action, else the default."""
    a, b = F.lower(F.trim(action_from)), F.lower(F.trim(action_to))
    pairs = F.create_map(*[x for k1, k2, s in {(k1, k2): (k1, k2, s) for k1, k2, s in table}.values() for x in (F.lit(f"{k1}|{k2}"), F.lit(s))])
    rows = F.array(*[F.struct(F.lit(k1).alias("p"), F.lit(k2).alias("q"), F.lit(s).alias("s")) for k1, k2, s in table])
    like = F.filter(rows, lambda r: (_within(r["p"], a) & _within(r["q"], b)) | (_within(r["q"], a) & _within(r["p"], b)))
    return F.coalesce(
        F.try_element_at(pairs, F.concat_ws("|", a, b)), F.try_element_at(pairs, F.concat_ws("|", b, a)), F.try_element_at(like, F.lit(1))["s"],
        F.when(a == b, SAME_ACTION_SCORE).otherwise(UNKNOWN_TRANSITION_SCORE),
    )


def action_group(action: Column, synonyms: dict[str, list[str]] = SYNONYMS) -> Column:
    """Name of the last synonym group one of whose words occurs in the action; null if none."""
    a = F.lower(F.trim(action))
    hits = [F.when(F.exists(F.array(*[F.lit(w) for w in [k, *ws]]), lambda w: F.contains(a, w)), F.lit(k)) for k, ws in synonyms.items()]
    return F.coalesce(*reversed(hits))


def action_similarity(a: Column, b: Column) -> Column:
    """1 for the same action, less where one text holds the other or both are of one synonym group."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return F.when(x == y, 1.0).when(_within(x, y), WITHIN).when(action_group(a) == action_group(b), SAME_GROUP).otherwise(0.0)


def align(likeness: list, columns: list[int], optional: list[bool]) -> float:
    """Best alignment score of a sequence with a template, scaled to [0, 1].

    ``likeness`` has a row per action of the sequence, a value per known template action;
    ``columns`` picks the template's; ``optional`` marks the actions that are cheap to skip.
    """
    m = len(columns)
    if not len(likeness) or not m:
        return 0.0
    best = -LEADING_TEMPLATE * np.arange(m + 1)
    slide = SKIP_TEMPLATE * np.arange(m + 1)
    for like, cheap in zip(likeness, optional):
        here = np.asarray(like, dtype=float)[columns]
        stay = best - (SKIP_OPTIONAL if cheap else SKIP_ACTION)
        stay[0] = best[0] - LEADING_ACTION
        stay[1:] = np.maximum(stay[1:], best[:-1] + here)
        best = np.maximum.accumulate(stay + slide) - slide  # skipped steps of the template cost alike
    return float(np.clip(best[-1] / min(len(likeness), m), 0.0, 1.0))


class _Likeness(dict):
    """Likeness of action pairs as they come up, by the rule of :func:`action_similarity`."""

    def _group(self, text: str) -> str | None:
        return next((k for k in reversed(SYNONYMS) if any(w in text for w in (k, *SYNONYMS[k]))), None)

    def __missing__(self, pair: tuple[str, str]) -> float:
        x, y = (p.strip().lower() for p in pair)
        kin = self._group(x)
        value = 1.0 if x == y else WITHIN if x in y or y in x else SAME_GROUP * (kin is not None and kin == self._group(y))
        self[pair] = value
        return value


def template_scores(templates: list[PathTemplate] = PATH_TEMPLATES):
    """Arrow UDF: action array -> one alignment score per template, in template order."""
    steps = list(dict.fromkeys(a for t in templates for a in t.actions))
    picks = [[steps.index(a) for a in t.actions] for t in templates]
    cheap = [{o.lower() for o in t.optional} for t in templates]

    @F.pandas_udf("array<double>")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        like = _Likeness()
        rows: dict[str, list[float]] = {}
        for seqs in batches:
            out = []
            for seq in seqs:
                table = [rows.get(a) or rows.setdefault(a, [like[a, w] for w in steps]) for a in seq]
                out.append([align(table, p, [a.lower() in c for a in seq]) for p, c in zip(picks, cheap)])
            yield pd.Series(out)

    return scores


def best_template(scores: Column, scene: Column, templates: list[PathTemplate] = PATH_TEMPLATES) -> Column:
    """Struct(name, score) of the best template for the scene, the first one on a tie; null
    when none scores above 0. Templates of other scenes are left out unless the scene is blank."""
    s = F.lower(F.trim(scene))
    cand = []
    for i, t in enumerate(templates):
        fits = F.lit(True) if t.scenes == ["*"] else (s == "") | F.exists(F.array(*[F.lit(x.lower()) for x in t.scenes]), lambda k: _within(k, s))
        sc = F.element_at(scores, i + 1)
        cand.append(F.when(fits & (sc > 0), F.struct((-sc).alias("neg"), F.lit(i).alias("i"), F.lit(t.name).alias("name"), sc.alias("score"))))
    return F.array_min(F.array_compact(F.array(*cand)))


def matching_rules(scene: Column, contracts: dict[str, list[str]]) -> Column:
    """Rules of every key that contains, or is contained in, the scene, in table order; the
    ``default`` rules when none matches."""
    s = F.lower(F.trim(scene))
    parts = [F.when(_within(s, F.lit(k)), F.array(*[F.lit(r) for r in rs])).otherwise(F.array().cast("array<string>")) for k, rs in contracts.items() if k != "default"]
    default = F.array(*[F.lit(r) for r in contracts.get("default", [])]).cast("array<string>")
    found = F.concat(*parts) if parts else F.array().cast("array<string>")
    return F.when(F.size(found) > 0, found).otherwise(default)
