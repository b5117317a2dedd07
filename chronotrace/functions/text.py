"""Text columns: clock strings, scores and JSON in free text, keyword evidence, clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronotrace.functions.vectors import let

NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"


def format_clock(sec: Column) -> Column:
    """Seconds as ``mm:ss.f``; negative values count as 0."""
    s = F.greatest(F.lit(0.0), sec)
    return F.format_string("%02d:%04.1f", F.floor(s / 60).cast("int"), s - F.floor(s / 60) * 60)


def parse_clock(text: Column) -> Column:
    """``h:m:s``, ``m:s`` or plain seconds; 0 for anything else."""
    p = F.split(F.trim(text), ":")
    ok = F.forall(p, lambda x: F.rlike(x, F.lit(NUMBER)))
    val = F.aggregate(p, F.lit(0.0), lambda acc, x: acc * 60 + x.try_cast("double"))
    return F.when(ok & (F.size(p) <= 3), val).otherwise(0.0)


def _in_unit(x: Column) -> Column:
    return F.when((x >= 0) & (x <= 1), x)


# Where a score may stand in an answer, in order of trust.
SCORE_OBJECT = r'(?s)\{[^{}]*"score"[^{}]*\}'
SCORE_PATTERNS = [r'(?i)"score"\s*:\s*(\d+\.?\d*)', r"(?i)score[:\s]+(\d+\.?\d*)", r"(?i)\b(0\.\d+|1\.0|0|1)\b"]
TEN_POINT_PATTERNS = [r"[Ss]core:\s*(\d+(?:\.\d+)?)", r"(\d+(?:\.\d+)?)\s*/\s*10", r"(\d+(?:\.\d+)?)\s*out of\s*10", r"^(\d+(?:\.\d+)?)\s*$"]


def _first_group(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, 1).try_cast("double")


def _head(x: Column, n: int | None) -> Column:
    return x if n is None else F.left(x, F.lit(n))


def unit_score(text: Column, max_answer: int | None = None) -> Column:
    """Struct(score, status, summary, reasoning) from an answer: a JSON object with a score
    (number or one-element list), else a number after the word score, else any 0..1 number;
    -1 and an error status with the answer (its first ``max_answer`` characters) when nothing fits."""
    obj = F.regexp_extract(text, SCORE_OBJECT, 0)
    raw = F.coalesce(F.get_json_object(obj, "$.score[0]"), F.get_json_object(obj, "$.score"))
    from_json = _in_unit(raw.try_cast("double"))
    loose = F.coalesce(*[_in_unit(_first_group(text, p)) for p in SCORE_PATTERNS])
    score = F.coalesce(from_json, loose, F.lit(-1.0))
    txt = lambda k: F.when(from_json.isNotNull(), F.coalesce(F.get_json_object(obj, f"$.{k}"), F.lit(""))).otherwise("")
    status = F.when(score >= 0, "success").otherwise(F.concat(F.lit("no score in answer: "), _head(text, max_answer)))
    return F.struct(score.alias("score"), status.alias("status"), txt("summary").alias("summary"), txt("reasoning").alias("reasoning"))


def ten_point_score(text: Column, default: float = 0.3) -> Column:
    """0..10 score of an answer scaled to 0..1, by pattern or by the first small number."""
    found = F.coalesce(*[_first_group(text, p) for p in TEN_POINT_PATTERNS])
    hit = F.when(found.isNotNull(), F.least(found / 10, F.lit(1.0)))
    first = _first_group(text, r"(\d+(?:\.\d+)?)")
    return F.coalesce(hit, F.when(first <= 10, first / 10), F.lit(default))


def _count(text: Column, ch: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))


def _valid(text: Column) -> Column:
    """``text`` where it is JSON, else null."""
    return let(text, lambda c: F.when(F.try_parse_json(F.when(F.length(c) > 0, c)).isNotNull(), c))


# Strings in either quotes, bare clock values, brackets, bare words, and a string that never ends.
_TOKEN = r"""(?s)"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|\d+:\d{2}(?:\.\d+)?|[{}\[\],:]|[^\s{}\[\],:"']+|["'].*"""


def _spelled(token: Column) -> Column:
    """A token as JSON spells it: double quotes around strings and clock values."""
    inner = F.replace(F.substring(token, F.lit(2), F.length(token) - 2), F.lit('"'), F.lit('\\"'))
    single = token.startswith("'") & token.endswith("'")
    return F.when(single, F.concat(F.lit('"'), inner, F.lit('"'))).when(F.rlike(token, F.lit(r"^\d+:\d")), F.concat(F.lit('"'), token, F.lit('"'))).otherwise(token)


def _rebuilt(text: Column, keep_cut: bool) -> tuple[Column, Column]:
    """First document of a text, put together again token by token.

    The scan holds the text so far, the brackets that would close it, and both as they stood when
    the last member was complete. Returned are the document closed where it stops and closed after
    its last complete member. A string that never ends is kept only with ``keep_cut``.
    """
    bare = lambda x: F.regexp_replace(x, ",$", "")

    def step(s: Column, x: Column) -> Column:
        opens, closes = x.isin("{", "["), x.isin("}", "]")
        endless = (F.length(x) == 1) & x.isin('"', "'") | (x.startswith('"') & ~x.endswith('"')) | (x.startswith("'") & ~x.endswith("'"))
        shut_more = F.concat(F.when(x == "{", "}").otherwise("]"), s["shut"])
        shut_less = F.substring(s["shut"], F.lit(2), F.length(s["shut"]))
        fits = F.substring(s["shut"], 1, 1) == x
        cut = F.concat(s["out"], F.lit('"'), F.substring(x, F.lit(2), F.length(x)), F.lit('"')) if keep_cut else s["out"]
        put = F.concat(s["out"], _spelled(x))
        full = lambda out, shut: F.struct(out.alias("out"), shut.alias("shut"), out.alias("safe"), shut.alias("safe_shut"))
        part = lambda out, shut=s["shut"]: F.struct(out.alias("out"), shut.alias("shut"), s["safe"].alias("safe"), s["safe_shut"].alias("safe_shut"))
        return (
            F.when((s["out"] != "") & (s["shut"] == ""), s)
            .when(opens, part(F.concat(s["out"], x), shut_more))
            .when(closes & fits, full(F.concat(bare(s["out"]), x), shut_less))
            .when(closes, s)
            .when(x == ",", F.struct(F.concat(s["out"], x).alias("out"), s["shut"].alias("shut"), s["out"].alias("safe"), s["shut"].alias("safe_shut")))
            .when(endless, part(cut))
            .otherwise(part(put))
        )

    none = F.struct(*[F.lit("").alias(n) for n in ("out", "shut", "safe", "safe_shut")])
    tokens = F.regexp_extract_all(F.regexp_extract(text, r"(?s)\{.*", 0), F.lit(_TOKEN), F.lit(0))
    s = F.aggregate(tokens, none, step)
    return let(s, lambda z: F.concat(bare(z["out"]), z["shut"])), let(s, lambda z: F.concat(z["safe"], z["safe_shut"]))


def json_in_text(text: Column) -> Column:
    """JSON document found in an answer, repaired where that is simple; null if none.

    Tried in turn: the whole text, a fenced block, the outermost braces, and the first document
    rebuilt from its tokens: trailing commas, single quotes and bare clock values are put right, and
    a truncated document is closed, without its unfinished member if need be.
    """
    t = F.trim(text)
    fenced = F.trim(F.regexp_extract(t, r"(?s)```\w*\s*(.*?)\s*```", 1))
    return F.coalesce(*[_valid(c) for c in (t, fenced, F.regexp_extract(t, r"(?s)\{.*\}", 0), *_rebuilt(t, False))])


def json_string_cut(text: Column) -> Column:
    """Like :func:`json_in_text`, but an answer cut inside a string keeps what there is of it."""
    return F.coalesce(_valid(F.trim(text)), _valid(_rebuilt(F.trim(text), True)[0]), json_in_text(text))


def loose_bool(x: Column) -> Column:
    """True for true, 1 and yes in any case, false otherwise (also for null)."""
    return F.coalesce(F.lower(x).isin("true", "1", "yes"), F.lit(False))


def _field(js: Column, key: str, default: str, limit: int | None = None) -> Column:
    c = F.coalesce(F.get_json_object(js, f"$.{key}"), F.lit(default))
    return F.left(c, F.lit(limit)) if limit else c


def semantic_fields(js: Column) -> Column:
    """Struct of the nine semantic keys with defaults for missing ones."""
    g = lambda k: F.get_json_object(js, f"$.{k}")
    return F.struct(
        F.coalesce(g("box_action"), g("temporal_action"), F.lit("")).alias("box_action"),
        _field(js, "context_relation", "").alias("context_relation"),
        _field(js, "action", "unknown").alias("action"),
        _field(js, "action_object", "none").alias("action_object"),
        _field(js, "posture", "unknown").alias("posture"),
        F.coalesce(g("scene_context"), g("scene_type"), F.lit("unknown")).alias("scene_context"),
        loose_bool(g("is_suspicious")).alias("is_suspicious"),
        F.coalesce(g("danger_score").try_cast("double"), F.lit(0.0)).alias("danger_score"),
        _field(js, "anomaly_category_guess", "none").alias("anomaly_category_guess"),
    )


SNAPSHOT_ENTITY = (
    "array<struct<portrait:string,action:string,action_object:string,location:string,posture:string,is_suspicious:string,suspicious_reason:string>>"
)


def snapshot_fields(js: Column, max_long: int | None = None, max_short: int | None = None, max_density: int | None = None) -> Column:
    """Cleaned snapshot: defaults, loose booleans, danger clamped to [0, 1]. With limits, portraits and
    reasons are cut to ``max_long`` characters, the crowd density to ``max_density``, other texts to ``max_short``."""
    ents = F.from_json(F.get_json_object(js, "$.entities"), SNAPSHOT_ENTITY)

    def clean(e):
        cut = lambda k, n, d="": _head(F.coalesce(e[k], F.lit(d)), n).alias(k)
        return F.struct(
            cut("portrait", max_long, "unknown"), cut("action", max_short, "unknown"), cut("action_object", max_short), cut("location", max_short), cut("posture", max_short),
            loose_bool(e["is_suspicious"]).alias("is_suspicious"), cut("suspicious_reason", max_long),
        )

    danger = F.get_json_object(js, "$.visual_danger_score").try_cast("double")
    return F.struct(
        F.coalesce(F.get_json_object(js, "$.frame_id").try_cast("bigint"), F.lit(-1)).alias("frame_id"),
        F.coalesce(F.get_json_object(js, "$.timestamp").try_cast("double"), F.lit(-1.0)).alias("timestamp"),
        F.coalesce(F.transform(F.filter(ents, lambda e: e.isNotNull()), clean), F.array().cast("array<struct<portrait:string,action:string,action_object:string,location:string,posture:string,is_suspicious:boolean,suspicious_reason:string>>")).alias("entities"),
        _head(F.coalesce(F.get_json_object(js, "$.scene.type"), F.lit("")), max_short).alias("scene_type"),
        _head(F.coalesce(F.get_json_object(js, "$.scene.crowd_density"), F.lit("")), max_density).alias("crowd_density"),
        F.coalesce(F.get_json_object(js, "$.motion_energy").try_cast("double"), F.lit(0.0)).alias("motion_energy"),
        loose_bool(F.get_json_object(js, "$.is_cinematic")).alias("is_cinematic"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(danger, F.lit(0.0)))).alias("danger"),
    )


def verdict_fields(answer: Column) -> Column:
    """Verdict struct from an answer: clamped confidence, break time as number or clock."""
    return let(json_in_text(answer), _verdict_of)


def _verdict_of(js: Column) -> Column:
    g = lambda k: F.get_json_object(js, f"$.{k}")
    raw = g("break_timestamp")
    brk = F.coalesce(raw.try_cast("double"), F.when(F.rlike(raw, F.lit(r"^\d+:\d+(\.\d+)?$")), parse_clock(raw)))
    conf = F.coalesce(g("confidence").try_cast("double"), F.lit(0.0))
    return F.struct(
        js.isNotNull().alias("parsed"), loose_bool(g("is_anomaly")).alias("is_anomaly"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf)).alias("confidence"),
        brk.alias("break_ts"), F.coalesce(g("reason"), g("reason_en"), F.when(js.isNull(), "answer is not JSON").otherwise("")).alias("reason"),
        loose_bool(g("is_cinematic_false_alarm")).alias("film_false_alarm"),
    )


# Words that count as evidence in an entity narrative (two rule sets).
EVIDENCE_WORDS = [
    "suspicious", "dangerous", "extreme danger", "fighting", "stealing", "shooting", "fire", "running away", "climbing", "vandalizing",
]
EVIDENCE_WORDS_GRAPH = ["低合理性", "low reasonableness", "激增", "surge", "危险度", "danger", "⚠️", "断裂", "breakage"]


def keyword_evidence(text: Column, words: list[str] = EVIDENCE_WORDS) -> Column:
    """Struct(is_anomaly, confidence, hits): 0.3 plus 0.1 per word found, at most 0.85."""
    low = F.lower(text)
    hits = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
    return let(hits, lambda h: F.struct((F.size(h) > 0).alias("is_anomaly"), F.round(F.least(F.lit(0.85), 0.3 + 0.1 * F.size(h)), 2).alias("confidence"), h.alias("hits")))


# Scene words that suggest film or broadcast material.
FILM_SCENE_WORDS = [
    "movie", "film", "cinema", "studio", "stage", "set", "broadcast", "tv show", "television", "news studio", "sports arena", "basketball court",
    "soccer field", "football field", "stadium", "ice rink", "wrestling ring", "boxing ring", "concert", "performance", "theater",
]
FILM_NAME = r"(?i)^(?!v=)[A-Z][\w.]+\.\d{4}__#"


def is_film_name(stem: Column) -> Column:
    return F.rlike(stem, F.lit(FILM_NAME))


def film_scene(scene: Column) -> Column:
    """True / false for a known scene, null for a blank or unknown one."""
    s = F.lower(F.trim(scene))
    hit = F.exists(F.array(*[F.lit(w) for w in FILM_SCENE_WORDS]), lambda w: F.contains(s, w))
    return F.when(s.isNotNull() & (s != "") & (s != "unknown"), hit)


def errors_of(*checks: tuple[Column, str]) -> Column:
    """Array of the messages whose condition holds."""
    return F.array_compact(F.array(*[F.when(c, F.lit(msg)) for c, msg in checks]))
