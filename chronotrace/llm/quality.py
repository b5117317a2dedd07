"""Quality of narratives by weak supervision, with DataFrame functions only.

Each rule looks at one trait of a narrative and votes good (1), bad (-1) or abstains (0); each kind of
damage is seen by two rules or more, as agreement is what the estimate learns from. How far a
rule can be trusted is not set by hand: expectation-maximisation over the counts of vote patterns
estimates, for each rule, how often it votes good, bad or not at all on good and on bad narratives,
and the posterior of "good" replaces the demand that all rules pass. Patterns are at most 3 to the
number of rules, whatever the number of narratives, so the estimate runs in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotrace.llm.columns import ink, let, text_or_empty, without, word_array
from chronotrace.session import cut

WINDOW = 8
ODD = "!#$%&*+/<=>@\\^_`{|}~"
SYMBOLS = "#*$%&|<>"
ROUNDS = 25
#: Rule: trait, good at most, bad above. Between the two it abstains. A trait may be per hundred.
RULES = (
    ("symbols", "100 * n_symbols / word_chars", 0.5, 3.0),
    ("symbols_by_word", "100 * n_symbols / n_words", 3.0, 15.0),
    ("odd_signs", "100 * n_odd / n_words", 8.0, 20.0),
    ("odd_signs_by_char", "100 * n_odd / word_chars", 1.5, 3.5),
    ("shouting", "100 * n_upper / word_chars", 10.0, 40.0),
    ("shouting_by_word", "100 * n_upper / n_words", 60.0, 200.0),
    ("lines", "100 * n_dup_lines / n_lines", 10.0, 40.0),
    ("repeats", "100 * n_repeat_words / n_words", 10.0, 25.0),
    ("digits", "100 * n_digits / word_chars", 10.0, 30.0),
    ("word_length", "abs(word_chars / n_words - 5.5)", 2.5, 6.5),
    ("short", "100 / n_words", 2.0, 5.0),
)
#: Starting point: P(vote bad), P(abstain), P(vote good) of every rule on bad and on good narratives.
START_BAD, START_GOOD, PRIOR = (0.4, 0.2, 0.4), (0.05, 0.15, 0.8), 0.8
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside a window of ``window`` words that occurs twice or more in the same array.

    Windows become hashes; a sort puts equal ones side by side; the starts of those with an equal
    neighbour are sorted back, and each covers what the one before it has not.
    """
    starts = F.sequence(F.lit(1), F.size(words) - window + 1)

    def covered(hashes: Column) -> Column:
        at = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(a: Column) -> Column:
            same = lambda k, j: F.coalesce(F.get(a, k)["h"] == F.get(a, j)["h"], F.lit(False))
            hit = F.filter(a, lambda x, k: same(k, k - 1) | same(k, k + 1))
            return F.sort_array(F.transform(hit, lambda x: x["i"]))

        none = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
        add = lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(window), i - s["last"])).alias("n"))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(at, lambda a: F.aggregate(twice(a), none, add, lambda s: s["n"])))

    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, window)))
    return F.when(F.size(words) < window, F.lit(0)).otherwise(let(hashes, covered)).cast("long")


def with_traits(narratives: DataFrame, text_col: str = "narrative") -> DataFrame:
    """Input columns and ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and the other
    counts the rules read, all long."""
    text = text_or_empty(text_col)
    drop = lambda chars: F.length(F.col("_ink")) - F.length(without("_ink", chars))
    d = narratives.withColumns({"_words": word_array(text_col), "_ink": ink(text_col), "_lines": F.filter(F.split(text, "\n"), lambda x: F.length(ink(x)) > 0)})
    d = d.withColumns(
        {
            "n_words": F.size("_words"),
            "word_chars": F.length("_ink"),
            "n_symbols": drop(SYMBOLS),
            "n_lines": F.size("_lines"),
            "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
            "n_repeat_words": repeated_words(F.col("_words")),
            "n_upper": drop(_UPPER),
            "n_digits": drop("0123456789"),
            "n_odd": drop(ODD),
        }
    ).drop("_words", "_ink", "_lines")
    counts = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_odd")
    return d.withColumns({c: F.col(c).cast("long") for c in counts})


def votes() -> Column:
    """Vote of every rule, in order; a narrative without words gets only abstentions."""
    one = lambda trait, good, bad: F.when(F.expr("n_words = 0"), 0).when(F.expr(trait) <= good, 1).when(F.expr(trait) > bad, -1).otherwise(0)
    return F.array(*[one(t, g, b) for _, t, g, b in RULES])


def _posterior(model: Column, vote: Column) -> Column:
    """P(good | votes) under ``model``: a struct of prior and, per rule, chances of bad, none, good
    on bad (``b``) and on good (``g``) narratives."""
    odds = F.aggregate(
        F.sequence(F.lit(0), F.lit(len(RULES) - 1)),
        F.log(model["prior"] / (F.lit(1.0) - model["prior"])),
        lambda s, r: s + F.log(F.get(F.get(model["g"], r), F.get(vote, r) + 1)) - F.log(F.get(F.get(model["b"], r), F.get(vote, r) + 1)),
    )
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def fit_rule_model(voted: DataFrame, vote_col: str = "votes", rounds: int = ROUNDS) -> DataFrame:
    """One row with the column ``model``: accuracies of the rules by expectation-maximisation.

    Votes are counted by pattern first. Each round weighs patterns by their posterior and takes new
    chances with one pseudo-count per outcome. Empty input keeps the starting point.
    """
    patterns = voted.groupBy(F.col(vote_col).alias("v")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("p"))
    table = lambda p: F.array(*[F.array(*[F.lit(x) for x in p]) for _ in RULES])
    start = F.struct(F.lit(PRIOR).alias("prior"), table(START_BAD).alias("b"), table(START_GOOD).alias("g"))

    def step(model: Column, _: Column) -> Column:
        weighed = F.transform(F.col("p"), lambda x: F.struct(x["v"].alias("v"), (x["n"] * _posterior(model, x["v"])).alias("g"), x["n"].alias("n")))

        def next_model(q: Column) -> Column:
            total = lambda pick: F.aggregate(q, F.lit(0.0), lambda s, x: s + pick(x))
            n, good = total(lambda x: x["n"]), total(lambda x: x["g"])

            def chances(weight) -> Column:
                rule = lambda r: F.transform(
                    F.sequence(F.lit(-1), F.lit(1)), lambda o: F.lit(1.0) + F.aggregate(q, F.lit(0.0), lambda s, x: s + F.when(F.get(x["v"], r) == o, weight(x)).otherwise(0.0))
                )
                return F.transform(F.sequence(F.lit(0), F.lit(len(RULES) - 1)), lambda r: let(rule(r), lambda c: F.transform(c, lambda y: y / (F.get(c, F.lit(0)) + F.get(c, F.lit(1)) + F.get(c, F.lit(2))))))

            return F.struct(((good + 1.0) / (n + 2.0)).alias("prior"), chances(lambda x: x["n"] - x["g"]).alias("b"), chances(lambda x: x["g"]).alias("g"))

        return let(weighed, next_model)

    return one.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("model"))


def quality_verdicts(narratives: DataFrame, id_col: str = "video_id", text_col: str = "narrative", least: float = 0.5) -> DataFrame:
    """Per narrative: ``video_id``, the traits, ``base_failed``, ``p_good`` and ``kept``.

    ``base_failed``: under 20 words, or more than 30 of 100 words in repeated windows. ``kept`` is
    false for those, else whether the posterior reaches ``least``. A null text counts as empty, has
    only abstaining rules and fails the base; rows that repeat are judged alike; an empty table gives
    an empty result; other columns are not read.
    """
    base = with_traits(narratives.select(F.col(id_col).alias("video_id"), F.col(text_col).alias("narrative")))
    base = cut(base.drop("narrative").withColumn("votes", votes()))
    model = fit_rule_model(base.select("votes"))
    judged = base.withColumn("_model", model.scalar()).withColumn("p_good", _posterior(F.col("_model"), F.col("votes"))).drop("_model")
    failed = (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))
    judged = judged.withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least))
