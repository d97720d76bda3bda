"""Quality rules that vote or abstain, weighed by expectation-maximisation (weak supervision).

Every rule looks at a statistic of a whole text and votes good, votes bad, or abstains. How often
each rule casts each vote on good and on bad documents is not known; it is estimated, with the
share of good documents, by expectation-maximisation on the counts of vote patterns over all
documents (at most 3**rules patterns, so the fit is a small sum on the driver). The posterior
probability of being good then decides, instead of asking every rule to pass.

All statistics are built-in column expressions; no Python runs on the executors.

Defined results: null and empty texts have no words and zero statistics, and fail the base
check; very long texts are one row like any other; repeated rows get the same verdict; empty
tables give empty results (the starting estimates are kept); other columns pass through, and
working columns have reserved names beginning with ``_q_``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio.session import materialize

WHITE = " \t\n\x0b\f\r"
THRESHOLD = 0.5
PSEUDO = 20.0
GOOD, BAD, ABSTAIN = 1, 0, -1


@dataclass(frozen=True)
class Rule:
    """Votes bad above ``bad`` and good at or below ``good`` of a statistic; else abstains."""

    name: str
    statistic: str
    bad: float
    good: float | None = None

    def vote(self) -> Column:
        value = F.col(self.statistic)
        vote = F.when(value > self.bad, F.lit(BAD))
        if self.good is not None:
            vote = vote.when(value <= self.good, F.lit(GOOD))
        return vote.otherwise(F.lit(ABSTAIN))


RULES = (
    Rule("symbols", "_q_symbols", 0.25),
    Rule("capitals", "_q_capitals", 0.5),
    Rule("shouting", "_q_shouts", 0.25),
    Rule("same_lines", "_q_same_lines", 0.4),
    Rule("same_words", "_q_repeats", 0.35),
    Rule("word_length", "_q_odd_length", 0.5),
    Rule("prose", "_q_not_prose", 2.0, 0.5),
)


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what rules look at.

    Repeated 3-word windows of a text are found by sorting (hash, position) pairs of its windows,
    so a text of n words takes n log n steps, however often its words repeat.
    """
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    bare = F.btrim(F.col("_q_text"), F.lit(WHITE))
    base = docs.withColumn("_q_text", content).withColumn(
        "_q_words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t-\r]+"))
    )
    n = F.size("_q_words")
    hashed = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(
            F.xxhash64(F.get("_q_words", i), F.get("_q_words", i + 1), F.get("_q_words", i + 2)).alias("h"), i.alias("p")
        ),
    )
    empty = F.array().cast("array<struct<h:bigint,p:int>>")
    windows = base.withColumn("_q_sorted", F.when(n >= 3, F.sort_array(hashed)).otherwise(empty))

    def again(x: Column, i: Column) -> Column:
        h = x["h"]
        before, after = F.get("_q_sorted", i - 1)["h"], F.get("_q_sorted", i + 1)["h"]
        return h.eqNullSafe(before) | h.eqNullSafe(after)

    places = F.transform(F.filter("_q_sorted", again), lambda x: x["p"])
    found = windows.withColumn("_q_places", places)
    covered = F.array_distinct(
        F.concat("_q_places", F.transform("_q_places", lambda p: p + 1), F.transform("_q_places", lambda p: p + 2))
    )
    lined = found.withColumn(
        "_q_lines", F.filter(F.split("_q_text", "\n"), lambda line: F.btrim(line, F.lit(WHITE)) != "")
    )
    letters = F.array_join("_q_words", "")

    def only(pattern: str) -> Column:
        """Number of characters left when every run of ``pattern`` is taken out."""
        return F.char_length(F.regexp_replace("_q_text", pattern, ""))

    counted = lined.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.char_length(letters).cast("long"),
            "n_symbols": only(r"[^#*$%&|<>]+").cast("long"),
            "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
            "n_repeat_words": F.size(covered).cast("long"),
            "_q_n_lines": F.size("_q_lines"),
            "_q_n_capitals": only(r"[^\p{Lu}]+"),
            "_q_n_shouts": only("[^!]+"),
            "_q_n_stops": only("[^.,]+"),
        }
    ).drop("_q_text", "_q_words", "_q_sorted", "_q_places", "_q_lines")
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    length = F.col("word_chars") / words
    stops = F.col("_q_n_stops") / words
    rated = counted.withColumns(
        {
            "_q_symbols": F.col("n_symbols") / words,
            "_q_capitals": F.col("_q_n_capitals") / chars,
            "_q_shouts": F.col("_q_n_shouts") / words,
            "_q_same_lines": F.col("n_dup_lines") / F.greatest(F.col("_q_n_lines"), F.lit(1)),
            "_q_repeats": F.col("n_repeat_words") / words,
            "_q_odd_length": F.when((length < 2.5) | (length > 12), 1.0).otherwise(0.0),
        }
    )
    # prose has stops at a usual rate and few capitals; what has neither for certain abstains
    calm = (F.col("_q_capitals") < 0.1) & (F.col("_q_shouts") < 0.02) & (F.col("_q_symbols") < 0.02)
    return rated.withColumn(
        "_q_not_prose", F.when(calm & stops.between(0.03, 0.4) & (F.col("_q_repeats") < 0.2), 0.0).otherwise(1.0)
    )


def base_failed() -> Column:
    """Too short, or more than half of the words lie in repeated windows."""
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


@dataclass(frozen=True)
class Model:
    """Share of good documents, and of each rule the chance of each vote on good and bad ones."""

    good: float
    votes: dict[str, dict[int, dict[int, float]]]  # rule -> class -> vote -> chance

    def posterior(self, rules: tuple[Rule, ...]) -> Column:
        """Probability that a document is good, from its ``_q_vote_*`` columns."""
        odds = F.lit(math.log(self.good / (1 - self.good)))
        terms = []
        for rule in rules:
            chance = self.votes[rule.name]
            term = F.lit(0.0)
            for vote in (GOOD, BAD, ABSTAIN):
                weight = math.log(chance[GOOD][vote] / chance[BAD][vote])
                term = F.when(F.col(f"_q_vote_{rule.name}") == vote, F.lit(weight)).otherwise(term)
            terms.append(term)
        total = reduce(lambda a, b: a + b, terms, odds)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def start(rules: tuple[Rule, ...]) -> Model:
    """A bad vote is rare on good documents; each rule finds a part of the bad ones."""
    votes = {}
    for rule in rules:
        good_vote = 0.5 if rule.good is not None else 0.005
        votes[rule.name] = {
            GOOD: {GOOD: good_vote, BAD: 0.004, ABSTAIN: 1 - good_vote - 0.004},
            BAD: {GOOD: good_vote / 10, BAD: 0.25, ABSTAIN: 1 - good_vote / 10 - 0.25},
        }
    return Model(0.85, votes)


def estimate(patterns: list[tuple[tuple[int, ...], int]], rules: tuple[Rule, ...], rounds: int = 200) -> Model:
    """Expectation-maximisation over (votes of the rules, number of documents) patterns.

    ``PSEUDO`` documents in the proportions of the start keep every chance above zero, and keep a
    handful of odd documents from turning the rules around.
    """
    model = first = start(rules)
    total = sum(n for _, n in patterns)
    for _ in range(rounds):
        weight = {GOOD: PSEUDO * first.good, BAD: PSEUDO * (1 - first.good)}
        sums = {
            r.name: {c: {v: weight[c] * first.votes[r.name][c][v] for v in (GOOD, BAD, ABSTAIN)} for c in (GOOD, BAD)}
            for r in rules
        }
        for votes, n in patterns:
            odds = math.log(model.good / (1 - model.good))
            for rule, vote in zip(rules, votes):
                chance = model.votes[rule.name]
                odds += math.log(chance[GOOD][vote] / chance[BAD][vote])
            good = n / (1 + math.exp(-max(-700.0, min(700.0, odds))))
            for c, w in ((GOOD, good), (BAD, n - good)):
                weight[c] += w
                for rule, vote in zip(rules, votes):
                    sums[rule.name][c][vote] += w
        share = weight[GOOD] / (total + PSEUDO)
        chances = {
            name: {c: {v: x / sum(by.values()) for v, x in by.items()} for c, by in classes.items()}
            for name, classes in sums.items()
        }
        moved, model = abs(share - model.good), Model(min(max(share, 1e-6), 1 - 1e-6), chances)
        if moved < 1e-9:
            break
    return model


def with_votes(rated: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return rated.withColumns({f"_q_vote_{r.name}": r.vote() for r in rules})


def fit(voted: DataFrame, rules: tuple[Rule, ...] = RULES) -> Model:
    """Fit on the vote patterns of all documents; what is collected is bounded by 3**rules."""
    names = [f"_q_vote_{r.name}" for r in rules]
    rows = voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()
    return estimate(sorted((tuple(row[n] for n in names), row["n"]) for row in rows), rules)


def judged(voted: DataFrame, model: Model, rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """Add base_failed, quality (the posterior) and kept."""
    return (
        voted.withColumn("base_failed", base_failed())
        .withColumn("quality", model.posterior(rules))
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
    )


def accepted(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows of ``docs`` that the rules keep; no shuffle of texts.

    Rows and votes are written once: the fit reads the votes alone, and the filter is a short
    expression over them (over the statistics themselves the optimiser would repeat the work).
    """
    # whole rows ride along as one struct, so that no column of theirs meets a working column
    rows = docs.select(F.col(text).alias("text"), F.struct(*[F.col(c) for c in docs.columns]).alias("_q_row"))
    rated = with_votes(with_statistics(rows), rules)
    votes = [f"_q_vote_{r.name}" for r in rules]
    short = base_failed().alias("_q_failed")
    voted = materialize(rated.select("_q_row", *votes, short), "votes")
    good = fit(voted, rules).posterior(rules) >= THRESHOLD
    return voted.filter(~F.col("_q_failed") & good).select("_q_row.*")
