"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0..1: straight lines between knots. Its
integral up to time t, scaled to the source's target, is the source's cumulative token demand.
A document that starts after c tokens of its source is wanted when that demand reaches c, so
inverting the demand gives the document its training position, and a range sort by position
gives the training order. Where the target exceeds the source, the source is read again, at
most ``max_repeats`` times; where it is smaller, the documents past the demand are not taken.

Documents are taken whole. A document that does not fit into what its source still lacks is
skipped and the reading goes on behind it, so in the end a source lacks less than its smallest
document that is not used up. With ``fillers`` the reading stops at the first document that
crosses the target instead, and so many times the largest document that fits is read once more
at the end of training; what lacks is then not bounded (one long document can be most of it).

Defined results: a null source is a source of its own, ordered last; a null text has no
tokens; documents without tokens keep a position (their place in the source's order) and take
nothing; ties in the seeded order are broken by id, size and text checksum, and repeated rows
are independent documents; an empty table gives an empty mix. Other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio.functions.columns import hash_key
from retentio.operators.ranking import running_total, with_row_index
from retentio.session import materialize

SPACE = r"[ \t-\r]+"
IN_ORDER = 4  # rounds that go on in the seeded order; later ones go from large to small


@dataclass(frozen=True)
class Schedule:
    """Weight of a source at common knots of training time; only the shape matters."""

    times: tuple[float, ...]
    weights: tuple[float, ...]

    def __post_init__(self):
        if len(self.times) != len(self.weights) or len(self.times) < 2:
            raise ValueError("a schedule needs a weight for each of two or more knots")
        if self.times[0] != 0.0 or self.times[-1] != 1.0 or list(self.times) != sorted(set(self.times)):
            raise ValueError("knots rise from 0 to 1")
        if min(self.weights) < 0 or self.integral() <= 0:
            raise ValueError("weights are not negative, and not all zero")

    def integral(self) -> float:
        t, w = self.times, self.weights
        return sum((t[i + 1] - t[i]) * (w[i] + w[i + 1]) / 2 for i in range(len(t) - 1))

    def segments(self) -> list[tuple[float, float, float, float]]:
        """(share of the demand before, start time, rate, slope) of each line, integral 1."""
        total, before, out = self.integral(), 0.0, []
        for i in range(len(self.times) - 1):
            h = self.times[i + 1] - self.times[i]
            rate, end = self.weights[i] / total, self.weights[i + 1] / total
            out.append((before, self.times[i], rate, (end - rate) / h))
            before += h * (rate + end) / 2
        return out


def invert(schedule: Schedule, share: Column) -> Column:
    """Training time at which the schedule's integral reaches ``share`` of its total."""
    result = None
    for before, start, rate, slope in schedule.segments():
        q = F.greatest(share - F.lit(before), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(rate * rate) + F.lit(2.0 * slope) * q, F.lit(0.0)))
        time = F.lit(start) + F.when(q > 0, F.lit(2.0) * q / (F.lit(rate) + root)).otherwise(F.lit(0.0))
        result = time if result is None else F.when(share >= F.lit(before), time).otherwise(result)
    return F.least(result, F.lit(1.0))


def word_count(text: Column) -> Column:
    """Number of words between white space (space, tab to carriage return); null has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACE))).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], max_repeats: int) -> DataFrame:
    """Token targets of (source, source_size) rows: equal to all tokens in sum, in proportion to weight.

    Sources by name (null last) take the weights in turn. A source stops at ``max_repeats``
    times its size and its excess goes to the others by weight, until none is above: every
    round is a small sum over the source table.
    """
    ranked = with_row_index(
        sizes.withColumn("_last", F.col("source").isNull().cast("int")), ["_last", "source"], "_rank"
    )
    choice = F.array(*[F.lit(float(w)) for w in weights])
    table = materialize(
        ranked.select(
            "source",
            "source_size",
            F.get(choice, (F.col("_rank") % len(weights)).cast("int")).alias("weight"),
            (F.pmod(F.col("_rank"), F.lit(len(weights)))).cast("int").alias("weight_class"),
            (F.col("source_size") * max_repeats).alias("_cap"),
        ),
        "sources",
    )
    capped, level, known = F.lit(False), 0.0, -1
    while True:
        total, kept, weight, n = table.agg(
            F.sum("source_size"),
            F.coalesce(F.sum(F.when(capped, F.col("_cap"))), F.lit(0)),
            F.sum(F.when(~capped, F.col("weight"))),
            F.count(F.when(capped, 1)),
        ).first()
        if n == known or not weight:
            break
        level, known = (total - kept) / weight, n
        capped = F.col("weight") * F.lit(level) > F.col("_cap")
    target = F.when(capped, F.col("_cap").cast("double")).otherwise(F.col("weight") * F.lit(level))
    return table.select("source", "source_size", "weight_class", target.alias("target"))


def plan(
    docs: DataFrame,
    weights: tuple[float, ...],
    schedules: tuple[Schedule, ...],
    max_repeats: int = 3,
    fillers: int | None = None,
    seed: int = 29,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One narrow row per document: doc_id, text_crc32, size, source, source_size, target, taken, positions.

    ``schedules`` go with ``weights``, one each. The running token counts inside a source are
    sums over range slices, so a source of any size is spread over many tasks. ``fillers`` is
    None to skip what does not fit, or a number of single documents after the first that crosses.
    """
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    ).withColumn("_order", hash_key(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), seed=seed))
    narrow = materialize(narrow, "sizes")
    order = ["_order", "doc_id", "size", "text_crc32"]
    # the running total slices by (source, order): null sources sort as a key of their own
    keyed = narrow.withColumn("_none", F.col("source").isNull().cast("int")).withColumn(
        "source", F.coalesce("source", F.lit(""))
    )
    wanted = targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats)
    if fillers is None:
        filled = _skipping(keyed, wanted, order, max_repeats)
    else:
        filled = _stopping(keyed, wanted, order, max_repeats, fillers)

    def times(schedule: Schedule) -> Column:
        return F.transform("_demand", lambda d: invert(schedule, d))

    position = None
    for i, schedule in enumerate(schedules):
        inverted = times(schedule)
        position = inverted if position is None else F.when(F.col("weight_class") == i, inverted).otherwise(position)
    return filled.select(
        "doc_id",
        "text_crc32",
        "size",
        "source",
        "source_size",
        "target",
        (F.col("size") * F.size("_demand")).cast("long").alias("taken"),
        position.alias("positions"),
    )


def _stopping(keyed: DataFrame, wanted: DataFrame, order: list, max_repeats: int, fillers: int) -> DataFrame:
    """Adds source facts and ``_demand``, the share of the target at each pass; nothing after the crossing document."""
    summed = running_total(keyed, order, {"_upto": "size"}, ["_none", "source"])
    named = summed.withColumn("source", F.when(F.col("_none") == 0, F.col("source")))
    joined = named.join(wanted.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    ends = F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda i: i * F.col("source_size") + F.col("_upto"))
    whole = joined.withColumn("_passes", F.size(F.filter(ends, lambda e: e <= F.col("target"))).cast("long"))
    filled = _fill(whole.withColumn("_extra", F.lit(0).cast("long")), max_repeats, fillers)
    regular = F.slice(ends, 1, F.col("_passes").cast("int"))
    demand = F.concat(
        F.transform(regular, _share),
        F.array_repeat(F.lit(1.0), F.col("_extra").cast("int")),
    )
    return filled.withColumn("_demand", demand)


def _skipping(keyed: DataFrame, wanted: DataFrame, order: list, max_repeats: int) -> DataFrame:
    """Adds source facts and ``_demand``; a document that does not fit is skipped and the reading goes on.

    A round sets aside the documents longer than the room of their source (for good, as room
    only shrinks), runs the totals over the others and takes what ends within the room. The
    first of them always fits, and after ``IN_ORDER`` rounds they are read from large to small,
    each as often as it may be: what is then taken is at least half of the room, or all there
    is, so the number of rounds grows with the logarithm of the room. A round only reads and
    writes documents that still fit.
    """
    key = ["_none", "source"]
    facts = wanted.withColumn("_none", F.col("source").isNull().cast("int")).withColumn(
        "source", F.coalesce("source", F.lit(""))
    )
    now = keyed.join(facts, key).select(
        *keyed.columns, "source_size", "weight_class", "target", F.lit(0).cast("long").alias("_before"),
        F.array().cast("array<double>").alias("_demand"),
    )
    now = materialize(now, "unread")
    fits = (F.col("_before") + F.col("size") <= F.col("target")) & (F.size("_demand") < max_repeats)
    done, left, rounds = now.filter(~fits), now.filter(fits), 0
    while not left.isEmpty():
        taken = _in_passes(left, key, order, max_repeats) if rounds < IN_ORDER else _by_size(left, key, order, max_repeats)
        taken = materialize(taken, "taken")
        used = materialize(taken.groupBy(*key).agg(F.sum(F.col("size") * F.col("_added")).alias("_used")), "used")
        now = taken.join(used, key).withColumn("_before", F.col("_before") + F.col("_used")).select(*now.columns)
        rest = fits & (F.col("size") > 0)
        done, left, rounds = done.unionByName(now.filter(~rest)), now.filter(rest), rounds + 1
    return done.withColumn("source", F.when(F.col("_none") == 0, F.col("source")))


def _share(end: Column) -> Column:
    """Share of the target that is read at the middle of a document; a target of zero has only documents without tokens."""
    return F.when(F.col("target") > 0, (end - F.col("size") / F.lit(2.0)) / F.col("target")).otherwise(F.lit(0.0))


def _in_passes(left: DataFrame, key: list, order: list, max_repeats: int) -> DataFrame:
    """One round in the seeded order: those read least often come first, then the next pass over all."""
    passes = range(max_repeats)
    sized = left.select(
        "*", *[F.when(F.size("_demand") <= a, F.col("size")).otherwise(F.lit(0)).cast("long").alias(f"_s{a}") for a in passes]
    )
    summed = materialize(running_total(sized, order, {f"_u{a}": f"_s{a}" for a in passes}, key), "passes")
    totals = summed.groupBy(*key).agg(*[F.sum(f"_s{a}").alias(f"_t{a}") for a in passes])
    ends = [
        F.when(F.size("_demand") <= a, sum([F.col(f"_t{b}") for b in range(a)], F.col("_before")) + F.col(f"_u{a}"))
        for a in passes
    ]
    within = F.filter(F.array(*ends), lambda e: e <= F.col("target"))
    shares = F.transform(within, _share)
    return summed.join(totals, key).select(
        *[F.concat("_demand", shares).alias(c) if c == "_demand" else c for c in left.columns], F.size(within).alias("_added")
    )


def _by_size(left: DataFrame, key: list, order: list, max_repeats: int) -> DataFrame:
    """One round from large to small, each document as often as it may still be read."""
    allowed = F.lit(max_repeats) - F.size("_demand")
    summed = running_total(
        left.select("*", (F.col("size") * allowed).cast("long").alias("_all"), (-F.col("size")).alias("_small")),
        ["_small", *order],
        {"_upto": "_all"},
        key,
    )
    begin = F.col("_before") + F.col("_upto") - F.col("_all")
    ends = F.transform(F.sequence(F.lit(1), allowed), lambda i: begin + i * F.col("size"))
    within = F.filter(ends, lambda e: e <= F.col("target"))
    shares = F.transform(within, _share)
    return summed.select(
        *[F.concat("_demand", shares).alias(c) if c == "_demand" else c for c in left.columns], F.size(within).alias("_added")
    )


def _fill(taken: DataFrame, max_repeats: int, rounds: int) -> DataFrame:
    """Each round gives what a source still lacks to its largest document that fits in whole.

    One aggregate row per source and round; a document's running total names it in its source.
    """
    for _ in range(rounds):
        taken = materialize(taken, "taken")
        key = ["_none", F.coalesce("source", F.lit("")).alias("_name")]
        room = taken.groupBy(*key).agg(
            (F.max("target") - F.sum(F.col("size") * (F.col("_passes") + F.col("_extra")))).alias("_room")
        )
        open_to = taken.filter((F.col("size") > 0) & (F.col("_passes") + F.col("_extra") < max_repeats))
        # one row per source and size before sources meet, so that a large source stays spread
        best = (
            open_to.groupBy(*key, "size")
            .agg(F.max("_upto").alias("_upto"))
            .join(room, ["_none", "_name"])
            .filter(F.col("size") <= F.col("_room"))
            .groupBy("_none", "_name")
            .agg(F.max(F.struct("size", "_upto"))["_upto"].alias("_chosen"))
        )
        taken = (
            taken.withColumn("_name", F.coalesce("source", F.lit("")))
            .join(best, ["_none", "_name"], "left")
            .withColumn(
                "_extra",
                F.col("_extra") + ((F.col("size") > 0) & F.col("_upto").eqNullSafe(F.col("_chosen"))).cast("long"),
            )
            .drop("_name", "_chosen")
        )
    return taken


def in_order(planned: DataFrame) -> DataFrame:
    """Documents range-sorted by their first training position; those not taken come last."""
    first = F.get("positions", F.lit(0))
    return planned.withColumn("position", first).orderBy(
        F.col("position").asc_nulls_last(), "doc_id", "size", "text_crc32"
    )


def mix(docs: DataFrame, planned: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed corpus: one whole row for each pass over a document, in training order.

    Rows meet their plan by id, text checksum and source. Rows equal in all three are the
    same document several times over: they keep all their passes, and their other columns
    are those of one of them.
    """
    same = F.expr("r._mix_id <=> p._mix_id AND r._mix_crc = p._mix_crc AND r._mix_source <=> p._mix_source")
    passes = planned.select(
        F.col("doc_id").alias("_mix_id"),
        F.col("text_crc32").alias("_mix_crc"),
        F.col("source").alias("_mix_source"),
        F.explode("positions").alias("_mix_position"),
    )
    key = ["_mix_id", "_mix_crc", "_mix_source"]
    repeated = (
        planned.groupBy(F.col("doc_id").alias("_mix_id"), F.col("text_crc32").alias("_mix_crc"), F.col("source").alias("_mix_source"))
        .count()
        .filter("count > 1")
        .drop("count")
    )
    rows = docs.select(
        *docs.columns,
        F.col(doc_id).alias("_mix_id"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("_mix_crc"),
        F.col(source).alias("_mix_source"),
    )
    several = materialize(repeated, "repeated")
    if several.isEmpty():
        parts = [rows]
    else:
        once = rows.alias("r").join(several.alias("p"), same, "left_anti")
        parts = [once, rows.alias("r").join(several.alias("p"), same, "left_semi").dropDuplicates(key)]
    out = [
        part.alias("r").join(passes.alias("p"), same).select(*[F.col(f"r.{c}") for c in docs.columns], "p._mix_position")
        for part in parts
    ]
    whole = out[0] if len(out) == 1 else out[0].unionByName(out[1])
    return whole.orderBy("_mix_position", doc_id).drop("_mix_position")
