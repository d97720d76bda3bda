"""Chat formatting of logged conversations, after cumulative snapshots have been collapsed.

Loggers often store a conversation again after every turn, so the log holds all its prefixes.
Every turn gets the rolling hash of the turns up to it: sums of two independent hashes of
(position, role, text), which running sums over range slices give for conversations of any
length. A conversation whose last hash is also passed by a longer one is a prefix of it and is
removed by an anti-join; equal conversations keep the one with the smallest id. What is left is
rendered turn by turn, so no conversation is gathered into one task.

Only DataFrame operations are used.

Defined results: a null role is ``unknown``, a null text empty; rows equal in id, turn, role and
text count once; different rows of one turn follow each other by role and text hash; turns are
counted by order, so gaps and other starting numbers don't matter, and null turns come first;
rows with a null id form one conversation, which never names a group that has an id; empty
tables give empty results; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio.operators.ranking import running_total, with_row_index
from retentio.session import materialize

KEY = ["none", "conv"]
PREFIX = ["position", "first", "second"]


def _cleaned(turns: DataFrame) -> DataFrame:
    return turns.select(
        F.col("conv_id").isNull().cast("int").alias("none"),
        F.coalesce("conv_id", F.lit(0)).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def _content(salt: int) -> Column:
    return F.xxhash64(F.lit(salt), F.col("role"), F.col("text"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(none, conv, turn, role, one, two, position, first, second): rolling hashes of every distinct turn."""
    narrow = (
        _cleaned(turns)
        .select(*KEY, "turn", "role", _content(1).alias("one"), _content(2).alias("two"))
        .distinct()
    )
    placed = with_row_index(narrow, [F.col("turn").asc_nulls_first(), "role", "one", "two"], "position", KEY)
    hashed = placed.withColumns(
        {
            "_a": F.xxhash64("position", "one").cast("decimal(38,0)"),
            "_b": F.xxhash64("two", "position").cast("decimal(38,0)"),
        }
    )
    rolled = running_total(hashed, ["position"], {"first": "_a", "second": "_b"}, KEY)
    return rolled.drop("_a", "_b")


def maximal(rolled: DataFrame) -> DataFrame:
    """(none, conv, n_turns, copies) of the conversations that are no proper prefix of another.

    A prefix is passed by as many turns as conversations share it. If more pass than end there,
    some conversation goes on, and those that end there are dropped.
    """
    ends = rolled.groupBy(*KEY).agg(F.max(F.struct(*PREFIX)).alias("last")).select(*KEY, "last.*")
    ended = ends.groupBy(*PREFIX).agg(F.min(F.struct(*KEY)).alias("least"), F.count(F.lit(1)).alias("copies"))
    passed = rolled.groupBy(*PREFIX).agg(F.count(F.lit(1)).alias("passing"))
    same = [F.col(f"e.{c}") == F.col(f"p.{c}") for c in PREFIX]
    kept = ended.alias("e").join(passed.alias("p"), [*same, F.col("passing") > F.col("copies")], "left_anti")
    return kept.select("least.*", (F.col("position") + 1).alias("n_turns"), "copies")


def rendered(role: Column, text: Column) -> Column:
    """One turn in chat markup; marks inside the text are broken up so that they can't end a turn."""
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("<|im_end|>\n"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies, position, role and rendered text of every turn of the maximal conversations."""
    rolled = materialize(prefixes(turns), "prefixes")
    kept = materialize(maximal(rolled), "maximal")
    places = rolled.select(*KEY, "turn", "role", "one", "two", "position").join(kept, KEY)
    texts = _cleaned(turns).withColumns({"one": _content(1), "two": _content(2)})
    # equal rows are one turn: the first of them carries the text
    whole = texts.join(kept.select(*KEY), KEY, "left_semi").groupBy(*KEY, "turn", "role", "one", "two").agg(F.first("text").alias("text"))
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"p.{c}")) for c in (*KEY, "turn", "role", "one", "two")]
    joined = whole.alias("t").join(places.alias("p"), same)
    return joined.select(
        F.when(F.col("p.none") == 0, F.col("p.conv")).alias("conv_id"),
        "p.n_turns",
        "p.copies",
        "p.position",
        "p.role",
        rendered(F.col("p.role"), F.col("t.text")).alias("rendered"),
    )
