"""Exact quantiles and order statistics without collecting a column in one task.

``percentile`` keeps every distinct value of a group in one reducer. Here a mergeable
sketch brackets each wanted rank, counts make the bracket exact, and only the few values
strictly inside the bracket are fetched. Four scans (range, sketch, count, fetch) suffice up to
about 10^9 values; two more scans narrow a bracket about a thousandfold. Equal values
never inflate a bracket because its two edges are counted, not fetched. Counting and fetching
are scans of their own: plain counts run as compiled code over all rows, and the lists see
only the few rows that lie inside a bracket.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio.operators.ranking import running_total

ACCURACY = 20_000  # rank error of the sketch: n / ACCURACY
DIRECT_LIMIT = 20_000  # values fetched without a sketch
FETCH_LIMIT = 200_000  # values fetched per bracket, bounded before fetching
GROUP_LIMIT = 1_000_000  # rows of one group that one task may hold


@dataclass
class _Bracket:
    """Neighbouring ranks known to lie in [low, high] of one column."""

    name: str
    ranks: list[int]
    low: object
    high: object
    below: int  # rows below low
    at_low: int  # rows equal to low
    inside: int  # rows strictly between
    counted: bool = False
    bound: int = 0  # proven bound on ``inside``
    slack: int = 2  # sketch errors allowed on either side

    def interior(self, c: Column) -> Column:
        return F.when((c > F.lit(self.low)) & (c < F.lit(self.high)), c)


def rank_values(df: DataFrame, wanted: dict, sizes: dict | None = None) -> dict[str, dict]:
    """Values at 0-based ranks: ``{name: (column, ranks)} -> {name: {rank: value}}``.

    ``ranks`` is a list, or a function from the number of non-null values to a list.
    Nulls are skipped. Ranks outside the population give ``None``.
    """
    if not wanted:
        return {}
    # computed once a row here, not once per comparison below
    df = df.select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(wanted.values())])
    columns = {name: F.col(f"c{i}") for i, name in enumerate(wanted)}
    aggregates = []
    for i, c in enumerate(columns.values()):
        aggregates += [F.count(c).alias(f"n{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
    row = df.agg(*aggregates).first()
    found: dict[str, dict] = {name: {} for name in wanted}
    pending: list[_Bracket] = []
    for i, (name, (_, ranks)) in enumerate(wanted.items()):
        n, low, high = row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]
        if sizes is not None:
            sizes[name] = n
        asked = ranks(n) if callable(ranks) else ranks
        found[name] = {r: None for r in asked if not 0 <= r < n}
        for group in _neighbours([r for r in asked if 0 <= r < n]):
            pending.append(_Bracket(name, group, low, high, 0, 0, n, bound=n))
    while pending:
        if any(not _fetchable(b) for b in pending):
            _sketch(df, columns, [b for b in pending if not _fetchable(b)])
        pending = _count(df, columns, pending, found)
    return found


def _neighbours(ranks: list[int]) -> list[list[int]]:
    groups: list[list[int]] = []
    for r in sorted(set(ranks)):
        if groups and r - groups[-1][-1] <= 1:
            groups[-1].append(r)
        else:
            groups.append([r])
    return groups


def _fetchable(b: _Bracket) -> bool:
    return b.bound <= (FETCH_LIMIT if b.counted else DIRECT_LIMIT)


def _sketch(df: DataFrame, columns: dict[str, Column], brackets: list[_Bracket]) -> None:
    """Narrow each bracket around its ranks from one sketch of its interior."""
    spans: dict[tuple, list[_Bracket]] = {}
    for b in brackets:
        spans.setdefault((b.name, b.low, b.high, b.counted), []).append(b)
    aggregates, asked = [], []
    for i, members in enumerate(spans.values()):
        shares = []
        for b in members:
            start = b.below + b.at_low if b.counted else 0
            margin = b.slack * b.inside / ACCURACY + 2
            shares.append(max(0.0, (b.ranks[0] - start - margin) / b.inside))
            shares.append(min(1.0, (b.ranks[-1] - start + 1 + margin) / b.inside))
            b.bound = int((shares[-1] - shares[-2]) * b.inside + 2 * b.inside / ACCURACY) + 2
        asked.append(shares)
        first = members[0]
        value = first.interior(columns[first.name]) if first.counted else columns[first.name]
        steps = F.expr("array(" + ",".join(f"{p!r}D" for p in shares) + ")")
        aggregates.append(F.percentile_approx(value, steps, F.lit(ACCURACY)).alias(f"s{i}"))
    row = df.agg(*aggregates).first()
    for i, members in enumerate(spans.values()):
        for j, b in enumerate(members):
            low, high = row[f"s{i}"][2 * j], row[f"s{i}"][2 * j + 1]
            # a share of 0 or 1 keeps the old edge, which is known to be exact
            b.low = max(b.low, _widened(low, -1)) if asked[i][2 * j] > 0 else b.low
            b.high = min(b.high, _widened(high, 1)) if asked[i][2 * j + 1] < 1 else b.high
            b.counted = True


def _widened(edge, direction: int):
    """Sketches work in doubles, so edges of large integers may be off by a rounding step."""
    return edge + direction * (abs(edge) >> 51) if isinstance(edge, int) else edge


def _count(df: DataFrame, columns: dict[str, Column], brackets: list[_Bracket], found: dict) -> list[_Bracket]:
    """Count around the brackets, fetch the small ones, and return those still open."""
    spans: dict[tuple, int] = {}
    aggregates, inner = [], {}
    for b in brackets:
        key = (b.name, b.low, b.high)
        if key in spans:
            continue
        i = spans[key] = len(spans)
        c, low, high = columns[b.name], F.lit(b.low), F.lit(b.high)
        aggregates += [
            F.count_if(c < low).alias(f"below{i}"),
            F.count_if(c == low).alias(f"low{i}"),
            F.count(b.interior(c)).alias(f"inside{i}"),
            F.count_if(c == high).alias(f"high{i}"),
        ]
        if _fetchable(b):
            inner[i] = b.interior(c)
    row = df.agg(*aggregates).first()
    fetched = {i: [] for i in inner}
    inner = {i: value for i, value in inner.items() if row[f"inside{i}"]}
    if inner:
        near = df.filter(reduce(lambda a, b: a | b, [value.isNotNull() for value in inner.values()]))
        lists = near.agg(*[F.collect_list(value).alias(f"v{i}") for i, value in inner.items()]).first()
        fetched |= {i: sorted(lists[f"v{i}"]) for i in inner}
    open_again = []
    for b in brackets:
        i = spans[(b.name, b.low, b.high)]
        below, at_low, inside, at_high = (row[f"{k}{i}"] for k in ("below", "low", "inside", "high"))
        at_high = 0 if b.low == b.high else at_high
        left = []
        for r in b.ranks:
            offset = r - below - at_low
            if r < below or offset >= inside + at_high:
                raise RuntimeError(f"rank {r} of {b.name} left its bracket: the input changed between scans")
            if offset < 0:
                found[b.name][r] = b.low
            elif offset >= inside:
                found[b.name][r] = b.high
            elif i in fetched:
                found[b.name][r] = fetched[i][offset]
            else:
                left.append(r)
        if left:
            open_again.append(
                _Bracket(b.name, left, b.low, b.high, below, at_low, inside, True, bound=inside)
            )
    return open_again


def _positions(n: int, p: float) -> tuple[int, int, float]:
    at = (n - 1) * p
    low = int(at)
    return low, min(low + 1, n - 1), at - low


def exact_quantiles(df: DataFrame, columns, probabilities) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of whole columns, ``{column: [value, ...]}``."""
    named = columns if isinstance(columns, dict) else {c: F.col(c) for c in columns}
    if not named:
        return {}

    def ranks(n: int) -> list[int]:
        return [r for p in probabilities for r in _positions(n, p)[:2]] if n else []

    sizes: dict[str, int] = {}
    values = rank_values(df, {name: (c.cast("double"), ranks) for name, c in named.items()}, sizes)
    result: dict[str, list[float | None]] = {}
    for name in named:
        result[name] = []
        for p in probabilities:
            if not sizes[name]:
                result[name].append(None)
                continue
            low, high, part = _positions(sizes[name], p)
            a, b = values[name][low], values[name][high]
            result[name].append(a + (b - a) * part)
    return result


def grouped_quantiles(
    df: DataFrame, keys: list[str], columns: list[str], probability: float, group_limit: int = GROUP_LIMIT
) -> DataFrame:
    """Exact quantile per group: one row per key, columns keep their names.

    Groups small enough for one task use ``percentile``. Larger ones (there are at most
    rows / ``group_limit`` of them) go through value counts and distributed running sums.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    heavy = sizes.filter(F.col("_n") > group_limit).select(*keys)
    plain = [F.percentile(F.col(c).cast("double"), F.lit(probability)).alias(c) for c in columns]
    if heavy.isEmpty():
        return df.groupBy(*keys).agg(*plain)
    light = df.join(heavy, keys, "left_anti").groupBy(*keys).agg(*plain)
    long = (
        df.join(heavy, keys, "left_semi")
        .select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
        .unpivot(keys, columns, "_column", "_value")
        .filter(F.col("_value").isNotNull())
    )
    counted = long.groupBy(*keys, "_column", "_value").agg(F.count(F.lit(1)).alias("_k"))
    ranked = running_total(counted, order=["_value"], sums={"_upto": "_k"}, keys=[*keys, "_column"])
    totals = counted.groupBy(*keys, "_column").agg(F.sum("_k").alias("_n"))
    at = (F.col("_n") - 1) * F.lit(probability)
    picked = (
        ranked.join(totals, [*keys, "_column"])
        .withColumn("_low", F.floor(at))
        .withColumn("_high", F.least(F.floor(at) + 1, F.col("_n") - 1))
        .groupBy(*keys, "_column")
        .agg(
            F.min(F.when(F.col("_upto") > F.col("_low"), F.col("_value"))).alias("_a"),
            F.min(F.when(F.col("_upto") > F.col("_high"), F.col("_value"))).alias("_b"),
            F.first(at - F.floor(at)).alias("_part"),
        )
        .withColumn("_q", F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part"))
    )
    wide = picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_column") == c, F.col("_q"))).alias(c) for c in columns]
    )
    return light.unionByName(wide.select(*light.columns))
