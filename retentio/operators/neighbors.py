"""Exact k nearest neighbours of distinct vectors through a block index, without comparing all pairs.

Index: the vectors are projected onto their ``AXES`` leading principal axes. The axes are
orthonormal, so a distance between projections never exceeds the true distance. Rows are
ordered by the first projected axis and cut into slabs of at most ``SLAB_BLOCKS`` blocks; a slab
is halved at the median of its widest axis until its parts, the blocks, have at most
``cell_rows`` rows. So blocks are short on every axis and not only on the first. Each block
keeps its box (least and largest projection on every axis), one row per block.

Search: every row first searches its own block, and its k-th distance there (its reach)
bounds the answer. It then visits every other block whose box comes within its reach:
bisection on the slabs' first-axis ranges (ordered, as the slabs are) finds the candidates,
and the box test on all axes decides. Visits are grouped by block; a block visited by many
rows is met in parts of at most ``QUERY_ROWS`` rows, each part against the whole block, so no
task searches more than one block and one part (the cut holds one slab). Each task keeps k per
row and a bounded merge (k per visited block) keeps the k best per row. Distances live in
numpy blocks inside the tasks; pairs are never written out.

One path for every size: a table of one block is searched as one block. The box table has
at most ``MAX_BLOCKS`` rows (blocks grow beyond that), which bounds what the driver holds.
Ties order by the smaller id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.operators.ranking import with_row_index
from retentio.session import materialize

CELL_ROWS = 4_096
SLAB_BLOCKS = 32
QUERY_ROWS = 50_000
MAX_BLOCKS = 1_000_000
AXES = 3
BLOCK = 512
PAIRS = 100_000
EPSILON = 1e-9
SLACK = 4 * np.finfo(float).eps  # per dimension and eight more

_OUT = "id long, neighbours array<struct<distance:double,id:long>>"


def _distances(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Euclidean distances of the pairs (row ``i`` of ``a``, row ``j`` of ``b``), one dimension at a time."""
    out = np.zeros(len(i))
    with np.errstate(over="ignore", invalid="ignore"):
        for axis in range(a.shape[1]):
            out += (a[i, axis] - b[j, axis]) ** 2
    return np.sqrt(out)


def _top(ids, vectors, other_ids, others, k, limits=None):
    """Per row the k nearest others (self excluded) as sorted (distance, id) lists.

    Squared distances from one matrix product (|b|^2 - 2ab, plus |a|^2) are off by a rounding
    error that is at most ``SLACK`` times the squared lengths. So the product only finds who may
    be among the k; their distances are then summed one dimension at a time and decide. Where
    squared lengths leave the range of doubles, everyone may be among the k.
    """
    usable = np.isfinite(others).all(axis=1)  # a distance to any other row is not a number
    others, other_ids = others[usable], other_ids[usable]
    if len(others) == 0:
        return [[] for _ in ids]
    with np.errstate(over="ignore", invalid="ignore"):
        middle = others.mean(axis=0)
        a, b = vectors - middle, others - middle
        aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    slack = SLACK * (vectors.shape[1] + 8)
    largest = np.finfo(float).max / 16
    in_range = bool((bb < largest).all() and ((aa < largest) | ~np.isfinite(vectors).all(axis=1)).all())
    if in_range:
        left = np.hstack([a, np.ones((len(a), 1))])
        right = np.hstack([-2 * b, (bb * (1 + slack))[:, None]]).T
    found = []
    for start in range(0, len(ids), BLOCK):
        block, rows = ids[start : start + BLOCK], vectors[start : start + BLOCK]
        near = np.ones((len(block), len(others)), dtype=bool)
        own = block[:, None] == other_ids[None, :]
        if in_range:
            most = left[start : start + BLOCK] @ right  # largest squared distance, less the row's part
            most[own] = np.inf
            kth = most.min(axis=1) if k == 1 else np.partition(most, min(k, len(others)) - 1, axis=1)[:, min(k, len(others)) - 1]
            most -= 2 * slack * bb  # now the least
            with np.errstate(invalid="ignore"):  # rows with a value that is no number have no neighbours
                near = most <= (kth + 2 * slack * aa[start : start + BLOCK] + np.finfo(float).tiny * 16)[:, None]
        near &= ~own
        i, j = np.nonzero(near)
        distance = _distances(rows, others, i, j)
        keep = np.isfinite(distance)
        if limits is not None:
            keep &= distance <= limits[start : start + BLOCK][i]
        i, j, distance = i[keep], j[keep], distance[keep]
        order = np.lexsort((other_ids[j], distance, i))
        i, near_ids, distance = i[order], other_ids[j[order]], distance[order]
        first = np.searchsorted(i, np.arange(len(block)))
        last = np.minimum(np.searchsorted(i, np.arange(len(block)), "right"), first + k)
        pairs = [{"distance": d, "id": n} for d, n in zip(distance.tolist(), near_ids.tolist())]
        found += [pairs[f:l] for f, l in zip(first.tolist(), last.tolist())]
    return found


def nearest(df: DataFrame, k: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``(id, vector array<double>)`` with unique vectors -> ``(id, neighbours)``, nearest first."""
    first = df.select(F.size("vector").alias("d")).where(F.col("d") >= 0).first()
    if first is None:
        return df.sparkSession.createDataFrame([], _OUT)
    d = int(first["d"])
    n = df.count()
    rows = max(cell_rows, math.ceil(n / MAX_BLOCKS))
    axes = _axes(df, d)
    projected = _project(df.select("id", "vector"), axes)
    ordered = with_row_index(projected, [F.col("p")[0], F.col("id")], "_index")
    width = axes.shape[1]
    per_slab = max(1, min(SLAB_BLOCKS, round((n / rows) ** (2 / 3))))
    slabs = ordered.select("id", "vector", "p", F.floor(F.col("_index") / F.lit(rows * per_slab)).cast("int").alias("slab"))
    blocks = materialize(_cut(slabs, rows, width), "blocks")
    local = materialize(_search_home(blocks, k), "cells")
    boxes = (
        blocks.groupBy("cell")
        .agg(*[F.min(F.col("p")[j]).alias(f"lo{j}") for j in range(width)], *[F.max(F.col("p")[j]).alias(f"hi{j}") for j in range(width)])
        .orderBy("cell")
        .collect()  # one row per block, about MAX_BLOCKS at most
    )
    low = np.array([[b[f"lo{j}"] for j in range(width)] for b in boxes], dtype=float).reshape(len(boxes), width)
    high = np.array([[b[f"hi{j}"] for j in range(width)] for b in boxes], dtype=float).reshape(len(boxes), width)
    cells = np.array([b["cell"] for b in boxes], dtype=np.int64)
    remote = _search_around(local, blocks, cells, low, high, k)
    both = local.select("id", F.inline("neighbours")).toDF("id", "distance", "other").unionByName(
        remote.select("id", F.inline("neighbours")).toDF("id", "distance", "other")
    )
    # each visited block contributes at most k rows per id
    return both.groupBy("id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("distance", F.col("other").alias("id")))), 1, k).alias("neighbours")
    )


def _axes(df: DataFrame, d: int) -> np.ndarray:
    """``d x m`` orthonormal leading principal axes, from moments summed over all rows."""
    m = min(AXES, d)
    if m == 0:
        return np.zeros((d, 0))

    def partial(batches):
        for pdf in batches:
            x = np.array(pdf["vector"].tolist(), dtype=float).reshape(len(pdf), d)
            yield pd.DataFrame({"s": [np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()]).tolist()]})

    parts = df.select("vector").mapInPandas(partial, "s array<double>")
    summed = parts.select(F.posexplode("s")).groupBy("pos").agg(F.sum("col").alias("v")).collect()  # 1 + d + d*d rows
    total = np.zeros(1 + d + d * d)
    for row in summed:
        total[row["pos"]] = row["v"]
    count = max(total[0], 1.0)
    mean = total[1 : 1 + d] / count
    cov = total[1 + d :].reshape(d, d) / count - np.outer(mean, mean)
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    return vectors[:, np.argsort(-values, kind="stable")[:m]]


def _project(df: DataFrame, axes: np.ndarray) -> DataFrame:
    d = axes.shape[0]

    def project(batches):
        for pdf in batches:
            x = np.array(pdf["vector"].tolist(), dtype=float).reshape(len(pdf), d)
            yield pdf.assign(p=list(x @ axes))

    return df.mapInPandas(project, "id long, vector array<double>, p array<double>")


def _blocks(p: np.ndarray, rows: int) -> list[np.ndarray]:
    """Row numbers of each block: halves at the median of the widest axis, down to ``rows``."""
    done, todo = [], [np.arange(len(p))]
    while todo:
        part = todo.pop()
        if len(part) <= rows:
            done.append(part)
            continue
        if p.shape[1]:
            axis = int(np.argmax(p[part].max(0) - p[part].min(0)))
            part = part[np.argsort(p[part, axis], kind="stable")]
        todo += [part[len(part) // 2 :], part[: len(part) // 2]]
    return done


def _within(p: np.ndarray, low: np.ndarray, high: np.ndarray, bound) -> np.ndarray:
    """Whether the boxes come within ``bound`` of the projection."""
    gaps = np.maximum(np.maximum(low - p, p - high), 0.0)
    return np.sqrt((gaps**2).sum(axis=1)) <= bound


def _cut(slabs: DataFrame, rows: int, width: int) -> DataFrame:
    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        p = np.array(pdf["p"].tolist(), dtype=float).reshape(len(pdf), width)
        cell = np.zeros(len(pdf), dtype=np.int64)
        for j, part in enumerate(_blocks(p, rows)):  # at most SLAB_BLOCKS of them
            cell[part] = j
        return pdf.assign(cell=pdf["slab"] * SLAB_BLOCKS + cell)[["id", "vector", "p", "cell"]]

    return slabs.groupBy("slab").applyInPandas(cut, "id long, vector array<double>, p array<double>, cell int")


def _search_home(blocks: DataFrame, k: int) -> DataFrame:
    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, vectors = pdf["id"].to_numpy(), np.array(pdf["vector"].tolist(), dtype=float)
        lists = _top(ids, vectors, ids, vectors, k)
        reach = [l[k - 1]["distance"] if len(l) >= k else math.inf for l in lists]
        return pdf.assign(neighbours=lists, reach=reach)[["id", "vector", "p", "cell", "reach", "neighbours"]]

    schema = "id long, vector array<double>, p array<double>, cell int, reach double, "
    schema += "neighbours array<struct<distance:double,id:long>>"
    return blocks.groupBy("cell").applyInPandas(search, schema)


def _search_around(local: DataFrame, blocks: DataFrame, cells: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> DataFrame:
    slab = cells // SLAB_BLOCKS
    first = np.flatnonzero(np.r_[True, slab[1:] != slab[:-1]])  # first block of each slab
    ends = np.r_[first, len(cells)]
    if low.shape[1]:
        slab_low, slab_high = np.minimum.reduceat(low[:, 0], first), np.maximum.reduceat(high[:, 0], first)

    def visits(batches):
        for pdf in batches:
            n, home = len(pdf), pdf["cell"].to_numpy()
            p = np.array(pdf["p"].tolist(), dtype=float).reshape(n, low.shape[1])
            bound = pdf["reach"].to_numpy() * (1 + EPSILON) + EPSILON
            if low.shape[1]:
                start = ends[np.searchsorted(slab_high, p[:, 0] - bound, "left")]
                end = ends[np.searchsorted(slab_low, p[:, 0] + bound, "right")]
            else:
                start, end = np.zeros(n, dtype=int), np.full(n, len(cells))
            counts = np.maximum(end - start, 0)
            before = np.cumsum(counts) - counts
            # tests of about ``PAIRS`` boxes at a time; one row has at most all of them
            for rows in np.split(np.arange(n), np.flatnonzero(np.diff(before // PAIRS)) + 1):
                row = np.repeat(rows, counts[rows])
                if len(row) == 0:
                    continue
                box = start[row] + np.arange(len(row)) - (before[row] - before[rows[0]])
                hit = _within(p[row], low[box], high[box], bound[row]) & (cells[box] != home[row])
                yield pdf[["id", "vector", "reach"]].iloc[row[hit]].assign(cell=cells[box[hit]])

    queries = materialize(
        local.select("id", "vector", "p", "cell", "reach").mapInPandas(visits, "id long, vector array<double>, reach double, cell int"),
        "visits",
    )
    parts = queries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("parts"))
    salted = queries.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    spread = (
        blocks.select("id", "vector", "cell")
        .join(parts, "cell")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    )

    def search(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"id": pd.Series([], dtype="int64"), "neighbours": []})
        a, b = np.array(left["vector"].tolist(), dtype=float), np.array(right["vector"].tolist(), dtype=float)
        limits = left["reach"].to_numpy() * (1 + EPSILON)
        lists = _top(left["id"].to_numpy(), a, right["id"].to_numpy(), b, k, limits)
        return pd.DataFrame({"id": left["id"], "neighbours": lists})

    return (
        salted.select("id", "vector", "reach", "cell", "part")
        .groupBy("cell", "part")
        .cogroup(spread.select("id", "vector", "cell", "part").groupBy("cell", "part"))
        .applyInPandas(search, _OUT)
    )
