"""Exact top-k inner-product search over integer vectors, by norm buckets.

Method (bucketed retrieval in the manner of LEMP): candidate vectors are grouped by length
into geometric norm bands, and bands are cut into chunks of at most ``chunk_rows`` rows.
Each query first gets a threshold: the k-th best exact score against the ``head`` longest
vectors, which is a lower bound of its final k-th score. A band whose longest vector times
the query's length stays below that threshold cannot hold an answer and is never paired
with the query. In a (chunk, query block) task, every query takes its local cosine
threshold ``t = theta / (|q| * longest in chunk)``; above ``coord_above`` it searches by
coordinate (the candidates' normalised value on the query's largest coordinate must lie in
``[cos(a + g), cos(a - g)]`` with ``a = acos(q_f)``, ``g = acos(t)``, clipped to [-1, 1], found by
bisection on a sorted column), below it by
length (candidates longer than ``theta / |q|``). Products of the survivors are then computed
exactly in 64-bit integers, each task keeps its k best per query, and a window keeps the k
best per query over all tasks.

Defined results:
- a row whose id or vector is null, or whose vector holds a null, NaN or infinite component,
  takes no part (neither query nor candidate); an empty vector is valid, with norm 0;
- vectors of unequal length are multiplied over their common prefix;
- a query never meets a row with its own id; a query row that occurs twice is answered
  twice; ties order by the smaller id; fewer than k candidates give fewer rows;
- an empty table gives no rows; extra columns of the input are ignored.
Scores must fit in 64 bits, which holds for any component below about 2**26 in 64 dims.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio.session import materialize

BANDS_PER_DOUBLING = 8  # norm bands: floor(8 * log2(norm)); the number of bands is bounded by the double range
CHUNK_ROWS = 4096  # candidates of one task at most (one band is cut into chunks)
QUERY_ROWS = 4096  # queries of one task at most (queries of one band are cut into blocks)
HEAD = 256  # longest vectors whose scores give every query its starting threshold
COORD_ABOVE = 0.5  # local cosine threshold from which a chunk is searched by coordinate
SLACK = 1e-9  # relative widening of every floating bound; the exact products decide

ZERO_BAND = -(1 << 20)  # band of the zero vector


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int = 1024) -> DataFrame:
    """(``_id``, ``_v`` array<long> of floor(scale * x), ``_norm``, ``_band``, ``_row``) of valid rows."""
    def bad(e: Column) -> Column:
        x = e.cast("double")
        return e.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    valid = df.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).alias("_x")).where(
        F.col("_id").isNotNull() & F.col("_x").isNotNull() & ~F.exists("_x", bad)
    )
    ints = valid.select(
        "_id", F.transform("_x", lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("long")).alias("_v")
    )
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))
    withnorm = ints.withColumn("_norm", norm)
    band = F.when(F.col("_norm") > 0, F.floor(F.log2("_norm") * BANDS_PER_DOUBLING)).otherwise(F.lit(ZERO_BAND))
    return materialize(
        withnorm.withColumn("_band", band.cast("long")).withColumn("_row", F.monotonically_increasing_id()),
        "vectors",
    )


def _matrix(values) -> np.ndarray:
    """Rows of unequal length are padded with zeros, which is the common-prefix product."""
    rows = [np.asarray(v, dtype=np.int64) for v in values]
    width = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _pad(a: np.ndarray, width: int) -> np.ndarray:
    if a.shape[1] >= width:
        return a
    return np.pad(a, ((0, 0), (0, width - a.shape[1])))


def _kth(scores: np.ndarray, k: int) -> float | None:
    if len(scores) < k:
        return None
    return float(np.partition(scores, len(scores) - k)[len(scores) - k])


def thresholds(queries: DataFrame, head: pd.DataFrame, k: int) -> DataFrame:
    """Add ``_theta``: the k-th best exact score of each query against ``head`` (other ids only)."""
    ids = head["_id"].to_numpy(dtype=np.int64)
    matrix = _matrix(head["_v"])

    def score(batches):
        for b in batches:
            q = _matrix(b["_v"])
            width = max(q.shape[1], matrix.shape[1])
            products = _pad(q, width) @ _pad(matrix, width).T if len(ids) else np.zeros((len(b), 0), np.int64)
            own = b["_id"].to_numpy(dtype=np.int64)[:, None] == ids[None, :]
            theta = []
            for i in range(len(b)):
                kth = _kth(products[i][~own[i]], k)
                theta.append(kth)
            yield b.assign(_theta=pd.array(theta, dtype="Float64"))

    schema = T.StructType([*queries.schema.fields, T.StructField("_theta", T.DoubleType())])
    return queries.mapInPandas(score, schema)


def _search(k: int, coord_above: float):
    """Local top k of one (chunk, query block) task."""

    def run(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"_qrow": [], "_qid": [], "vec_id": [], "score": []})
        if candidates.empty or queries.empty:
            return empty.astype("int64")
        cid = candidates["_id"].to_numpy(dtype=np.int64)
        cmat = _matrix(candidates["_v"])
        cnorm = candidates["_norm"].to_numpy(dtype=np.float64)
        qmat = _matrix(queries["_v"])
        width = max(cmat.shape[1], qmat.shape[1])
        cmat, qmat = _pad(cmat, width), _pad(qmat, width)
        longest = float(cnorm.max())
        by_length = np.argsort(-cnorm, kind="stable")
        sorted_norms = -cnorm[by_length]  # ascending, for bisection
        unit = cmat / np.where(cnorm > 0, cnorm, 1.0)[:, None]
        columns: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        out_q, out_id, out_s, out_qid = [], [], [], []
        for i, (qrow, qid, qnorm, theta) in enumerate(
            zip(queries["_qrow"], queries["_id"], queries["_norm"], queries["_theta"])
        ):
            qnorm = float(qnorm)
            theta = None if theta is None or pd.isna(theta) else float(theta)
            if theta is None or theta <= 0 or qnorm == 0 or longest == 0:
                chosen = np.arange(len(cid))  # nothing to prune by
            else:
                t = theta / (qnorm * longest) * (1 - SLACK)
                if t > 1 + SLACK:
                    continue  # the whole chunk is too short for this query
                if t >= coord_above and width > 0:
                    qunit = qmat[i] / qnorm
                    f = int(np.argmax(np.abs(qunit)))
                    if f not in columns:
                        order = np.argsort(unit[:, f], kind="stable")
                        columns[f] = order, unit[order, f]
                    order, values = columns[f]
                    # angles: the candidate's angle to axis f is within acos(t) of the query's
                    alpha = math.acos(min(1.0, max(-1.0, float(qunit[f]))))
                    gamma = math.acos(min(1.0, t))
                    hi = 1.0 if alpha <= gamma else math.cos(alpha - gamma)
                    lo = -1.0 if alpha + gamma >= math.pi else math.cos(alpha + gamma)
                    lo, hi = lo - SLACK, hi + SLACK
                    chosen = order[bisect.bisect_left(values, lo) : bisect.bisect_right(values, hi)]
                else:
                    need = theta / qnorm * (1 - SLACK)
                    chosen = by_length[: bisect.bisect_right(sorted_norms, -need)]
            chosen = chosen[cid[chosen] != qid]
            if len(chosen) == 0:
                continue
            exact = cmat[chosen] @ qmat[i]  # verified in 64-bit integers
            if theta is not None:
                keep = exact >= theta
                chosen, exact = chosen[keep], exact[keep]
            if len(chosen) > k:
                order = np.lexsort((cid[chosen], -exact))[:k]
                chosen, exact = chosen[order], exact[order]
            out_q.append(np.full(len(chosen), qrow, dtype=np.int64))
            out_qid.append(np.full(len(chosen), qid, dtype=np.int64))
            out_id.append(cid[chosen])
            out_s.append(exact.astype(np.int64))
        if not out_q:
            return empty.astype("int64")
        return pd.DataFrame(
            {
                "_qrow": np.concatenate(out_q),
                "_qid": np.concatenate(out_qid),
                "vec_id": np.concatenate(out_id),
                "score": np.concatenate(out_s),
            }
        )

    return run


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    chunk_rows: int = CHUNK_ROWS,
    query_rows: int = QUERY_ROWS,
    head: int = HEAD,
    coord_above: float = COORD_ABOVE,
) -> DataFrame:
    """k best candidates of every query row: (query_id, rank, vec_id, score).

    ``vectors`` comes from :func:`integer_vectors`; ``is_query`` is a condition on its
    ``_id``. Every valid row is a candidate.
    """
    bands = vectors.groupBy("_band").agg(F.max("_norm").alias("_longest"), F.count(F.lit(1)).alias("_n")).collect()
    chunks = {r["_band"]: max(1, math.ceil(r["_n"] / chunk_rows)) for r in bands}
    longest = {r["_band"]: float(r["_longest"]) for r in bands}

    seed = vectors.orderBy(F.col("_norm").desc(), "_id").limit(head).select("_id", "_v").toPandas()
    queries = vectors.where(is_query).select(F.col("_row").alias("_qrow"), "_id", "_v", "_norm")
    queries = materialize(thresholds(queries, seed, k), "queries")

    # bands worth visiting: longest vector times the query's length reaches the threshold
    table = F.array(
        *[F.struct(F.lit(b).cast("long").alias("band"), F.lit(longest[b]).alias("longest")) for b in sorted(chunks)]
    ) if chunks else F.array().cast("array<struct<band:bigint,longest:double>>")
    reach = F.filter(
        table,
        lambda e: F.col("_theta").isNull()
        | (e["longest"] * F.col("_norm") * F.lit(1 + SLACK) >= F.col("_theta")),
    )
    paired = queries.withColumn("_reach", F.explode(reach)).withColumn("_band", F.col("_reach.band")).drop("_reach")
    per_band = {r["_band"]: r["n"] for r in paired.groupBy("_band").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = {b: max(1, math.ceil(per_band.get(b, 0) / query_rows)) for b in chunks}

    def lookup(mapping: dict) -> Column:
        if not mapping:
            return F.create_map().cast("map<bigint,bigint>")
        return F.create_map(*[x for b, n in mapping.items() for x in (F.lit(b).cast("long"), F.lit(n).cast("long"))])

    chunk_of = F.pmod(F.xxhash64("_row"), lookup(chunks)[F.col("_band")])
    candidates = (
        vectors.withColumn("_chunk", chunk_of)
        .withColumn("_block", F.explode(F.sequence(F.lit(0), lookup(blocks)[F.col("_band")] - 1)))
        .select("_band", "_chunk", "_block", "_id", "_v", "_norm")
    )
    copies = (
        paired.withColumn("_chunk", F.explode(F.sequence(F.lit(0), lookup(chunks)[F.col("_band")] - 1)))
        .withColumn("_block", F.pmod(F.xxhash64("_qrow"), lookup(blocks)[F.col("_band")]))
        .select("_band", "_chunk", "_block", "_qrow", "_id", "_v", "_norm", "_theta")
    )
    schema = "_qrow long, _qid long, vec_id long, score long"
    local = (
        candidates.groupBy("_band", "_chunk", "_block")
        .cogroup(copies.groupBy("_band", "_chunk", "_block"))
        .applyInPandas(_search(k, coord_above), schema)
    )
    best = Window.partitionBy("_qrow").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("_qid").alias("query_id"), F.col("rank").cast("int"), "vec_id", "score")
