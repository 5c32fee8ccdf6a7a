"""Exact top-k search: histograms of all scores locate each query's k-th value, then rows from that value on are filtered."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from objcat.llm import vectors
from objcat.session import staged

BLOCK = 1024  # queries of one block
CELL = 16_384  # rows that meet a block at a time
STRIP = 2048  # of those, scored at once
BITS = 9  # a histogram has at most 2 ** BITS bins


def _strips(shape: vectors.Shape, left: pa.Table, right: pa.Table):
    """(ids of the rows, scores as whole numbers, which are of another row than the query), a few rows at a time."""
    queries, own = shape.matrix(left["v"]), left["id"].to_numpy()
    ids = right["id"].to_numpy()
    for at in range(0, len(ids), STRIP):
        part = right.slice(at, STRIP)
        scores = queries @ shape.matrix(part["v"]).T
        yield ids[at : at + STRIP], scores.astype(np.int64), own[:, None] != ids[None, at : at + STRIP]


def _histogram(shape: vectors.Shape, step: int, bins: int):
    """For each query of a block, its highest bins that are not empty, until they hold as many rows as it still needs.

    Bins are 2 ** step scores wide and begin at `low`, a multiple of that; scores beyond the last bin were counted before.
    Bins below those cannot hold the k-th value of all rows, since the rows of this cell alone come before it.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        low, need = left["low"].to_numpy(), left["need"].to_numpy()
        counts = np.zeros(len(low) * bins, np.int64)
        for _, scores, other in _strips(shape, left, right):
            at = (scores >> step) - (low >> step)[:, None]
            inside = other & (at >= 0) & (at < bins)
            counts += np.bincount((at + np.arange(len(low))[:, None] * bins)[inside], minlength=len(counts))
        counts = counts.reshape(len(low), bins)
        above = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
        query, chosen = np.nonzero((counts > 0) & (above < need[:, None]))
        return pa.table({"id": left["id"].take(pa.array(query)), "bin": pa.array(chosen, pa.int64()), "n": pa.array(counts[query, chosen], pa.int64())})

    return run


def _highest(shape: vectors.Shape, k: int):
    """For each query of a block, at most k rows whose score reaches its k-th value, the best ones first by score and id."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        low = left["low"].to_numpy()
        found = [(np.zeros(0, np.int64),) * 3]
        for ids, scores, other in _strips(shape, left, right):
            query, at = np.nonzero(other & (scores >= low[:, None]))
            found.append((query, ids[at], scores[query, at]))
            if sum(len(f[0]) for f in found) > 4 * k * len(low) + STRIP:
                found = [_best(found, k)]
        query, ids, scores = _best(found, k)
        return pa.table({"query_id": left["id"].take(pa.array(query)), "vec_id": pa.array(ids), "score": pa.array(scores, pa.int64())})

    return run


def _best(found: list[tuple], k: int) -> tuple:
    query, ids, scores = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    first = np.searchsorted(query, query, "left")
    keep = np.arange(len(query)) - first < k
    return query[keep], ids[keep], scores[keep]


def top_k(df: DataFrame, is_query, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest inner product with each query, ties to the smaller key.

    Components count as floor(256 * x). `is_query` is a condition on the column `id`. Every row is scored against
    every query, in blocks. The first histogram covers all possible scores; each next one divides the bin that
    holds the k-th value, which is the first at which the rows from the top reach k. When that bin is one score wide, or
    all of its rows are wanted, the value is known exactly. Then only rows that reach it are
    written, at most k for each query and cell, and the last ties are cut by key.

    Rows with a null key or vector, or a component that is null or not finite, take no part. Rows that
    repeat a key are one row (the least vector), which is never its own neighbour. A query with fewer than k others
    gets them all; an empty table gives no rows. Histograms and candidates grow with queries and cells, not with the scores.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    rows, shape = vectors.integers(df, key, vector)
    rows = rows.select("id", "v")
    count = rows.filter(is_query).count()
    blocks = max(1, math.ceil(count / BLOCK))
    queries = rows.filter(is_query).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    kind = rows.schema["id"].dataType.simpleString()

    bits = shape.bound.bit_length() + 1  # scores are from -(2 ** (bits - 1)) on
    state = queries.select("id", F.lit(-(1 << bits - 1)).cast("long").alias("low"), F.lit(k).cast("long").alias("need"), F.lit(True).alias("open"))
    while bits > 0:
        step = max(0, bits - BITS)
        searched = queries.join(state.filter("open").select("id", "low", "need"), "id")
        counts = vectors.beside(searched, rows, blocks, CELL, _histogram(shape, step, 1 << bits - step), f"id {kind}, bin long, n long").groupBy("id", "bin").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0))
        passed = counts.select("id", "bin", "n", upto.alias("upto")).join(state.select("id", "need"), "id").filter("upto >= need")
        holds = passed.groupBy("id").agg(F.max(F.struct("bin", "n", "upto")).alias("b"))
        low = F.shiftleft(F.shiftright("low", step) + F.coalesce(F.col("b.bin"), F.lit(0)), step)
        need = F.col("need") - F.coalesce(F.col("b.upto") - F.col("b.n"), F.lit(0))
        # Closed: fewer rows than wanted, all rows of the bin wanted, or closed before.
        still = F.col("open") & F.col("b").isNotNull() & (F.col("b.upto") > F.col("need"))
        state = staged(state.join(holds, "id", "left").select("id", low.alias("low"), need.alias("need"), still.alias("open")), "located")
        bits = step
        if state.filter("open").isEmpty():
            break

    found = vectors.beside(queries.join(state.select("id", "low"), "id"), rows, blocks, CELL, _highest(shape, k), f"query_id {kind}, vec_id {kind}, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
