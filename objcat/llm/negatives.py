"""Hard negatives: scores at a parent anchor bound those of its children, and only rows that may fall in a window are scored again."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from objcat.llm import vectors
from objcat.session import staged

BLOCK = 512  # anchors of one tree
CELL = 8192  # rows that meet a tree at a time
STRIP = 2048  # of those, bounded at once


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge) of a minimum spanning tree: each point after its parent, the first one with parent -1.

    Edges are Euclidean lengths, never less than the true ones.
    """
    count = len(points)
    norms = (points * points).sum(axis=1)
    order, parent, edge = np.zeros(count, np.int64), np.full(count, -1), np.zeros(count)
    nearest, via = np.full(count, np.inf), np.full(count, -1)
    open_ = np.ones(count, bool)
    now = 0
    for place in range(count):
        order[place], parent[now], open_[now] = now, via[now], False
        edge[now] = 0.0 if via[now] < 0 else math.sqrt(max(0.0, nearest[now])) * (1 + 1e-9) + 1e-6
        away = norms + norms[now] - 2 * (points @ points[now])
        closer = open_ & (away < nearest)
        nearest[closer], via[closer] = away[closer], now
        if place + 1 < count:
            now = int(np.where(open_, nearest, np.inf).argmin())
    return order, parent, edge


def planted(shape: vectors.Shape, anchors: DataFrame) -> tuple[DataFrame, int]:
    """The anchors with their place in a tree of their block: (…, block, place, parent, edge), and the number of blocks.

    Blocks are ranges of the signs of the first components, so that near anchors share a tree and edges are short.
    `parent` is a place; -1 at the root.
    """
    blocks = max(1, math.ceil(anchors.count() / BLOCK))
    ranges = staged(anchors.repartitionByRange(blocks, "code", "id").withColumn("block", F.spark_partition_id()), "anchors")
    schema = ranges.withColumn("place", F.lit(0)).withColumn("parent", F.lit(0)).withColumn("edge", F.lit(0.0)).schema

    def run(table: pa.Table) -> pa.Table:
        order, parent, edge = spanning_tree(shape.matrix(table["v"]).astype(np.float64))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        up = np.where(parent[order] < 0, -1, place[parent[order]])
        table = table.take(pa.array(order))
        for name, values in (("place", pa.array(np.arange(len(order)), pa.int32())), ("parent", pa.array(up, pa.int32())), ("edge", pa.array(edge[order]))):
            table = table.append_column(name, values)
        return table

    trees = staged(ranges.groupBy("block").applyInArrow(run, schema), "trees")
    return trees, (trees.agg(F.max("block")).first()[0] or 0) + 1


class Walk:
    """Bounds of the scores of one strip of rows at each anchor of a tree, parents first."""

    def __init__(self, anchors: np.ndarray, parents: np.ndarray, edges: np.ndarray, rows: np.ndarray):
        self.anchors, self.parents, self.edges, self.rows = anchors, parents, edges, rows
        whole = rows.astype(np.float64)
        self.norms = np.sqrt((whole * whole).sum(axis=1)) * (1 + 1e-9)
        self.waiting = np.bincount(parents[parents >= 0], minlength=len(anchors))
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def bounds(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        """The least and the highest score that each row can have with this anchor: a parent's, less or plus edge times norm."""
        up = int(self.parents[at])
        if up < 0:
            exact = (self.rows @ self.anchors[at]).astype(np.float64)
            low, high = exact, exact.copy()
        else:
            low, high = self.known[up]
            reach = self.edges[at] * self.norms
            low, high = low - reach, high + reach
            self.waiting[up] -= 1
            if not self.waiting[up]:
                del self.known[up]
        if self.waiting[at]:
            self.known[at] = low, high
        return low, high

    def rescored(self, at: int, some: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Exact scores of some rows, which also narrow what the children are told."""
        exact = self.rows[some] @ self.anchors[at]
        low[some] = high[some] = exact
        return exact.astype(np.int64)


def _merged(ids: np.ndarray, scores: np.ndarray, old: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    ids, scores = np.concatenate([old[0], ids]), np.concatenate([old[1], scores])
    best = np.lexsort((ids, -scores))[:k]
    return ids[best], scores[best]


_NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _trees(shape: vectors.Shape, left: pa.Table, right: pa.Table):
    """The anchors' arrays in tree order, and a walk for each strip of rows."""
    left = left.take(pa.array(np.argsort(left["place"].to_numpy(), kind="stable")))
    anchors = shape.matrix(left["v"])
    parents, edges = left["parent"].to_numpy(), left["edge"].to_numpy()
    strips = (right.slice(at, STRIP) for at in range(0, right.num_rows, STRIP))
    return left, ((Walk(anchors, parents, edges, shape.matrix(s["v"])), s["id"].to_numpy(), s["label"].to_numpy()) for s in strips)


def _positives(shape: vectors.Shape, count: int):
    """Of one cell, the best `count` other rows of each anchor's label. Rows whose upper bound misses the worst so far are not scored."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, walks = _trees(shape, left, right)
        own, labels = left["id"].to_numpy(), left["label"].to_numpy()
        best = [_NONE] * len(own)
        for walk, ids, marks in walks:
            for at in range(len(own)):
                low, high = walk.bounds(at)
                least = best[at][1][-1] if len(best[at][1]) == count else -np.inf
                some = np.flatnonzero((marks == labels[at]) & (high >= least) & (ids != own[at]))
                if len(some):
                    best[at] = _merged(ids[some], walk.rescored(at, some, low, high), best[at], count)
        sizes = [len(b[0]) for b in best]
        of = np.repeat(own, sizes)
        return pa.table({"anchor_id": of, "positive_id": np.concatenate([*(b[0] for b in best), _NONE[0]]), "positive_score": np.concatenate([*(b[1] for b in best), _NONE[1]])})

    return run


def _negatives(shape: vectors.Shape, count: int, low_share: int, high_share: int):
    """Of one cell, the best `count` rows of other labels in the window of each positive. Only rows whose bounds meet one are scored."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, walks = _trees(shape, left, right)
        own, labels = left["id"].to_numpy(), left["label"].to_numpy()
        # Windows as whole scores: low_share * p <= 100 * s <= high_share * p.
        wanted = [[(p["id"], p["score"], -(-low_share * p["score"] // 100), high_share * p["score"] // 100) for p in row] for row in left["positives"].to_pylist()]
        best = {(at, p[0]): _NONE for at, row in enumerate(wanted) for p in row}
        for walk, ids, marks in walks:
            for at, row in enumerate(wanted):
                low, high = walk.bounds(at)
                other = marks != labels[at]
                windows = []
                for p in row:
                    now = best[at, p[0]]
                    least = max(p[2], now[1][-1]) if len(now[1]) == count else p[2]
                    if least <= p[3]:
                        windows.append((p[0], least, p[3]))
                if not windows:
                    continue
                meets = np.zeros(len(ids), bool)
                for _, least, most in windows:
                    meets |= (high >= least) & (low <= most)
                some = np.flatnonzero(meets & other)
                if not len(some):
                    continue
                scores, found = walk.rescored(at, some, low, high), ids[some]
                for positive, least, most in windows:
                    inside = (scores >= least) & (scores <= most)
                    if inside.any():
                        best[at, positive] = _merged(found[inside], scores[inside], best[at, positive], count)
        rows = [(own[at], p[0], p[1], best[at, p[0]]) for at, row in enumerate(wanted) for p in row]
        sizes = [len(r[3][0]) for r in rows]
        column = lambda values: pa.array(np.repeat(np.array(values, np.int64), sizes))
        return pa.table(
            {
                "anchor_id": column([r[0] for r in rows]),
                "positive_id": column([r[1] for r in rows]),
                "positive_score": column([r[2] for r in rows]),
                "negative_id": np.concatenate([*(r[3][0] for r in rows), _NONE[0]]),
                "negative_score": np.concatenate([*(r[3][1] for r in rows), _NONE[1]]),
            }
        )

    return run


def mine(
    df: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of every anchor and positive.

    Components count as floor(256 * x); scores are inner products, higher first, ties by the smaller key. The
    positives of an anchor are its first `positives` other rows of its label. For each, the first `negatives` rows of
    other labels with low * positive_score <= 100 * score <= high * positive_score are returned; a window that holds
    no row gives none, and one of a negative positive_score is empty. `is_anchor` is a condition on the column `id`.

    Anchors are cut into blocks, each with a minimum spanning tree. A strip of rows is scored at the root; at every other
    anchor the parent's score, less and plus edge length times the row's norm, bounds the score (Cauchy and Schwarz),
    and only rows whose bounds meet a window are scored again, exactly. The worst result so far narrows the windows.

    Rows with a null key, label or vector, or a component that is null or not finite, take no part. Rows that repeat a
    key are one row: the least by vector, then label. An empty table, or one without anchors, gives no rows.
    """
    labelled = df.filter(label.isNotNull())
    vecs, shape = vectors.integers(labelled, key, vector, {"label": label.cast("long")})
    rows = vecs.select("id", "v", "label")
    trees, blocks = planted(shape, vecs.filter(is_anchor))
    anchors = trees.select("id", "v", "label", "block", "place", "parent", "edge")

    found = vectors.beside(anchors, rows, blocks, CELL, _positives(shape, positives), "anchor_id long, positive_id long, positive_score long")
    first = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    near = staged(found.withColumn("rank", first).filter(F.col("rank") <= positives).drop("rank"), "positives")
    # At most `positives` of them for each anchor.
    lists = near.groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("positives"))
    with_lists = anchors.join(lists, anchors["id"] == lists["anchor_id"], "left").drop("anchor_id")
    with_lists = with_lists.withColumn("positives", F.coalesce("positives", F.array().cast("array<struct<id:bigint,score:bigint>>")))

    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    hard = vectors.beside(with_lists, rows, blocks, CELL, _negatives(shape, negatives, low, high), schema)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return hard.withColumn("rank", rank).filter(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
