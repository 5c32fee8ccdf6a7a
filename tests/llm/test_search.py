"""Prefix trie, exact top-k and hard negatives against brute force, with nulls, repeats, ties, long and empty input and clashing columns."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from objcat.llm import negatives, topk, trie, vectors

# 11

CLASH = {"conv": "x", "depth": "x", "name": "x", "digest": "x", "pos": "x", "chars": "x", "length": "x"}


def talks_of(spark, rows):
    return spark.createDataFrame([(*r, *CLASH.values()) for r in rows], "conv_id long, turn long, role string, text string, " + ", ".join(f"{c} string" for c in CLASH))


def trie_by_hand(rows):
    said = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            said[conv].append(((turn is not None, turn or 0), role, tie, (role, text)))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in said.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + ts[h:]
    nodes = collections.defaultdict(list)
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            nodes[tuple(ts[:d])].append(c)
    children = collections.Counter(p[:-1] for p in nodes if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(members) - 1) * (len(p[-1][1]) if p else 0)
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(whole[c]) == len(p))
        parent = min(nodes[p[:-1]]) if p else None
        out.append((min(members), len(p), parent, len(members), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def test_trie_by_brute_force(spark):
    draw = random.Random(11)
    rows = []
    for c in [0, 100, 200, *draw.sample(range(-250, 650), 90)]:
        for t in range(draw.choice([1, 2, 3, 5, 8])):
            rows.append((c, t, draw.choice(["user", "bot"]), draw.choice(["hi", "hé𝄞", "", "long " * 5])))
    rows += [(300, t, "user", f"t{t % 3}") for t in range(41)] + [(301, t, "user", f"t{t % 3}") for t in range(41)]  # deep
    rows += [(400, None, "a", "first"), (400, 0, "b", "x"), (400, 0, "a", "y"), (400, 0, "a", "x"), (400, 0, "a", "x"), (400, -1, None, None)]  # ties, repeats, nulls
    rows += [(None, 0, "a", "none"), (7, None, None, None), (999, 0, "a", "alone"), (1_000_000_007, 2, "user", "hi")]
    got = sorted((tuple(r) for r in trie.prefix_trie(talks_of(spark, rows)).collect()), key=lambda r: r[:2])
    assert got == trie_by_hand(rows)
    assert any(r[1] > 30 for r in got)


def test_trie_of_turnless_and_empty_tables(spark):
    # Conversation 5 leaves out its only turn and finds no conversation 0: it is a member of the root alone.
    alone = [c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 >= 2][:3]
    rows = [(c, 0, "a", "gone") for c in alone]
    got = [tuple(r) for r in trie.prefix_trie(talks_of(spark, rows)).collect()]
    assert got == trie_by_hand(rows) and got[0][:6] == (min(alone), 0, None, 3, 0, 1)
    assert trie.prefix_trie(talks_of(spark, rows).limit(0)).count() == 0
    assert trie.prefix_trie(talks_of(spark, [(None, 1, "a", "b")])).count() == 0


def test_lists_that_cross_ranges(spark):
    many = spark.range(3 * trie.PIECE).select(F.lit(1).cast("long").alias("name"), F.lit(2).cast("long").alias("depth"), F.col("id").alias("conv"))
    few = spark.createDataFrame([(1, 3, 5), (0, 2, -4), (0, 2, 10), (0, 2, 9)], "name long, depth long, conv long")
    got = {(r["name"], r["depth"]): r["sha"] for r in trie.hashed_lists(many.unionByName(few)).collect()}
    lists = {(1, 2): range(3 * trie.PIECE), (1, 3): [5], (0, 2): [-4, 9, 10]}
    assert got == {k: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for k, v in lists.items()}


# 12 and 13


def vectors_of(spark, rows):
    extra = {"id": "x", "v": "x", "block": "x", "cell": "x", "bin": "x", "code": "x", "score": "x"}
    return spark.createDataFrame([(*r, *extra.values()) for r in rows], "vec_id long, embedding array<double>, label int, " + ", ".join(f"{c} string" for c in extra))


def whole(rows, labelled=False):
    """What takes part: {id: (integer vector, label)}; of repeated ids the least."""
    found = {}
    for i, v, label in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or labelled and label is None:
            continue
        row = ([math.floor(256 * x) for x in v], label)
        found[i] = min(found.get(i, row), row)
    return found


def score(a, b):
    return sum(x * y for x, y in zip(a, b))


def random_rows(draw, count, width=8, centers=6):
    middle = [[draw.gauss(0, 0.4) for _ in range(width)] for _ in range(centers)]
    rows = [(i, [x + draw.gauss(0, 0.05) for x in draw.choice(middle)], draw.randrange(4)) for i in range(count)]
    same = rows[3][1]
    rows += [(1000 + i, same, i % 2) for i in range(60)]  # a large group of copies: ties
    rows += [(None, same, 1), (2000, None, 1), (2050, [None] * width, 1), (2100, [math.nan] * width, 1), (2150, [math.inf] + [0.0] * (width - 1), 1), (2200, same, None)]
    rows += [(10, same, 2), (rows[0][0], rows[0][1], rows[0][2]), (2250, same[:3], 1), (2300, [], 0), (2350, [0.0] * width, 3)]  # repeated ids, short and empty vectors
    return rows


@pytest.mark.parametrize("factor", [1.0, 1000.0, 3.0e6])
def test_top_k_by_brute_force(spark, factor):
    draw = random.Random(12)
    rows = [(i, v and [x and x * factor for x in v], label) for i, v, label in random_rows(draw, 150)]
    part = whole(rows)
    expected = []
    for q in part:
        if q % 10 == 0:
            ranked = sorted((-score(part[q][0], v), i) for i, (v, _) in part.items() if i != q)[:5]
            expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(ranked)]
    got = topk.top_k(vectors_of(spark, rows), F.col("id") % 10 == 0).collect()
    assert sorted(tuple(r) for r in got) == sorted(expected)


@pytest.mark.parametrize("scale, shift", [(0.02, 0.2), (0.5, 0.0), (1e4, 9.95e6)])
def test_top_k_of_scores_close_together(spark, scale, shift):
    # Bins narrower than a whole histogram: what lies above them was counted before. The last scale nearly fills 64 bits.
    draw, width = random.Random(14), 1 if shift > 2 else 8
    rows = [(i, [draw.choice([-1, 1, 1]) * shift * (width == 1) + shift * (width > 1) + draw.gauss(0, scale) for _ in range(width)], 0) for i in range(1500)]
    part = whole(rows)
    expected = []
    for q in range(0, 1500, 50):
        ranked = sorted((-score(part[q][0], v), i) for i, (v, _) in part.items() if i != q)[:5]
        expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(ranked)]
    got = topk.top_k(vectors_of(spark, rows), F.col("id") % 50 == 0).collect()
    assert sorted(tuple(r) for r in got) == expected


def test_top_k_of_few_rows(spark):
    rows = [(0, [1.0, 0.0], 0), (50, [0.5, 0.5], 0), (7, [-1.0, -1.0], 0)]
    frame = vectors_of(spark, rows)
    got = sorted(tuple(r) for r in topk.top_k(frame, F.col("id") % 50 == 0).collect())
    assert got == [(0, 1, 50, 128 * 256), (0, 2, 7, -(256**2)), (50, 1, 0, 128 * 256), (50, 2, 7, -(256**2))]
    assert topk.top_k(frame.limit(0), F.col("id") % 50 == 0).count() == 0
    assert topk.top_k(frame, F.col("id") < 0).count() == 0
    with pytest.raises(ValueError):
        vectors.integers(vectors_of(spark, [(1, [1e12], 0)]), "vec_id", "embedding")


def negatives_by_hand(rows, anchors):
    part = whole(rows, labelled=True)
    out = []
    for a in part:
        if not anchors(a):
            continue
        ranked = sorted((-score(part[a][0], v), i, label) for i, (v, label) in part.items() if i != a)
        for p, i, _ in [r for r in ranked if r[2] == part[a][1]][:5]:
            p = -p
            inside = [(-s, j) for s, j, label in ranked if label != part[a][1] and 50 * p <= -100 * s <= 95 * p][:3]
            out += [(a, i, n + 1, j, p, s) for n, (s, j) in enumerate(inside)]
    return sorted(out)


def test_hard_negatives_by_brute_force(spark):
    rows = random_rows(random.Random(13), 400)
    got = negatives.mine(vectors_of(spark, rows), F.col("id") % 10 == 0, F.col("label"))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    expected = negatives_by_hand(rows, lambda a: a % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == expected and len(expected) > 100
    frame = vectors_of(spark, rows)
    assert negatives.mine(frame.limit(0), F.col("id") % 10 == 0, F.col("label")).count() == 0
    assert negatives.mine(frame, F.col("id") < 0, F.col("label")).count() == 0


def test_tree_bounds_hold_and_spare_work():
    draw = np.random.default_rng(13)
    centers = draw.normal(0, 100, (8, 16))
    make = lambda n: np.floor(centers[draw.integers(0, 8, n)] + draw.normal(0, 4, (n, 16)))
    anchors, rows = make(60), make(500)
    order, parent, edge = negatives.spanning_tree(anchors)
    # A minimum spanning tree, by Kruskal.
    away = np.linalg.norm(anchors[:, None] - anchors[None], axis=2)
    root = list(range(60))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    least = 0.0
    for a, b in sorted(((a, b) for a in range(60) for b in range(a)), key=lambda p: away[p]):
        if top(a) != top(b):
            root[top(a)] = top(b)
            least += away[a, b]
    assert edge.sum() == pytest.approx(least, abs=1e-2) and sorted(order) == list(range(60)) and (parent >= 0).sum() == 59
    place = np.empty(60, int)
    place[order] = np.arange(60)
    up = np.where(parent[order] < 0, -1, place[parent[order]])
    assert all(p < i for i, p in enumerate(up))
    walk = negatives.Walk(anchors[order], up, edge[order], rows)
    scored = 0
    for at in range(60):
        low, high = walk.bounds(at)
        true = rows @ anchors[order][at]
        assert (low <= true).all() and (true <= high).all()
        some = np.flatnonzero(high >= np.quantile(true, 0.95))
        scored += len(some)
        assert set(np.flatnonzero(true >= np.quantile(true, 0.95))) <= set(some)
        walk.rescored(at, some, low, high)
    assert scored < 0.6 * 60 * 500
