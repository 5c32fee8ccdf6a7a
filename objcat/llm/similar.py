"""Near-duplicates by the exact similarity of word shingles: rare shingles name the candidates, whole sets decide."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objcat.llm.common import slices, text_of, texts
from objcat.llm.components import connected
from objcat.session import staged

# At most about so many documents, and so many of their shingles, say which shingles are common.
SAMPLED, COMMON = 20_000, 100_000
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def shingles(text: bytes, shingle: int) -> np.ndarray:
    """The distinct hashes of the word shingles, in order; a text of fewer words is one shingle, one of none has none."""
    words = text.lower().split()  # as for fingerprints
    if not words:
        return np.zeros(0, np.int64)
    count = max(1, len(words) - shingle + 1)
    return np.unique(np.fromiter((_hash(b" ".join(words[i : i + shingle])) for i in range(count)), np.uint64, count).view(np.int64))


def _node(found: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(found.tobytes()), "big", signed=True)


def _lists(found: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))


def common(docs: DataFrame, shingle: int, key: str = "doc_id", text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The shingles that most documents of a sample share, in order of their hash, and in how many they are.

    They only set the order in which shingles are looked at, so they change the work and never the result.
    """
    total = docs.count()
    share = min(1.0, SAMPLED / total) if total else 1.0
    picked = docs.filter(F.pmod(F.xxhash64(docs[key]), F.lit(1_000_000)) < F.lit(math.ceil(share * 1_000_000)))
    short = picked.select(text_of(picked, text).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(t, shingle) for t in texts(batch, "text")]))], ["token"])

    counted = short.mapInArrow(run, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 5")
    rows = counted.orderBy(F.desc("n"), "token").limit(COMMON).collect()
    rows.sort()
    return np.array([r["token"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64)


def needed(n: int, percent: int) -> int:
    """How many of its n shingles a set shares at least with one that is similar to it."""
    return -(-n * percent // 100)


def prefixes(docs: DataFrame, shingle: int, percent: int, often: tuple[np.ndarray, np.ndarray], key: str, text: str) -> DataFrame:
    """(id, node, n, prefix): the hash of each row's set of shingles, their number, and its first shingles, rare ones before common ones.

    Two sets that are similar enough share one of these: each set without its own has too few left for the overlap.
    """
    short = docs.select(docs[key].alias("id"), text_of(docs, text).alias("text"))
    schema = short.select("id", F.expr("0L AS node"), F.expr("0 AS n"), F.expr("array(0L) AS prefix")).schema
    tokens, counts = often

    def first(found: np.ndarray) -> np.ndarray:
        rank = np.zeros(len(found), np.int64)
        if len(tokens):
            at = np.minimum(np.searchsorted(tokens, found), len(tokens) - 1)
            rank = np.where(tokens[at] == found, counts[at], 0)
        return found[np.lexsort((found, rank))][: len(found) - needed(len(found), percent) + 1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            sets = [shingles(t, shingle) for t in texts(batch, "text")]
            nodes = pa.array([_node(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), nodes, pa.array([len(s) for s in sets], pa.int32()), _lists([first(s) for s in sets])], ["id", "node", "n", "prefix"])

    return short.mapInArrow(run, schema)


def sets_of(docs: DataFrame, nodes: DataFrame, shingle: int, key: str, text: str) -> DataFrame:
    """(node, set): once for each of `nodes` (node, id), from the text of a row with that id."""
    short = docs.select(docs[key].alias("id"), text_of(docs, text).alias("text")).join(nodes.select("id").distinct(), "id", "left_semi")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            sets = [shingles(t, shingle) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), _lists(sets)], ["node", "set"])

    # Rows that repeat an id may have other texts; what is no set asked for goes.
    found = short.mapInArrow(run, "node long, set array<long>").join(nodes.select("node"), "node", "left_semi")
    return found.groupBy("node").agg(F.first("set").alias("set"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose sets share `percent` of their union or more."""
    left, right = sets.select(F.col("node").alias("a"), F.col("set").alias("x")), sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    both = F.size(F.array_intersect("x", "y")).cast("long")
    return pairs.join(left, "a").join(right, "b").filter(both * (100 + percent) >= (F.size("x").cast("long") + F.size("y")) * percent).select("a", "b")


def links(docs: DataFrame, prints: DataFrame, shingle: int, percent: int, key: str, text: str) -> DataFrame:
    """(a, b): pairs of different sets that are similar enough, as many as it takes to join all that such pairs join.

    First each set is held against the smallest that shares one of its shingles, which is one pair for each set and shingle
    however many share it. That joins most of a group of copies. Only where one shingle still has sets of
    different components, all its pairs across components are looked at, so no link between components is missed.
    """
    owners = prints.groupBy("node").agg(F.min("id").alias("id"))
    rows = prints.join(owners, ["node", "id"], "left_semi").select("node", "n", F.explode("prefix").alias("token")).distinct()
    rows = staged(rows, "prefixes")
    firsts = rows.groupBy("token").agg(F.min(F.struct("node", "n")).alias("first"), F.max("node").alias("last")).filter(F.col("first.node") < F.col("last"))
    shared = staged(rows.join(firsts.select("token", "first"), "token"), "shared")
    fits = lambda n, m: (F.least(n, m).cast("long") * 100 >= F.greatest(n, m).cast("long") * percent)
    star = shared.filter((F.col("first.node") < F.col("node")) & fits(F.col("n"), F.col("first.n")))
    star = staged(star.select(F.col("first.node").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    asked = shared.select("node").distinct().join(owners, "node")
    sets = staged(sets_of(docs, asked, shingle, key, text), "sets")
    found = staged(verified(star, sets, percent), "star-links")

    joined = connected(found, "a", "b")
    of = shared.select("token", "node", "n").join(joined, "node", "left").select("token", "node", "n", F.coalesce("component", "node").alias("of"))
    of = staged(of, "members")
    mixed = of.groupBy("token").agg(F.min("of").alias("low"), F.max("of").alias("high")).filter("low <> high").select("token")
    of = of.join(mixed, "token")
    a, b = of.alias("a"), of.alias("b")
    across = (F.col("a.token") == F.col("b.token")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.of") != F.col("b.of"))
    more = a.join(b, across & fits(F.col("a.n"), F.col("b.n"))).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()
    more = staged(more.join(star, ["a", "b"], "left_anti"), "pairs")
    return found.unionByName(verified(more, sets, percent))


def groups(docs: DataFrame, shingle: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, component_id) of every row of `docs` that has a key.

    Rows are in one component if a chain of texts joins them, each of which shares `percent` or more of all distinct word
    shingles with the next; component_id is the smallest key in it. Every such pair counts, none is estimated. Rows with
    equal sets become one before any pair is looked for. Texts without words are one component.
    """
    docs = docs.filter(docs[key].isNotNull())
    prints = staged(prefixes(docs, shingle, percent, common(docs, shingle, key, text), key, text), "shingles")
    joined = connected(staged(links(docs, prints, shingle, percent, key, text), "links"), "a", "b").withColumnRenamed("node", "_node")
    rooted = prints.select("id", "node").join(joined, F.col("node") == F.col("_node"), "left").select("id", F.coalesce("component", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    return rooted.join(named, "root").select(F.col("id").alias(key), "component_id")
