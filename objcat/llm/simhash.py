"""SimHash near-duplicates found through tables of distances to reference fingerprints."""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator
from functools import partial, reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objcat.llm import similar
from objcat.llm.common import slices, text_of, texts
from objcat.llm.components import connected
from objcat.session import staged

CHUNK = 1 << 15  # shingles turned into bits at a time
BLOCK_PIVOTS = 12  # reference fingerprints inside each block
WIDE_PIVOTS = 7  # reference fingerprints over all 64 bits
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: bytes, shingle: int) -> int:
    """The SimHash of the word shingles, with repeats: a bit is 1 if set in over half of their hashes."""
    words = text.lower().split()  # of bytes: only A-Z change, and only the six ASCII white spaces split
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(word) + 1 for word in words))  # one past the space that follows
    starts = [0, *ends[:-1]]
    last = ends[min(shingle, len(words)) - 1 :]
    ones, total = np.zeros(64, np.int64), len(last)
    for at in range(0, total, CHUNK):
        pieces = [joined[a : b - 1] for a, b in zip(starts[at : at + CHUNK], last[at : at + CHUNK])]
        hashes = np.fromiter(map(_hash, pieces), "<u8", len(pieces))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint as a signed 64-bit number) of every row; null text is empty and has fingerprint 0."""
    short = docs.select(docs[key].alias("id"), text_of(docs, text).alias("text"))
    schema = short.select("id", F.lit(0).cast("long").alias("fp")).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = np.array([fingerprint(t, shingle) for t in texts(batch, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints)], ["id", "fp"])

    return short.mapInArrow(run, schema)


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _edges(count: int) -> list[int]:
    return [round(64 * i / count) for i in range(count + 1)]


def _block_masks(blocks: int) -> list[int]:
    return [sum(1 << bit for bit in range(a, b)) for a, b in zip(_edges(blocks), _edges(blocks)[1:])]


def _distance(column: Column, pivot: int) -> Column:
    return F.bit_count(column.bitwiseXOR(F.lit(_signed(pivot))))


def pivot_table(prints: DataFrame, radius: int, blocks: int) -> DataFrame:
    """One row per fingerprint and choice of blocks: the key of that choice and the distances to wide pivots.

    The 64 bits are cut into `blocks`. Each block has its own reference fingerprints, 0 elsewhere; the distance to
    one of them less the distance to 0 depends on that block alone. Two fingerprints that differ in
    at most `radius` bits leave blocks - radius blocks untouched, and in those every such coordinate is
    equal. So the coordinates of each choice of blocks - radius blocks make a key; pairs that meet in no
    key differ too much in some coordinate of every choice and are discarded without being looked at.
    `table` holds the distances to the wide pivots in 8 bits each and, on top, the last block of the choice.
    """
    draw = random.Random(64)
    coordinates = []
    for mask in _block_masks(blocks):
        packed = F.lit(0).cast("long")
        for j in range(BLOCK_PIVOTS):
            pivot = draw.getrandbits(64) & mask
            relative = _distance(F.col("fp"), pivot) - F.bit_count("fp") + 16  # a block has at most 16 bits
            packed = packed.bitwiseOR(F.shiftleft(relative.cast("long"), 5 * j))
        coordinates.append(packed)
    wide = F.lit(0).cast("long")
    for j in range(WIDE_PIVOTS):
        wide = wide.bitwiseOR(F.shiftleft(_distance(F.col("fp"), draw.getrandbits(64)).cast("long"), 8 * j))
    known = prints.select("fp", wide.alias("wide"), *[c.alias(f"c{i}") for i, c in enumerate(coordinates)])
    keys = [
        F.struct(F.xxhash64(F.lit(n), *[F.col(f"c{i}") for i in chosen]).alias("key"), F.lit(chosen[-1] << 56).cast("long").alias("top"))
        for n, chosen in enumerate(combinations(range(blocks), blocks - radius))
    ]
    rows = known.select("fp", "wide", F.explode(F.array(*keys)).alias("k"))
    return rows.select("k.key", "fp", F.col("wide").bitwiseOR(F.col("k.top")).alias("table"))


def links(prints: DataFrame, radius: int = 4, blocks: int = 7) -> DataFrame:
    """(a, b): every pair of the given distinct fingerprints that differ in 1 to `radius` bits, once.

    `blocks` is how many blocks the bits are cut into: more blocks make longer keys, so fewer pairs to look at, and
    more keys for each fingerprint. It changes the work, never the result.
    """
    if not radius < blocks <= 64 or 64 > 16 * blocks:
        raise ValueError("blocks must be more than the radius, and blocks of at most 16 bits")
    rows = pivot_table(prints, radius, blocks)
    a, b = rows.alias("a"), rows.alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    near = (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp"))
    for j in range(WIDE_PIVOTS):  # a pivot's distances to two near fingerprints differ by no more than they do
        x, y = (F.shiftright(F.col(f"{side}.table"), 8 * j).bitwiseAND(F.lit(255)) for side in "ab")
        near = near & (F.abs(x - y) <= radius)
    near = near & (F.bit_count(differ) <= radius)
    # Of the choices that such a pair shares it is reported in the first: the choice of its lowest equal blocks.
    last = F.shiftright(F.col("a.table"), 56)
    equal = F.lit(0)
    for i, mask in enumerate(_block_masks(blocks)):
        same = differ.bitwiseAND(F.lit(_signed(mask))) == 0
        equal = equal + F.when((F.lit(i) < last) & same, 1).otherwise(0)
    near = near & (equal == blocks - radius - 1)
    return a.join(b, near).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def groups(docs: DataFrame, shingle: int = 4, radius: int = 4, blocks: int = 7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id) of every row of `docs`.

    Rows are in one component if a chain of fingerprints, each at most `radius` bits from the next, joins them;
    component_id is the smallest key in it. Equal fingerprints, and so all exact copies, become one before
    any pair is looked for, by a grouping that is reduced before the shuffle. Every pair within the radius
    is found. A null key is carried along and never is a component's id (a component of nothing else has id
    null); repeated rows get equal results; texts without words all have fingerprint 0 and are one component;
    an empty table gives no rows.
    """
    prints = staged(fingerprints(docs, shingle, key, text), "fingerprints")
    classes = staged(prints.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    joined = connected(links(classes.select("fp"), radius, blocks), "a", "b")
    rooted = classes.join(joined, classes["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return prints.join(of, "fp").select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingles: tuple[int, ...] = (4,), radius: int = 4, blocks: int = 7, key: str = "doc_id", text: str = "text", percent: int | None = None) -> DataFrame:
    """The rows of `docs` whose key is the smallest of their group, once each.

    A group is what the components by the fingerprints of any of the given shingle lengths join: a copy that one
    length places just outside the radius is often inside by another. With `percent`, all texts that share so much of
    their five-word shingles are joined too, by exact similarity. Only rows that have a smaller copy take
    part in that last search, so it is short. Rows that repeat a kept key stay once for each text. Rows without a key
    cannot be told apart and are all kept.
    """
    ways = [groups(docs, n, radius, blocks, key, text) for n in shingles]
    if percent is not None:
        ways.append(similar.groups(docs, 5, percent, key, text))
    named = []
    for way in ways:
        found = way.groupBy(key)
        # A key that repeats with other texts stays if one of them is the first of its component.
        own = F.max(F.col(key) == F.col("component_id"))
        named.append(found.agg(F.when(own, F.col(key)).otherwise(F.min("component_id")).alias("first")).filter(F.col(key).isNotNull()))
    firsts = reduce(DataFrame.unionByName, named).groupBy(key).agg(F.min("first").alias("least"), F.collect_set("first").alias("firsts"))
    firsts = staged(firsts, "firsts")
    # Edges between components, not documents: all copies of a text are one edge at most.
    edges = firsts.select("least", F.explode("firsts").alias("other")).filter("least <> other").distinct()
    joined = connected(edges, "least", "other")
    last = firsts.join(joined, firsts["least"] == joined["node"], "left")
    gone = last.filter(F.coalesce("component", "least") != F.col(key)).select(F.col(key).alias("_gone"))
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("whole"), docs[key].alias("_key"), F.xxhash64(text_of(docs, text)).alias("_row"))
    kept = whole.filter("_key is not null").join(gone, F.col("_key") == F.col("_gone"), "left_anti").dropDuplicates(["_key", "_row"]).select("whole.*")
    return kept.unionByName(docs.filter(docs[key].isNull()))
