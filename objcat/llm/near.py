"""Near-duplicates by fingerprints and by similarity: short rows name the candidates, whole texts decide."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from objcat.llm import simhash, similar
from objcat.llm.common import slices, text_of, texts
from objcat.llm.components import connected
from objcat.session import discard, staged

SHINGLE, PERCENT = 5, 80
BANDS, ROWS = 20, 6  # least hashes: a pair of similarity 0.8 shares a band in 0.998 of all cases
LIKELY = 84  # of BANDS * ROWS equal bytes, so many are asked for before texts are compared (a pair of 0.8 has 96 on average)
CHUNK = 256  # members of a mixed band that are held against each other at a time
MEMBERS = 500  # texts that one task compares with a band's first text, or with the nodes asked of a component
ASKED = 512  # of those, at a time

# Odd multipliers of the least hashes, drawn once from a fixed seed.
_MULTIPLY, _ADD = np.random.default_rng(80).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64, endpoint=False)
_MULTIPLY |= np.uint64(1)


def least_hashes(shingles: np.ndarray) -> np.ndarray:
    """For each of BANDS * ROWS hash functions, the least value over the set (32 bits)."""
    found = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    values = shingles.view(np.uint64)
    for at in range(0, len(values), 1024):
        mixed = (values[at : at + 1024, None] * _MULTIPLY + _ADD) >> np.uint64(32)
        found = np.minimum(found, mixed.min(axis=0).astype(np.uint32))
    return found


def _hashes(text: bytes) -> np.ndarray:
    """Hashes of the word shingles in order, repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    count = max(1, len(words) - SHINGLE + 1)
    return np.fromiter((similar._hash(b" ".join(words[i : i + SHINGLE])) for i in range(count)), np.uint64, count)


def _fingerprint(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), simhash.CHUNK):
        part = hashes[at : at + simhash.CHUNK].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, row, node, n, fp4, fp5, least, bands) of every row: all that candidates need, in one pass over the texts.

    `row` is the hash of the text; `node` that of its set of five-word shingles, `n` their number; fp4 and fp5 are fingerprints of
    four-word and five-word shingles; `least` holds a byte of each least hash, `bands` a hash of each group of them.
    """
    short = docs.select(docs[key].alias("id"), F.xxhash64(text_of(docs, text)).alias("row"), text_of(docs, text).alias("text"))
    schema = short.select("id", "row", *[F.expr(f"0L AS {c}") for c in ("node", "n", "fp4", "fp5")], F.lit(b"").alias("least"), F.expr("array(0L) AS bands")).schema
    names = schema.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            node, n, four, five, least, bands = [], [], [], [], [], []
            for whole in texts(batch, "text"):
                hashes = _hashes(whole)
                found = np.unique(hashes.view(np.int64))
                hashed = least_hashes(found)
                node.append(similar._node(found))
                n.append(len(found))
                four.append(simhash.fingerprint(whole, 4))
                five.append(_fingerprint(hashes))
                least.append(hashed.astype(np.uint8).tobytes())
                bands.append([xxhash.xxh64_intdigest(band.tobytes(), seed=k) for k, band in enumerate(hashed.reshape(BANDS, ROWS))] if len(found) else [])
            numbers = [pa.array(np.array(v, d).view(np.int64)) for v, d in ((node, np.int64), (n, np.int64), (four, np.uint64), (five, np.uint64))]
            flat = np.array([x for b in bands for x in b], np.uint64).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, bands)]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), *numbers, pa.array(least, pa.binary()), lists], names)

    return short.mapInArrow(run, schema)


def fingerprint_links(prints: DataFrame, column: str) -> list[DataFrame]:
    """Edges (a, b) between nodes of one fingerprint, and of fingerprints within the radius."""
    pairs = prints.select(F.col(column).alias("fp"), "node").distinct()
    first = staged(pairs.groupBy("fp").agg(F.min("node").alias("first"), F.max("node").alias("last")), "classes")
    same = pairs.join(first.filter("first < last"), "fp").filter("node > first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = simhash.links(first.select("fp"))
    ends = first.select("fp", "first")
    near = near.join(ends.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(ends.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    return [same, near.select(F.col("x").alias("a"), F.col("y").alias("b")).filter("a <> b")]


def fits(n: Column, m: Column) -> Column:
    """Whether sets of such sizes can be similar enough."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those whose least hashes agree often enough to compare the texts."""
    of = lambda side, name: nodes.select(F.col("node").alias(side), F.col("least").alias(name))
    both = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for c in "xy")
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= LIKELY))

    return both.mapInArrow(run, "a long, b long")


def similar_enough(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) * 100 < max(len(a), len(b)) * PERCENT:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * 100 >= (len(a) + len(b) - both) * PERCENT


def texts_of(asked: DataFrame, docs: DataFrame, nodes: DataFrame, key: str, text: str) -> DataFrame:
    """(node, text) of every node in `asked`, written once."""
    wanted = nodes.join(asked.select("node").distinct(), "node", "left_semi").select("node", "id", "row")
    found = docs.select(docs[key].alias("_id"), F.xxhash64(text_of(docs, text)).alias("_row"), text_of(docs, text).alias("text"))
    found = found.join(wanted, (F.col("_id") == F.col("id")) & (F.col("_row") == F.col("row"))).select("node", "text")
    return staged(found.groupBy("node").agg(F.first("text").alias("text")), "texts")  # equal rows have one text


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, key: str, text: str) -> DataFrame:
    """Of the pairs (a, b), those whose texts share PERCENT of their shingles or more.

    Pairs are grouped by a; each text of a group is moved once, and a's once for every MEMBERS of them, so a text that
    very many resemble is spread over tasks. A task holds one set of shingles beside the text it reads.
    """
    pairs = staged(pairs.distinct(), "pairs")
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("parts"))
    dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    asked = dealt.select("a", "part", F.lit(0).alias("nr"), F.col("a").alias("node")).distinct()
    asked = asked.unionByName(dealt.select("a", "part", F.lit(1).alias("nr"), F.col("b").alias("node")))
    found = texts_of(asked, docs, nodes, key, text)
    sorted_ = asked.join(found, "node").repartition("a", "part").sortWithinPartitions("a", "part", "nr").select("a", "nr", "node", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(0, np.int64)
        for batch in slices(batches, 256):
            kept = []
            for a, nr, node, whole in zip(batch.column("a").to_pylist(), batch.column("nr").to_pylist(), batch.column("node").to_pylist(), texts(batch, "text")):
                other = similar.shingles(whole, SHINGLE)
                if nr == 0:
                    mine = other
                    continue
                if similar_enough(mine, other):
                    kept.append((a, node))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in kept], pa.int64()) for i in (0, 1)], ["a", "b"])

    links = staged(sorted_.mapInArrow(run, "a long, b long"), "links")
    discard(found, pairs)
    return links


def across(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(x, of): nodes outside the largest component of a band, and the other components there that hold a likely partner of theirs.

    `members` are (band, node, n, of). Only those outside a band's largest component are held against the whole band, so
    a large group that is joined already costs one short row for each text. Both sides are cut into chunks by hash, and every two chunks
    meet in one group of at most about 2 * CHUNK rows; the pairs of a group are held against each other as one matrix, and are not rows.
    """
    parts = members.groupBy("band", "of").agg(F.count(F.lit(1)).alias("times"))
    sizes = parts.groupBy("band").agg(F.max(F.struct("times", "of")).alias("main"), F.sum("times").alias("whole"))
    chunks = lambda n: F.ceil(n / CHUNK).cast("int")
    mixed = sizes.filter(F.col("main.times") < F.col("whole"))
    mixed = mixed.select("band", F.col("main.of").alias("main"), chunks(F.col("whole") - F.col("main.times")).alias("few"), chunks(F.col("whole")).alias("all"))
    inside = members.join(mixed, "band")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    over = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["band", "node", "n", "of"]
    outside = inside.filter(F.col("of") != F.col("main")).select(*columns, F.lit(True).alias("outside"), place("few").alias("p"), over("all").alias("q"))
    spread = outside.unionByName(inside.select(*columns, F.lit(False).alias("outside"), over("few").alias("p"), place("all").alias("q")))
    spread = spread.join(nodes.select("node", "least"), "node")

    def run(table: pa.Table) -> pa.Table:
        node, n, of = (table[c].to_numpy() for c in ("node", "n", "of"))
        least = np.frombuffer(b"".join(table["least"].to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
        outside = table["outside"].to_numpy(zero_copy_only=False)
        other = np.flatnonzero(~outside)
        node_, n_, of_, least_ = node[other], n[other], of[other], least[other]
        found = set()
        for at in np.flatnonzero(outside):
            equal = (least_ == least[at]).sum(axis=1)
            small, large = np.minimum(n_, n[at]), np.maximum(n_, n[at])
            fit = (of_ != of[at]) & (equal >= LIKELY) & (small * 100 >= large * PERCENT)
            found |= {(int(node[at]), int(c)) for c in np.unique(of_[fit])}
        return pa.table({c: pa.array([f[i] for f in found], pa.int64()) for i, c in enumerate(("x", "of"))})

    return spread.groupBy("band", "p", "q").applyInArrow(run, "x long, of long").distinct()


def joined_to(asked: DataFrame, members: DataFrame, docs: DataFrame, nodes: DataFrame, key: str, text: str) -> DataFrame:
    """(a, b): for each (x, of) asked, a member of the component that shares PERCENT of its shingles with x, if there is one.

    Members (node, of) and asked nodes of a component are cut into chunks by hash. A task holds the shingles of the asked nodes of
    one chunk, at most about ASKED, and reads the texts of the members one by one; so a text is moved once for each chunk of asked nodes,
    and pairs are not rows.
    """
    few = asked.groupBy("of").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("few"))
    sizes = members.join(few, "of").groupBy("of", "few").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("all"))
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    over = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.withColumnRenamed("x", "node").join(sizes, "of").select("node", "of", F.lit(0).alias("nr"), place("few").alias("p"), over("all").alias("q"))
    right = members.join(sizes, "of").select("node", "of", F.lit(1).alias("nr"), over("few").alias("p"), place("all").alias("q"))
    rows = staged(left.unionByName(right), "asked")
    found = texts_of(rows, docs, nodes, key, text).join(nodes.select("node", "least"), "node")
    dealt = rows.join(found, "node").repartition("of", "p", "q").sortWithinPartitions("of", "p", "q", "nr").select("of", "p", "q", "nr", "node", "least", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mine, sketched, ready = None, [], [], None
        for batch in slices(batches, 256):
            kept = []
            places = zip(*(batch.column(c).to_pylist() for c in ("of", "p", "q")))
            for place, nr, node, least, whole in zip(places, batch.column("nr").to_pylist(), batch.column("node").to_pylist(), batch.column("least").to_pylist(), texts(batch, "text")):
                if place != now:
                    now, mine, sketched, ready = place, [], [], None
                sketch = np.frombuffer(least, np.uint8)
                if nr == 0:
                    mine.append((node, similar.shingles(whole, SHINGLE)))
                    sketched.append(sketch)
                    continue
                if ready is None:
                    ready, open_ = np.array(sketched).reshape(-1, BANDS * ROWS), np.ones(len(mine), bool)
                likely_ = np.flatnonzero(open_ & ((ready == sketch).sum(axis=1) >= LIKELY))
                other = similar.shingles(whole, SHINGLE) if len(likely_) else None
                for at in likely_:
                    if similar_enough(mine[at][1], other):
                        kept.append((mine[at][0], node))
                        open_[at] = False  # one link joins it
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], pa.int64()) for i in (0, 1)], ["a", "b"])

    return staged(dealt.mapInArrow(run, "a long, b long"), "across-links")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, row, component, least) of every row with a key; rows of one component are joined by a chain of near texts.

    Two texts are near if their fingerprints of four-word or five-word shingles differ in at most 4 bits, or if they share 0.8 or more
    of their distinct five-word shingles. Links of the first kind are all found, through the tables of distances to
    reference fingerprints. For those of the second, texts that share a band of least hashes are candidates. In each band all are
    compared with its first text, which joins most of a group of copies at a cost of one comparison each. Where a band still holds
    several components, each node outside the largest one is compared with all members of every other component in which it has
    a likely partner, until one is near.
    Similarity itself is always counted on whole texts. A pair of exactly 0.8 shares no band in 0.002 of all cases, and has too few equal
    least hashes in 0.003; texts that are more alike are missed less often.
    """
    docs = docs.filter(docs[key].isNotNull())
    prints = staged(sketches(docs, key, text), "sketches")
    nodes = prints.groupBy("node").agg(F.min(F.struct("id", "row")).alias("o"), F.first("n").alias("n"), F.first("least").alias("least"), F.first("bands").alias("bands"))
    nodes = staged(nodes.select("node", "o.id", "o.row", "n", "least", "bands"), "nodes")
    rows = nodes.select(F.explode("bands").alias("band"), "node", "n")
    shared = rows.groupBy("band").agg(F.min(F.struct("node", "n")).alias("first"), F.max("node").alias("last")).filter(F.col("first.node") < F.col("last"))
    members = staged(rows.join(shared.select("band", "first"), "band").select("band", "node", "n", "first"), "members")
    star = members.filter((F.col("first.node") < F.col("node")) & fits(F.col("n"), F.col("first.n")))
    stars = staged(likely(star.select(F.col("first.node").alias("a"), F.col("node").alias("b")).distinct(), nodes), "candidates")

    edges = [verified(stars, docs, nodes, key, text)]
    for column in ("fp4", "fp5"):
        edges += fingerprint_links(prints, column)
    whole = edges[0]
    for more in edges[1:]:
        whole = whole.unionByName(more)
    links = staged(whole.distinct(), "near")
    of = connected(links, "a", "b").select("node", F.col("component").alias("of"))
    inside = members.select("band", "node", "n").join(of, "node", "left").select("band", "node", "n", F.coalesce("of", "node").alias("of"))
    inside = staged(inside, "components")
    asked = staged(across(inside, nodes), "across")
    if not asked.isEmpty():
        more = joined_to(asked, inside.select("node", "of").distinct(), docs, nodes, key, text)
        # What is new joins components, not texts: a few rows.
        for side in "ab":
            ends = inside.select(F.col("node").alias(side), "of").distinct()
            more = more.join(ends, side).drop(side).withColumnRenamed("of", side)
        joined = connected(more.distinct(), "a", "b").withColumnRenamed("node", "of")
        known = of.join(joined, "of", "left").select("node", F.coalesce("component", "of").alias("of"))
        fresh = joined.join(of, "of", "left_anti").select(F.col("of").alias("node"), F.col("component").alias("of"))
        of = staged(known.unionByName(fresh), "components")
    named = prints.select("id", "row", "node").join(of, "node", "left")
    named = staged(named.select("id", "row", F.coalesce("of", "node").alias("component")), "named")
    discard(prints, nodes, members, inside)
    return named


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that come first in their group of near texts, by key, then by the hash of the text; each once.

    So rows that repeat a key with unrelated texts all stay, and rows that repeat key and text are one: the least by their
    other columns, as text. Rows without a key cannot be told apart and are all kept. Null text is empty; texts without words are one
    group. An empty table gives no rows. Texts are moved only to be compared with another that is likely near, or to be kept.
    """
    named = groups(docs, key, text)
    first = named.groupBy("component").agg(F.min(F.struct("id", "row")).alias("f"), F.count(F.lit(1)).alias("rows")).select("f.id", "f.row")
    counts = named.groupBy("id", "row").agg(F.count(F.lit(1)).alias("times"))
    first = staged(first.join(counts, ["id", "row"]).select(F.col("id").alias("_id"), F.col("row").alias("_row"), "times"), "first")
    hashed = F.xxhash64(text_of(docs, text))
    found = docs.filter(docs[key].isNotNull()).join(first.filter("times = 1"), (docs[key] == F.col("_id")) & (hashed == F.col("_row")), "left_semi")
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("whole"), docs[key].alias("_key"), hashed.alias("_hash"))
    again = whole.join(first.filter("times > 1"), (F.col("_key") == F.col("_id")) & (F.col("_hash") == F.col("_row")))
    order = Window.partitionBy("_id", "_row").orderBy(F.to_json("whole"))
    again = again.withColumn("_nr", F.row_number().over(order)).filter("_nr = 1").select("whole.*")
    return found.unionByName(again).unionByName(docs.filter(docs[key].isNull()))
