"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from objcat.llm.common import slices, text_of, texts
from objcat.session import staged

# The benchmark is read in blocks of at most so many characters (plus one item). A block is sent to the executors
# whole, one at a time; the documents are read once for each block, so a benchmark of any size is worked off.
BLOCK_CHARS = 8_000_000
_FOLD = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes) -> list[bytes]:
    """Words in lower case; ASCII punctuation separates."""
    return text.decode("utf-8", "replace").lower().encode().translate(_FOLD).split()


class Block:
    """Part of the benchmark: its vocabulary, its items as word numbers, and where each seed occurs."""

    def __init__(self, items: list[tuple[object, str]], length: int):
        self.length = length
        self.ids = [key for key, _ in items]
        self.numbers: dict[bytes, int] = {}
        self.items = [np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(t.encode())], np.int64) for _, t in items]
        seeds = [self._rolled(item) for item in self.items]
        counts = [len(s) for s in seeds]
        owner = np.repeat(np.arange(len(items)), counts)
        place = np.concatenate([np.arange(n) for n in counts]) if counts else np.array([], int)
        value = np.concatenate(seeds) if seeds else np.array([], np.uint64)
        order = np.argsort(value, kind="stable")
        self.value, self.owner, self.place = value[order], owner[order], place[order]
        # Items laid end to end: items without a word share their place with the next, which comes after them.
        self.sizes = np.array([len(item) for item in self.items], int)
        self.first = np.cumsum(self.sizes) - self.sizes

    def _rolled(self, numbers: np.ndarray) -> np.ndarray:
        """Karp-Rabin values of all runs of `length` words."""
        if len(numbers) < self.length:
            return np.array([], np.uint64)
        total = np.zeros(len(numbers) - self.length + 1, np.uint64)
        for j in range(self.length):
            total = total * _BASE + numbers[j : j + len(total)].astype(np.uint64)
        return total

    def matches(self, text: bytes, threshold: float) -> Iterator[tuple[object, int, int, int]]:
        """(item, words of it, words of it that are tiled, tiles) for the items that `text` covers to the threshold."""
        get = self.numbers.get
        doc = np.fromiter((get(w, 0) for w in words(text)), np.int64)
        if len(doc) < self.length or not len(self.value):
            return
        known = np.convolve(doc > 0, np.ones(self.length, int), "valid") == self.length
        at = np.flatnonzero(known)
        if not len(at):
            return
        rolled = self._rolled(doc)[at]
        # Each shared seed once, however often the text repeats it: what follows is bounded by the block.
        seeds = np.unique(rolled)
        low, high = np.searchsorted(self.value, seeds, "left"), np.searchsorted(self.value, seeds, "right")
        sizes = high - low
        if not sizes.any():
            return
        index = np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        # Tiles are made of seeds, so what the seeds cover of an item bounds what tiles can cover.
        touched = np.unique((self.first[self.owner[index]] + self.place[index])[:, None] + np.arange(self.length))
        covered = np.bincount(np.searchsorted(self.first, touched, "right") - 1, minlength=len(self.items))
        for item in np.flatnonzero((covered > 0) & (covered >= threshold * self.sizes)):
            goal = self.items[item]
            starts = at[np.isin(rolled, self._rolled(goal))]
            tiled, tiles = _tiled(_within(doc, starts, self.length), goal, self.length)
            if tiled >= threshold * len(goal):
                yield self.ids[item], len(goal), tiled, tiles


def _within(doc: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The words that runs of `length` from `starts` cover, in order, with a 0 wherever words between them are left out."""
    covered = np.zeros(len(doc) + 1, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + length, -1)
    inside = np.cumsum(covered[:-1]) > 0
    gap = ~inside
    gap[1:] &= inside[:-1]  # of each gap, its first word
    return np.where(inside, doc, 0)[inside | gap]


class _Runs:
    """Karp-Rabin values of the unmarked runs of any length in a sequence of word numbers; 0 is never part of a run."""

    def __init__(self, numbers: np.ndarray):
        mixed = numbers.astype(np.uint64) * _BASE
        mixed ^= mixed >> np.uint64(29)
        powers = np.full(len(numbers) + 1, _BASE, np.uint64)
        powers[0] = 1
        self.powers = np.multiply.accumulate(powers)
        # Sums over all words so far, the last with the highest power: a run is the difference of two, brought to one power.
        self.sums = np.zeros(len(numbers) + 1, np.uint64)
        np.cumsum(mixed * self.powers[:-1], out=self.sums[1:])
        self.free = numbers > 0

    def starts(self, length: int) -> np.ndarray:
        """Where unmarked runs of `length` begin."""
        taken = np.concatenate([[0], np.cumsum(~self.free)])
        return np.flatnonzero(taken[length:] == taken[: len(taken) - length])

    def values(self, starts: np.ndarray, length: int) -> np.ndarray:
        """The runs' values, all brought to the highest power of the sequence."""
        return (self.sums[starts + length] - self.sums[starts]) * self.powers[len(self.free) - starts]


def _tiled(doc: np.ndarray, goal: np.ndarray, length: int) -> tuple[int, int]:
    """Words of `goal` covered by greedy string tiling against `doc`, and the number of tiles.

    Again and again the longest common runs of unmarked words are marked, in both, until none of `length` is left.
    The longest length is found by halving: a common run of n words holds one of every shorter length. Each pass is
    linear in both texts, however often words repeat, and there are at most as many passes as tiles have different
    lengths, whose sum is within the item. Words are compared before they are marked, so equal values of other
    words are nothing.
    """
    size = max(len(doc), len(goal))  # both are brought to one power
    ours, theirs = _Runs(np.pad(doc, (0, size - len(doc)))), _Runs(np.pad(goal, (0, size - len(goal))))
    tiled = tiles = 0
    limit = min(len(doc), len(goal))
    while limit >= length:
        low, high, middle = length - 1, limit, length
        places = ours.starts(length)
        while low < high:
            longer = places[places + middle <= size]
            wanted = theirs.starts(middle)
            free = longer[np.isin(longer, ours.starts(middle), assume_unique=True)]
            shared = free[np.isin(ours.values(free, middle), theirs.values(wanted, middle))]
            if len(shared):
                low, places = middle, shared
            else:
                high = middle - 1
            middle = (low + high + 1) // 2
        if low < length:
            break
        marked = _mark(ours, theirs, places, doc, goal, low)
        tiled, tiles, limit = tiled + low * marked, tiles + marked, low - 1
    return tiled, tiles


def _mark(ours: _Runs, theirs: _Runs, places: np.ndarray, doc: np.ndarray, goal: np.ndarray, length: int) -> int:
    """Mark common runs of `length` from left to right, each with the first free place in the item; how many there were."""
    waiting: dict[int, list[int]] = {}
    starts = theirs.starts(length)
    for value, j in zip(theirs.values(starts, length).tolist()[::-1], starts.tolist()[::-1]):
        waiting.setdefault(value, []).append(j)  # the first place last, where it is taken
    begin = marked = 0
    for i, value in zip(places.tolist(), ours.values(places, length).tolist()):
        if i < begin:
            continue
        left = waiting.get(value)
        while left and not theirs.free[left[-1] : left[-1] + length].all():
            left.pop()
        for j in reversed(left or ()):
            if theirs.free[j : j + length].all() and (doc[i : i + length] == goal[j : j + length]).all():
                ours.free[i : i + length] = theirs.free[j : j + length] = False
                begin, marked = i + length, marked + 1
                break
        if left is not None and not left:
            del waiting[value]
            if not waiting:
                break
    return marked


def blocks(benchmark: DataFrame, item: str, text: str, limit: int = BLOCK_CHARS) -> Iterator[list[tuple[object, str]]]:
    """The distinct items with text, a block at a time."""
    rows = benchmark.select(benchmark[item].alias("item"), text_of(benchmark, text).alias("text")).filter("text <> ''").distinct().orderBy("item", "text")
    block, size = [], 0
    for row in rows.toLocalIterator():
        block.append((row["item"], row["text"]))
        size += len(row["text"])
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminated(
    docs: DataFrame, benchmark: DataFrame, length: int = 5, threshold: float = 0.6,
    key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(key, item, n_words, n_tiled, n_tiles): the benchmark items of which a text covers at least `threshold`.

    Tiles are common runs of at least `length` words in any order, so reordered passages count. An item shorter
    than `length` words makes no tile and is never found; null texts are empty. Rows that repeat are judged each
    on its own. Documents stay where they were read: no shuffle, and a passage that many share costs each its own tiling.
    """
    short = docs.select(docs[key].alias(key), text_of(docs, text).alias("text"))
    kind = benchmark.schema[item].dataType
    schema = short.select(key).schema.add(item, kind).add("n_words", "long").add("n_tiled", "long").add("n_tiles", "long")
    types = [to_arrow_type(kind), pa.int64(), pa.int64(), pa.int64()]
    parts = []
    for block, last in _shared(docs, benchmark, length, item, item_text):
        part = short.mapInArrow(_finder(block, length, threshold, types, schema.names), schema)
        parts.append(part if last else staged(part, "contaminated"))
    return reduce(DataFrame.unionByName, parts) if parts else short.sparkSession.createDataFrame([], schema)


def _shared(docs: DataFrame, benchmark: DataFrame, length: int, item: str, text: str) -> Iterator[tuple[Broadcast, bool]]:
    """Each block of the benchmark on the executors, and whether it is the last.

    All but the last leave the executors when the next is asked for, so a caller that writes its result before it
    goes on holds one block there, whatever the size of the benchmark.
    """
    context = docs.sparkSession.sparkContext
    waiting = None
    for block in blocks(benchmark, item, text):
        if waiting is not None:
            held = context.broadcast(Block(waiting, length))
            yield held, False
            held.destroy()
        waiting = block
    if waiting is not None:
        yield context.broadcast(Block(waiting, length)), True


def _finder(block: Broadcast, length: int, threshold: float, types: list[pa.DataType], names: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, found = [], []
            for i, whole in enumerate(texts(batch, "text")):
                for match in block.value.matches(whole, threshold):
                    rows.append(i)
                    found.append(match)
            if found:
                columns = [pa.array(c, t) for c, t in zip(zip(*found), types)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns], names)

    return run


def clean(docs: DataFrame, benchmark: DataFrame, length: int = 5, threshold: float = 0.6, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of `docs` that cover no benchmark item to the threshold; each row is judged where it is read.

    A benchmark of more than one block has what each block leaves written before the next.
    """
    kept = docs
    for block, last in _shared(docs, benchmark, length, item, item_text):
        kept = kept.filter(_untouched(block, threshold)(text_of(kept, text)))
        kept = kept if last else staged(kept, "untouched")
    return kept


def _untouched(block: Broadcast, threshold: float):
    @F.arrow_udf("boolean")
    def untouched(column: pa.Array) -> pa.Array:
        return pa.array([next(block.value.matches(t.encode(), threshold), None) is None for t in column.to_pylist()], pa.bool_())

    return untouched
