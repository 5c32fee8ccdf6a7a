"""The prefix trie of rebuilt conversations, cut at half depth again and again (van Emde Boas)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objcat.llm.common import text_of
from objcat.operators.ordered import with_position
from objcat.session import staged

HEADS = 6  # a conversation takes fewer turns than this from the first of its hundred
PIECE = 1 << 14  # ids of one piece of a list that is hashed


def _digest(*columns: Column) -> Column:
    """16 bytes that stand for a sequence of byte strings or texts."""
    return F.substring(F.unhex(F.sha2(F.concat(*columns), 256)), 1, 16)


def turns(talks: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, digest, chars): every turn as a short row, numbered from 1 within its conversation.

    Order: turn, null first; equal turns by role, then by the digest of role and text. Null role or text is empty.
    Rows without a conversation take no part. The texts are read once and never moved.
    """
    part = talks.filter(talks[conv].isNotNull())
    said, by = text_of(part, text), text_of(part, role)
    short = part.select(
        part[conv].cast("long").alias("conv"),
        part[turn].alias("turn"),
        by.alias("role"),
        _digest(F.char_length(by).cast("string"), F.lit(":"), by, said).alias("digest"),
        F.char_length(said).cast("long").alias("chars"),
    )
    return with_position(staged(short, "turns"), ["conv"], ["turn", "role", "digest"], "pos").select("conv", "pos", "digest", "chars")


def rebuilt(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv, depth, digest, chars), (conv, length)): the turns of every rebuilt conversation, and how many it has.

    The first h turns are those of conversation conv - conv % 100 (all it has, if fewer), the others its own after its
    first h; h is the CRC-32 of the decimal conv, modulo 6. Only the first 5 turns of a hundredth of the conversations are joined.
    """
    taken = F.crc32(F.col("conv").cast("string")) % HEADS
    first = F.col("conv") - F.col("conv") % 100
    whole = numbered.groupBy("conv").agg(F.count(F.lit(1)).alias("own")).select("conv", "own", taken.cast("int").alias("h"), first.alias("first"))
    few = numbered.filter((F.col("conv") % 100 == 0) & (F.col("pos") < HEADS)).groupBy("conv")
    heads = few.agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "chars"))).alias("head")).withColumnRenamed("conv", "first")
    planned = whole.join(heads, "first", "left").select("conv", "own", "h", F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.expr("slice(head, 1, 0)")).alias("head"))
    planned = staged(planned.withColumn("taken", F.coalesce(F.size("head"), F.lit(0))), "heads")
    borrowed = planned.filter("taken > 0").select("conv", F.explode("head").alias("t")).select("conv", F.col("t.pos").alias("depth"), "t.digest", "t.chars")
    # Conversations that take fewer turns than they leave out move up; the others keep their places.
    moved = planned.filter("taken < h").select(F.col("conv").alias("_conv"), "taken")
    own = numbered.filter(F.col("pos") > taken).join(moved, F.col("conv") == F.col("_conv"), "left")
    place = F.coalesce(F.col("pos") - taken + F.col("taken"), F.col("pos"))
    own = own.select("conv", place.cast("long").alias("depth"), "digest", "chars")
    lengths = planned.select("conv", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).cast("long").alias("length"))
    return staged(borrowed.unionByName(own), "rebuilt"), lengths


def cuts(sequences: DataFrame, levels: int) -> list[DataFrame]:
    """For each level k, (conv, depth, digest): the part that reaches from one cut to the next one below.

    A trie of height 2^(k+1) is cut at half its depth, so a cut of level k lies at an odd multiple of 2^k, and the part above it
    has 2^k turns. Parts of a level are put together from pairs of the level before, all conversations at once.
    """
    found, now = [], sequences.select("conv", (F.col("depth") - 1).alias("nr"), "digest")
    for level in range(levels):
        now = staged(now, f"parts-{level}")
        cut = now.filter("nr % 2 = 0")
        found.append(cut.select("conv", ((F.col("nr") + 1) * (1 << level)).alias("depth"), "digest"))
        pairs = now.groupBy("conv", F.shiftright("nr", 1).alias("nr"))
        halves = pairs.agg(F.min(F.struct("nr", "digest")).alias("a"), F.max(F.struct("nr", "digest")).alias("b"), F.count(F.lit(1)).alias("both"))
        now = halves.filter("both = 2").select("conv", "nr", _digest(F.col("a.digest"), F.col("b.digest")).alias("digest"))
    return found


def _level(depth: str = "depth") -> Column:
    """Of a depth from 1, the number of times 2 divides it."""
    return F.bit_count(F.col(depth).bitwiseAND(-F.col(depth)) - 1)


def named(parts: list[DataFrame], lengths: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """For each level, the names (conv, depth, name) of the prefixes cut there, and the nodes (name, depth, n_convs).

    The first cut halves the whole trie: each distinct prefix down to it is named by the smallest conversation that
    has it, and becomes the root of a trie below. The trie above the cut and all tries below are cut at their own half
    in one step, and so on: a prefix is its root's name and the part between, so one grouping, reduced before the shuffle, names all
    cuts of a level, whatever root they hang from.
    """
    root = lengths.agg(F.min("conv")).first()[0]
    top = lengths.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(root).cast("long").alias("name"))
    names: list[DataFrame] = [None] * len(parts)
    nodes: list[DataFrame] = [None] * len(parts)
    for level in reversed(range(len(parts))):
        above = top
        for other in names[level + 1 :]:
            above = above.unionByName(other)
        # Roots are multiples of twice the height of a part.
        above = above.filter(F.col("depth") % (2 << level) == 0).select("conv", F.col("depth").alias("from"), F.col("name").alias("root"))
        tied = parts[level].withColumn("from", F.col("depth") - (1 << level)).join(above, ["conv", "from"])
        tied = staged(tied.select("conv", "depth", "root", "digest"), f"tied-{level}")
        groups = tied.groupBy("depth", "root", "digest").agg(F.min("conv").alias("name"), F.count(F.lit(1)).alias("n_convs"))
        groups = staged(groups, f"nodes-{level}")
        nodes[level] = groups.select("name", "depth", "n_convs")
        names[level] = staged(tied.join(groups.select("depth", "root", "digest", "name"), ["depth", "root", "digest"]).select("conv", "depth", "name"), f"names-{level}")
    return names, nodes


def _union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def grafted(own: DataFrame, names: DataFrame, levels: int) -> DataFrame:
    """(name, depth, leaves, saved) summed over the subtree of every node of `own`, its own included.

    From the smallest tries up: when all cuts below a level have been added, the total at a cut of level k is that of its whole lower
    trie, and is grafted on the 2^k nodes above it that the upper trie has on the way. So a node's total is moved once, to as many
    nodes as its part is long, in as many steps as there are levels. `names` are (conv, depth, name), with the root.
    """
    added: list[DataFrame] = []
    for level in range(levels):
        cut = own.filter((F.col("depth") > 0) & (_level() == level))
        for earlier in added:
            cut = cut.unionByName(earlier.filter((F.col("depth") > 0) & (_level() == level)))
        totals = cut.groupBy("name", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        # The nodes of the part above a cut are those of any member, and the name is one.
        below = totals.select(F.col("name").alias("conv"), (F.shiftright("depth", level) - 1).alias("part"), "leaves", "saved")
        way = names.withColumn("part", F.shiftright("depth", level))
        up = below.join(way, ["conv", "part"]).groupBy("name", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        added.append(staged(up, f"grafts-{level}"))
    return _union([own, *added]).groupBy("name", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def hashed_lists(members: DataFrame) -> DataFrame:
    """(name, depth, sha): SHA-256 of the conversations of each (name, depth) in ascending order, joined by commas.

    Rows are dealt in ranges of name, depth and conversation, so a node with very many is spread over tasks, each of
    which joins its ids to pieces. A node inside one range is hashed there. Pieces of a node that crosses ranges go on to one task, in
    order: the hash is sequential by its definition, and that task holds one piece at a time.
    """

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        now, ids, cut = None, [], True  # of the first run of a range, the start may lie in the one before

        def close(last: bool):
            text = ",".join(map(str, ids))
            open_ = cut or last
            made.append((*now, ids[0], None if open_ else hashlib.sha256(text.encode()).hexdigest(), text if open_ else None))

        for batch in batches:
            for name, depth, conv in zip(*(batch.column(c).to_pylist() for c in ("name", "depth", "conv"))):
                if now != (name, depth):
                    if now is not None:
                        close(False)
                        cut = False
                    now, ids = (name, depth), []
                elif len(ids) == PIECE:
                    close(True)
                    cut, ids = True, []
                ids.append(conv)
            if made:
                yield _rows(made)
                made = []
        if now is not None:
            close(True)
            yield _rows(made)

    def _rows(made: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], ["name", "depth", "first", "sha", "ids"])

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []
        for batch in batches:
            for name, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("name", "depth", "ids"))):
                if now != (name, depth):
                    if now is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = (name, depth), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if now is not None:
            out.append((*now, state.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))], ["name", "depth", "sha"])

    ranges = members.repartitionByRange("name", "depth", "conv").sortWithinPartitions("name", "depth", "conv")
    found = staged(ranges.mapInArrow(pieces, "name long, depth long, first long, sha string, ids string"), "lists")
    crossing = found.filter("sha is null").repartition("name", "depth").sortWithinPartitions("name", "depth", "first")
    return found.filter("sha is not null").select("name", "depth", "sha").unionByName(crossing.select("name", "depth", "ids").mapInArrow(joined, "name long, depth long, sha string"))


def prefix_trie(talks: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): one row per node.

    A node is a distinct sequence of the first turns of rebuilt conversations, named by the smallest of them and its depth; the root is
    the empty sequence. saved_tokens sums, over the subtree, (n_convs - 1) times the code points of a node's last
    text; ends_sha256 is that of the conversations that end there. Rows without a conversation take no part; a
    null role or text is empty; repeated rows are turns like others; a conversation left without turns is a member of the root;
    an empty table gives no rows. Depth is limited only by the longest conversation, which spreads over tasks.
    """
    sequences, lengths = rebuilt(turns(talks, conv, turn, role, text))
    lengths = staged(lengths, "lengths")
    facts = lengths.agg(F.min("conv").alias("root"), F.max("length").alias("deepest"), F.count(F.lit(1)).alias("convs")).first()
    levels = (facts["deepest"] or 0).bit_length()
    result = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if facts["root"] is None:
        return talks.sparkSession.createDataFrame([], result)

    root = lengths.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(facts["root"]).cast("long").alias("name"))
    names, nodes = named(cuts(sequences, levels), lengths) if levels else ([], [])
    names = _union([root, *names])
    top = lengths.agg(F.min("conv").alias("name"), F.lit(0).cast("long").alias("depth"), F.count(F.lit(1)).alias("n_convs"))
    nodes = _union([top, *nodes])

    # A node's name has it on its own way, one step below its parent and with its last text.
    steps = names.select(F.col("conv").alias("name"), (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    last = sequences.select(F.col("conv").alias("name"), "depth", "chars")
    tied = nodes.join(steps, ["name", "depth"], "left").join(last, ["name", "depth"], "left")
    tied = staged(tied.select("name", "depth", "n_convs", F.when(F.col("depth") > 0, F.col("parent")).alias("parent"), F.coalesce("chars", F.lit(0)).alias("chars")), "trie")
    children = tied.filter("depth > 0").groupBy(F.col("parent").alias("name"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    tied = staged(tied.join(children, ["name", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "trie")

    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    own = tied.select("name", "depth", leaf.alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    sums = grafted(own, names, levels)
    ends = names.join(lengths, (names["conv"] == lengths["conv"]) & (names["depth"] == lengths["length"])).select("name", "depth", names["conv"])
    nothing = hashlib.sha256(b"").hexdigest()
    whole = tied.join(sums, ["name", "depth"]).join(hashed_lists(ends), ["name", "depth"], "left")
    return whole.select(
        F.col("name").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("sha", F.lit(nothing)).alias("ends_sha256"),
    )
