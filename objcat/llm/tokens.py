"""Token counts from flat token files, by a scan for the end-of-document identifier."""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from objcat.llm.common import slices, text_of
from objcat.session import scratch_folder, staged

# Fixed value: how the byte-level vocabulary cuts text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50_256  # the identifier that the vocabulary leaves free
TOKEN = np.dtype("<u2")
BLOCK = 1 << 20  # tokens read at a time
LEVEL = 1024  # summaries that one step of the prefix scan takes together


def encoder(vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> Callable[[], Callable[[str], list[int]]]:
    """What makes, in a task, the function from text to token numbers. The vocabulary file is read once, on the driver."""
    with open(vocabulary, "rb") as file:
        lines = file.read()

    def make() -> Callable[[str], list[int]]:
        import tiktoken

        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines.splitlines())}
        return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    return make


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (pafs.LocalFileSystem(), path)


def write_stream(docs: DataFrame, folder: str, make: Callable[[], Callable[[str], list[int]]], end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all texts as one flat stream of 16-bit tokens, each text closed by `end`, a file for each input partition.

    Returns (file, place, key): which text is the place-th of which file. Nothing in the files says where a text
    begins. A task writes under a name of its own and renames when it is done, so a task that runs twice
    leaves one file with the same tokens. Null text is empty and is written as `end` alone.
    """
    short = docs.select(docs[key].alias(key), text_of(docs, text).alias("text"))
    fields = short.select(key).schema
    schema = fields.add("file", "string").add("place", "long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make()
        name = f"tokens-{TaskContext.get().partitionId():08d}.bin"
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        part = f"{base}/.{name}-{uuid.uuid4().hex}"
        place = 0
        with store.open_output_stream(part) as out:
            for batch in slices(batches):
                for whole in batch.column("text").to_pylist():
                    numbers = np.array([*encode(whole), end], np.int64)
                    if numbers.max() > 65_535 or (numbers == end).sum() != 1:
                        raise ValueError("token numbers must fit 16 bits and never be the end-of-document identifier")
                    out.write(numbers.astype(TOKEN).tobytes())
                names = pa.array([name] * batch.num_rows)
                places = pa.array(range(place, place + batch.num_rows), pa.int64())
                place += batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), names, places], [key, "file", "place"])
        store.move(part, f"{base}/{name}")

    return staged(short.mapInArrow(run, schema), "places")


def token_blocks(spark: SparkSession, folder: str, block: int = BLOCK) -> DataFrame:
    """(path, file, block, begin, size): the files of a folder cut into blocks, in tokens. Only their lengths are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "length")
    tokens = (F.col("length") / TOKEN.itemsize).cast("long")
    cut = files.filter("length > 0").select("path", F.element_at(F.split("path", "/"), -1).alias("file"), tokens.alias("tokens"))
    at = F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / block))
    each = cut.select("path", "file", "tokens", F.explode(at).alias("block"))
    return each.select("path", "file", "block", (F.col("block") * block).alias("begin"), F.least(F.lit(block), F.col("tokens") - F.col("block") * block).cast("long").alias("size"))


def find_ends(blocks: DataFrame, end: int = END) -> DataFrame:
    """(file, block, size, ends): where in each block the identifier stands; one vectorised search for each block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            path, file, number, begin, size = (batch.column(i)[0].as_py() for i in range(5))
            store, place = _store(path)
            with store.open_input_file(place) as source:
                tokens = np.frombuffer(source.read_at(size * TOKEN.itemsize, begin * TOKEN.itemsize), TOKEN)
            if len(tokens) != size:
                raise OSError(f"{path} is shorter than it was when it was listed")
            ends = pa.array([np.flatnonzero(tokens == end)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([number], pa.int64()), pa.array([size], pa.int64()), ends], ["file", "block", "size", "ends"])

    dealt = blocks.repartition("file", "block")
    return dealt.mapInArrow(run, "file string, block long, size long, ends array<long>")


def _scanned(found: DataFrame) -> DataFrame:
    """(file, block, open, before): tokens since the last end and ends before each block, over all files in order.

    A prefix scan in levels: blocks inside groups of LEVEL of one file, then groups inside their file, then
    files, each level on one short summary for each group of the level below. A summary is (ends, tokens after the
    last end); two summaries join by adding, where a part without an end adds its tokens to what is open.
    """
    last = F.try_element_at("ends", F.lit(-1))
    rows = found.select("file", "block", F.size("ends").cast("long").alias("n"), F.coalesce(F.col("size") - 1 - last, F.col("size")).alias("tail"))
    rows = rows.withColumn("group", F.floor(F.col("block") / LEVEL))

    def carried(frame: DataFrame, by: list[str], order: str) -> DataFrame:
        """Add what stands before each row in its group: `b_n` ends, `b_tail` open tokens."""
        window = Window.partitionBy(*by).orderBy(order) if by else Window.orderBy(order)
        before = window.rowsBetween(Window.unboundedPreceding, -1)
        # Rows up to and with one that has an end form a run; open tokens are those of the run that is not closed.
        run = F.coalesce(F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).over(window), F.lit(0))
        frame = frame.withColumn("_run", run)
        opened = Window.partitionBy(*by, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        frame = frame.withColumn("_open", F.sum("tail").over(opened))
        window = Window.partitionBy(*by).orderBy(order) if by else Window.orderBy(order)
        return frame.select("*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("b_n"), F.coalesce(F.lag("_open").over(window), F.lit(0)).alias("b_tail")).drop("_run", "_open")

    def whole(frame: DataFrame, by: list[str], order: str) -> DataFrame:
        """One summary for each group."""
        total = F.struct(order, F.struct("n", "tail", "b_tail").alias("v"))
        return frame.groupBy(*by).agg(F.sum("n").alias("n"), F.max(total).alias("end")).select(*by, "n", F.when(F.col("end.v.n") > 0, F.col("end.v.tail")).otherwise(F.col("end.v.tail") + F.col("end.v.b_tail")).alias("tail"))

    blocks = carried(rows, ["file", "group"], "block")
    groups = carried(whole(blocks, ["file", "group"], "block"), ["file"], "group")
    files = carried(whole(groups, ["file"], "group"), [], "file")
    a = blocks.select("file", "group", "block", F.col("b_n").alias("n1"), F.col("b_tail").alias("t1"))
    b = groups.select("file", "group", F.col("b_n").alias("n2"), F.col("b_tail").alias("t2"))
    c = files.select("file", F.col("b_n").alias("n3"), F.col("b_tail").alias("t3"))
    joined = a.join(b, ["file", "group"]).join(c, "file")
    opened = F.col("t1") + F.when(F.col("n1") > 0, 0).otherwise(F.col("t2") + F.when(F.col("n2") > 0, 0).otherwise(F.col("t3")))
    return joined.select("file", "block", opened.alias("open"), (F.col("n1") + F.col("n2")).alias("before"), F.col("n3").alias("files_before"))


def count(spark: SparkSession, folder: str, end: int = END, block: int = BLOCK) -> DataFrame:
    """(document, file, place, n_tokens, closed): every text of the stream, numbered from 0 over all files in order.

    n_tokens does not count the identifier. file and place (from 0) say in which file a text ends and how many end
    before it there. Text that runs over the end of a block or file is one text. Tokens behind the last
    identifier are a text with closed = false, placed in the last file; two identifiers in a row close a text of 0 tokens.
    """
    found = staged(find_ends(token_blocks(spark, folder, block), end), "ends")
    stitched = found.join(_scanned(found), ["file", "block"])
    e = F.col("ends")
    lengths = F.transform(e, lambda x, i: F.struct(i.alias("i"), F.when(i == 0, x + F.col("open")).otherwise(x - F.get(e, i - 1) - 1).alias("n")))
    ends = stitched.select("file", "before", "files_before", F.explode(lengths).alias("d"))
    closed = ends.select(
        (F.col("files_before") + F.col("before") + F.col("d.i")).cast("long").alias("document"), "file",
        (F.col("before") + F.col("d.i")).cast("long").alias("place"), F.col("d.n").cast("long").alias("n_tokens"), F.lit(True).alias("closed"),
    )
    last = F.try_element_at("ends", F.lit(-1))
    tail = F.coalesce(F.col("size") - 1 - last, F.col("size") + F.col("open"))
    final = stitched.select("file", "block", (F.col("before") + F.size("ends")).alias("before"), "files_before", tail.alias("tail"))
    final = final.agg(F.max(F.struct("file", "block", "before", "files_before", "tail")).alias("l")).filter("l.tail > 0")
    left = final.select((F.col("l.files_before") + F.col("l.before")).cast("long").alias("document"), F.col("l.file").alias("file"), F.col("l.before").cast("long").alias("place"), F.col("l.tail").cast("long").alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(left)


def document_counts(docs: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens) of every row: texts written as a flat stream in the shared folder, counted by the scan alone.

    The list of places, made when the stream is written, only gives the counts their keys back.
    """
    spark = docs.sparkSession
    folder = scratch_folder(spark, "tokens")
    places = write_stream(docs, folder, encoder(vocabulary), key=key, text=text)
    counts = count(spark, folder).filter("closed").select(F.col("file").alias("_file"), F.col("place").alias("_place"), "n_tokens")
    return places.join(counts, (places["file"] == counts["_file"]) & (places["place"] == counts["_place"])).select(key, "n_tokens")
