"""Substring duplicates: hashed units of text, of which the earliest occurrence stays."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from objcat.llm.common import SPACE, slices, text_of
from objcat.session import discard, staged

# Marks that end a sentence, and blocks of scripts that write no spaces (Thai to Tibetan, Myanmar, Khmer, kana, Han).
MARKS = ".!?…。！？｡"
UNSPACED = "฀-࿿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿"
# A unit: up to the next mark or line end, with the marks and white space that follow. Units cover the whole text.
SENTENCES = rf"[^{MARKS}\n]*[{MARKS}\n][{MARKS}{SPACE}]*|[^{MARKS}\n]+"
LINES = r"[^\n]*\n|[^\n]+"
# A word, or one character of a script without spaces.
WORD = rf"[{UNSPACED}]|[^{SPACE}{UNSPACED}]+"
RUN = 30  # words


def units(docs: DataFrame, pattern: str = SENTENCES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, row, at, start, end, words, high, low): the units of each text that hold a word, with their digests.

    `row` is the hash of the whole text, so two rows with one key and different texts stay apart. `at` counts units from 0;
    start and end are offsets in code points of the original text, and each unit ends where the next begins. Normal form: words in
    lower case with single spaces. Digests have 128 bits.
    """
    short = docs.select(docs[key].alias("id"), text_of(docs, text).alias("text"), F.xxhash64(text_of(docs, text)).alias("row"))
    schema = short.select("id", "row", *[F.expr(f"0 AS {c}") for c in ("at", "start", "end", "words")], *[F.expr(f"0L AS {c}") for c in ("high", "low")]).schema
    names = schema.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, word = re.compile(pattern), re.compile(WORD)
        for batch in slices(batches):
            owner, at, start, end, words, high, low = [], [], [], [], [], [], []
            for i, whole in enumerate(batch.column("text").to_pylist()):
                for n, found in enumerate(unit.finditer(whole)):
                    plain = found[0].lower().split()
                    if plain:
                        plain = " ".join(plain)
                        digest = xxhash.xxh3_128_digest(plain.encode())
                        owner.append(i)
                        at.append(n)
                        start.append(found.start())
                        end.append(found.end())
                        words.append(len(word.findall(plain)))
                        high.append(int.from_bytes(digest[:8], "big", signed=True))
                        low.append(int.from_bytes(digest[8:], "big", signed=True))
            rows = pa.array(owner, pa.int64())
            numbers = [pa.array(v, pa.int32()) for v in (at, start, end, words)] + [pa.array(v, pa.int64()) for v in (high, low)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(rows), batch.column("row").take(rows), *numbers], names)

    return short.mapInArrow(run, schema)


def repeated(found: DataFrame) -> DataFrame:
    """(id, row, at, start, end, words) of every unit that occurs earlier: in a smaller key, or before it in the same text.

    The first occurrence of a digest is a minimum and the last a maximum, both reduced before the shuffle, so a
    unit that a third of the corpus shares is one short row for each task. Only digests seen more than once
    take part in the join back, an equi-join whose large keys adaptive execution splits. Null keys come first.
    """
    place = F.struct("id", "row", "at")
    shared = found.groupBy("high", "low").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    shared = staged(shared.filter("not (first <=> last)").select("high", "low", "first"), "shared")
    return found.join(shared, ["high", "low"]).filter(~place.eqNullSafe(F.col("first"))).select("id", "row", "at", "start", "end", "words")


def cut(again: DataFrame, run: int) -> DataFrame:
    """(id, row, cut): per text, the runs of neighbouring repeated units that have `run` words or more, as (start, end, units) in order."""
    again = again.distinct()  # rows that repeat key and text
    number = F.row_number().over(Window.partitionBy("id", "row").orderBy("at"))
    runs = again.withColumn("run", F.col("at") - number).groupBy("id", "row", "run")
    runs = runs.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("units"), F.sum("words").alias("words"))
    kept = runs.filter(F.col("words") >= run).groupBy("id", "row")
    return kept.agg(F.array_sort(F.collect_list(F.struct("start", "end", "units"))).alias("cut"))


def _rest(text: Column, spans: Column) -> Column:
    """The text without the spans: what lies between the end of one and the start of the next."""
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.char_length(text)))
    return F.array_join(F.zip_with(ends, starts, lambda a, b: F.substring(text, a + 1, b - a)), "")


def dedupe(docs: DataFrame, pattern: str = SENTENCES, run: int = RUN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, n_removed, removed): every row's text without the passages that occur earlier in the corpus.

    Texts are cut into units (sentences, or lines with `LINES`), whose digests are compared over the whole corpus, however short they
    are. Of each, the earliest occurrence stays. Others go where they stand in a run of neighbouring repeated units of at least `run`
    words (characters, in scripts without spaces): shorter repeats occur by chance and stay. `run=1` removes every repeat.
    A passage that begins or ends inside a unit keeps what is not whole, and one whose whole units have fewer words stays.

    `removed` are the (start, end) of the runs, in code points of the original text, in order; n_removed counts their units.
    Null text is empty. Rows that repeat key and text are one document and get the same result. An empty table gives no rows.
    """
    found = staged(units(docs, pattern, key, text), "units")
    spans = staged(cut(repeated(found), run), "cut").select(F.col("id").alias("_id"), F.col("row").alias("_row"), "cut")
    discard(found)
    whole = docs.select(docs[key].alias("id"), text_of(docs, text).alias("text"), F.xxhash64(text_of(docs, text)).alias("row"))
    joined = whole.join(spans, whole["id"].eqNullSafe(spans["_id"]) & (whole["row"] == spans["_row"]), "left")
    removed = F.transform("cut", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    counted = F.aggregate("cut", F.lit(0).cast("long"), lambda n, s: n + s["units"])
    return joined.select(
        F.col("id").alias(key),
        F.when(F.col("cut").isNull(), F.col("text")).otherwise(_rest(F.col("text"), F.col("cut"))).alias("text"),
        F.coalesce(counted, F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce(removed, F.array().cast("array<struct<start:int,end:int>>")).alias("removed"),
    )
