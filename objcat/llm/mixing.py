"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objcat.llm.common import text_of, uniform
from objcat.session import staged

# A rate above this is drawn as the sum of several independent draws of equal, smaller rates: a sum of
# Poisson numbers is one, and e^-rate stays far from underflow.
PIECE = 32.0


def rates(docs: DataFrame, weights: Mapping[str, float], rest: float, total: float | None = None, source: str = "source", text: str = "text") -> DataFrame:
    """One row per source: its characters and the mean number of times its documents are to be repeated.

    `weights` holds target shares by source; the sources it does not name (null among them) share `rest` in
    proportion to their size. Shares are scaled to sum to 1 over the sources that have text. `total` is the
    number of characters wanted (default: as many as there are). A source without text has rate 0.
    """
    sizes = docs.select(docs[source].cast("string").alias("source"), F.length(text_of(docs, text)).cast("double").alias("size"))
    sizes = sizes.groupBy("source").agg(F.sum("size").alias("size"))
    sizes = staged(sizes, "sizes")
    named = F.lit(None).cast("double")
    for name, weight in weights.items():
        if weight < 0:
            raise ValueError(f"weight of {name!r} is negative")
        named = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(named)
    sizes = sizes.select("source", "size", named.alias("named"))
    whole = sizes.agg(
        F.sum("size").alias("size"),
        F.sum(F.when(F.col("named").isNull(), F.col("size"))).alias("unnamed"),
        F.sum(F.when(F.col("size") > 0, F.col("named"))).alias("named"),
    ).first()
    size, unnamed, weighed = (float(whole[k] or 0) for k in ("size", "unnamed", "named"))
    weighed += rest if unnamed else 0.0
    wanted = size if total is None else float(total)
    if weighed == 0:
        return sizes.select("source", "size", F.lit(0.0).alias("rate"))
    scale = F.lit(wanted / weighed)
    rate = F.when(F.col("size") == 0, F.lit(0.0)).when(F.col("named").isNull(), F.lit(rest / (unnamed or 1.0)) * scale)
    return sizes.select("source", "size", rate.otherwise(F.col("named") * scale / F.col("size")).alias("rate"))


def _steps(rate: Column) -> Column:
    """P(N <= k) for k = 0, 1, …, up to where it is 1 in double precision."""
    last = F.ceil(rate + 10 * F.sqrt(rate) + 20).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("sums"))

    def add(state: Column, k: Column) -> Column:
        p = state["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(state["sums"], F.array(F.element_at(state["sums"], -1) + p)).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), last), start, add, lambda state: state["sums"])


def copies(docs: DataFrame, rates: DataFrame, seed: int, key: str = "doc_id", source: str = "source") -> DataFrame:
    """`docs` with the column `_copies`: a Poisson number with the mean of the document's source.

    The number is the inverse of the Poisson distribution at a hash of seed and key, so it is the same on every
    run and however the rows are split. Rows that repeat a key draw the same number each.
    """
    pieces = F.greatest(F.ceil(F.col("rate") / PIECE), F.lit(1)).cast("int")
    known = rates.select(F.col("source").alias("_source"), pieces.alias("_pieces"), _steps(F.col("rate") / pieces).alias("_steps"))
    # The rates are a written table, so Spark knows their size and broadcasts them only if they are small.
    known = staged(known, "rates")
    joined = docs.join(known, docs[source].cast("string").eqNullSafe(known["_source"]))

    def draw(piece: Column) -> Column:
        at = uniform(seed, "copies", piece, docs[key])
        return F.size(F.filter(F.col("_steps"), lambda step: step <= at))

    drawn = F.aggregate(F.sequence(F.lit(1), F.col("_pieces")), F.lit(0), lambda n, piece: n + draw(piece))
    return joined.select(*[docs[c] for c in docs.columns], drawn.alias("_copies"))


def mix(
    docs: DataFrame, weights: Mapping[str, float], rest: float = 0.0, total: float | None = None, seed: int = 0,
    key: str = "doc_id", source: str = "source", text: str = "text",
) -> DataFrame:
    """Every document as often as its Poisson number says, in one global random order.

    Returns the columns of `docs`, `copy` (1, 2, …) and `place`, the hash that orders all copies: rows are
    dealt to partitions by it and sorted by it inside them. Only the text's one way through that
    shuffle depends on the size of the corpus; sizes of sources are summed before they move, so a source that
    holds most rows costs no more than the others. Columns of `docs` named copy or place are replaced.
    A null source is a source of its own, null text has size 0; an empty table gives no rows.
    """
    own = [c for c in docs.columns if c.lower() not in ("copy", "place", "_copies", "_source", "_pieces", "_steps")]
    docs = docs.select(*[docs[c] for c in own])
    counted = copies(docs, rates(docs, weights, rest, total, source, text), seed, key, source)
    counted = counted.filter(F.col("_copies") > 0)
    each = counted.select(*own, F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("copy"))
    each = each.withColumn("place", F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("place"), F.coalesce(F.col(key).cast("string"), F.lit("\\N")), F.col("copy").cast("string"))))
    return each.repartition("place").sortWithinPartitions("place")
