"""Digests, verification of stored objects against their records, and sampling for scrubs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objcat.errors import Refused
from objcat.operators.chunks import FOOTER, chunk_count, stored_end
from objcat.operators.keyfilter import may_be_in
from objcat.schema import as_col, count_where, measured_total, total_or_null, unmeasured_count
from objcat.session import staged

# Verdicts by rising severity.
SEVERITY = {"ok": 0, "unverifiable": 1, "unreadable": 2, "missing": 3, "corrupt": 4}
HEALTHY, DEGRADED, DAMAGED, UNVERIFIED = "healthy", "degraded", "damaged", "unverified"

# Draws allowed for each requested sample, and on top of them.
DRAWS_PER_SAMPLE = 8
DRAWS_EXTRA = 16


def digest(content: Column | str, algo: str = "sha256") -> Column:
    """Digest of a binary or text column. BLAKE3 is only ever recorded, never computed here."""
    content = as_col(content).cast("binary")
    if algo == "sha256":
        return F.sha2(content, 256)
    if algo == "sha1":
        return F.sha1(content)
    if algo == "md5":
        return F.md5(content)
    raise Refused(f"digest {algo!r} cannot be computed here")


def hashsum(df: DataFrame, content: str = "content", algo: str = "sha256", recorded: str | None = None) -> DataFrame:
    """(path, hash) per object. A recorded digest is used as it is, and its row's content is never read.

    A digest that is neither recorded nor computable here (BLAKE3) is NULL: the object keeps its row.
    """
    if recorded is None:
        return df.select("path", digest(content, algo).alias("hash"))
    if algo == "blake3":
        return df.select("path", F.col(recorded).alias("hash"))
    have = df.filter(F.col(recorded).isNotNull()).select("path", F.col(recorded).alias("hash"))
    need = df.filter(F.col(recorded).isNull()).select("path", digest(content, algo).alias("hash"))
    return have.unionByName(need)


def verify(catalog: DataFrame, store: DataFrame, algo: str = "sha256") -> DataFrame:
    """ok / corrupt / missing / unreadable / unverifiable per catalog row, with the reason.

    Bodies are reduced to a digest and a length before the join, so they never cross a shuffle. A stored
    row without content could not be read; a catalog row without a digest, or whose column `algo` names another
    digest than the one computed, cannot be judged.
    """
    held = store.select(
        F.col("object_key").alias("_key"),
        digest("content", algo).alias("_digest"),
        F.octet_length("content").cast("long").alias("_length"),
    )
    joined = catalog.join(held, catalog["object_key"] == held["_key"], "left")
    recorded = F.when(F.length("hash") > 0, F.lower("hash"))
    foreign = F.lower("algo") != algo if "algo" in catalog.columns else F.lit(False)
    measured = F.when(recorded.isNotNull() | (F.col("size") > 0), F.col("size"))
    def verdict(status: str, detail: str | None = None) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(detail).cast("string").alias("detail"))

    found = (
        F.when(F.col("_key").isNull(), verdict("missing", "no stored object"))
        .when(F.col("_digest").isNull(), verdict("unreadable", "content could not be read"))
        .when(measured != F.col("_length"), verdict("corrupt", "length differs from the record"))
        .when(recorded.isNull(), verdict("unverifiable", "no digest recorded"))
        .when(foreign, verdict("unverifiable", "digest of another kind recorded"))
        .when(recorded != F.col("_digest"), verdict("corrupt", "digest differs from the record"))
        .otherwise(verdict("ok"))
    )
    return joined.withColumn("_f", found).select(
        "path", F.col("_f.status").alias("status"), measured.alias("size"), F.col("_f.detail").alias("detail")
    )


def is_failure(status: Column | str = "status") -> Column:
    return as_col(status) != "ok"


def severity_of(status: Column | str) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair]), as_col(status))


def verify_summary(v: DataFrame) -> DataFrame:
    """Counts, bytes, the worst verdict, and the outcome: an empty run is `unverified`, not a pass."""
    row = v.agg(
        F.count(F.lit(1)).alias("examined"),
        count_where(~is_failure()).alias("verified"),
        count_where(is_failure()).alias("failed"),
        total_or_null("size").alias("bytes"),
        measured_total("size").alias("measured_bytes"),
        unmeasured_count("size").alias("unmeasured"),
        F.coalesce(F.max_by("status", severity_of("status")), F.lit("ok")).alias("worst"),
    )
    return row.withColumn("outcome", outcome_of("examined", "failed"))


def outcome_of(examined: Column | str, failed: Column | str) -> Column:
    """passed, failed, or unverified when nothing was examined."""
    return F.when(as_col(examined) == 0, UNVERIFIED).when(as_col(failed) > 0, "failed").otherwise("passed")


def ensure_verified(v: DataFrame) -> DataFrame:
    """The verdicts themselves, or a refusal when the run looked at nothing."""
    if v.isEmpty():
        raise Refused("nothing was verified")
    return v


def fail_fast(v: DataFrame) -> DataFrame:
    """Rows up to and including the first failure in path order."""
    return error_budget(v, 1)


def error_budget(v: DataFrame, max_errors: int) -> DataFrame:
    """Rows up to and including the `max_errors`-th failure in path order; 0 means no limit.

    The verdicts are written once, so no body is read a second time for the cut. The path of that failure is
    found among the failures alone: no running count over the whole table.
    """
    if max_errors < 0:
        raise Refused("max_errors must not be negative")
    if max_errors == 0:
        return v
    v = staged(v, "verdicts")
    failed = v.filter(is_failure()).select("path").orderBy("path").limit(max_errors)
    cut = failed.agg(F.count(F.lit(1)).alias("found"), F.max("path").alias("path")).first()
    return v if cut["found"] < max_errors else v.filter(F.col("path") <= cut["path"])


def scrub_bucket(path: Column | str, seed: int) -> Column:
    """Stable number from 0 to 99 for a path: the same seed gives the same sample on any engine."""
    keyed = F.md5(F.concat(F.lit(f"{seed}:"), as_col(path)))
    return F.conv(F.substring(keyed, 1, 8), 16, 10).cast("long") % 100


def scrub_sample(inv: DataFrame, percent: int, seed: int) -> DataFrame:
    """The share of paths a scrub reads."""
    if not 1 <= percent <= 100:
        raise Refused(f"percent must be from 1 to 100, got {percent}")
    return inv if percent == 100 else inv.filter(scrub_bucket("path", seed) < percent)


def scrub(catalog: DataFrame, store: DataFrame, percent: int, seed: int, algo: str = "sha256") -> DataFrame:
    """`verify` over the sampled share of the catalog. Only stored objects that the sample names are read and hashed.

    The store is cut where it is read, by a bitmap of the sampled keys of bounded size; what passes becomes a digest there, and
    only key, digest and length are moved. A few objects outside the sample pass the bitmap and fall out of the join.
    """
    sampled = scrub_sample(catalog, percent, seed)
    return verify(sampled, may_be_in(store, "object_key", sampled, "object_key"), algo)


def scrub_report(inv: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Coverage and grade of a scrub: `verdicts` (path, status, optional repaired) over a sample of `inv`."""
    repaired = F.coalesce(F.col("repaired"), F.lit(False)) if "repaired" in verdicts.columns else F.lit(False)
    seen = verdicts.select(F.col("path").alias("_path"), "status", repaired.alias("_repaired"))
    joined = inv.select("path", "size").join(seen, F.col("path") == F.col("_path"), "left")
    scanned, size = F.col("_path").isNotNull(), F.col("size")
    bad = scanned & is_failure()
    blank = count_where(scanned & size.isNull())
    measured = F.coalesce(F.sum(F.when(scanned, size)), F.lit(0).cast("long"))
    row = joined.agg(
        count_where(scanned).alias("scanned"),
        count_where(~scanned).alias("skipped"),
        count_where(scanned & ~is_failure()).alias("healthy"),
        count_where(bad).alias("damaged"),
        count_where(bad & F.col("_repaired")).alias("repaired"),
        F.when(blank == 0, measured).alias("bytes"),
        measured.alias("measured_bytes"),
        blank.alias("unmeasured"),
    )
    grade = (
        F.when(F.col("scanned") == 0, UNVERIFIED)
        .when(F.col("damaged") == 0, HEALTHY)
        .when(F.col("damaged") <= F.col("repaired"), DEGRADED)
        .otherwise(DAMAGED)
    )
    return row.withColumn("health", grade)


def sample_chunks(objects: DataFrame, samples: int, seed: int, chunk_size: int) -> DataFrame:
    """(object_key, chunk): the first and the last chunk of each object, and up to `samples` distinct seeded draws.

    The number of draws is bounded, so an object with few chunks does not search for more than it has.
    """
    count = chunk_count("size", chunk_size)
    draws = F.sequence(F.lit(0), F.lit(samples * DRAWS_PER_SAMPLE + DRAWS_EXTRA - 1))
    last = F.col("_n") - 1

    def draw(n: Column) -> Column:
        keyed = F.md5(F.concat(F.lit(f"{seed}:"), F.col("object_key"), F.lit(":"), n.cast("string")))
        return F.conv(F.substring(keyed, 1, 15), 16, 10).cast("long") % F.col("_n")

    inner = F.filter(F.array_distinct(F.transform(draws, draw)), lambda c: (c != 0) & (c != last))
    ends = F.array_distinct(F.array(F.lit(0).cast("long"), last))
    picked = F.concat(ends, F.slice(inner, 1, samples)) if samples else ends
    return (
        objects.select("object_key", count.alias("_n"))
        .filter(F.col("_n") > 0)
        .select("object_key", F.explode(picked).alias("chunk"))
    )


def confirm_length(objects: DataFrame) -> DataFrame:
    """Whether the stored size is what the geometry implies, with or without a footer.

    Rows: object_key, size (plaintext), chunk_size, payload_start, stored_size.
    """
    end = stored_end(F.col("size"), F.col("chunk_size"), F.col("payload_start"))
    fits = (F.col("size") == 0) | F.col("stored_size").isin(end, end + FOOTER)
    return objects.select("object_key", "stored_size", end.alias("expected"), fits.alias("ok"))


def confirm_restored(plan: DataFrame, landed: DataFrame) -> DataFrame:
    """Restored paths whose length is not the recorded one; unmeasured rows are exempt."""
    there = landed.select(F.col("path").alias("dest"), F.col("size").alias("landed"))
    return (
        plan.filter(F.col("size").isNotNull())
        .join(there, "dest")
        .filter(F.col("landed") != F.col("size"))
        .select("dest", F.col("size").alias("recorded"), "landed")
    )
