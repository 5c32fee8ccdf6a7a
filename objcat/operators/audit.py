"""Hash-chained audit logs: sealing, verification, anchors, and questions about what was recorded."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from objcat.errors import Refused
from objcat.functions import paths, redact, units
from objcat.operators.ordered import with_position
from objcat.schema import as_col

# The canonical form of a record and the start of a chain.
FIELD_SEPARATOR = "\x1f"
GENESIS = "0" * 64
VERSION = 2
LEGACY_VERSION = 1
DIRECTIONS = ("in", "out", "internal")

# Results a record may carry, with the exit code of each and whether it ends a run.
OUTCOMES = {
    "success": (0, False),
    "usage": (1, True),
    "uncategorised": (2, False),
    "dir_not_found": (3, False),
    "file_not_found": (4, False),
    "temporary_error": (5, False),
    "partial_failure": (6, False),
    "fatal_error": (7, True),
    "transfer_limit_exceeded": (8, True),
    "no_files_transferred": (9, False),
    "duration_limit_exceeded": (10, True),
    "checksum_mismatch": (20, False),
    "integrity_failure": (21, False),
    "vault_locked": (22, True),
    "index_error": (23, True),
    "audit_chain_broken": (24, True),
    "cancelled": (25, True),
    "audit_head_mismatch": (26, False),
    "verification_not_possible": (27, False),
    "link_silent": (28, True),
}

# Operations that must appear in a log, and those that need not.
RECORDED_OPS = (
    "init copy move sync copyto moveto replicate cat rcat delete deletefile purge rmdir rmdirs cleanup touch "
    "index vault backup restore mount put get rm"
).split()
EXEMPT_OPS = (
    "config ls lsd lsl lsjson tree size mkdir verify check scrub hashsum audit about home version completion"
).split()

# Places of a chain that one window group looks at.
RUN = 4096

_TEXT = ("time", "op", "result", "direction", "path", "plaintext_hash", "ciphertext_hash", "remote")
_NUMBERS = ("size", "bytes", "objects")


def _field(df_columns: list[str], name: str) -> Column:
    """A record field as text: absent is empty, or 0 for a number."""
    if name in _NUMBERS:
        value = F.col(name).cast("string") if name in df_columns else F.lit("0")
        return F.coalesce(value, F.lit("0"))
    value = F.col(name).cast("string") if name in df_columns else F.lit("")
    return F.coalesce(value, F.lit(""))


def _tail(columns: list[str], version: int) -> Column:
    """The part of the canonical form after the index."""
    names = ["time", "op", "result", "path", "size", "plaintext_hash", "ciphertext_hash", "remote"]
    if version >= VERSION:
        names += ["direction", "bytes", "objects"]
    return F.concat_ws(FIELD_SEPARATOR, *[_field(columns, n) for n in names])


def canonical(columns: list[str]) -> Column:
    """The text a record's hash is taken over: version 2 leads with its version and ends with direction,
    bytes and objects; version 1 (or none) has neither."""
    version = F.coalesce(F.col("v"), F.lit(LEGACY_VERSION)) if "v" in columns else F.lit(LEGACY_VERSION)
    linked = [F.coalesce(F.col("prev"), F.lit("")), F.col("index").cast("string")]
    legacy = F.concat_ws(FIELD_SEPARATOR, *linked, _tail(columns, LEGACY_VERSION))
    current = F.concat_ws(FIELD_SEPARATOR, version.cast("string"), *linked, _tail(columns, VERSION))
    return F.when(version == LEGACY_VERSION, legacy).otherwise(current)


def redact_entry(df: DataFrame) -> DataFrame:
    """Text fields without control characters, and a remote without credentials, before sealing."""
    changed = {n: redact.escape_controls(n) for n in _TEXT if n in df.columns and n != "remote"}
    if "remote" in df.columns:
        changed["remote"] = redact.redact_remote("remote")
    return df.withColumns(changed) if changed else df


def seal(entries: DataFrame, chain: str = "chain", order: str = "order", heads: DataFrame | None = None) -> DataFrame:
    """Number the entries of each chain from 0 and hash each over the hash before it.

    Chains run in parallel. Inside a chain each hash needs the one before, so the rows of a chain pass in
    order through one task, a batch at a time, holding only the last hash; the text that is hashed is
    built beforehand by Spark. With `heads` (chain, records, head) an existing chain is continued.
    """
    kept = [f for f in entries.schema.fields if f.name not in ("v", "index", "prev", "hash")]
    work = entries.select(*[f.name for f in kept]).withColumn("_tail", _tail(entries.columns, VERSION))
    if heads is not None:
        start = heads.select(F.col(chain).alias("_chain"), F.col("records").alias("_from"), F.col("head").alias("_head"))
        work = work.join(start, work[chain].eqNullSafe(start["_chain"]), "left").drop("_chain")
    else:
        work = work.withColumn("_from", F.lit(None).cast("long")).withColumn("_head", F.lit(None).cast("string"))
    added = [
        T.StructField("v", T.IntegerType()),
        T.StructField("index", T.LongType()),
        T.StructField("prev", T.StringType()),
        T.StructField("hash", T.StringType()),
    ]
    names = [f.name for f in kept]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, index, previous = object(), 0, GENESIS
        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in (chain, "_tail", "_from", "_head")}
            indexes, prevs, hashes = [], [], []
            for key, tail, at, head in zip(*columns.values()):
                if key != current:
                    current, index, previous = key, at or 0, head or GENESIS
                text = FIELD_SEPARATOR.join((str(VERSION), previous, str(index), tail))
                made = hashlib.sha256(text.encode()).hexdigest()
                indexes.append(index)
                prevs.append(previous)
                hashes.append(made)
                index, previous = index + 1, made
            arrays = [batch.column(n) for n in names]
            arrays += [pa.array([VERSION] * len(hashes), pa.int32()), pa.array(indexes, pa.int64())]
            arrays += [pa.array(prevs, pa.string()), pa.array(hashes, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "v", "index", "prev", "hash"])

    ordered = work.repartition(F.col(chain)).sortWithinPartitions(chain, order)
    return ordered.mapInArrow(fold, T.StructType(kept + added))


def _is_chain_hash(col: Column) -> Column:
    return F.coalesce(units.is_hex_digest(col, "sha256"), F.lit(False))


def positioned(log: DataFrame, chain: str, pos: str, dense: bool) -> DataFrame:
    """The log with `_pos`, the 0-based place of each record in its chain."""
    if dense:
        return log.withColumn("_pos", F.col(pos).cast("long"))
    placed = with_position(log, [chain], [pos], "_pos")
    return placed.withColumn("_pos", F.col("_pos") - 1)


def verify_chain(log: DataFrame, chain: str = "chain", pos: str = "pos", dense: bool = True) -> DataFrame:
    """One row per chain: intact with its head, or broken with the first break.

    Every record is tested by itself before anything moves, which leaves a few short columns. To meet the
    record before it, a chain is cut into runs of places that overlap by one record: one shuffle, in which a
    chain with most of the records is spread like many short ones. `pos` numbers the records of a chain from 0; with
    `dense=False` it only orders them and is numbered here. A line that is no record (column `corrupt`)
    breaks its chain wherever it stands.
    """
    log = positioned(log, chain, pos, dense)
    version = F.coalesce(F.col("v"), F.lit(LEGACY_VERSION)) if "v" in log.columns else F.lit(LEGACY_VERSION)
    corrupt = F.col("corrupt").isNotNull() if "corrupt" in log.columns else F.lit(False)
    line = F.col("line").cast("long") if "line" in log.columns else F.col("_pos") + 1
    own = log.select(
        F.col(chain).alias("chain"),
        "_pos",
        line.alias("line"),
        F.col("index").alias("claimed_index"),
        F.col("prev"),
        F.col("hash"),
        version.alias("version"),
        corrupt.alias("corrupt"),
        _is_chain_hash(F.col("prev")).alias("prev_ok"),
        _is_chain_hash(F.col("hash")).alias("hash_ok"),
        F.sha2(canonical(log.columns), 256).alias("computed"),
    )
    # A record goes to the run of places it belongs to, and the last of a run also to the next run.
    run = F.call_function("div", F.col("_pos"), F.lit(RUN).cast("long"))
    runs = F.when(F.col("_pos") % RUN == RUN - 1, F.array(run, run + 1)).otherwise(F.array(run))
    inside = Window.partitionBy("chain", "_run").orderBy("_pos")
    linked = (
        own.withColumn("_run", F.explode(runs))
        .withColumn("_linked", F.lag("hash").over(inside))
        .filter(F.col("_run") == run)
    )
    expected_link = F.when(F.col("_pos") == 0, F.lit(GENESIS)).otherwise(F.coalesce("_linked", F.lit("")))

    def broken(kind: str, field: str, expected: Column, found: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            F.lit(field or None).cast("string").alias("field"),
            expected.cast("string").alias("expected"),
            found.cast("string").alias("found"),
        )

    none = F.lit(None)
    found = (
        F.when(F.col("corrupt"), broken("not-a-record", "", none, none))
        .when(~F.col("prev_ok"), broken("malformed-hash", "prev", none, F.col("prev")))
        .when(~F.col("hash_ok"), broken("malformed-hash", "hash", none, F.col("hash")))
        .when(
            ~F.col("version").between(LEGACY_VERSION, VERSION),
            broken("unsupported-version", "", F.lit(VERSION), F.col("version")),
        )
        .when(
            F.col("claimed_index") != F.col("_pos"),
            broken("index-discontinuity", "", F.col("_pos"), F.col("claimed_index")),
        )
        .when(F.lower("prev") != F.lower(expected_link), broken("broken-link", "", expected_link, F.col("prev")))
        .when(F.lower("hash") != F.col("computed"), broken("content-mismatch", "", F.col("computed"), F.col("hash")))
    )
    place = F.struct((~F.col("corrupt")).alias("late"), F.col("_pos").alias("position"), "line", "claimed_index", found.alias("b"))
    per_chain = linked.groupBy("chain").agg(
        F.count(F.lit(1)).alias("records"),
        F.max_by("hash", "_pos").alias("_head"),
        F.min(F.when(found.isNotNull(), place)).alias("_first"),
    )
    intact = F.col("_first").isNull()
    return per_chain.select(
        "chain",
        "records",
        F.when(intact, "intact").otherwise("broken").alias("verdict"),
        F.when(intact, F.col("_head")).alias("head"),
        *[F.col("_first." + c).alias(c) for c in ("position", "line", "claimed_index")],
        *[F.col("_first.b." + c).alias(c) for c in ("kind", "field", "expected", "found")],
    )


def head(verified: DataFrame) -> DataFrame:
    """The anchor `<records>:<hash>` of each chain; none for a broken one."""
    text = F.concat(F.col("records").cast("string"), F.lit(":"), "head")
    return verified.select("chain", "records", "head", text.alias("anchor"))


def parse_anchor(col: Column | str) -> Column:
    """struct(records, head, problem) of an anchor: a head hash, or a record count, a colon and the hash."""
    text = F.trim(as_col(col))
    counted = text.contains(":")
    count = F.substring_index(text, ":", 1)
    digest = F.when(counted, F.substring(text, F.char_length(count) + 2, F.char_length(text))).otherwise(text)
    number = F.when(count.rlike(r"^\+?[0-9]+$"), count).try_cast("long")
    problem = F.when(counted & number.isNull(), "not-a-count").when(~_is_chain_hash(digest), "not-a-hash")
    good = problem.isNull()
    return F.struct(
        F.when(good & counted, number).alias("records"), F.when(good, digest).alias("head"), problem.alias("problem")
    )


def compare_anchor(
    log: DataFrame, anchors: DataFrame, chain: str = "chain", pos: str = "pos", dense: bool = True
) -> DataFrame:
    """match / advanced / truncated / diverged / absent per anchored chain (anchors: chain, records or NULL, head).

    One pass over the log: it meets the one anchor of its chain and is reduced to one row per chain.
    """
    log = positioned(log.select(chain, pos, "hash"), chain, pos, dense)
    want = anchors.select(
        F.col(chain).alias("_chain"), F.col("records").alias("_records"), F.lower("head").alias("_anchor")
    )
    met = log.join(want, log[chain] == want["_chain"])
    digest = F.lower("hash")
    seen = met.groupBy("_chain").agg(
        F.count(F.lit(1)).alias("_now"),
        F.max_by(digest, "_pos").alias("_head"),
        F.max(F.when(F.col("_pos") == F.col("_records") - 1, digest)).alias("_at_count"),
        F.max(F.when(digest == F.col("_anchor"), F.col("_pos") + 1)).alias("_last_seen"),
    )
    joined = want.join(seen.withColumnRenamed("_chain", "_c"), F.col("_chain") == F.col("_c"), "left")
    now = F.coalesce("_now", F.lit(0).cast("long"))
    at_head = F.col("_anchor") == F.coalesce("_head", F.lit(GENESIS))
    at_count = F.when(F.col("_records") == 0, F.lit(GENESIS)).otherwise(F.col("_at_count"))
    at_bare = F.coalesce("_last_seen", F.when(F.col("_anchor") == GENESIS, F.lit(0).cast("long")))
    counted = F.col("_records").isNotNull()
    kind = (
        F.when(at_head, "match")
        .when(counted & at_count.isNull(), "truncated")
        .when(counted & (at_count == F.col("_anchor")), "advanced")
        .when(counted, "diverged")
        .when(at_bare.isNotNull(), "advanced")
        .otherwise("absent")
    )
    place = F.when(counted, F.col("_records")).otherwise(at_bare)
    return joined.select(
        F.col("_chain").alias("chain"),
        kind.alias("comparison"),
        now.alias("records"),
        F.when(~at_head, place).alias("anchored_records"),
        F.when(kind == "advanced", now - place).alias("appended"),
        F.when(kind == "truncated", F.col("_records") - now).alias("missing"),
        F.when(kind == "diverged", at_count).alias("found"),
    )


def audit_verdict(
    log: DataFrame, anchors: DataFrame | None = None, chain: str = "chain", pos: str = "pos", dense: bool = True
) -> DataFrame:
    """intact / broken / head-mismatch per chain, and what that proves: nothing, integrity and order, and
    length only where an anchor agrees."""
    verified = verify_chain(log, chain, pos, dense)
    if anchors is None:
        proves = F.when(F.col("verdict") == "intact", "integrity,order").otherwise("")
        return verified.select("chain", "verdict", proves.alias("proves"), "records", "head", "kind")
    compared = compare_anchor(log, anchors, chain, pos, dense).select("chain", "comparison")
    joined = verified.join(compared, "chain", "left")
    whole = F.col("verdict") == "intact"
    off = F.col("comparison").isNotNull() & (F.col("comparison") != "match")
    verdict = F.when(~whole, "broken").when(off, "head-mismatch").otherwise("intact")
    proves = (
        F.when(~whole, "")
        .when(F.col("comparison") == "match", "integrity,order,length")
        .otherwise("integrity,order")
    )
    return joined.select(
        "chain",
        verdict.alias("verdict"),
        proves.alias("proves"),
        "records",
        "head",
        F.when(whole & off, F.col("comparison")).otherwise(F.col("kind")).alias("kind"),
    )


def _instant(value: int | str | None, name: str, now: int | None) -> int | None:
    if value is None or isinstance(value, int):
        return value
    read = units.parse_time(F.lit(value), int(time.time()) if now is None else now)
    found = SparkSession.builder.getOrCreate().range(1).select(read.alias("at")).first()["at"]
    if found is None:
        raise Refused(f"{name}: {value!r} is not a time")
    return found


def admits(
    op: str | None = None,
    path: str | None = None,
    direction: str | None = None,
    since: int | str | None = None,
    until: int | str | None = None,
    now: int | None = None,
) -> Column:
    """Row test of an audit listing; a time that cannot be read is kept. Also valid on a stream.

    `since` and `until` are Unix seconds, or text as `parse_time` reads it (`2d`, a date, an offset), counted
    back from `now`.
    """
    since, until = _instant(since, "since", now), _instant(until, "until", now)
    if direction is not None and direction not in DIRECTIONS:
        raise Refused(f"direction {direction!r} is not one of {DIRECTIONS}")
    kept = F.lit(True)
    if op is not None:
        kept = kept & (F.col("op") == op)
    if path is not None:
        if ".." in path.replace("\\", "/").split("/"):
            raise Refused(f"path {path!r} leaves the root")
        kept = kept & paths.is_under("/".join(paths.components_of(path.replace("\\", "/"))), F.coalesce("path", F.lit("")))
    if direction is not None:
        kept = kept & (F.col("direction") == direction)
    if since is not None or until is not None:
        at = units.parse_time("time", 0)
        if since is None:
            inside = at < until
        elif until is None:
            inside = at >= since
        else:
            # Distance from the middle of the window: the parsed time appears, and is worked out, once.
            inside = F.abs(at * 2 - (since + until - 1)) <= until - 1 - since
        kept = kept & F.coalesce(inside, F.lit(True))
    return kept


def audit_list(log: DataFrame, limit: int = 0, chain: str = "chain", pos: str = "pos", **window) -> DataFrame:
    """Records that match, in order; with `limit` the last ones of each chain (0: all).

    The rank of a record among those of its chain, from the last, is cut before records move, so each task hands on `limit` records
    of a chain and those that share the place of the last of them. A record without a place counts as the earliest.
    """
    shown = log.filter(admits(**window))
    if limit:
        back = Window.partitionBy(chain).orderBy(F.desc(pos))
        shown = shown.withColumn("_rank", F.rank().over(back)).filter(F.col("_rank") <= limit).drop("_rank")
    return shown.orderBy(chain, pos)


def coverage_table(spark: SparkSession) -> DataFrame:
    rows = [(op, "recorded") for op in RECORDED_OPS] + [(op, "exempt") for op in EXEMPT_OPS]
    return spark.createDataFrame(rows, "op string, rule string")


def audit_coverage(log: DataFrame, coverage: DataFrame | None = None) -> DataFrame:
    """Every operation with its rule and its records: `unruled` has no rule, `unseen` has no record."""
    coverage = coverage_table(log.sparkSession) if coverage is None else coverage
    ops = log.groupBy("op").agg(F.count(F.lit(1)).alias("records"))
    joined = ops.join(coverage, "op", "full_outer")
    state = (
        F.when(F.col("rule").isNull(), "unruled")
        .when(F.col("records").isNull() & (F.col("rule") == "recorded"), "unseen")
        .when(F.col("records").isNotNull() & (F.col("rule") == "exempt"), "exempt-but-seen")
        .otherwise("covered")
    )
    return joined.select(
        "op", "rule", F.coalesce("records", F.lit(0).cast("long")).alias("records"), state.alias("state")
    )


def traffic(log: DataFrame) -> DataFrame:
    """Bytes and objects that went in, out or stayed inside, per operation and remote."""
    return log.groupBy("op", "remote", "direction").agg(
        F.count(F.lit(1)).alias("records"), F.sum("bytes").alias("bytes"), F.sum("objects").alias("objects")
    )


def outcome(result: Column | str) -> Column:
    """struct(code, stops) of a result; NULL code for a word that is not a result."""
    result = as_col(result)
    codes = F.create_map(*[F.lit(x) for slug, (code, _) in OUTCOMES.items() for x in (slug, code)])
    fatal = [slug for slug, (_, stops) in OUTCOMES.items() if stops]
    return F.struct(F.try_element_at(codes, result).alias("code"), result.isin(*fatal).alias("stops"))


def outcome_counts(log: DataFrame) -> DataFrame:
    """Records per result with its exit code, and whether it ends a run."""
    counted = log.groupBy("result").agg(F.count(F.lit(1)).alias("records"))
    graded = counted.withColumn("_o", outcome("result"))
    return graded.select("result", "records", F.col("_o.code").alias("code"), F.col("_o.stops").alias("stops"))
