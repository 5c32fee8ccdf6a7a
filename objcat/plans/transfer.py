"""Plans for copy, sync and move: one row per path with its action and the reason for it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objcat.errors import Refused
from objcat.functions import paths
from objcat.operators.bounded import counted_with_first
from objcat.operators.ordered import first_over_limit
from objcat.plans.compare import DEFAULT_WINDOW, side, within
from objcat.schema import beside, count_where
from objcat.session import discard, staged

COPY, UPDATE, DELETE, SKIP, MKDIR = "copy", "update", "delete", "skip", "mkdir"
TRANSFERS = (COPY, UPDATE)
REPLACES = (UPDATE, DELETE)

# Why a row has its action.
MISSING = "missing-at-destination"
LOST = "destination-object-missing"
EXISTS = "exists"
NEWER = "destination-newer"
IDENTICAL = "identical"
CHECKSUM = "checksum-differs"
SIZE = "size-differs"
SIZE_UNRECORDED = "size-not-recorded"
MODIFIED = "modified"
EXTRA = "not-at-source"
EMPTY_DIR = "empty-source-dir"
UNTRAVERSED = "destination-not-listed"
MOVED = "landed-at-destination"

# Rows quoted in a refusal, and the share of deletions that raises the alarm.
QUOTED = 10
ALARM_SHARE = 0.5


@dataclass(frozen=True)
class Policy:
    """What makes a destination entry good enough to leave alone."""

    checksum: bool = False
    size_only: bool = False
    ignore_existing: bool = False
    update: bool = False
    window: int = DEFAULT_WINDOW
    create_empty_dirs: bool = False
    traverse: bool = True

    def fields(self) -> tuple[str, ...]:
        needed = ["size", "mtime", "object_missing", "kind"]
        return tuple(needed + ["hash"] if self.checksum else needed)


def _verdict(action: str, reason: str) -> Column:
    return F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"))


def decide(policy: Policy) -> Column:
    """struct(action, reason) over a joined row with `s_` and `d_` fields, tests in their fixed order.

    Under `checksum` a missing digest stops the run: no plan is better than one that guessed.
    """
    s_time, d_time = F.col("s_mtime"), F.col("d_mtime")
    chain = F.when(F.col("d_path").isNull(), _verdict(COPY, MISSING)).when(
        F.col("d_object_missing"), _verdict(COPY, LOST)
    )
    if policy.ignore_existing:
        return chain.otherwise(_verdict(SKIP, EXISTS))
    if policy.update:
        chain = chain.when(F.coalesce(F.try_subtract(d_time, s_time) > policy.window, d_time > s_time), _verdict(SKIP, NEWER))
    if policy.checksum:
        s_hash, d_hash = F.col("s_hash"), F.col("d_hash")
        unknown = F.raise_error(F.concat(F.lit("no content hash for "), "s_path"))
        absent = s_hash.isNull() | d_hash.isNull()
        return (
            chain.when(absent, F.struct(unknown.cast("string").alias("action"), F.lit("").alias("reason")))
            .when(s_hash == d_hash, _verdict(SKIP, IDENTICAL))
            .otherwise(_verdict(UPDATE, CHECKSUM))
        )
    s_size, d_size = F.col("s_size"), F.col("d_size")
    chain = chain.when(s_size != d_size, _verdict(UPDATE, SIZE)).when(
        s_size.isNull() | d_size.isNull(), _verdict(UPDATE, SIZE_UNRECORDED)
    )
    if policy.size_only:
        return chain.otherwise(_verdict(SKIP, IDENTICAL))
    close = within(s_time, d_time, policy.window)
    return chain.when(close, _verdict(SKIP, IDENTICAL)).otherwise(_verdict(UPDATE, MODIFIED))


def _empty_dir(policy: Policy) -> Column:
    there = F.col("d_path").isNotNull()
    if policy.create_empty_dirs:
        return F.when(there, _verdict(SKIP, IDENTICAL)).otherwise(_verdict(MKDIR, EMPTY_DIR))
    return F.when(there, _verdict(SKIP, IDENTICAL)).otherwise(_verdict(SKIP, MISSING))


def _plan_rows(joined: DataFrame, verdict: Column, *kept: str) -> DataFrame:
    """Rows of a plan. A row that is only at the destination is a deletion of a file."""
    from_src = F.col("s_path").isNotNull()
    is_dir = F.col("s_kind") == "dir"
    return joined.withColumn("_v", F.when(from_src, verdict).otherwise(_verdict(DELETE, EXTRA))).select(
        F.col("_v.action").alias("action"),
        F.when(from_src, F.col("s_path")).otherwise("").alias("source"),
        F.coalesce("s_path", "d_path").alias("dest"),
        F.when(from_src & is_dir, F.lit(0).cast("long"))
        .when(from_src, F.col("s_size"))
        .otherwise(F.col("d_size"))
        .alias("size"),
        F.col("_v.reason").alias("reason"),
        F.when(~is_dir, F.col("s_mtime")).alias("mtime"),
        *kept,
    )


def _row_verdict(policy: Policy) -> Column:
    return F.when(F.col("s_kind") == "dir", _empty_dir(policy)).otherwise(decide(policy))


def copy_plan(src: DataFrame, dst: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """An action for every source path; destination extras are left alone."""
    if not policy.traverse:
        return untraversed_plan(src)
    left, right = side(src, "s_", policy.fields()), side(dst, "d_", policy.fields())
    return _plan_rows(left.join(right, left["s_path"] == right["d_path"], "left"), _row_verdict(policy))


def sync_plan(src: DataFrame, dst: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """`copy_plan` plus the deletion of destination files the source lacks, from one full outer join.

    Both inventories must have passed the same filter: an excluded destination file is then no extra.
    """
    left, right = side(src, "s_", policy.fields()), side(dst, "d_", policy.fields())
    joined = left.join(right, left["s_path"] == right["d_path"], "full_outer")
    joined = joined.filter(F.col("s_path").isNotNull() | (F.col("d_kind") != "dir"))
    return _plan_rows(joined, _row_verdict(policy))


def untraversed_plan(src: DataFrame) -> DataFrame:
    """Copy everything without looking at the destination."""
    left = side(src, "s_", ("size", "mtime", "kind")).filter(F.col("s_kind") != "dir")
    return left.select(
        F.lit(COPY).alias("action"),
        F.col("s_path").alias("source"),
        F.col("s_path").alias("dest"),
        F.col("s_size").alias("size"),
        F.lit(UNTRAVERSED).alias("reason"),
        F.col("s_mtime").alias("mtime"),
    )


def copyto_plan(src: DataFrame, dst: DataFrame, source: str, name: str, policy: Policy = Policy()) -> DataFrame:
    """One source entry against one named destination."""
    one = side(src.filter(F.col("path") == source), "s_", policy.fields())
    there = side(dst.filter(F.col("path") == name), "d_", policy.fields())
    if not policy.traverse:
        return untraversed_plan(src.filter(F.col("path") == source)).withColumn("dest", F.lit(name))
    keyed = one.withColumn("_name", F.lit(name))
    joined = keyed.join(there, keyed["_name"] == there["d_path"], "left")
    return _plan_rows(joined, decide(policy)).withColumn("dest", F.lit(name))


def move_plan(src: DataFrame, dst: DataFrame, outcomes: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """`copy_plan` plus the removal of each source whose transfer succeeded (outcomes: path, result).

    The outcomes are joined on the key the two inventories are already spread by, and a landed row yields
    its transfer and its removal side by side: the plan is worked out once.
    """
    left = side(src, "s_", policy.fields())
    landed = outcomes.filter(F.col("result") == "success").select(F.col("path").alias("_landed")).distinct()
    joined = left.join(landed, left["s_path"] == landed["_landed"], "left")
    if policy.traverse:
        right = side(dst, "d_", policy.fields())
        plan = _plan_rows(joined.join(right, left["s_path"] == right["d_path"], "left"), _row_verdict(policy), "_landed")
    else:
        plan = untraversed_plan(src).join(landed, F.col("source") == F.col("_landed"), "left")
    names = [c for c in plan.columns if c != "_landed"]
    row = F.struct(*names)
    removal = F.struct(
        F.lit(DELETE).alias("action"),
        "source",
        F.lit("").alias("dest"),
        "size",
        F.lit(MOVED).alias("reason"),
        F.lit(None).cast("long").alias("mtime"),
    )
    gone = F.col("_landed").isNotNull() & F.col("action").isin(*TRANSFERS)
    return plan.select(F.explode(F.when(gone, F.array(row, removal)).otherwise(F.array(row))).alias("r")).select("r.*")


def order_plan(plan: DataFrame, mode: str = "during") -> DataFrame:
    """The rows that act, with the `phase` in which they run, in running order.

    `before` deletes first, `after` last; both make directories ahead of transfers. `during` follows the
    plan: source rows in path order, then the extras.
    """
    action = F.col("action")
    if mode == "during":
        phase = F.when(action == DELETE, 1).otherwise(0)
    elif mode in ("before", "after"):
        phase = F.when(action == DELETE, 0 if mode == "before" else 3).when(action == MKDIR, 1).otherwise(2)
    else:
        raise Refused(f"deletion mode {mode!r} is not one of before, during, after")
    return plan.filter(action != SKIP).withColumn("phase", phase).orderBy("phase", "dest")


def plan_summary(plan: DataFrame) -> DataFrame:
    """Rows per action, and the bytes to transfer (NULL when one size is unknown)."""
    action = F.col("action")
    moving = action.isin(*TRANSFERS)
    unknown = count_where(moving & F.col("size").isNull())
    total = F.coalesce(F.sum(F.when(moving, F.col("size"))), F.lit(0).cast("long"))
    counts = [count_where(action == name).alias(name) for name in (COPY, UPDATE, DELETE, SKIP, MKDIR)]
    return plan.agg(*counts, F.when(unknown == 0, total).alias("bytes"))


def immutable_violations(plan: DataFrame, quoted: int = QUOTED) -> DataFrame:
    """How many rows replace or remove something, and the first of them spelled out, removals last; the plan runs once."""
    refused = plan.filter(F.col("action").isin(*REPLACES)).select((F.col("action") == DELETE).alias("late"), "dest", "action")
    found = counted_with_first(refused, {}, ["late", "dest", "action"], quoted)
    names = F.transform("rows", lambda r: F.concat_ws(" ", r["action"], r["dest"]))
    return found.select(F.col("_all").alias("refused"), F.array_join(names, ", ").alias("quoted"), (F.col("_all") - F.size("rows")).alias("more"))


def ensure_immutable(plan: DataFrame) -> DataFrame:
    """The plan itself, or a refusal when it would replace or remove an existing object."""
    row = immutable_violations(plan).first()
    if row["refused"]:
        more = f", and {row['more']} more" if row["more"] else ""
        raise Refused(f"the plan changes {row['refused']} objects that are there already: {row['quoted']}{more}")
    return plan


def ensure_apart(source: str, destination: str) -> None:
    """A refusal where one root is the other or lies inside it: such a run would read what it writes."""
    a, b = (paths.components_of(root.rstrip("/")) for root in (source, destination))
    if a[: len(b)] == b or b[: len(a)] == a:
        raise Refused(f"{source!r} and {destination!r} overlap")


def empty_source(plan: DataFrame) -> DataFrame:
    """Whether the plan comes from an empty source and still deletes something."""
    action = F.col("action")
    kept = count_where(action.isin(COPY, UPDATE, SKIP))
    gone = count_where(action == DELETE)
    return plan.agg(kept.alias("from_source"), gone.alias("deletions"), ((kept == 0) & (gone > 0)).alias("refused"))


def guard_empty_source(plan: DataFrame, force: bool = False) -> DataFrame:
    """The plan itself, or a refusal of a sync that would empty the destination from an empty source."""
    if not force:
        row = empty_source(plan).first()
        if row["refused"]:
            raise Refused(f"the source holds no files, so all {row['deletions']} at the destination would go")
    return plan


def mass_deletion(plan: DataFrame, dst: DataFrame, share: float = ALARM_SHARE) -> DataFrame:
    """Deletions against the files at the destination, and whether their share raises the alarm."""
    files = dst.filter(F.col("kind") != "dir") if "kind" in dst.columns else dst
    there = files.agg(F.count(F.lit(1)).alias("destination_files"))
    gone = plan.agg(count_where(F.col("action") == DELETE).alias("deletions"))
    alarm = (F.col("deletions") > 0) & (F.col("deletions") >= F.col("destination_files") * share)
    return beside(gone, there).withColumn("alarm", alarm & (F.col("destination_files") > 0))


def apply_budget(plan: DataFrame, max_bytes: int) -> DataFrame:
    """Transfers that start before the byte budget is used up, in path order; other rows stay.

    The first transfer that would pass the budget stops the run, so nothing after it starts, however small.
    Zero-byte and unmeasured transfers are charged nothing. Only the paths and sizes of the charged transfers are written for the search.
    """
    moving = F.col("action").isin(*TRANSFERS)
    charged = staged(plan.filter(moving & (F.col("size") > 0)).select("dest", "size"), "charged")
    cut = first_over_limit(charged, "dest", "size", max_bytes)
    discard(charged)
    return plan if cut is None else plan.filter(~moving | (F.col("dest") < cut))
