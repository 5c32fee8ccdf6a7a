"""Names that will not survive on another file system, and names that fall together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objcat.errors import Refused
from objcat.functions import paths
from objcat.schema import as_col, count_where

BLOCKING, PORTABILITY = "blocking", "portability"
ILLEGAL_NAME, TOO_LONG, CASE = "illegal-name", "path-too-long", "case-collision"
TYPE_CONFLICT, NORMALISATION = "directory-file-conflict", "normalisation-collision"

# What Windows does not allow in a name, and how long a path may be there.
ILLEGAL_CHARS = '<>:"|?*'
RESERVED_STEMS = ["CON", "PRN", "AUX", "NUL"] + [f"{port}{n}" for port in ("COM", "LPT") for n in range(1, 10)]
MAX_PATH = 260

# POSIX file type bits of the kinds that hold no bytes, and of the ordinary ones.
SPECIAL_KINDS = {0o010000: "fifo", 0o140000: "socket", 0o020000: "char-device", 0o060000: "block-device"}
ORDINARY_TYPES = (0o100000, 0o040000, 0o120000)
TYPE_MASK = 0o170000

# What can be done with links.
LINK_POLICIES = ("skip", "follow", "in-tree")


def name_issues(inv: DataFrame) -> DataFrame:
    """Rows (path, component, issue, detail) per broken rule of each component.

    A row is only taken apart when one test over the whole path says that something may be wrong.
    """
    reserved = "(?i:" + "|".join(RESERVED_STEMS) + ")"
    suspect = rf'[\x00-\x1F<>:"|?*]|[. ](?:/|\z)|(?:\A|/){reserved}(?:[./]|\z)'
    parts = inv.filter(F.col("path").rlike(suspect)).select("path", F.explode(paths.components("path")).alias("component"))
    name = F.col("component")
    marks = F.array_distinct(F.regexp_extract_all(name, F.lit(r'([\x00-\x1F<>:"|?*])'), F.lit(1)))
    stem = F.substring_index(name, ".", 1)

    def issue(kind: str, detail: Column) -> Column:
        return F.struct(F.lit(kind).alias("issue"), detail.alias("detail"))

    def of_mark(mark: Column) -> Column:
        code = F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(mark)), 4, "0"))
        return F.when(mark.rlike(r"[\x00-\x1F]"), issue("control", code)).otherwise(issue("illegal-char", mark))

    none = F.array().cast("array<struct<issue:string,detail:string>>")
    found = F.concat(
        F.transform(marks, of_mark),
        F.when(name.endswith(".") | name.endswith(" "), F.array(issue("trailing", F.lit("")))).otherwise(none),
        F.when(stem.rlike(rf"\A{reserved}\z"), F.array(issue("reserved", F.upper(stem)))).otherwise(none),
    )
    return parts.select("path", "component", F.explode(found).alias("_i")).select("path", "component", "_i.*").distinct()


def path_length(inv: DataFrame, root: str = "") -> DataFrame:
    """Paths of more than 260 bytes with the root joined."""
    joined = F.col("path") if root == "" else F.concat(F.lit(root.rstrip("/") + "/"), "path")
    length = F.octet_length(joined).cast("long")
    return inv.select("path", length.alias("length")).filter(F.col("length") > MAX_PATH)


def case_collisions(inv: DataFrame) -> DataFrame:
    """Paths that equal another one but for case, each against the first of its kind in path order."""
    listed = inv.select("path", F.lower("path").alias("_fold"))
    firsts = listed.groupBy("_fold").agg(F.min("path").alias("first"), F.max("path").alias("_other"))
    firsts = firsts.filter(F.col("first") != F.col("_other")).select("_fold", "first")
    return listed.join(firsts, "_fold").filter(F.col("path") != F.col("first")).select("path", "first").distinct()


def type_conflicts(inv: DataFrame) -> DataFrame:
    """Paths that need an ancestor to be a directory which is itself a file of the set.

    The files are tested against the distinct directories that are needed, and only paths below a conflicting
    one are expanded: far fewer rows than every path times its depth.
    """
    folders = inv.select(paths.parent("path").alias("folder")).distinct()
    levels = F.array_remove(F.concat(paths.directories("folder"), F.array("folder")), "")
    above = folders.select("folder", F.explode(levels).alias("ancestor"))
    needed = above.select("ancestor").distinct()
    files = inv.select(F.col("path").alias("ancestor")).join(needed, "ancestor", "left_semi").distinct()
    bad = above.join(files, "ancestor", "left_semi")
    listed = inv.select("path", paths.parent("path").alias("folder"))
    return listed.join(bad, "folder").select("path", "ancestor").distinct()


def nfc_collisions(names: DataFrame) -> DataFrame:
    """Composed names that several native names share (rows native, logical), with how many they are.

    A clash needs a name that is not ASCII (its composed form may be), so only names whose composed form such a
    name has are grouped.
    """
    candidates = names if "logical" in names.columns else names.withColumn("logical", paths.nfc("native"))
    changed = candidates.filter(~paths.is_ascii("native")).select("logical").distinct()
    return (
        candidates.join(changed, "logical", "left_semi")
        .groupBy("logical")
        .agg(F.count(F.lit(1)).alias("natives"))
        .filter(F.col("natives") > 1)
    )


def collision_members(names: DataFrame) -> DataFrame:
    """The native names behind each collision, one row per name."""
    candidates = names if "logical" in names.columns else names.withColumn("logical", paths.nfc("native"))
    return candidates.select("logical", "native").join(nfc_collisions(candidates), "logical")


def severity(
    problem: Column | str, issue: Column | str, audience: str = "any", windows: bool = False, ignores_case: bool | None = None
) -> Column:
    """blocking or portability for an audience (`any` platform, or `here`); control characters always block.

    `ignores_case` says whether names that differ in case are one file on this host (as on `windows`, unless said
    otherwise): there a case collision blocks, whatever else the host allows.
    """
    if audience not in ("any", "here"):
        raise Refused(f"audience {audience!r} is neither 'any' nor 'here'")
    problem, issue = as_col(problem), as_col(issue)
    always = problem.isin(TYPE_CONFLICT, NORMALISATION) | ((problem == ILLEGAL_NAME) & (issue == "control"))
    folds = windows if ignores_case is None else ignores_case
    local = F.when(problem == CASE, F.lit(folds)).otherwise(F.lit(windows))
    return F.when(always | (F.lit(audience == "here") & local), BLOCKING).otherwise(PORTABILITY)


_ISSUE_TEXT = {
    "illegal-char": "not allowed in Windows file names: ",
    "reserved": "names a Windows device: ",
    "trailing": "loses its last dot or space on Windows",
    "control": "holds the control character ",
}


def preflight(
    inv: DataFrame,
    root: str = "",
    audience: str = "any",
    windows: bool = False,
    names: DataFrame | None = None,
    ignores_case: bool | None = None,
) -> DataFrame:
    """Every finding (path, problem, severity, detail), without duplicates, in order."""
    texts = F.create_map(*[F.lit(x) for pair in _ISSUE_TEXT.items() for x in pair])

    def rows(df: DataFrame, problem: str, detail: Column, issue: Column = F.lit("")) -> DataFrame:
        level = severity(F.lit(problem), issue, audience, windows, ignores_case)
        return df.select("path", F.lit(problem).alias("problem"), level.alias("severity"), detail.alias("detail"))

    found = rows(
        name_issues(inv),
        ILLEGAL_NAME,
        F.concat(F.lit("'"), "component", F.lit("' "), F.element_at(texts, F.col("issue")), "detail"),
        F.col("issue"),
    )
    others = [
        rows(
            path_length(inv, root),
            TOO_LONG,
            F.concat(F.lit("the path is "), F.col("length").cast("string"), F.lit(f" bytes, past {MAX_PATH}")),
        ),
        rows(case_collisions(inv), CASE, F.concat(F.lit("differs from '"), "first", F.lit("' only in case"))),
        rows(
            type_conflicts(inv),
            TYPE_CONFLICT,
            F.concat(F.lit("needs '"), "ancestor", F.lit("' to be a directory, but it is a file")),
        ),
    ]
    if names is not None:
        clashes = nfc_collisions(names).withColumnRenamed("logical", "path")
        text = F.concat(F.col("natives").cast("string"), F.lit(" native names compose to this one path"))
        others.append(rows(clashes, NORMALISATION, text))
    for other in others:
        found = found.unionByName(other)
    return found.distinct().orderBy("path", "problem", "detail")


def blocked_paths(findings: DataFrame) -> DataFrame:
    return findings.filter(F.col("severity") == BLOCKING).select("path").distinct().orderBy("path")


def link_verdict(policy: str, target: Column | str) -> Column:
    """What happens to a link whose target is unread, missing, inside or outside the tree."""
    if policy not in LINK_POLICIES:
        raise Refused(f"link policy {policy!r} is not one of {LINK_POLICIES}")
    target = as_col(target)
    if policy == "skip":
        return F.when(target.isNotNull(), F.lit("not-followed"))
    outside = "followed" if policy == "follow" else "out-of-tree"
    return (
        F.when(target == "unread", "not-followed")
        .when(target == "missing", "broken")
        .when(target == "inside", "followed")
        .when(target == "outside", outside)
    )


def special_kind(mode: Column | str) -> Column:
    """Kind of a special file by its POSIX type bits; NULL for files, directories and links."""
    bits = as_col(mode).bitwiseAND(F.lit(TYPE_MASK))
    kind = F.when(bits.isin(*ORDINARY_TYPES), F.lit(None).cast("string"))
    for value, name in SPECIAL_KINDS.items():
        kind = kind.when(bits == value, name)
    return F.when(bits.isNotNull(), kind.otherwise("unknown"))


def unrepresentable(names: DataFrame, column: str = "name") -> DataFrame:
    """How many native names have no logical form."""
    problem = paths.to_logical_component(column)["problem"]
    return names.agg(F.count(F.lit(1)).alias("names"), count_where(problem.isNotNull()).alias("unrepresentable"))
