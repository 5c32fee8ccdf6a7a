"""Queries for comparisons, plans, removals and preflight checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from objcat.functions import paths
from objcat.operators import preflight, removal
from objcat.operators.filters import FilterSet
from objcat.plans import compare, recovery, replicate, transfer
from objcat.plans.transfer import Policy
from objcat.queries.fixtures import Registry

R = Registry()
NOW = 1_710_000_000

# -- comparison ------------------------------------------------------------------------------------------

STATUS = {
    "size+mtime": """CASE WHEN s.size IS NULL OR d.size IS NULL THEN 'error' WHEN s.size <> d.size THEN 'differ'
        WHEN abs(s.mtime - d.mtime) <= 1 THEN 'match' ELSE 'differ' END""",
    "size": "CASE WHEN s.size IS NULL OR d.size IS NULL THEN 'error' WHEN s.size = d.size THEN 'match' ELSE 'differ' END",
    "checksum": "CASE WHEN s.hash = d.hash THEN 'match' ELSE 'differ' END",
}


def _check_sql(src: str, dst: str, how: str, one_way: bool = False) -> str:
    return f"""SELECT coalesce(s.path, d.path) AS path, CASE WHEN d.path IS NULL THEN 'missing-on-dst' WHEN s.path IS NULL THEN 'missing-on-src'
      ELSE {STATUS[how]} END AS status FROM {{{src}}} AS s {'LEFT' if one_way else 'FULL OUTER'} JOIN {{{dst}}} AS d ON s.path = d.path"""


BOTH = ["inv_src", "inv_dst"]
R.add("check", "F1", BOTH, lambda s, d: compare.check(s, d), _check_sql(*BOTH, "size+mtime"))
R.add("check_size", "F1", BOTH, lambda s, d: compare.check(s, d, "size"), _check_sql(*BOTH, "size"))
R.add("check_checksum", "F1", BOTH, lambda s, d: compare.check(s, d, "checksum"), _check_sql(*BOTH, "checksum"))
R.add("check_one_way", "F2", BOTH, lambda s, d: compare.check(s, d, one_way=True), _check_sql(*BOTH, "size+mtime", True))
COUNTS = """SELECT count(*) AS checked, count(*) FILTER (status = 'match') AS matched, count(*) FILTER (status = 'differ') AS differ,
  count(*) FILTER (status = 'missing-on-src') AS missing_on_src, count(*) FILTER (status = 'missing-on-dst') AS missing_on_dst,
  count(*) FILTER (status = 'error') AS errors, {proves} AS proves_contents FROM ({inner})"""
BIG = ["inv_big", "inv_big_dst"]
R.add(
    "check_summary",
    "F3",
    BIG,
    lambda s, d: compare.check_summary(compare.check(s, d)),
    COUNTS.replace("{proves}", "false").replace("{inner}", _check_sql(*BIG, "size+mtime")),
)
R.add(
    "check_combined_marks",
    "F4",
    BOTH,
    lambda s, d: compare.combined_marks(compare.check(s, d)),
    f"""SELECT CASE status WHEN 'match' THEN '=' WHEN 'missing-on-src' THEN '-' WHEN 'missing-on-dst' THEN '+' WHEN 'differ' THEN '*' ELSE '!' END AS mark,
      path, CASE status WHEN 'match' THEN '=' WHEN 'missing-on-src' THEN '-' WHEN 'missing-on-dst' THEN '+' WHEN 'differ' THEN '*' ELSE '!' END
        || ' ' || path AS line FROM ({_check_sql(*BOTH, "size+mtime")})""",
)
R.add(
    "confirm_objects",
    "F5",
    ["recorded", "stored"],
    lambda c, s: compare.confirm(c, s).select("path", "object_key", "object_missing"),
    """SELECT path, object_key, object_key NOT IN (SELECT object_key FROM {stored}) AS object_missing FROM {recorded}""",
)
R.add(
    "check_lost_objects",
    "F5",
    ["recorded", "stored", "recorded"],
    lambda c, s, d: compare.check(compare.confirm(c, s), d, "size"),
    """SELECT path, CASE WHEN object_key NOT IN (SELECT object_key FROM {stored}) THEN 'missing-on-src' ELSE 'match' END AS status FROM {recorded}""",
)

# -- transfer plans --------------------------------------------------------------------------------------

DECIDE = """CASE WHEN d.path IS NULL THEN 'copy missing-at-destination' WHEN s.size <> d.size THEN 'update size-differs'
  WHEN s.size IS NULL OR d.size IS NULL THEN 'update size-not-recorded' WHEN abs(s.mtime - d.mtime) <= 1 THEN 'skip identical' ELSE 'update modified' END"""


def _plan_sql(decide: str, src: str = "inv_src", dst: str = "inv_dst", extras: bool = False) -> str:
    rows = f"""SELECT split_part(v, ' ', 1) AS action, source, dest, size, split_part(v, ' ', 2) AS reason, mtime FROM (
      SELECT {decide} AS v, s.path AS source, s.path AS dest, s.size, s.mtime FROM {{{src}}} AS s LEFT JOIN {{{dst}}} AS d ON s.path = d.path)"""
    if not extras:
        return rows
    return f"""{rows} UNION ALL SELECT 'delete', '', path, size, 'not-at-source', NULL FROM {{{dst}}}
      WHERE path NOT IN (SELECT path FROM {{{src}}})"""


R.add("copy_plan", "F7", BOTH, lambda s, d: transfer.copy_plan(s, d), _plan_sql(DECIDE))
R.add("sync_plan", "F8", BOTH, lambda s, d: transfer.sync_plan(s, d), _plan_sql(DECIDE, extras=True))
R.add(
    "copy_plan_checksum",
    "F6",
    BOTH,
    lambda s, d: transfer.copy_plan(s, d, Policy(checksum=True)),
    _plan_sql("CASE WHEN d.path IS NULL THEN 'copy missing-at-destination' WHEN s.hash = d.hash THEN 'skip identical' ELSE 'update checksum-differs' END"),
)
R.add(
    "copy_plan_update",
    "F6",
    BOTH,
    lambda s, d: transfer.copy_plan(s, d, Policy(update=True)),
    _plan_sql(DECIDE.replace("WHEN s.size <>", "WHEN d.mtime - s.mtime > 1 THEN 'skip destination-newer' WHEN s.size <>", 1)),
)
R.add(
    "copy_plan_ignore_existing",
    "F6",
    BOTH,
    lambda s, d: transfer.copy_plan(s, d, Policy(ignore_existing=True)),
    _plan_sql("CASE WHEN d.path IS NULL THEN 'copy missing-at-destination' ELSE 'skip exists' END"),
)
R.add(
    "copy_plan_size_only",
    "F6",
    BOTH,
    lambda s, d: transfer.copy_plan(s, d, Policy(size_only=True)),
    _plan_sql(DECIDE.replace("WHEN abs(s.mtime - d.mtime) <= 1 THEN 'skip identical' ELSE 'update modified'", "ELSE 'skip identical'")),
)
R.add(
    "copy_plan_lost_objects",
    "F6",
    ["recorded", "recorded", "stored"],
    lambda s, d, st: transfer.copy_plan(s, compare.confirm(d, st)),
    """SELECT CASE WHEN lost THEN 'copy' ELSE 'skip' END AS action, path AS source, path AS dest, size,
      CASE WHEN lost THEN 'destination-object-missing' ELSE 'identical' END AS reason, mtime
      FROM (SELECT *, object_key NOT IN (SELECT object_key FROM {stored}) AS lost FROM {recorded})""",
)
R.add(
    "sync_plan_filtered",
    "F8",
    BOTH,
    lambda s, d: transfer.sync_plan(*[FilterSet.build(exclude=["/archive/**", "*5.txt"], now=NOW).admit(x) for x in (s, d)]),
    "WITH a AS (SELECT * FROM {inv_src} WHERE path NOT LIKE '%5.txt'), b AS (SELECT * FROM {inv_dst} WHERE path NOT LIKE '%5.txt' AND path NOT LIKE 'archive/%') "
    + _plan_sql(DECIDE, "inv_src", "inv_dst", True).replace("{inv_src}", "a").replace("{inv_dst}", "b"),
)
R.add(
    "plan_order",
    "F9",
    BOTH,
    lambda s, d: transfer.order_plan(transfer.sync_plan(s, d), "after").select("action", "dest", "phase"),
    f"""SELECT action, dest, CASE WHEN action = 'delete' THEN 3 WHEN action = 'mkdir' THEN 1 ELSE 2 END AS phase
      FROM ({_plan_sql(DECIDE, extras=True)}) WHERE action <> 'skip'""",
)
R.add_run(
    "copyto_plan",
    "F10",
    lambda spark, sf: _copyto(spark, sf),
    """WITH s AS (SELECT * FROM {inv_src} WHERE path = (SELECT max(path) FROM {inv_src})),
      d AS (SELECT * FROM {inv_dst} WHERE path = (SELECT min(path) FROM {inv_dst}))
      SELECT CASE WHEN s.size IS NULL OR d.size IS NULL OR s.size <> d.size OR abs(s.mtime - d.mtime) > 1 THEN 'update' ELSE 'skip' END AS action,
        s.path AS source, d.path AS dest, s.size FROM s, d""",
)


def _copyto(spark, sf):
    from objcat.queries.fixtures import derived

    src, dst = derived(spark, sf, "inv_src"), derived(spark, sf, "inv_dst")
    source, name = src.agg(F.max("path")).first()[0], dst.agg(F.min("path")).first()[0]
    return transfer.copyto_plan(src, dst, source, name).select("action", "source", "dest", "size")


R.add(
    "move_plan",
    "F11",
    BIG + ["outcomes"],
    lambda s, d, o: transfer.move_plan(
        s, d, o.select(F.concat(F.lit("x/"), "path").alias("path"), "result").unionByName(s.select("path", F.when(F.col("size") % 3 > 0, "success").otherwise("file_not_found").alias("result")))
    ).select("action", "source", "dest", "size", "reason"),
    f"""WITH p AS ({_plan_sql(DECIDE, *BIG)}) SELECT action, source, dest, size, reason FROM p
      UNION ALL SELECT 'delete', source, '', size, 'landed-at-destination' FROM p WHERE action IN ('copy', 'update') AND size % 3 > 0""",
)


def _with_dirs(df):
    folders = df.select(paths.parent("path").alias("path")).distinct()
    return df.select("path", "size", "mtime", F.lit("file").alias("kind")).unionByName(
        folders.select("path", F.lit(0).cast("long").alias("size"), F.lit(None).cast("long").alias("mtime"), F.lit("dir").alias("kind"))
    )


R.add(
    "empty_directories_plan",
    "F12",
    BOTH,
    lambda s, d: transfer.copy_plan(
        _with_dirs(s.withColumn("path", F.concat(F.when(F.col("doc_id") % 2 == 0, "new/").otherwise(""), "path"))),
        _with_dirs(d),
        Policy(create_empty_dirs=True),
    )
    .filter("mtime IS NULL")
    .select("action", "dest", "size", "reason"),
    """WITH s AS (SELECT DISTINCT regexp_extract(CASE WHEN doc_id % 2 = 0 THEN 'new/' ELSE '' END || path, '^(.*)/', 1) AS p FROM {inv_src}),
      d AS (SELECT DISTINCT regexp_extract(path, '^(.*)/', 1) AS p FROM {inv_dst})
      SELECT CASE WHEN p IN (SELECT p FROM d) THEN 'skip' ELSE 'mkdir' END AS action, p AS dest, CAST(0 AS BIGINT) AS size,
        CASE WHEN p IN (SELECT p FROM d) THEN 'identical' ELSE 'empty-source-dir' END AS reason FROM s""",
)
R.add(
    "untraversed_plan",
    "F13",
    BOTH,
    lambda s, d: transfer.copy_plan(s, d, Policy(traverse=False)),
    "SELECT 'copy' AS action, path AS source, path AS dest, size, 'destination-not-listed' AS reason, mtime FROM {inv_src}",
)
SUMMARY = """SELECT count(*) FILTER (action = 'copy') AS copy, count(*) FILTER (action = 'update') AS update,
  count(*) FILTER (action = 'delete') AS delete, count(*) FILTER (action = 'skip') AS skip, count(*) FILTER (action = 'mkdir') AS mkdir,
  CASE WHEN count(*) FILTER (action IN ('copy', 'update') AND size IS NULL) = 0
    THEN coalesce(sum(size) FILTER (action IN ('copy', 'update')), 0)::BIGINT END AS bytes FROM"""
R.add("plan_summary", "F14", BOTH, lambda s, d: transfer.plan_summary(transfer.sync_plan(s, d)), f"{SUMMARY} ({_plan_sql(DECIDE, extras=True)})")
R.add("plan_summary_measured", "F14", BIG, lambda s, d: transfer.plan_summary(transfer.sync_plan(s, d)), f"{SUMMARY} ({_plan_sql(DECIDE, *BIG, True)})")
R.add(
    "immutable_guard",
    "F15",
    BOTH,
    lambda s, d: transfer.immutable_violations(transfer.sync_plan(s, d)),
    f"""WITH r AS (SELECT * FROM ({_plan_sql(DECIDE, extras=True)}) WHERE action IN ('update', 'delete')),
      q AS (SELECT action, dest FROM r ORDER BY action = 'delete', dest LIMIT 10)
      SELECT count(*) AS refused, (SELECT string_agg(action || ' ' || dest, ', ' ORDER BY action = 'delete', dest) FROM q) AS quoted, count(*) - 10 AS more FROM r""",
)
R.add(
    "empty_source_guard",
    "F16",
    BOTH,
    lambda s, d: transfer.empty_source(transfer.sync_plan(s.filter("path IS NULL"), d)),
    "SELECT CAST(0 AS BIGINT) AS from_source, count(*) AS deletions, count(*) > 0 AS refused FROM {inv_dst}",
)
R.add(
    "mass_deletion_alarm",
    "F17",
    BOTH,
    lambda s, d: transfer.mass_deletion(transfer.sync_plan(s, d), d),
    f"""WITH p AS ({_plan_sql(DECIDE, extras=True)}), g AS (SELECT count(*) AS n FROM p WHERE action = 'delete'), f AS (SELECT count(*) AS n FROM {{inv_dst}})
      SELECT g.n AS deletions, f.n AS destination_files, g.n > 0 AND g.n * 2 >= f.n AS alarm FROM g, f""",
)
BUDGET = 20_000_000_000
R.add(
    "transfer_budget",
    "F18",
    BIG,
    lambda s, d: transfer.apply_budget(transfer.copy_plan(s, d), BUDGET).select("action", "dest", "size"),
    f"""WITH p AS ({_plan_sql(DECIDE, *BIG)}), r AS (SELECT *, sum(CASE WHEN action IN ('copy', 'update') THEN coalesce(size, 0) ELSE 0 END)
        OVER (ORDER BY dest ROWS UNBOUNDED PRECEDING) AS spent FROM p),
      c AS (SELECT min(dest) AS cut FROM r WHERE spent > {BUDGET} AND action IN ('copy', 'update') AND size > 0)
      SELECT action, dest, size FROM r, c WHERE action NOT IN ('copy', 'update') OR cut IS NULL OR dest < cut""",
)
STORE = """a AS (SELECT object_key, size FROM {catalog}), b AS (SELECT object_key, CASE WHEN size % 7 = 1 THEN size + 1 ELSE size END AS size FROM {catalog_new})"""


def _mirror(c, n):
    return c.select("object_key", "size"), n.select("object_key", F.when(F.col("size") % 7 == 1, F.col("size") + 1).otherwise(F.col("size")).alias("size"))


REPLICA = """CASE WHEN b.object_key IS NULL THEN 'replicate missing-at-destination' WHEN a.size <> b.size THEN 'replicate size-differs' ELSE '{there} exists' END"""
R.add(
    "replicate_plan",
    "F19",
    ["catalog", "catalog_new"],
    lambda c, n: replicate.replicate_plan(*_mirror(c, n), "strict"),
    f"""WITH {STORE} SELECT split_part(v, ' ', 1) AS action, key, size, split_part(v, ' ', 2) AS reason FROM (
      SELECT {REPLICA.replace('{there}', 'reverify')} AS v, a.object_key AS key, a.size FROM a LEFT JOIN b ON a.object_key = b.object_key)""",
)
R.add(
    "replicate_summary",
    "F19",
    ["catalog", "catalog_new"],
    lambda c, n: replicate.replicate_summary(*_mirror(c, n)),
    f"""WITH {STORE}, p AS (SELECT {REPLICA.replace('{there}', 'skip')} AS v, a.size FROM a LEFT JOIN b ON a.object_key = b.object_key)
      SELECT count(*) AS objects, count(*) FILTER (v LIKE 'replicate%') AS replicated, CAST(0 AS BIGINT) AS reverified, count(*) FILTER (v LIKE 'skip%') AS skipped,
        sum(size) FILTER (v LIKE 'replicate%')::BIGINT AS bytes, sum(size) FILTER (v LIKE 'replicate%')::BIGINT AS egress_bytes,
        (SELECT count(*) FROM b WHERE object_key NOT IN (SELECT object_key FROM a)) AS extra FROM p""",
)
NATIVE = """SELECT CASE WHEN size % 9 = 0 THEN replace(path, '/', chr(92)) ELSE path END AS native, size, mtime FROM {names}"""


def _native(n):
    return n.select(F.when(F.col("size") % 9 == 0, F.replace("path", F.lit("/"), F.lit("\\"))).otherwise(F.col("path")).alias("native"), "size", "mtime")


BACKUP_SQL = f"""n AS ({NATIVE}), g AS (SELECT native, nfc_normalize(native) AS path, size FROM n WHERE NOT contains(native, chr(92))),
  k AS (SELECT * FROM g WHERE NOT regexp_matches(path, '(^|/)what[?]/') AND (size IS NULL OR size >= 100)),
  c AS (SELECT path FROM k WHERE strlen(path) <> length(path) GROUP BY path HAVING count(*) > 1)"""


def _backup_filter():
    return FilterSet.build(exclude=[r"what\?/"], min_size="100B", now=NOW)


R.add(
    "backup_plan",
    "F20",
    "names",
    lambda n: recovery.backup_plan(_native(n), "vault/2024", _backup_filter()),
    f"""WITH {BACKUP_SQL} SELECT 'store' AS action, native AS source, 'vault/2024/' || path AS dest, size FROM k
      WHERE path NOT IN (SELECT path FROM c)""",
)
R.add(
    "backup_counts",
    "F20",
    "names",
    lambda n: recovery.backup_counts(_native(n), _backup_filter()),
    f"""WITH {BACKUP_SQL} SELECT (SELECT count(*) FROM n) AS seen, (SELECT count(*) FROM g) - (SELECT count(*) FROM k) AS filtered,
      (SELECT count(*) FROM n) - (SELECT count(*) FROM g) AS problems""",
)


def _restore(n):
    there = n.select(F.when(F.col("size") % 4 == 0, F.col("path")).otherwise(F.concat(F.lit("elsewhere/"), "path")).alias("path"))
    return recovery.restore_plan(n, there, preflight.preflight(n), "/restore", "vault")


RESTORE_SQL = """SELECT CASE WHEN contains(n.path, chr(9)) THEN 'skip' WHEN n.size % 4 = 0 THEN 'overwrite' ELSE 'restore' END AS action,
  'vault:' || n.path AS source, '/restore/' || n.path AS dest, n.size,
  CASE WHEN contains(n.path, chr(9)) THEN 'blocking' WHEN n.size % 4 = 0 THEN 'exists' END AS reason FROM {names} AS n"""
R.add(
    "restore_plan",
    "F21",
    "names",
    _restore,
    RESTORE_SQL,
)
R.add(
    "overwrite_gate",
    "F22",
    "names",
    lambda n: recovery.overwrites(_restore(n)),
    f"SELECT count(*) FILTER (action = 'overwrite') AS overwrites FROM ({RESTORE_SQL})",
)


def _manifest(n, change):
    return n.select(change.alias("path"), "size", F.md5(F.concat("path", F.col("size").cast("string"))).alias("hash"))


R.add(
    "manifest_compare",
    "F23",
    ["names", "names"],
    lambda e, a: compare.compare_manifest(
        _manifest(e, F.col("path")),
        _manifest(
            a,
            F.when(F.col("path").startswith("café/"), F.concat(paths.nfc("path"), F.lit(".b")))
            .when(F.col("path").startswith("dot./"), F.concat(F.lit("é/"), "path"))
            .otherwise(F.col("path")),
        ).withColumn("size", F.when(F.col("path").startswith("plain/"), F.col("size") + 1).otherwise(F.col("size"))),
    ).select("path", "status"),
    """WITH e AS (SELECT path, size, md5(concat(path, CAST(size AS STRING))) AS hash FROM {names}),
      a AS (SELECT CASE WHEN starts_with(path, 'café/') THEN nfc_normalize(path) || '.b' WHEN starts_with(path, 'dot./') THEN 'é/' || path ELSE path END AS path,
        CASE WHEN starts_with(path, 'plain/') THEN size + 1 ELSE size END AS size, hash FROM e),
      x AS (SELECT e.path, CASE WHEN e.size = a.size AND e.hash = a.hash THEN 'identical' ELSE 'differing' END AS status FROM e JOIN a ON e.path = a.path),
      l AS (SELECT * FROM e WHERE path NOT IN (SELECT path FROM a)),
      f AS (SELECT nfc_normalize(path) AS form, min(path) AS path FROM a GROUP BY 1),
      y AS (SELECT l.path, f.path AS other, CASE WHEN f.path IS NULL THEN 'missing' WHEN l.size = a.size AND l.hash = a.hash THEN 'respelled' ELSE 'differing' END AS status
        FROM l LEFT JOIN f ON nfc_normalize(l.path) = f.form LEFT JOIN a ON a.path = f.path)
      SELECT * FROM x UNION ALL SELECT path, status FROM y UNION ALL SELECT path, 'unexpected' FROM a
        WHERE path NOT IN (SELECT path FROM e) AND path NOT IN (SELECT other FROM y WHERE other IS NOT NULL)""",
)
R.add(
    "manifest_respelled",
    "F23",
    ["messy", "messy"],
    lambda e, a: compare.compare_manifest(
        e.select(F.col("raw").alias("path"), F.col("doc_id").alias("size"), F.md5("raw").alias("hash")),
        a.select(paths.nfc("raw").alias("path"), F.col("doc_id").alias("size"), F.md5("raw").alias("hash")),
    ).select("path", "restored_as", "status"),
    """SELECT raw AS path, nfc_normalize(raw) AS restored_as, CASE WHEN raw = nfc_normalize(raw) THEN 'identical' ELSE 'respelled' END AS status FROM {messy}""",
)
R.add(
    "superseded_objects",
    "F24",
    ["catalog", "catalog_new"],
    compare.superseded,
    """SELECT o.path, o.object_key, n.object_key AS replaced_by FROM {catalog} AS o JOIN {catalog_new} AS n ON o.path = n.path
      WHERE o.object_key <> n.object_key""",
)
R.add(
    "superseded_versions",
    "F24",
    "changes",
    lambda c: compare.superseded_versions(c.filter("kind = 'put'").select("path", F.col("hash").alias("object_key"), F.col("seq").alias("version"))),
    """WITH v AS (SELECT path, hash AS object_key, seq FROM {changes} WHERE kind = 'put'), l AS (SELECT path, arg_max(object_key, seq) AS replaced_by FROM v GROUP BY path)
      SELECT DISTINCT v.path, v.object_key, l.replaced_by FROM v JOIN l ON v.path = l.path WHERE v.object_key <> l.replaced_by""",
)

# -- removal ---------------------------------------------------------------------------------------------

MARKERS = "m AS (SELECT regexp_extract(path, '^(.*)/', 1) AS dir FROM {marked} WHERE path LIKE '%/.objcat-dir'), o AS (SELECT path, size FROM {marked} WHERE path NOT LIKE '%/.objcat-dir')"
R.add(
    "delete_selection",
    "G1",
    "marked",
    lambda m: removal.select_delete(m, "src1", FilterSet.build(exclude=["*7.txt"], max_size="9k", now=NOW)),
    f"""WITH {MARKERS} SELECT path, size, 'object' AS kind FROM o WHERE starts_with(path, 'src1/') AND path NOT LIKE '%7.txt'
      AND (size IS NULL OR size <= 9216)""",
)
R.add(
    "delete_with_directories",
    "G2",
    "marked",
    lambda m: removal.select_delete(m, "", FilterSet.build(include=["en/**", "/src1/fr/**"], now=NOW), rmdirs=True),
    f"""WITH {MARKERS}, gone AS (SELECT * FROM o WHERE regexp_matches(path, '(^|/)en/') OR starts_with(path, 'src1/fr/')),
      left_ AS (SELECT path FROM o WHERE path NOT IN (SELECT path FROM gone))
      SELECT path, size, 'object' AS kind FROM gone UNION ALL
      SELECT dir || '/.objcat-dir', 0, 'directory' FROM m WHERE EXISTS (SELECT 1 FROM o WHERE starts_with(o.path, m.dir || '/'))
        AND NOT EXISTS (SELECT 1 FROM left_ WHERE starts_with(left_.path, m.dir || '/'))""",
)


def _deletefile(spark, sf):
    from objcat.queries.fixtures import derived

    inv = derived(spark, sf, "marked")
    return removal.select_deletefile(inv, inv.agg(F.max("path")).first()[0])


R.add_run(
    "delete_one",
    "G3",
    _deletefile,
    """SELECT path, size, CASE WHEN path LIKE '%/.objcat-dir' THEN 'directory' ELSE 'object' END AS kind FROM {marked}
      WHERE path = (SELECT max(path) FROM {marked})""",
)
R.add(
    "purge_selection",
    "G4",
    "marked",
    lambda m: removal.select_purge(m, "src1"),
    """SELECT path, size, CASE WHEN path LIKE '%/.objcat-dir' THEN 'directory' ELSE 'object' END AS kind FROM {marked} WHERE starts_with(path, 'src1/')""",
)
R.add(
    "rmdir_state",
    "G5",
    "marked",
    lambda m: removal.rmdir_state(m, "empty").unionByName(removal.rmdir_state(m, "src1")).unionByName(removal.rmdir_state(m, "nowhere")),
    f"""WITH {MARKERS}, d AS (SELECT unnest(['empty', 'src1', 'nowhere']) AS dir)
      SELECT declared OR occupant IS NOT NULL OR child IS NOT NULL AS exists, declared, occupant, child FROM (
        SELECT dir IN (SELECT dir FROM m) AS declared, (SELECT min(path) FROM o WHERE starts_with(path, d.dir || '/')) AS occupant,
          (SELECT m.dir FROM m WHERE starts_with(m.dir, d.dir || '/') ORDER BY len(string_split(m.dir, '/')) DESC, m.dir LIMIT 1) AS child FROM d)""",
)
R.add(
    "rmdirs_selection",
    "G6",
    "marked",
    lambda m: removal.select_rmdirs(m, "", leave_root=True),
    f"""WITH {MARKERS} SELECT dir || '/.objcat-dir' AS path, CAST(0 AS BIGINT) AS size, 'directory' AS kind FROM m
      WHERE NOT EXISTS (SELECT 1 FROM o WHERE starts_with(o.path, m.dir || '/'))""",
)
DEBRIS_NOW = 1704067200
AGED = f"""CASE WHEN {{t}} IS NULL THEN 'age-unknown' WHEN greatest({DEBRIS_NOW} - {{t}}, 0) < 86400 THEN 'too-young' END"""


def _aged_sql(path: str, size: str, kind: str, time: str, source: str, where: str) -> str:
    reason = AGED.replace("{t}", time)
    return f"""SELECT {path} AS path, {size} AS size, '{kind}' AS kind, CASE WHEN {reason} IS NULL THEN 'reclaim' ELSE 'held' END AS status,
      {reason} AS reason FROM {source} WHERE {where}"""


R.add(
    "debris_staging",
    "G7",
    "store_objects",
    lambda s: removal.debris_staging(s, DEBRIS_NOW),
    _aged_sql("path", "size", "staging", "mtime", "{store_objects}", "regexp_matches(path, '(^|/)[.]objcat-staging[.][^/]*$')"),
)
R.add(
    "debris_multipart",
    "G8",
    "store_objects",
    lambda s: removal.debris_multipart(
        s.select(F.col("path").alias("object_key"), F.md5("path").alias("upload_id"), F.col("mtime").alias("started")), DEBRIS_NOW, scope="src1"
    ),
    _aged_sql("path", "CAST(NULL AS BIGINT)", "multipart", "mtime", "{store_objects}", "starts_with(path, 'src1/')"),
)
R.add(
    "debris_orphans",
    "G9",
    ["catalog", "catalog_new"],
    lambda c, n: removal.debris_orphans(c, n, c.select("path", "object_key"), 400_000),
    """SELECT object_key AS path, size, 'orphan' AS kind, CASE WHEN greatest(400000 - mtime, 0) < 86400 THEN 'held' ELSE 'reclaim' END AS status,
      CASE WHEN greatest(400000 - mtime, 0) < 86400 THEN 'too-young' END AS reason FROM {catalog}
      WHERE object_key NOT IN (SELECT object_key FROM {catalog_new})""",
)
R.add(
    "age_hold",
    "G10",
    "store_objects",
    lambda s: s.withColumn("v", removal.age_verdict("mtime", DEBRIS_NOW)).select("path", "v.status", "v.reason"),
    f"""SELECT path, CASE WHEN {AGED.replace('{t}', 'mtime')} IS NULL THEN 'reclaim' ELSE 'held' END AS status, {AGED.replace('{t}', 'mtime')} AS reason FROM {{store_objects}}""",
)
ITEM = "CASE length(path) % 5 WHEN 0 THEN 'removed' WHEN 1 THEN 'would-remove' WHEN 2 THEN 'absent' WHEN 3 THEN 'failed' ELSE 'held' END"
R.add(
    "removal_totals",
    "G11",
    "inv_src",
    lambda i: removal.removal_totals(i.select("path", "size", F.expr(ITEM).alias("status"))),
    f"""WITH i AS (SELECT size, {ITEM} AS status FROM {{inv_src}})
      SELECT count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status = 'would-remove') AS would_remove,
        count(*) FILTER (status = 'absent') AS absent, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'held') AS held,
        sum(coalesce(size, 0)) FILTER (status = 'held')::BIGINT AS held_bytes,
        CASE WHEN count(*) FILTER (status IN ('removed', 'would-remove') AND size IS NULL) = 0
          THEN sum(size) FILTER (status IN ('removed', 'would-remove'))::BIGINT END AS bytes,
        sum(size) FILTER (status IN ('removed', 'would-remove'))::BIGINT AS measured_bytes,
        count(*) FILTER (status IN ('removed', 'would-remove') AND size IS NULL) AS unmeasured FROM i""",
)

# -- preflight -------------------------------------------------------------------------------------------

ISSUES = r"""SELECT DISTINCT path, component, issue, detail FROM (
  SELECT path, component, CASE WHEN c = chr(9) THEN 'control' ELSE 'illegal-char' END AS issue, CASE WHEN c = chr(9) THEN 'U+0009' ELSE c END AS detail
    FROM p, unnest(regexp_extract_all(component, '[\x00-\x1F<>:"|?*]')) AS u(c)
  UNION ALL SELECT path, component, 'trailing', '' FROM p WHERE regexp_matches(component, '[. ]$')
  UNION ALL SELECT path, component, 'reserved', upper(split_part(component, '.', 1)) FROM p
    WHERE regexp_full_match(split_part(component, '.', 1), '(?i)(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])'))"""
PIECES = "p AS (SELECT path, unnest(string_split(path, '/')) AS component FROM {names})"
R.add("name_issues", "I1", "names", preflight.name_issues, f"WITH {PIECES} {ISSUES}")
LONG = "concat(repeat(concat(source, '/'), CAST(n_chars % 90 AS INT)), CAST(doc_id AS STRING))"
R.add(
    "path_length",
    "I2",
    "documents",
    lambda d: preflight.path_length(d.select(F.expr(LONG).alias("path")), "/restore/here"),
    f"WITH p AS (SELECT {LONG} AS path FROM {{documents}}) SELECT path, strlen(path) + 14 AS length FROM p WHERE strlen(path) + 14 > 260",
)
R.add(
    "case_collisions",
    "I3",
    "names",
    preflight.case_collisions,
    """WITH f AS (SELECT lower(path) AS k, min(path) AS first FROM {names} GROUP BY 1)
      SELECT DISTINCT n.path, f.first FROM {names} AS n JOIN f ON lower(n.path) = f.k WHERE n.path <> f.first""",
)
R.add(
    "type_conflicts",
    "I4",
    "clashing",
    preflight.type_conflicts,
    "SELECT DISTINCT a.path, b.path AS ancestor FROM {clashing} AS a JOIN (SELECT DISTINCT path FROM {clashing}) AS b ON starts_with(a.path, b.path || '/')",
)
R.add(
    "normalisation_collisions",
    "I5",
    "names",
    lambda n: preflight.nfc_collisions(n.select(F.col("path").alias("native"))),
    """SELECT nfc_normalize(path) AS logical, count(*) AS natives FROM {names} WHERE strlen(nfc_normalize(path)) <> length(nfc_normalize(path))
      GROUP BY 1 HAVING count(*) > 1""",
)
R.add(
    "collision_members",
    "I5",
    "names",
    lambda n: preflight.collision_members(n.select(F.col("path").alias("native"))),
    """WITH c AS (SELECT nfc_normalize(path) AS logical, count(*) AS natives FROM {names} WHERE strlen(nfc_normalize(path)) <> length(nfc_normalize(path))
        GROUP BY 1 HAVING count(*) > 1) SELECT c.logical, n.path AS native, c.natives FROM {names} AS n JOIN c ON nfc_normalize(n.path) = c.logical""",
)
R.add(
    "finding_severity",
    "I6",
    "names",
    lambda n: preflight.name_issues(n).select(
        "path",
        "issue",
        preflight.severity(F.lit("illegal-name"), "issue").alias("anywhere"),
        preflight.severity(F.lit("illegal-name"), "issue", "here", windows=True).alias("on_windows"),
    ),
    f"""WITH {PIECES} SELECT path, issue, CASE WHEN issue = 'control' THEN 'blocking' ELSE 'portability' END AS anywhere, 'blocking' AS on_windows FROM ({ISSUES})""",
)
R.add(
    "preflight_findings",
    "I7",
    "names",
    lambda n: preflight.preflight(n, names=n.select(F.col("path").alias("native"))).groupBy("problem", "severity").agg(
        F.count(F.lit(1)).alias("findings"), F.min("path").alias("first"), F.max("path").alias("last")
    ),
    f"""WITH {PIECES}, f AS (SELECT path, 'illegal-name' AS problem, issue = 'control' AS blocks FROM ({ISSUES})
        UNION ALL SELECT nfc_normalize(path), 'normalisation-collision', true FROM {{names}} WHERE strlen(nfc_normalize(path)) <> length(nfc_normalize(path))
          GROUP BY 1 HAVING count(*) > 1
        UNION ALL SELECT DISTINCT n.path, 'case-collision', false FROM {{names}} AS n
          JOIN (SELECT lower(path) AS k, min(path) AS first FROM {{names}} GROUP BY 1) AS c ON lower(n.path) = c.k WHERE n.path <> c.first)
      SELECT problem, CASE WHEN blocks THEN 'blocking' ELSE 'portability' END AS severity, count(*) AS findings, min(path) AS first, max(path) AS last
        FROM f GROUP BY 1, 2""",
)
R.add(
    "blocked_paths",
    "I7",
    "names",
    lambda n: preflight.blocked_paths(preflight.preflight(n)),
    "SELECT DISTINCT path FROM {names} WHERE contains(path, chr(9))",
)
TARGET = "CASE doc_id % 5 WHEN 0 THEN 'unread' WHEN 1 THEN 'missing' WHEN 2 THEN 'outside' ELSE 'inside' END"
R.add(
    "link_verdicts",
    "I8",
    "inv_src",
    lambda i: i.withColumn("t", F.expr(TARGET)).select(
        "path", *[preflight.link_verdict(p, "t").alias(p.replace("-", "_")) for p in preflight.LINK_POLICIES]
    ),
    """SELECT path, 'not-followed' AS skip, CASE doc_id % 5 WHEN 0 THEN 'not-followed' WHEN 1 THEN 'broken' ELSE 'followed' END AS follow,
      CASE doc_id % 5 WHEN 0 THEN 'not-followed' WHEN 1 THEN 'broken' WHEN 2 THEN 'out-of-tree' ELSE 'followed' END AS in_tree FROM {inv_src}""",
)
R.add(
    "special_kinds",
    "I9",
    "lineitem",
    lambda i: i.select("l_orderkey", "l_linenumber", "l_partkey", preflight.special_kind((F.col("l_partkey") * 37 + F.col("l_linenumber")) % 65536).alias("kind")),
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE ((l_partkey * 37 + l_linenumber) % 65536) & 61440 WHEN 4096 THEN 'fifo' WHEN 49152 THEN 'socket'
      WHEN 8192 THEN 'char-device' WHEN 24576 THEN 'block-device' WHEN 32768 THEN NULL WHEN 16384 THEN NULL WHEN 40960 THEN NULL ELSE 'unknown' END AS kind FROM {lineitem}""",
)
R.add(
    "unrepresentable_names",
    "I10",
    "messy",
    lambda m: preflight.unrepresentable(m.select(F.replace(F.substring_index("raw", "/", 1), F.lit("src1"), F.lit("..")).alias("name"))),
    """WITH n AS (SELECT replace(split_part(raw, '/', 1), 'src1', '..') AS name FROM {messy})
      SELECT count(*) AS names, count(*) FILTER (contains(name, chr(92)) OR name = '..') AS unrepresentable FROM n""",
)
