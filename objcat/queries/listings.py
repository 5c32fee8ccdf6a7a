"""Queries for filters, listings and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from objcat.functions import paths
from objcat.operators import listing, preflight
from objcat.operators.filters import FilterSet, Rule, under
from objcat.operators.globs import glob_match
from objcat.queries.fixtures import Registry, derived
from objcat.schema import as_inventory, catalog_inventory
from objcat.sources import listing as sources
from objcat.sources import records

R = Registry()
NOW = 1_710_000_000

# -- sources and contracts -------------------------------------------------------------------------------

R.add(
    "inventory_adapter",
    "A2",
    "pages",
    lambda p: as_inventory(p, F.concat(F.lit("p/"), F.col("page_id").cast("string")), F.length("html"), None, F.md5("html")),
    """SELECT 'p/' || page_id AS path, length(html) AS size, CAST(NULL AS BIGINT) AS mtime, md5(html) AS hash,
      false AS object_missing FROM {pages}""",
)
R.add(
    "catalog_source",
    "A3",
    "catalog",
    catalog_inventory,
    """SELECT path, object_key, CASE WHEN size = 0 AND hash = '' THEN NULL ELSE size END AS size, mtime,
      CASE WHEN hash <> '' THEN hash END AS hash, false AS object_missing FROM {catalog}""",
)


def _headers(catalog):
    return catalog.filter("hash <> ''").select("object_key", "size", "mtime", "hash")


R.add(
    "catalog_rebuild",
    "A4",
    "catalog",
    lambda c: sources.rebuild_catalog(c.select("path", "object_key"), _headers(c))[0],
    """SELECT path, object_key, CASE WHEN hash = '' THEN 0 ELSE size END AS size, CASE WHEN hash <> '' THEN mtime END AS mtime,
      hash FROM {catalog}""",
)
R.add(
    "catalog_rebuilt_counts",
    "A4",
    "catalog",
    lambda c: sources.rebuild_catalog(c.select("path", "object_key"), _headers(c))[1],
    """SELECT count(*) AS files, count(*) FILTER (hash <> '') AS measured, count(*) FILTER (hash = '') AS unmeasured FROM {catalog}""",
)
R.add(
    "listing_json",
    "A7",
    "inv_src",
    lambda i: records.lsjson(i, algo="md5").select(
        "Path", "Name", "Size", "ModTime", "IsDir", F.element_at("Hashes", "md5").alias("Md5")
    ),
    """SELECT path AS "Path", regexp_extract(path, '[^/]*$') AS "Name", size AS "Size",
      strftime(make_timestamp(mtime * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS "ModTime", false AS "IsDir", hash AS "Md5" FROM {inv_src}""",
)
R.add(
    "manifest_lines",
    "A8",
    "inv_src",
    lambda i: records.manifest_lines(i).unionByName(records.manifest_lines(i, binary=True)),
    """SELECT concat(hash, '  ', path) AS value FROM {inv_src} UNION ALL SELECT concat(hash, ' *', path) FROM {inv_src}""",
)
R.add(
    "manifest_parse",
    "A9",
    "inv_src",
    lambda i: records.parse_manifest(
        i.select(
            F.concat(
                F.when(F.col("doc_id") % 9 == 4, F.substring("hash", 1, 20)).otherwise(F.sha2("hash", 256)), F.lit("  "), "path"
            ).alias("value")
        )
    ),
    """SELECT path, CASE WHEN doc_id % 9 <> 4 THEN sha256(hash) END AS hash,
      CASE WHEN doc_id % 9 = 4 THEN 'malformed-digest' END AS problem FROM {inv_src}""",
)
R.add(
    "path_list",
    "A10",
    "inv_src",
    lambda i: sources.path_list(
        i.select(
            F.col("doc_id").alias("line"),
            F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("# "), "path"))
            .when(F.col("doc_id") % 6 == 1, F.concat(F.lit("  /"), F.replace("path", F.lit("/"), F.lit("//"))))
            .when(F.col("doc_id") % 6 == 2, "")
            .otherwise(paths.parent("path"))
            .alias("value"),
        )
    ),
    """WITH l AS (SELECT trim(CASE doc_id % 6 WHEN 0 THEN '# ' || path WHEN 1 THEN '  /' || replace(path, '/', '//') WHEN 2 THEN ''
        ELSE regexp_extract(path, '^(.*)/', 1) END) AS value FROM {inv_src})
      SELECT DISTINCT ltrim(replace(value, '//', '/'), '/') AS path FROM l WHERE value <> '' AND NOT starts_with(value, '#')""",
)

# -- filters ---------------------------------------------------------------------------------------------

GLOBS = {
    "stars": ("A/*/1*/*-[1-3]-*.bin", "^A/[^/]*/1[^/]*/[^/]*-[1-3]-[^/]*[.]bin$"),
    "cross": ("**/7/**", "(^|.*)/7/.*$"),
    "negated": ("[!A]/?/**", "^[^A/]/[^/]/.*$"),
    "choice": ("{A,R}/{F,O}/{1,2{3,4}}/*", "^(A|R)/(F|O)/(1|2(3|4))/[^/]*$"),
    "suffix": ("**-7-*", "-7-[^/]*$"),
    "literal": (r"N/O/\5/**", "^N/O/5/"),
}
R.add(
    "glob_match",
    "D1",
    "inv_big",
    lambda i: i.select("path", *[glob_match("path", g).alias(n) for n, (g, _) in GLOBS.items()]),
    "SELECT path, " + ", ".join(f"regexp_matches(path, '{r}') AS {n}" for n, (_, r) in GLOBS.items()) + " FROM {inv_big}",
)
RULES = {
    "root": ("/A/F/*/**", "^A/F/[^/]*/.*$"),
    "name": ("1*.bin", "(^|/)1[^/]*[.]bin$"),
    "tail": ("F/2?/*", "(^|/)F/2[^/]/[^/]*$"),
    "exact": ("9/12*", "(^|/)9/12[^/]*$"),
}
R.add(
    "rule_anchors",
    "D2",
    "inv_big",
    lambda i: i.select("path", *[Rule("include", g).predicate(F.col("path")).alias(n) for n, (g, _) in RULES.items()]),
    "SELECT path, " + ", ".join(f"regexp_matches(path, '{r}') AS {n}" for n, (_, r) in RULES.items()) + " FROM {inv_big}",
)
ORDERED = FilterSet.build(
    rules_from=["# keep a few\n- *-7-*.bin\n+ A/**\n; then\n- /N/O/1*/**\n+ 3*-*.bin\n- R/**\n"], now=NOW
)
ORDERED_SQL = """CASE WHEN regexp_matches(path, '(^|/)[^/]*-7-[^/]*[.]bin$') THEN 'exclude 1' WHEN regexp_matches(path, '(^|/)A/') THEN 'include 2'
  WHEN regexp_matches(path, '^N/O/1[^/]*/') THEN 'exclude 3' WHEN regexp_matches(path, '(^|/)3[^/]*-[^/]*[.]bin$') THEN 'include 4'
  WHEN regexp_matches(path, '(^|/)R/') THEN 'exclude 5' ELSE 'include' END"""
R.add(
    "filter_first_match",
    "D3",
    "inv_big",
    lambda i: ORDERED.admit(i).select("path", "size"),
    f"SELECT path, size FROM {{inv_big}} WHERE starts_with({ORDERED_SQL}, 'include')",
)


def _ten_thousand() -> FilterSet:
    """Rules by part, by order, by directory and by a piece of the name, in turn."""
    lines = []
    for n in range(1, 2501):
        lines += [f"- *-{n}.bin", f"+ {n}-*", f"- /N/O/{n % 100}/**", f"+ *{n}-3-*.bin"]
    return FilterSet.build(rules_from=["\n".join(lines)], now=NOW)


R.add(
    "filter_rule_table",
    "D3",
    "inv_big",
    lambda i: _ten_thousand().explain(i).select("path", "action", "reason", "position"),
    r"""WITH p AS (SELECT path, split_part(path, '/', 1) AS flag, split_part(path, '/', 2) AS status, CAST(split_part(path, '/', 3) AS BIGINT) AS folder,
        regexp_extract(path, '([0-9]+)-([0-9]+)-([0-9]+)[.]bin$', 1) AS ord, regexp_extract(path, '([0-9]+)-([0-9]+)-([0-9]+)[.]bin$', 2) AS line,
        CAST(regexp_extract(path, '([0-9]+)-([0-9]+)-([0-9]+)[.]bin$', 3) AS BIGINT) AS part FROM {inv_big}),
      t AS (SELECT *, (SELECT min(CAST(right(ord, n) AS BIGINT)) FROM unnest(range(1, 5)) AS u(n)
          WHERE n <= length(ord) AND right(ord, n) NOT LIKE '0%' AND CAST(right(ord, n) AS BIGINT) BETWEEN 1 AND 2500) AS tail FROM p),
      f AS (SELECT path, least(CASE WHEN part BETWEEN 1 AND 2500 THEN 4 * part - 3 END, CASE WHEN CAST(ord AS BIGINT) BETWEEN 1 AND 2500 THEN 4 * CAST(ord AS BIGINT) - 2 END,
          CASE WHEN flag = 'N' AND status = 'O' THEN 4 * CASE WHEN folder = 0 THEN 100 ELSE folder END - 1 END, CASE WHEN line = '3' THEN 4 * tail END) AS position FROM t)
      SELECT path, CASE WHEN position IS NULL OR position % 2 = 0 THEN 'include' ELSE 'exclude' END AS action,
        CASE WHEN position IS NULL THEN 'unmatched' ELSE 'rule' END AS reason, position FROM f""",
)
R.add(
    "filter_include_closes",
    "D3",
    "inv_big",
    lambda i: FilterSet.build(include=["1*.bin", "/N/**"], exclude=["*-3-*"], now=NOW).admit(i).select("path"),
    "SELECT path FROM {inv_big} WHERE regexp_matches(path, '(^|/)1[^/]*[.]bin$') OR starts_with(path, 'N/')",
)
R.add(
    "filter_size",
    "D4",
    "inv_src",
    lambda i: FilterSet.build(min_size="1k", max_size="4KiB", now=NOW).admit(i).select("path", "size"),
    "SELECT path, size FROM {inv_src} WHERE size IS NULL OR size BETWEEN 1024 AND 4096",
)
R.add(
    "filter_age",
    "D5",
    "inv_src",
    lambda i: FilterSet.build(min_age="1d", max_age="69d", now=NOW)
    .admit(i.withColumn("mtime", F.when(F.col("doc_id") % 30 != 7, F.col("mtime"))))
    .select("path", "mtime"),
    f"""WITH i AS (SELECT path, CASE WHEN doc_id % 30 <> 7 THEN mtime END AS mtime FROM {{inv_src}})
      SELECT path, mtime FROM i WHERE mtime IS NULL OR mtime BETWEEN {NOW} - 69 * 86400 AND {NOW} - 86400""",
)
R.add(
    "filter_depth",
    "D6",
    "marked",
    lambda i: FilterSet.build(max_depth=2, now=NOW).admit(i).select("path"),
    "SELECT path FROM {marked} WHERE length(path) - length(replace(path, '/', '')) < 2",
)
R.add(
    "filter_path_list",
    "D7",
    ["inv_src", "inv_dst"],
    lambda i, d: FilterSet.build(only=d.select("path"), max_size="3k", now=NOW)
    .admit(
        i.select("path", "size", F.lit(False).alias("is_dir")).unionByName(
            i.select(paths.parent("path").alias("path"), F.lit(None).cast("long").alias("size"), F.lit(True).alias("is_dir")).distinct()
        )
    )
    .select("path", "is_dir"),
    """WITH l AS (SELECT DISTINCT path FROM {inv_dst})
      SELECT path, false AS is_dir FROM {inv_src} WHERE path IN (SELECT path FROM l) AND (size IS NULL OR size <= 3072)
      UNION ALL SELECT DISTINCT p, true FROM (SELECT regexp_extract(path, '^(.*)/', 1) AS p FROM {inv_src}) AS d
      WHERE EXISTS (SELECT 1 FROM l WHERE regexp_extract(l.path, '^(.*)/', 1) = d.p)""",
)
R.add(
    "filter_pruned_directories",
    "D8",
    "inv_big",
    lambda i: FilterSet.build(rules_from=["+ A/F/7/**\n- 7/\n- /N/*/2?/\n- *-1-*\n"], now=NOW).admits_enumerated(i).select("path"),
    """SELECT path FROM {inv_big} WHERE (regexp_matches(path, '(^|/)A/F/7/') OR NOT regexp_matches(path, '(^|/)[^/]*-1-[^/]*$'))
      AND NOT regexp_matches(path, '(^|/)7/') AND NOT regexp_matches(path, '^N/[^/]*/2[^/]/')""",
)
def _explained() -> FilterSet:
    return FilterSet.build(
        rules_from=["- */en/*\n+ **/1*.txt\n- **/2*\n"],
        min_size="500B",
        max_size="20k",
        min_age="5d",
        max_age="69d",
        max_depth=3,
        now=NOW,
    )


R.add(
    "filter_explain",
    "D9",
    "inv_src",
    lambda i: _explained().explain(i).select("path", "action", "reason", "position"),
    f"""WITH d AS (SELECT path, CASE WHEN mtime < {NOW} - 69 * 86400 THEN 'too-old' WHEN mtime > {NOW} - 5 * 86400 THEN 'too-new'
        WHEN size < 500 THEN 'too-small' WHEN size > 20480 THEN 'too-large' WHEN regexp_matches(path, '(^|/)[^/]*/en/[^/]*$') THEN '1'
        WHEN regexp_matches(path, '/1[^/]*[.]txt$') THEN '2' WHEN regexp_matches(path, '/2[^/]*$') THEN '3' ELSE 'unmatched' END AS r FROM {{inv_src}})
      SELECT path, CASE WHEN r IN ('2', 'unmatched') THEN 'include' ELSE 'exclude' END AS action,
        CASE WHEN length(r) = 1 THEN 'rule' ELSE r END AS reason, CASE WHEN length(r) = 1 THEN CAST(r AS BIGINT) END AS position FROM d""",
)
R.add(
    "scope_prefix",
    "D10",
    "inv_big",
    lambda i: under(i, "N/O").select("path", "size"),
    "SELECT path, size FROM {inv_big} WHERE starts_with(path, 'N/O/')",
)

# -- listings --------------------------------------------------------------------------------------------

STAMP = "strftime(make_timestamp(mtime * 1000000), '%Y-%m-%dT%H:%M:%SZ')"
BYTES = "CASE WHEN count(size) = count(*) THEN coalesce(sum(size), 0)::BIGINT END"
R.add("ls", "E1", "inv_src", lambda i: listing.ls(i), "SELECT size, path FROM {inv_src} ORDER BY path")
R.add(
    "lsl",
    "E2",
    "inv_src",
    lambda i: listing.lsl(i, "src1"),
    f"""SELECT size, {STAMP} AS modified, CASE WHEN starts_with(path, 'src1/') THEN substr(path, 6) ELSE path END AS path
      FROM {{inv_src}} ORDER BY path""",
)
DIRS = """SELECT array_to_string(string_split(path, '/')[1:n], '/') AS dir, size FROM {source},
  unnest(range(1, len(string_split(path, '/')))) AS u(n)"""
R.add(
    "lsd",
    "E3",
    "inv_big",
    lambda i: listing.lsd(i, depth=2),
    f"""SELECT dir AS path, count(*) AS objects, {BYTES} AS bytes FROM ({DIRS.replace('source', 'inv_big')}) WHERE
      len(string_split(dir, '/')) <= 2 GROUP BY dir""",
)
R.add(
    "lsd_recursive",
    "E3",
    "inv_src",
    lambda i: listing.lsd(i, depth=None),
    f"SELECT dir AS path, count(*) AS objects, {BYTES} AS bytes FROM ({DIRS.replace('source', 'inv_src')}) GROUP BY dir",
)
R.add(
    "size_totals",
    "E4",
    "inv_src",
    listing.size_totals,
    f"""SELECT count(*) AS count, {BYTES} AS bytes, coalesce(sum(size), 0)::BIGINT AS measured_bytes,
      count(*) - count(size) AS unmeasured FROM {{inv_src}}""",
)
R.add(
    "size_totals_measured",
    "E4",
    "inv_big",
    listing.size_totals,
    f"""SELECT count(*) AS count, {BYTES} AS bytes, coalesce(sum(size), 0)::BIGINT AS measured_bytes,
      count(*) - count(size) AS unmeasured FROM {{inv_big}}""",
)
R.add(
    "usage_by_remote",
    "E5",
    "inv_src",
    lambda i: listing.usage(i.withColumn("remote", F.split("path", "/")[0]), "plaintext"),
    f"""SELECT split_part(path, '/', 1) AS remote, count(*) AS objects, {BYTES} AS bytes, coalesce(sum(size), 0)::BIGINT AS measured_bytes,
      count(*) - count(size) AS unmeasured, 'plaintext' AS sizes FROM {{inv_src}} GROUP BY 1""",
)
R.add(
    "catalog_totals",
    "E6",
    "catalog",
    listing.catalog_totals,
    """SELECT count(*) AS objects, sum(size)::BIGINT AS bytes, count(*) FILTER (size = 0 AND hash = '') AS unmeasured,
      CASE WHEN count(*) FILTER (size = 0 AND hash = '') = 0 THEN sum(size)::BIGINT END AS measured_bytes FROM {catalog}""",
)
R.add(
    "infer_dirs",
    "E7",
    "inv_big",
    listing.infer_dirs,
    f"SELECT dir, count(*) AS objects FROM ({DIRS.replace('source', 'inv_big')}) GROUP BY dir",
)
R.add(
    "children",
    "E8",
    "inv_big",
    lambda i: listing.children(i, "A/F/7").select("path", "size"),
    "SELECT path, size FROM {inv_big} WHERE regexp_matches(path, '^A/F/7/[^/]*$')",
)
R.add(
    "child_dirs",
    "E9",
    "inv_big",
    lambda i: listing.child_dirs(i, "A/F"),
    "SELECT DISTINCT regexp_extract(path, '^(A/F/[^/]*)/', 1) AS dir FROM {inv_big} WHERE regexp_matches(path, '^A/F/[^/]*/')",
)
R.add(
    "has_dir",
    "E10",
    "inv_big",
    lambda i: listing.has_dir(i, "A/F/7").unionByName(listing.has_dir(i, "A/F/777")),
    """SELECT count(*) > 0 AS exists FROM {inv_big} WHERE starts_with(path, 'A/F/7/')
      UNION ALL SELECT count(*) > 0 FROM {inv_big} WHERE starts_with(path, 'A/F/777/')""",
)


def _tree_sql(level: int | None, dirs_only: bool) -> str:
    upto = "len(string_split(path, '/'))" if level is None else f"least(len(string_split(path, '/')), {level})"
    return f"""WITH n AS (SELECT array_to_string(string_split(path, '/')[1:k], '/') AS node, k < len(string_split(path, '/')) AS is_dir, k, size
        FROM {{inv_src}}, unnest(range(1, {upto} + 1)) AS u(k)),
      g AS (SELECT node AS path, CASE WHEN contains(node, '/') THEN regexp_extract(node, '^(.*)/', 1) ELSE '' END AS parent,
        regexp_extract(node, '[^/]*$') AS name, max(k)::BIGINT AS depth, bool_and(is_dir) AS is_dir, {BYTES} AS bytes FROM n GROUP BY node)
      SELECT *, row_number() OVER (PARTITION BY parent ORDER BY name) AS position,
        lead(name) OVER (PARTITION BY parent ORDER BY name) IS NULL AS is_last FROM g {'WHERE is_dir' if dirs_only else ''}"""


R.add("tree", "E11", "inv_src", lambda i: listing.tree(i), _tree_sql(None, False))
R.add("tree_directories", "E11", "inv_src", lambda i: listing.tree(i, level=2, dirs_only=True), _tree_sql(2, True))
R.add(
    "tree_counts",
    "E12",
    "inv_src",
    lambda i: listing.tree_counts(listing.tree(i)),
    """SELECT (SELECT count(DISTINCT regexp_extract(path, '^(.*)/', 1)) + count(DISTINCT split_part(path, '/', 1)) FROM {inv_src}) AS directories,
      (SELECT count(*) FROM {inv_src}) AS files""",
)
R.add_run(
    "stat",
    "E13",
    lambda spark, sf: listing.stat(
        derived(spark, sf, "inv_big"), derived(spark, sf, "inv_big").agg(F.max("path").alias("p")).first()["p"]
    ),
    "SELECT path, size, mtime, hash FROM {inv_big} WHERE path = (SELECT max(path) FROM {inv_big})",
)
TARGET = "CASE doc_id % 5 WHEN 0 THEN 'unread' WHEN 1 THEN 'missing' WHEN 2 THEN 'outside' ELSE 'inside' END"


def _links(i):
    return i.select("path", preflight.link_verdict("in-tree", F.expr(TARGET)).alias("verdict"))


def _notes(df, label: str):
    return df.withColumn("notes", F.array_join(F.transform("notes", lambda n: F.concat_ws(" ", n["path"], n[label])), ","))


R.add(
    "link_report",
    "E14",
    "inv_src",
    lambda i: _notes(listing.link_report(_links(i)), "verdict"),
    """WITH v AS (SELECT path, CASE doc_id % 5 WHEN 0 THEN 'not-followed' WHEN 1 THEN 'broken' WHEN 2 THEN 'out-of-tree' ELSE 'followed' END AS verdict
        FROM {inv_src}), s AS (SELECT * FROM v ORDER BY path LIMIT 64)
      SELECT count(*) FILTER (verdict = 'followed') AS followed, count(*) FILTER (verdict IN ('not-followed', 'out-of-tree')) AS skipped,
        count(*) FILTER (verdict = 'broken') AS broken, count(*) - (SELECT count(*) FROM s) AS unnamed,
        (SELECT string_agg(path || ' ' || verdict, ',' ORDER BY path) FROM s) AS notes FROM v""",
)
MODE = "CASE doc_id % 7 WHEN 0 THEN 4516 WHEN 1 THEN 49645 WHEN 2 THEN 8612 WHEN 3 THEN 25008 WHEN 4 THEN 16877 WHEN 5 THEN 33188 ELSE 420 END"
KIND_SQL = "CASE doc_id % 7 WHEN 0 THEN 'fifo' WHEN 1 THEN 'socket' WHEN 2 THEN 'char-device' WHEN 3 THEN 'block-device' WHEN 6 THEN 'unknown' END"
R.add(
    "special_report",
    "E15",
    "inv_src",
    lambda i: _notes(listing.special_report(i.select("path", preflight.special_kind(F.expr(MODE)).alias("kind"))), "kind"),
    f"""WITH k AS (SELECT path, {KIND_SQL} AS kind FROM {{inv_src}}), v AS (SELECT * FROM k WHERE kind IS NOT NULL),
      s AS (SELECT * FROM v ORDER BY path LIMIT 16)
      SELECT count(*) AS skipped, count(*) - (SELECT count(*) FROM s) AS unnamed,
        (SELECT string_agg(path || ' ' || kind, ',' ORDER BY path) FROM s) AS notes FROM v""",
)
R.add(
    "listing_stats",
    "E16",
    "inv_big",
    lambda i: listing.listing_stats(i, ORDERED),
    f"SELECT count(*) AS seen, count(*) FILTER (starts_with({ORDERED_SQL}, 'include')) AS matched FROM {{inv_big}}",
)
