"""Queries that write derived tables through a sink and read them back through a source."""

from __future__ import annotations

from pyspark.sql import functions as F

from objcat.operators import audit
from objcat.operators.listing import children
from objcat.plans import compare, transfer
from objcat.queries.fixtures import Registry, derived
from objcat.queries.integrity import SEALED, _sealed
from objcat.queries.plans import BOTH, DECIDE, SUMMARY, _check_sql, _plan_sql
from objcat.session import scratch_folder
from objcat.sources import listing, records, sinks

R = Registry()

R.add_run("object_listing", "A1", lambda spark, sf: listing.scan_objects(spark, sf), None)


def _written_log(spark, sf: str) -> str:
    place = scratch_folder(spark, "audit")
    records.write_audit(_sealed(derived(spark, sf, "aud")), place)
    return place


R.add_run(
    "audit_log_source",
    "A5",
    lambda spark, sf: records.read_audit_export(spark, _written_log(spark, sf)).select(
        F.col("chain").cast("long").alias("chain"), "pos", "corrupt", "index", "op", "direction", "bytes", "prev", "hash"
    ),
    f"""WITH RECURSIVE {SEALED} SELECT e.chain, e.pos, CAST(NULL AS VARCHAR) AS corrupt, e.pos AS index, op, direction, bytes, prev, hash
      FROM e JOIN seal AS s ON e.chain = s.chain AND e.pos = s.pos""",
)
R.add_run(
    "audit_export_verified",
    "A6",
    lambda spark, sf: audit.verify_chain(records.read_audit_export(spark, _written_log(spark, sf))).select(
        F.col("chain").cast("long").alias("chain"), "records", "verdict", "head"
    ),
    f"""WITH RECURSIVE {SEALED} SELECT chain, count(*) AS records, 'intact' AS verdict, arg_max(hash, pos) AS head FROM seal GROUP BY chain""",
)


def _check_lists(spark, sf: str):
    place = scratch_folder(spark, "check")
    result = compare.check(derived(spark, sf, "inv_src"), derived(spark, sf, "inv_dst"))
    names = {n: f"{place}/{n}" for n in sinks.STATUS_LISTS}
    sinks.write_check(result, combined=f"{place}/combined", **names)
    out = spark.read.text(f"{place}/combined").select(F.lit("combined").alias("list"), F.col("value").alias("line"))
    for name, folder in names.items():
        out = out.unionByName(spark.read.text(folder).select(F.lit(name).alias("list"), F.col("value").alias("line")))
    return out


R.add_run(
    "check_lists",
    "A11",
    _check_lists,
    f"""WITH c AS ({_check_sql(*BOTH, "size+mtime")})
      SELECT 'combined' AS list, CASE status WHEN 'match' THEN '=' WHEN 'missing-on-src' THEN '-' WHEN 'missing-on-dst' THEN '+' WHEN 'differ' THEN '*' ELSE '!' END
        || ' ' || path AS line FROM c
      UNION ALL SELECT replace(status, '-', '_'), path FROM c WHERE status <> 'error'""",
)


def _verified(spark, sf: str):
    place = scratch_folder(spark, "verified")
    inv = derived(spark, sf, "inv_big")
    sinks.verified_write(inv, place)
    sinks.verified_write(derived(spark, sf, "inv_big_dst"), place, mode="overwrite")
    sinks.verified_write(inv, place)
    table = sinks.read_verified(spark, place, check=True)
    return table.groupBy(F.split("path", "/")[0].alias("top")).agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))


R.add_run(
    "verified_write",
    "A12",
    _verified,
    """SELECT split_part(path, '/', 1) AS top, count(*) AS rows, sum(size)::BIGINT AS bytes
      FROM (SELECT path, size FROM {inv_big} UNION ALL SELECT path, size FROM {inv_big_dst}) GROUP BY 1""",
)


def _stored_catalog(spark, sf: str):
    place = scratch_folder(spark, "catalog")
    sinks.write_catalog(derived(spark, sf, "catalog"), place)
    catalog = listing.read_catalog(spark, place)
    busiest = catalog.groupBy("parent").count().orderBy(F.desc("count"), "parent").first()["parent"]
    return children(catalog, busiest).select("path", "size")


R.add_run(
    "children_of_stored_catalog",
    "E8",
    _stored_catalog,
    """WITH c AS (SELECT *, regexp_extract(path, '^(.*)/', 1) AS parent FROM {catalog}),
      b AS (SELECT parent FROM c GROUP BY parent ORDER BY count(*) DESC, parent LIMIT 1)
      SELECT path, CASE WHEN size = 0 AND hash = '' THEN NULL ELSE size END AS size FROM c WHERE parent = (SELECT parent FROM b)""",
)


def _plan_documents(spark, sf: str):
    place = scratch_folder(spark, "plan")
    plan = transfer.sync_plan(derived(spark, sf, "inv_src"), derived(spark, sf, "inv_dst"))
    sinks.write_plan(plan, place)
    rows = spark.read.schema("action string, source string, dest string, size long, reason string").json(f"{place}/actions")
    summary = spark.read.schema("copy long, update long, delete long, skip long, mkdir long, bytes long").json(f"{place}/summary")
    note = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("copy", "update", "delete", "skip", "mkdir")])
    return rows.unionByName(summary.select(F.lit("summary").alias("action"), F.lit("").alias("source"), F.lit("").alias("dest"), F.col("bytes").alias("size"), note.alias("reason")))


R.add_run(
    "plan_documents",
    "A13",
    _plan_documents,
    f"""WITH p AS ({_plan_sql(DECIDE, extras=True)}) SELECT action, source, dest, size, reason FROM p WHERE action <> 'skip'
      UNION ALL SELECT 'summary', '', '', bytes, concat_ws(' ', copy, update, delete, skip, mkdir) FROM ({SUMMARY} p)""",
)
