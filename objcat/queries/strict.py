"""Queries over values at the edge: far times, missing and foreign digests, forged audit lines, both outcomes of a guard."""

from __future__ import annotations

from pyspark.sql import functions as F

from objcat.operators import integrity
from objcat.plans import compare, transfer
from objcat.queries.fixtures import Registry
from objcat.queries.integrity import PAIR, VERIFY_SQL
from objcat.queries.plans import BOTH
from objcat.sources import records

R = Registry()

FAR = 2**63 - 1


def _far(i):
    """The two sides of each path: the latest and the earliest time there is, the same time, and none."""
    known, turn = i.filter("size is not null"), F.col("doc_id") % 4
    src = F.when(turn == 0, F.lit(FAR)).when(turn == 1, F.lit(-FAR - 1)).when(turn == 2, F.col("mtime"))
    dst = F.when(turn == 0, F.lit(-5)).when(turn == 1, F.lit(5)).otherwise(F.col("mtime"))
    return known.withColumn("mtime", src.cast("long")), known.withColumn("mtime", dst.cast("long"))


R.add(
    "check_far_times",
    "F1",
    "inv_src",
    lambda i: compare.check(*_far(i)).select("path", "status"),
    "SELECT path, CASE doc_id % 4 WHEN 2 THEN 'match' WHEN 3 THEN 'error' ELSE 'differ' END AS status FROM {inv_src} WHERE size IS NOT NULL",
)
R.add(
    "copy_plan_far_times",
    "F6",
    "inv_src",
    lambda i: transfer.copy_plan(*_far(i)).select("dest", "action"),
    "SELECT path AS dest, CASE doc_id % 4 WHEN 2 THEN 'skip' ELSE 'update' END AS action FROM {inv_src} WHERE size IS NOT NULL",
)
R.add(
    "check_checksum_unknown",
    "F1",
    "inv_src",
    lambda i: compare.check(
        i.filter("size is not null").withColumn("hash", F.when(F.col("doc_id") % 5 != 1, F.col("hash"))),
        i.filter("size is not null").withColumn("hash", F.when(F.col("doc_id") % 7 != 2, F.col("hash"))),
        "checksum",
    ).select("path", "status"),
    "SELECT path, CASE WHEN doc_id % 5 = 1 OR doc_id % 7 = 2 THEN 'error' ELSE 'match' END AS status FROM {inv_src} WHERE size IS NOT NULL",
)
R.add(
    "verify_foreign_digest",
    "H2",
    PAIR,
    lambda c, s: integrity.verify(c.withColumn("algo", F.when(F.length("path") % 3 == 0, "blake3").otherwise("MD5")), s, "md5").select("path", "status", "size"),
    VERIFY_SQL.replace("WHEN c.hash <> md5(s.content)", "WHEN length(c.path) % 3 = 0 THEN 'unverifiable' WHEN c.hash <> md5(s.content)"),
)
R.add(
    "something_verified",
    "H12",
    PAIR,
    lambda c, s: integrity.verify_summary(integrity.verify(c, s, "md5").filter(~integrity.is_failure())).select("examined", "outcome"),
    f"""WITH v AS ({VERIFY_SQL}) SELECT count(*) AS examined, 'passed' AS outcome FROM v WHERE status = 'ok'""",
)
R.add(
    "full_source_guard",
    "F16",
    BOTH,
    lambda s, d: transfer.empty_source(transfer.sync_plan(s, d)),
    """SELECT (SELECT count(*) FROM {inv_src}) AS from_source, (SELECT count(*) FROM {inv_dst} WHERE path NOT IN (SELECT path FROM {inv_src})) AS deletions,
      false AS refused""",
)

# Of seven lines one is right; the others have a size that is text, a fraction or negative, a field twice, no end, or a path that is a number.
# chr(123) and chr(125) are the braces, which mark tables in SQL here.
LINE = f"""concat(chr(123), '"v":2,"index":', CAST(pos AS STRING), ',"time":"2024-01-01T00:00:00Z","op":"', op, '","result":"success","size":',
    CASE pos % 7 WHEN 1 THEN '"lots"' WHEN 2 THEN '1.5' WHEN 3 THEN '-4' ELSE '3' END, ',"prev":"{"0" * 64}","hash":"{"f" * 64}"',
    CASE pos % 7 WHEN 4 THEN concat(',"size":3', chr(125)) WHEN 5 THEN '' WHEN 6 THEN concat(',"path":7', chr(125)) ELSE chr(125) END)"""

R.add(
    "audit_forged_lines",
    "A5",
    "aud",
    lambda a: records.parse_audit(a.select(F.col("chain").cast("string").alias("chain"), "pos", F.col("pos").alias("line"), F.expr(LINE).alias("value"))).select(
        F.col("chain").cast("long").alias("chain"), "pos", "corrupt", *[F.when(F.col("corrupt").isNull(), F.col(c)).alias(c) for c in ("index", "op", "size")]
    ),
    f"""SELECT chain, pos, CASE WHEN pos % 7 > 0 THEN {LINE} END AS corrupt, CASE WHEN pos % 7 = 0 THEN pos END AS index,
      CASE WHEN pos % 7 = 0 THEN op END AS op, CASE WHEN pos % 7 = 0 THEN 3 END AS size FROM {{aud}}""",
)
