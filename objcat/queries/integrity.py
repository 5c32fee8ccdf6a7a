"""Queries for verification, chunk geometry, audit logs and streams."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from objcat.operators import audit, chunks, integrity, preflight
from objcat.queries.fixtures import Registry, derived
from objcat.session import scratch_folder
from objcat.streaming import catalog as stream_catalog
from objcat.streaming.audit import follow_audit

R = Registry()

# -- digests and verification ----------------------------------------------------------------------------

R.add(
    "hashsum",
    "H1",
    "documents",
    lambda d: integrity.hashsum(
        d.select(
            F.col("doc_id").cast("string").alias("path"),
            F.col("text").alias("content"),
            F.when(F.col("n_chars") % 2 == 0, F.sha2(F.lower("text"), 256)).alias("known"),
        ),
        recorded="known",
    ),
    "SELECT CAST(doc_id AS STRING) AS path, CASE WHEN n_chars % 2 = 0 THEN sha256(lower(text)) ELSE sha256(text) END AS hash FROM {documents}",
)
R.add(
    "hashsum_sha1",
    "H1",
    "pages",
    lambda p: integrity.hashsum(p.select(F.col("url").alias("path"), F.col("html").alias("content")), algo="sha1"),
    "SELECT url AS path, sha1(html) AS hash FROM {pages}",
)
VERIFY_SQL = """SELECT c.path, CASE WHEN s.object_key IS NULL THEN 'missing' WHEN s.content IS NULL THEN 'unreadable'
    WHEN (c.size > 0 OR c.hash <> '') AND c.size <> bit_length(s.content) / 8 THEN 'corrupt' WHEN c.hash = '' THEN 'unverifiable'
    WHEN c.hash <> md5(s.content) THEN 'corrupt' ELSE 'ok' END AS status,
  CASE WHEN c.size = 0 AND c.hash = '' THEN NULL ELSE c.size END AS size FROM {recorded} AS c LEFT JOIN {stored} AS s ON c.object_key = s.object_key"""
PAIR = ["recorded", "stored"]


def _verify(c, s):
    return integrity.verify(c, s, "md5").select("path", "status", "size")


R.add("verify", "H2", PAIR, _verify, VERIFY_SQL)
R.add(
    "verify_summary",
    "H3",
    PAIR,
    lambda c, s: integrity.verify_summary(_verify(c, s)),
    f"""WITH v AS ({VERIFY_SQL}) SELECT count(*) AS examined, count(*) FILTER (status = 'ok') AS verified, count(*) FILTER (status <> 'ok') AS failed,
      CASE WHEN count(size) = count(*) THEN sum(size)::BIGINT END AS bytes, sum(size)::BIGINT AS measured_bytes, count(*) - count(size) AS unmeasured,
      (SELECT status FROM v ORDER BY CASE status WHEN 'corrupt' THEN 4 WHEN 'missing' THEN 3 WHEN 'unreadable' THEN 2 WHEN 'unverifiable' THEN 1 ELSE 0 END DESC LIMIT 1) AS worst,
      CASE WHEN count(*) = 0 THEN 'unverified' WHEN count(*) FILTER (status <> 'ok') > 0 THEN 'failed' ELSE 'passed' END AS outcome FROM v""",
)
R.add(
    "verify_fail_fast",
    "H4",
    PAIR,
    lambda c, s: integrity.fail_fast(_verify(c, s)),
    f"WITH v AS ({VERIFY_SQL}) SELECT * FROM v WHERE path <= (SELECT min(path) FROM v WHERE status <> 'ok')",
)
BUCKET = "CAST(('0x' || substr(md5(concat('7:', path)), 1, 8)) AS BIGINT) % 100"
R.add("scrub_sample", "H5", "inv_big", lambda i: integrity.scrub_sample(i, 20, 7).select("path"), f"SELECT path FROM {{inv_big}} WHERE {BUCKET} < 20")
R.add(
    "scrub_report",
    "H6",
    PAIR,
    lambda c, s: integrity.scrub_report(
        c, integrity.scrub(c, s, 40, 7, "md5").withColumn("repaired", F.col("status") == "unreadable")
    ),
    f"""WITH v AS ({VERIFY_SQL}), p AS (SELECT *, {BUCKET} < 40 AS seen FROM v), j AS (SELECT p.*, c.size AS recorded FROM p JOIN {{recorded}} AS c ON c.path = p.path)
      SELECT count(*) FILTER (seen) AS scanned, count(*) FILTER (NOT seen) AS skipped, count(*) FILTER (seen AND status = 'ok') AS healthy,
        count(*) FILTER (seen AND status <> 'ok') AS damaged, count(*) FILTER (seen AND status = 'unreadable') AS repaired,
        sum(recorded) FILTER (seen)::BIGINT AS bytes, sum(recorded) FILTER (seen)::BIGINT AS measured_bytes, CAST(0 AS BIGINT) AS unmeasured, 'damaged' AS health FROM j""",
)
R.add(
    "scrub_error_budget",
    "H7",
    PAIR,
    lambda c, s: integrity.error_budget(_verify(c, s), 25),
    f"""WITH v AS ({VERIFY_SQL}), r AS (SELECT *, count(*) FILTER (status <> 'ok') OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v)
      SELECT path, status, size FROM r WHERE before < 25""",
)
CHUNK = 4096
DRAWS = 3 * integrity.DRAWS_PER_SAMPLE + integrity.DRAWS_EXTRA


def _objects(c):
    return c.select("object_key", (F.col("size") % 99991).alias("size"))


SAMPLED = f"""o AS (SELECT object_key, CAST(ceil((size % 99991) / {CHUNK}.0) AS BIGINT) AS n FROM {{catalog}} WHERE size % 99991 > 0),
  d AS (SELECT object_key, n, i, CAST(('0x' || substr(md5(concat('5:', object_key, ':', CAST(i AS STRING))), 1, 15)) AS BIGINT) % n AS c
    FROM o, unnest(range({DRAWS})) AS u(i)),
  f AS (SELECT object_key, c, min(i) AS i FROM d WHERE c <> 0 AND c <> n - 1 GROUP BY 1, 2),
  k AS (SELECT object_key, c, row_number() OVER (PARTITION BY object_key ORDER BY i) AS r FROM f),
  picked AS (SELECT object_key, 0::BIGINT AS chunk FROM o UNION SELECT object_key, n - 1 FROM o UNION SELECT object_key, c FROM k WHERE r <= 3)"""
R.add(
    "sample_chunks",
    "H8",
    "catalog",
    lambda c: integrity.sample_chunks(_objects(c), 3, 5, CHUNK),
    f"WITH {SAMPLED} SELECT object_key, chunk FROM picked",
)
R.add(
    "chunk_runs",
    "H9",
    "catalog",
    lambda c: chunks.coalesce_runs(integrity.sample_chunks(_objects(c), 3, 5, CHUNK), window=2),
    f"""WITH {SAMPLED}, i AS (SELECT *, chunk - row_number() OVER (PARTITION BY object_key ORDER BY chunk) AS g FROM picked),
      s AS (SELECT object_key, min(chunk) AS a, count(*) AS n FROM i GROUP BY object_key, g)
      SELECT object_key, a + k AS first, least(n - k, 2) AS count FROM s, unnest(range(0, n, 2)) AS u(k)""",
)
R.add(
    "object_length",
    "H10",
    "catalog",
    lambda c: integrity.confirm_length(
        c.select(
            "object_key",
            "size",
            F.lit(CHUNK).cast("long").alias("chunk_size"),
            F.lit(100).cast("long").alias("payload_start"),
            (F.col("size") + 100 + F.ceil(F.col("size") / CHUNK).cast("long") * 16 + F.element_at(F.array(F.lit(0), F.lit(32), F.lit(5)), (F.col("size") % 3 + 1).cast("int"))).alias("stored_size"),
        )
    ),
    f"""WITH o AS (SELECT object_key, size, size + 100 + CAST(ceil(size / {CHUNK}.0) AS BIGINT) * 16 AS expected FROM {{catalog}})
      SELECT object_key, expected + CASE size % 3 WHEN 0 THEN 0 WHEN 1 THEN 32 ELSE 5 END AS stored_size, expected, size = 0 OR size % 3 < 2 AS ok FROM o""",
)
R.add(
    "restored_length",
    "H11",
    "inv_src",
    lambda i: integrity.confirm_restored(
        i.select(F.col("path").alias("dest"), "size"), i.select("path", (F.coalesce("size", F.lit(0)) + F.col("doc_id") % 3).alias("size"))
    ),
    "SELECT path AS dest, size AS recorded, size + doc_id % 3 AS landed FROM {inv_src} WHERE size IS NOT NULL AND doc_id % 3 > 0",
)
R.add(
    "nothing_verified",
    "H12",
    PAIR,
    lambda c, s: integrity.verify_summary(_verify(c, s).filter("path IS NULL")).select("examined", "outcome"),
    f"""WITH v AS ({VERIFY_SQL}) SELECT count(*) FILTER (path IS NULL) AS examined,
      CASE WHEN count(*) FILTER (path IS NULL) = 0 THEN 'unverified' ELSE 'failed' END AS outcome FROM v""",
)

# -- chunk geometry --------------------------------------------------------------------------------------

R.add(
    "chunk_grid",
    "K1",
    "inv_big",
    lambda i: chunks.chunk_grid(i.select(F.col("path").alias("object_key"), "size"), 1 << 20, 64),
    """WITH o AS (SELECT path AS object_key, size, CAST(ceil(size / 1048576.0) AS BIGINT) AS n FROM {inv_big})
      SELECT object_key, c AS chunk, c * 1048576 AS "offset", least(size - c * 1048576, 1048576) AS length, 64 + c * 1048592 AS stored_offset,
        least(size - c * 1048576, 1048576) + 16 AS stored_length FROM o, unnest(range(n)) AS u(c)""",
)
R.add(
    "chunk_span",
    "K2",
    ["inv_big", "inv_big"],
    lambda i, o: chunks.chunk_span(
        i.select(F.col("path").alias("object_key"), (F.col("mtime") * 31 % 9_000_000).alias("offset"), F.when(F.col("size") % 5 > 0, F.col("size") % 3_000_000).alias("length")),
        o.select(F.col("path").alias("object_key"), "size"),
    ),
    """WITH r AS (SELECT path AS object_key, mtime * 31 % 9000000 AS o, CASE WHEN size % 5 > 0 THEN size % 3000000 END AS l, size FROM {inv_big}),
      w AS (SELECT *, least(coalesce(l, greatest(size - o, 0)), greatest(size - o, 0)) AS want FROM r),
      s AS (SELECT *, o // 1048576 AS a, (o + want - 1) // 1048576 AS b FROM w)
      SELECT object_key, o AS "offset", l AS length, CASE WHEN want = 0 THEN 0 ELSE a END AS first_chunk, CASE WHEN want = 0 THEN 0 ELSE b - a + 1 END AS chunk_count,
        CASE WHEN want = 0 THEN 0 ELSE a * 1048592 END AS stored_offset,
        CASE WHEN want = 0 THEN 0 ELSE (b - a) * 1048592 + least(size - b * 1048576, 1048576) + 16 END AS stored_length,
        CASE WHEN want = 0 THEN 0 ELSE o - a * 1048576 END AS window_offset, want AS window_length FROM s""",
)
SLICES = {"head": {"head": 4000}, "tail": {"tail": 4000}, "mid": {"offset": 1000, "count": 3000}, "back": {"offset": -2500, "count": 700}}


def _slices(i):
    resolved = {n: chunks.resolve_slice("size", **kw) for n, kw in SLICES.items()}
    return i.select("path", *[s[f].alias(f"{n}_{f}") for n, s in resolved.items() for f in ("start", "length")])


R.add(
    "slice_resolution",
    "K3",
    "inv_src",
    _slices,
    """SELECT path, 0 * size AS head_start, least(4000, size) AS head_length, greatest(size - 4000, 0) AS tail_start,
      size - greatest(size - 4000, 0) AS tail_length, least(1000, size) AS mid_start, least(3000, size - least(1000, size)) AS mid_length,
      greatest(size - 2500, 0) AS back_start, least(700, size - greatest(size - 2500, 0)) AS back_length FROM {inv_src} WHERE size IS NOT NULL
      UNION ALL SELECT path, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM {inv_src} WHERE size IS NULL""",
)
R.add(
    "content_slice",
    "K4",
    "pages",
    lambda p: chunks.cat(p.select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("content")), offset=-2500, count=700).select(
        "path", F.hex("content").alias("content")
    ),
    """WITH h AS (SELECT CAST(page_id AS STRING) AS path, hex(html) AS x FROM {pages})
      SELECT path, substr(x, 2 * greatest(length(x) // 2 - 2500, 0) + 1, 1400) AS content FROM h""",
)
R.add(
    "run_summary",
    "K5",
    "outcomes",
    chunks.run_summary,
    """SELECT count(*) FILTER (action IN ('copy', 'update') AND result = 'success') AS files,
      sum(bytes) FILTER (action IN ('copy', 'update') AND result = 'success')::BIGINT AS bytes, count(*) FILTER (action = 'delete' AND result = 'success') AS deleted,
      count(*) FILTER (action = 'skip') AS skipped, count(*) FILTER (result <> 'success') AS errors, count(*) FILTER (result = 'checksum_mismatch') AS checksum_mismatches,
      CAST(0 AS BIGINT) AS retries, sum(bytes) FILTER (action IN ('copy', 'update') AND result = 'success')::DOUBLE / sum(size) FILTER (action IN ('copy', 'update'))::DOUBLE * 100.0 AS percent,
      sum(bytes) FILTER (action IN ('copy', 'update') AND result = 'success')::DOUBLE / (sum(elapsed_ms)::DOUBLE / 1000.0) AS average_rate FROM {outcomes}""",
)

# -- audit -----------------------------------------------------------------------------------------------

SEP = "chr(31)"
TAIL = f"""concat_ws({SEP}, time, op, result, path, CAST(size AS STRING), '', '', remote, direction, CAST(bytes AS STRING), '1')"""
GENESIS = f"'{audit.GENESIS}'"
# Sealing is a recursion along each chain; DuckDB runs it as one.
SEALED = f"""e AS (SELECT *, {TAIL} AS tail FROM {{aud}}),
  seal AS (SELECT chain, pos, {GENESIS} AS prev, sha256(concat_ws({SEP}, '2', {GENESIS}, '0', tail)) AS hash FROM e WHERE pos = 0
    UNION ALL SELECT e.chain, e.pos, s.hash, sha256(concat_ws({SEP}, '2', s.hash, CAST(e.pos AS STRING), e.tail)) FROM e JOIN seal AS s
      ON e.chain = s.chain AND e.pos = s.pos + 1)"""


def _sealed(a):
    return audit.seal(a, "chain", "pos")


R.add(
    "audit_canonical",
    "J1",
    "aud",
    lambda a: a.select(
        "path",
        F.sha2(audit.canonical([*a.columns, "v"]), 256).alias("digest"),
    )
    if "v" in a.columns
    else (
        lambda r: r.select("path", F.md5(audit.canonical(r.columns)).alias("digest"))
    )(a.select("*", F.when(F.col("pos") % 2 == 0, 2).alias("v"), F.col("pos").alias("index"), F.md5("path").alias("prev"))),
    f"""SELECT path, md5(CASE WHEN pos % 2 = 0 THEN concat_ws({SEP}, '2', md5(path), CAST(pos AS STRING), {TAIL})
      ELSE concat_ws({SEP}, md5(path), CAST(pos AS STRING), time, op, result, path, CAST(size AS STRING), '', '', remote) END) AS digest FROM {{aud}}""",
)
R.add(
    "audit_seal",
    "J2",
    "aud",
    lambda a: _sealed(a).select("chain", "index", "prev", "hash"),
    f"WITH RECURSIVE {SEALED} SELECT chain, pos AS index, prev, hash FROM seal",
)


def _forged(a):
    """Every third chain is edited, every fourth loses its link, every fifth skips an index, in its middle."""
    sealed = _sealed(a)
    mid = F.col("pos") == 11 + F.col("chain") % 7
    edited, cut, skipped = (mid & (F.col("chain") % n == 0) for n in (3, 4, 5))
    return sealed.withColumns(
        {
            "bytes": F.when(edited, F.col("bytes") + 1).otherwise(F.col("bytes")),
            "prev": F.when(cut, F.sha2("prev", 256)).otherwise(F.col("prev")),
            "index": F.when(skipped, F.col("index") + 1).otherwise(F.col("index")),
        }
    )


FORGED_SQL = f"""WITH RECURSIVE {SEALED},
  c AS (SELECT chain, count(*) AS records, max(pos) AS last FROM {{aud}} GROUP BY chain),
  b AS (SELECT *, 11 + chain % 7 AS place, CASE WHEN last < 11 + chain % 7 THEN NULL WHEN chain % 5 = 0 THEN 'index-discontinuity'
    WHEN chain % 4 = 0 THEN 'broken-link' WHEN chain % 3 = 0 THEN 'content-mismatch' END AS kind FROM c)"""
R.add(
    "audit_verify_chain",
    "J3",
    "aud",
    lambda a: audit.verify_chain(_forged(a)).select("chain", "records", "verdict", "head", "position", "kind"),
    f"""{FORGED_SQL} SELECT b.chain, records, CASE WHEN kind IS NULL THEN 'intact' ELSE 'broken' END AS verdict, CASE WHEN kind IS NULL THEN s.hash END AS head,
      CASE WHEN kind IS NOT NULL THEN place END AS position, kind FROM b JOIN seal AS s ON s.chain = b.chain AND s.pos = b.last""",
)
R.add(
    "audit_heads",
    "J4",
    "aud",
    lambda a: audit.head(audit.verify_chain(_sealed(a))).select("chain", "anchor"),
    f"""WITH RECURSIVE {SEALED} SELECT chain, count(*) || ':' || arg_max(hash, pos) AS anchor FROM seal GROUP BY chain""",
)


def _anchors(sealed):
    """The head of each chain as it once was: shortened, as it is, counted too high, foreign, or without a count."""
    ends = sealed.groupBy("chain").agg(F.count(F.lit(1)).alias("n"), F.max_by("hash", "pos").alias("last"), F.max_by("prev", "pos").alias("before"))
    case = F.col("chain") % 6
    return ends.select(
        "chain",
        F.when(case == 0, F.col("n") - 1).when(case == 1, F.col("n")).when(case == 2, F.col("n") + 3).when(case == 3, F.col("n") - 1).alias("records"),
        F.when(case.isin(0, 4), F.col("before")).when(case == 1, F.upper("last")).when(case == 5, F.sha2("last", 256)).otherwise(F.sha2("before", 256)).alias("head"),
    )


ANCHORED = """CASE chain % 6 WHEN 0 THEN 'advanced' WHEN 1 THEN 'match' WHEN 2 THEN 'truncated' WHEN 3 THEN 'diverged' WHEN 4 THEN 'advanced' ELSE 'absent' END"""
R.add(
    "audit_anchor_compare",
    "J5",
    "aud",
    lambda a: (lambda s: audit.compare_anchor(s, _anchors(s)))(_sealed(a)),
    f"""WITH RECURSIVE {SEALED}, n AS (SELECT chain, count(*) AS n, arg_max(prev, pos) AS before FROM seal GROUP BY chain)
      SELECT chain, {ANCHORED} AS comparison, n AS records, CASE WHEN chain % 6 IN (0, 3, 4) THEN n - 1 WHEN chain % 6 = 2 THEN n + 3 END AS anchored_records,
        CAST(CASE WHEN chain % 6 IN (0, 4) THEN 1 END AS BIGINT) AS appended, CAST(CASE WHEN chain % 6 = 2 THEN 3 END AS BIGINT) AS missing, CASE WHEN chain % 6 = 3 THEN before END AS found FROM n""",
)
SINCE, UNTIL = 1704499200, 1706140800  # 2024-01-06 and 2024-01-25
LISTED = f"""SELECT chain, pos, op, path FROM {{aud}} WHERE direction = 'out' AND starts_with(path, 'data/')
  AND (time LIKE '% noon' OR (substr(time, 9, 2)::INT BETWEEN 6 AND 24))"""
R.add(
    "audit_list",
    "J6",
    "aud",
    lambda a: audit.audit_list(a, direction="out", path="/data/", since=SINCE, until=UNTIL).select("chain", "pos", "op", "path"),
    LISTED,
)
R.add(
    "audit_list_last",
    "J6",
    "aud",
    lambda a: audit.audit_list(a, limit=4, direction="out", path="data", since=SINCE, until=UNTIL).select("chain", "pos", "op", "path"),
    f"SELECT chain, pos, op, path FROM (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY pos DESC) AS r FROM ({LISTED})) WHERE r <= 4",
)
R.add(
    "audit_verdict",
    "J7",
    "aud",
    lambda a: audit.audit_verdict(_forged(a), _anchors(_sealed(a))).select("chain", "verdict", "proves", "kind"),
    f"""{FORGED_SQL} SELECT chain, CASE WHEN kind IS NOT NULL THEN 'broken' WHEN chain % 6 = 1 THEN 'intact' ELSE 'head-mismatch' END AS verdict,
      CASE WHEN kind IS NOT NULL THEN '' WHEN chain % 6 = 1 THEN 'integrity,order,length' ELSE 'integrity,order' END AS proves,
      CASE WHEN kind IS NOT NULL THEN kind WHEN chain % 6 <> 1 THEN {ANCHORED} END AS kind FROM b""",
)
RULES = " UNION ALL ".join(f"SELECT '{op}' AS op, '{rule}' AS rule" for rule, ops in (("recorded", audit.RECORDED_OPS), ("exempt", audit.EXEMPT_OPS)) for op in ops)
R.add(
    "audit_coverage",
    "J8",
    "aud",
    lambda a: audit.audit_coverage(a.withColumn("op", F.when(F.col("pos") % 19 == 3, "verify").when(F.col("pos") % 19 == 4, "warp").otherwise(F.col("op")))),
    f"""WITH r AS ({RULES}), o AS (SELECT CASE pos % 19 WHEN 3 THEN 'verify' WHEN 4 THEN 'warp' ELSE op END AS op, count(*) AS n FROM {{aud}} GROUP BY 1)
      SELECT coalesce(o.op, r.op) AS op, rule, coalesce(n, 0) AS records, CASE WHEN rule IS NULL THEN 'unruled' WHEN n IS NULL AND rule = 'recorded' THEN 'unseen'
        WHEN n IS NOT NULL AND rule = 'exempt' THEN 'exempt-but-seen' ELSE 'covered' END AS state FROM o FULL OUTER JOIN r ON o.op = r.op""",
)
R.add(
    "audit_traffic",
    "J9",
    "aud",
    audit.traffic,
    "SELECT op, remote, direction, count(*) AS records, sum(bytes)::BIGINT AS bytes, sum(objects)::BIGINT AS objects FROM {aud} GROUP BY 1, 2, 3",
)
R.add(
    "audit_outcomes",
    "J10",
    "outcomes",
    audit.outcome_counts,
    """SELECT result, count(*) AS records, CASE result WHEN 'success' THEN 0 WHEN 'checksum_mismatch' THEN 20 WHEN 'temporary_error' THEN 5 END AS code,
      false AS stops FROM {outcomes} GROUP BY result""",
)
R.add(
    "audit_redact",
    "J11",
    "aud",
    lambda a: audit.redact_entry(a.withColumn("path", F.concat("path", F.lit("\x07")))).select("chain", "pos", "path", "remote", "op"),
    """SELECT chain, pos, path || chr(92) || 'u0007' AS path, concat('s3://sha256:', substr(sha256(regexp_extract(remote, '//([^@]*)@', 1)), 1, 8), '@',
      regexp_extract(remote, '@([^?]*)', 1), '?token=<redacted>&a=1') AS remote, op FROM {aud}""",
)

# -- streams ---------------------------------------------------------------------------------------------


def _stream(spark, sf: str, name: str):
    """A derived table fed by the events as a stream."""
    from objcat.queries.fixtures import DERIVED

    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(os.path.abspath(sf))
    return spark.sql(DERIVED[name], events=events)


def _run_catalog(spark, sf: str) -> str:
    out = scratch_folder(spark, "catalog")
    stream_catalog.stream_catalog(_stream(spark, sf, "changes"), out).awaitTermination()
    return out


LATEST = """l AS (SELECT path, arg_max(kind, seq) AS kind, arg_max(size, seq) AS size, arg_max(hash, seq) AS hash FROM {changes} GROUP BY path),
  p AS (SELECT * FROM l WHERE kind = 'put')"""
R.add_run(
    "stream_totals",
    "L1",
    lambda spark, sf: stream_catalog.stream_totals(spark, _run_catalog(spark, sf)),
    f"""WITH {LATEST} SELECT count(*) AS objects, sum(size)::BIGINT AS bytes, count(*) FILTER (size = 0 AND hash = '') AS unmeasured,
      CASE WHEN count(*) FILTER (size = 0 AND hash = '') = 0 THEN sum(size)::BIGINT END AS measured_bytes FROM p""",
)
R.add_run(
    "stream_dirs",
    "L2",
    lambda spark, sf: stream_catalog.stream_dirs(spark, _run_catalog(spark, sf)),
    f"""WITH {LATEST} SELECT array_to_string(string_split(path, '/')[1:n], '/') AS dir, count(*) AS objects FROM p,
      unnest(range(1, len(string_split(path, '/')))) AS u(n) GROUP BY 1""",
)


def _run_batches(spark, sf: str) -> str:
    """The feed in six batches, late ones among them, of which two come again."""
    out, changes = scratch_folder(spark, "catalog"), derived(spark, sf, "changes")
    slices = [changes.filter(F.col("seq") % 6 == n) for n in (3, 0, 5, 1, 4, 2)]
    for number, part in [*enumerate(slices), (4, slices[4]), (5, slices[5])]:
        stream_catalog.apply_changes(part, out, number, buckets=8)
    return out


R.add_run(
    "stream_totals_batches",
    "L1",
    lambda spark, sf: stream_catalog.stream_totals(spark, _run_batches(spark, sf)),
    f"""WITH {LATEST} SELECT count(*) AS objects, sum(size)::BIGINT AS bytes, count(*) FILTER (size = 0 AND hash = '') AS unmeasured,
      CASE WHEN count(*) FILTER (size = 0 AND hash = '') = 0 THEN sum(size)::BIGINT END AS measured_bytes FROM p""",
)
R.add_run(
    "stream_dirs_batches",
    "L2",
    lambda spark, sf: stream_catalog.stream_dirs(spark, _run_batches(spark, sf)),
    f"""WITH {LATEST} SELECT array_to_string(string_split(path, '/')[1:n], '/') AS dir, count(*) AS objects FROM p,
      unnest(range(1, len(string_split(path, '/')))) AS u(n) GROUP BY 1""",
)


def _follow(spark, sf: str):
    from objcat.queries.fixtures import DERIVED

    out = scratch_folder(spark, "follow")
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(os.path.abspath(sf))
    # A running number per chain is no streaming question; the event's own number stands in for it.
    feed = spark.sql(DERIVED["aud"].replace("row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1", "event_id"), events=events)
    shown = follow_audit(feed, op="cat", since=SINCE, until=UNTIL)
    writer = shown.select("chain", "pos", "path").writeStream.format("parquet").outputMode("append")
    writer.option("path", out).option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("chain long, pos long, path string").parquet(out)


R.add_run(
    "stream_audit_follow",
    "L3",
    _follow,
    """WITH a AS (SELECT *, CAST(regexp_extract(path, '([0-9]+)$', 1) AS BIGINT) AS event FROM {aud})
      SELECT chain, event AS pos, path FROM a WHERE op = 'cat' AND (time LIKE '% noon' OR (substr(time, 9, 2)::INT BETWEEN 6 AND 24))""",
)


# An algorithm that is only recorded, never computed here: rows without a digest stay, with NULL.
R.add(
    "hashsum_recorded_only",
    "H1",
    "recorded",
    lambda df: integrity.hashsum(df.withColumn("hash", F.nullif("hash", F.lit(""))), algo="blake3", recorded="hash"),
    "SELECT path, nullif(hash, '') AS hash FROM {recorded}",
)
# The Kelvin sign composes to the letter K: names that look unlike become one.
R.add_run(
    "normalisation_ascii_forms",
    "I5",
    lambda spark, sf: preflight.nfc_collisions(
        derived(spark, sf, "documents").select(
            F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("\u212a"), F.col("doc_id").cast("string")))
            .when(F.col("doc_id") % 7 == 1, F.concat(F.lit("K"), (F.col("doc_id") - 1).cast("string")))
            .otherwise(F.concat(F.lit("p"), F.col("doc_id").cast("string")))
            .alias("native")
        )
    ),
    """SELECT concat('K', CAST(a.doc_id AS VARCHAR)) AS logical, CAST(2 AS BIGINT) AS natives
      FROM documents AS a JOIN documents AS b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 7 = 0""",
)
