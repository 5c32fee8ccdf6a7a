"""Inventories, catalogs and logs derived from the given tables, by one text that Spark and DuckDB both run."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

DERIVED = {
    # Three levels; some sizes are unknown.
    "inv_src": """
        SELECT doc_id, concat(source, '/', lang, '/', CAST(doc_id AS STRING), '.txt') AS path,
          CASE WHEN doc_id % 25 = 9 THEN NULL ELSE n_chars END AS size,
          1704067200 + doc_id * 3600 AS mtime, md5(text) AS hash
        FROM {documents}""",
    # The same rows elsewhere: moved (3), resized (5), rewritten (6), touched outside (7) and inside (8) a
    # one-second window, and extras from the web pages.
    "inv_dst": """
        SELECT CASE WHEN doc_id % 10 = 3 THEN concat('archive/', path) ELSE path END AS path,
          CASE WHEN doc_id % 10 = 5 THEN size + 1 ELSE size END AS size,
          CASE WHEN doc_id % 10 = 7 THEN mtime + 2 WHEN doc_id % 10 = 8 THEN mtime + 1 ELSE mtime END AS mtime,
          CASE WHEN doc_id % 10 = 6 THEN md5(concat(hash, 'x')) ELSE hash END AS hash
        FROM {inv_src}
        UNION ALL
        SELECT concat('extra/', CAST(page_id AS STRING), '.html'), CAST(length(html) AS BIGINT),
          1704067200 + page_id, md5(html) FROM {pages}""",
    # One row per line item, in a tree with two very large branches.
    "inv_big": """
        SELECT concat(l_returnflag, '/', l_linestatus, '/', CAST(l_suppkey % 100 AS STRING), '/',
            CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '.bin') AS path,
          CAST(round(l_extendedprice * 100) AS BIGINT) AS size, l_orderkey * 60 AS mtime,
          md5(concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING))) AS hash
        FROM {lineitem}""",
    "inv_big_dst": """
        SELECT CASE WHEN l_linenumber = 7 THEN concat('old/', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING),
              '-', CAST(l_partkey AS STRING), '.bin')
            ELSE concat(l_returnflag, '/', l_linestatus, '/', CAST(l_suppkey % 100 AS STRING), '/',
              CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '.bin') END AS path,
          CAST(round(l_extendedprice * 100) AS BIGINT) + CASE WHEN l_linenumber = 5 THEN 1 ELSE 0 END AS size,
          l_orderkey * 60 + CASE WHEN l_linenumber = 6 THEN 5 ELSE 0 END AS mtime,
          md5(concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING))) AS hash
        FROM {lineitem}""",
    # Paths as people type them: doubled and foreign separators, dots, climbs, composed and decomposed text.
    "messy": """
        SELECT doc_id, concat(source, CASE doc_id % 8 WHEN 0 THEN '//' WHEN 1 THEN chr(92) WHEN 2 THEN '/./'
            WHEN 3 THEN '/../' WHEN 4 THEN '/café/' WHEN 5 THEN '/café/' WHEN 6 THEN '/../../' ELSE '/' END,
            lang, '/', CAST(doc_id AS STRING), CASE doc_id % 3 WHEN 0 THEN '.txt' WHEN 1 THEN '' ELSE '/.' END) AS raw
        FROM {documents}""",
    # A catalog of orders; a few rows were never measured (size 0 and no digest).
    "catalog": """
        SELECT concat(o_orderstatus, '/', substr(o_orderpriority, 1, 1), '/', CAST(o_custkey % 50 AS STRING), '/',
            CAST(o_orderkey AS STRING), '.rec') AS path,
          concat('o/', md5(CAST(o_orderkey AS STRING))) AS object_key,
          CASE WHEN o_orderkey % 40 = 7 THEN CAST(0 AS BIGINT) ELSE CAST(round(o_totalprice) AS BIGINT) END AS size,
          o_orderkey * 30 AS mtime,
          CASE WHEN o_orderkey % 40 = 7 THEN '' ELSE md5(concat('c', CAST(o_orderkey AS STRING))) END AS hash
        FROM {orders}""",
    # Every third order was written again under a new key.
    "catalog_new": """
        SELECT path, CASE WHEN o_orderkey % 3 = 0 THEN concat('o/', md5(concat('n', CAST(o_orderkey AS STRING))))
          ELSE object_key END AS object_key, size, mtime, hash
        FROM (SELECT *, CAST(regexp_extract(path, '([0-9]+)[.]rec', 1) AS BIGINT) AS o_orderkey FROM {catalog}) AS t""",
    # Documents as recorded (some digests wrong, some absent) and as stored.
    "recorded": """
        SELECT concat(source, '/', CAST(doc_id AS STRING)) AS path, concat('k', CAST(doc_id AS STRING)) AS object_key,
          CASE WHEN doc_id % 13 = 4 THEN CAST(0 AS BIGINT)
            WHEN doc_id % 13 = 6 THEN CAST(bit_length(text) / 8 AS BIGINT) + 1
            ELSE CAST(bit_length(text) / 8 AS BIGINT) END AS size,
          1704067200 + doc_id AS mtime,
          CASE WHEN doc_id % 13 = 4 THEN '' WHEN doc_id % 13 = 5 THEN md5(concat(text, '!')) ELSE md5(text) END AS hash
        FROM {documents}""",
    "stored": """
        SELECT concat(CASE WHEN doc_id % 13 = 8 THEN 'lost' ELSE 'k' END, CAST(doc_id AS STRING)) AS object_key,
          CASE WHEN doc_id % 13 = 9 THEN NULL ELSE text END AS content FROM {documents}""",
    # Deletions need directory markers: one per directory of the document tree, and a few empty ones.
    "marked": """
        SELECT path, size, mtime, hash FROM {inv_src}
        UNION ALL SELECT DISTINCT concat(source, '/', lang, '/.objcat-dir'), CAST(0 AS BIGINT), CAST(0 AS BIGINT), ''
          FROM {documents}
        UNION ALL SELECT DISTINCT concat('empty/', source, '/.objcat-dir'), CAST(0 AS BIGINT), CAST(0 AS BIGINT), ''
          FROM {documents}
        UNION ALL SELECT DISTINCT 'empty/.objcat-dir', CAST(0 AS BIGINT), CAST(0 AS BIGINT), '' FROM {documents}""",
    # Objects on a store, some of them staging leftovers, with ages.
    "store_objects": """
        SELECT concat(source, '/', CASE WHEN doc_id % 11 = 2 THEN '.objcat-staging.' WHEN doc_id % 11 = 3
            THEN 'report.tmp.' ELSE 'f' END, CAST(doc_id AS STRING)) AS path,
          CASE WHEN doc_id % 25 = 9 THEN NULL ELSE n_chars END AS size,
          CASE WHEN doc_id % 7 = 1 THEN NULL ELSE 1704067200 - doc_id * 600 END AS mtime FROM {documents}""",
    # Names with trouble in them.
    "names": """
        SELECT doc_id, concat(CASE doc_id % 12 WHEN 0 THEN 'con.d/' WHEN 1 THEN 'a:b/' WHEN 2 THEN 'dot./'
            WHEN 3 THEN 'x/COM7.log' WHEN 4 THEN concat('tab', chr(9), '/') WHEN 5 THEN 'café/' WHEN 6 THEN 'café/'
            WHEN 7 THEN 'Case/' WHEN 8 THEN 'case/' WHEN 9 THEN 'what?/' WHEN 10 THEN 'end /' ELSE 'plain/' END,
            CAST(doc_id - doc_id % 12 AS STRING)) AS path, n_chars AS size, 1704067200 + doc_id AS mtime
        FROM {documents}""",
    # Files named like the directories above others.
    "clashing": """
        SELECT path FROM {inv_src}
        UNION ALL SELECT DISTINCT concat(source, '/', lang) FROM {documents}""",
    # Unsealed audit entries, one chain per user.
    "aud": """
        SELECT user_id AS chain, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS pos,
          concat('2024-01-', CASE WHEN event_id % 28 < 9 THEN '0' ELSE '' END, CAST(event_id % 28 + 1 AS STRING),
            CASE WHEN event_id % 9 = 0 THEN ' noon' ELSE 'T10:00:00Z' END) AS time,
          CASE event_type WHEN 'view' THEN 'cat' WHEN 'purchase' THEN 'copy' WHEN 'signup' THEN 'sync'
            WHEN 'click' THEN 'restore' ELSE 'delete' END AS op,
          CASE event_type WHEN 'error' THEN 'partial_failure' ELSE 'success' END AS result,
          CASE event_type WHEN 'view' THEN 'out' WHEN 'click' THEN 'out' WHEN 'error' THEN ''
            WHEN 'signup' THEN 'internal' ELSE 'in' END AS direction,
          concat('data/', event_type, '/', CAST(event_id AS STRING)) AS path,
          CAST(floor(value * 10) AS BIGINT) AS size, CAST(floor(value * 1000) AS BIGINT) AS bytes,
          CAST(1 AS BIGINT) AS objects,
          concat('s3://user', CAST(user_id % 5 AS STRING), ':pw@host', CAST(user_id % 3 AS STRING), '/b?token=x&a=1') AS remote
        FROM {events}""",
    # A feed of changes to a catalog, many of them to few paths.
    "changes": """
        SELECT event_id AS seq, concat('u', CAST(user_id % 13 AS STRING), '/', event_type, '/f',
            CAST(CAST(floor(value * 100) AS BIGINT) % 40 AS STRING)) AS path,
          CASE WHEN event_id % 5 = 4 THEN 'delete' ELSE 'put' END AS kind,
          CASE WHEN event_id % 17 = 3 THEN CAST(0 AS BIGINT) ELSE CAST(floor(value * 1000) AS BIGINT) END AS size,
          CASE WHEN event_id % 17 = 3 THEN '' ELSE md5(props) END AS hash
        FROM {events}""",
    # Outcomes of a run over the line items.
    "outcomes": """
        SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS path,
          CASE l_returnflag WHEN 'A' THEN 'copy' WHEN 'N' THEN 'update' ELSE CASE l_linestatus WHEN 'O' THEN 'delete'
            ELSE 'skip' END END AS action,
          CASE l_linenumber WHEN 7 THEN 'checksum_mismatch' WHEN 6 THEN 'temporary_error' ELSE 'success' END AS result,
          CAST(round(l_extendedprice) AS BIGINT) AS size,
          CASE WHEN l_linenumber > 5 THEN CAST(0 AS BIGINT) ELSE CAST(round(l_extendedprice) AS BIGINT) END AS bytes,
          CAST(l_linenumber AS BIGINT) AS elapsed_ms FROM {lineitem}""",
}


def _needs(name: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", DERIVED[name])


def derived(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table, or one derived from them, in Spark."""
    if name in TABLES:
        return spark.read.parquet(f"{sf}/{name}.parquet")
    return spark.sql(DERIVED[name], **{n: derived(spark, sf, n) for n in _needs(name)})


def with_ctes(sql: str) -> str:
    """SQL whose `{name}` references are given as common table expressions in front of it."""
    order: list[str] = []

    def visit(name: str) -> None:
        for n in _needs(name):
            if n in DERIVED:
                visit(n)
        if name not in order:
            order.append(name)

    for name in dict.fromkeys(re.findall(r"\{(\w+)\}", sql)):
        if name in DERIVED:
            visit(name)
    fill = {n: n for n in (*TABLES, *DERIVED)}

    def named(text: str) -> str:
        return re.sub(r"\{(\w+)\}", lambda m: fill[m[1]] if m[1] in fill else m[0], text)

    ctes = ", ".join(f"{n} AS ({named(DERIVED[n])})" for n in order)
    body = named(sql).strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, {body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[len('WITH '):]}"
    return f"WITH {ctes} {body}"


@dataclass(frozen=True)
class Query:
    name: str
    operator: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


class Registry:
    """Collects the queries of one module."""

    def __init__(self):
        self.found: list[Query] = []

    def add(self, name: str, operator: str, source: str | list[str], build: Callable[..., DataFrame], sql: str | None):
        """Register `build(df, …)` over derived tables, and the SQL that must agree with it."""
        sources = [source] if isinstance(source, str) else source

        def run(spark: SparkSession, sf: str) -> DataFrame:
            return build(*[derived(spark, sf, s) for s in sources])

        self.found.append(Query(name, operator, run, with_ctes(sql) if sql else None))

    def add_run(self, name: str, operator: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None):
        self.found.append(Query(name, operator, run, with_ctes(sql) if sql else None))
