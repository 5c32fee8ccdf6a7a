"""The text operators as queries over the given tables, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objcat.llm import decontamination, licenses, lines, mixing, negatives, pages, pii, rules, simhash, tokens, topk, trie, urls
from objcat.llm.common import table
from objcat.queries.fixtures import Registry
from objcat.session import staged

R = Registry()

# Target shares of the mixture: three sources by name, the others together by size.
WEIGHTS, REST, SEED = {"src0": 0.2, "src1": 0.1, "src2": 0.1}, 0.6, 7

# The rules of the url filter.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def _mixing(spark, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, WEIGHTS, REST, seed=SEED).withColumn("copy", F.col("copy").cast("long"))


R.add_run(
    "op1_mixing",
    "llm1",
    _mixing,
    """
    WITH docs AS (SELECT doc_id, source, text FROM documents),
    weights(source, weight) AS (VALUES ('src0', 0.2::DOUBLE), ('src1', 0.1::DOUBLE), ('src2', 0.1::DOUBLE)),
    sizes AS (SELECT d.source, any_value(w.weight) AS weight, sum(length(coalesce(d.text, '')))::DOUBLE AS size
      FROM docs AS d LEFT JOIN weights AS w ON d.source = w.source GROUP BY d.source),
    total AS (SELECT sum(size) AS size, coalesce(sum(size) FILTER (weight IS NULL), 0) AS unnamed,
      coalesce(sum(weight) FILTER (size > 0), 0) + CASE WHEN coalesce(sum(size) FILTER (weight IS NULL), 0) > 0 THEN 0.6::DOUBLE ELSE 0 END AS weighed FROM sizes),
    rates AS (SELECT s.source, CASE WHEN s.size = 0 THEN 0 WHEN s.weight IS NULL THEN 0.6::DOUBLE / t.unnamed * (t.size / t.weighed)
      ELSE s.weight * (t.size / t.weighed) / s.size END AS rate FROM sizes AS s, total AS t),
    pieces AS (SELECT source, greatest(ceil(rate / 32), 1)::BIGINT AS pieces, rate / greatest(ceil(rate / 32), 1) AS rate FROM rates),
    chances AS (SELECT source, k, CASE WHEN rate > 0 THEN exp(k * ln(rate) - rate - lgamma(k + 1)) WHEN k = 0 THEN 1 ELSE 0 END AS p
      FROM (SELECT source, rate, unnest(range(0, (ceil(rate + 10 * sqrt(rate) + 20))::BIGINT + 1)) AS k FROM pieces)),
    steps AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS step FROM chances),
    draws AS (SELECT d.doc_id, d.source, d.text, unnest(range(1, p.pieces + 1)) AS piece FROM docs AS d JOIN pieces AS p ON d.source IS NOT DISTINCT FROM p.source),
    drawn AS (SELECT *, ('0x' || substr(md5(concat('7|copies|', piece, '|', doc_id)), 1, 13))::BIGINT / 4503599627370496::DOUBLE AS u FROM draws),
    counted AS (SELECT doc_id, source, any_value(text) AS text, sum((SELECT count(*) FROM steps AS s WHERE s.source IS NOT DISTINCT FROM drawn.source AND s.step <= drawn.u)) AS copies
      FROM drawn GROUP BY doc_id, source)
    SELECT doc_id, source, text, copy, md5(concat('7|place|', doc_id, '|', copy)) AS place
    FROM (SELECT doc_id, source, text, unnest(range(1, copies::BIGINT + 1)) AS copy FROM counted)""",
)

R.add_run("op2_licenses", "llm2", lambda spark, sf: licenses.scan(table(spark, sf, "documents")), None)


def _pii(spark, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = pii.spans(docs, pii.fit(docs))
    # Counts are of the base spans, as the hash is; `spans` also lists what the trees add.
    counts = [F.size(F.filter("base", pii.is_kind(kind))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


R.add_run("op3_pii", "llm3", _pii, None)

R.add_run("op4_decontamination", "llm4", lambda spark, sf: decontamination.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark")), None)


def _lines(spark, sf: str) -> DataFrame:
    spans = F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return lines.dedupe(table(spark, sf, "documents")).withColumn("removed", F.array_join(spans, ","))


R.add_run(
    "op5_lines",
    "llm5",
    _lines,
    rf"""
    WITH units AS (
      SELECT doc_id, unnest(parts) AS unit, unnest(range(len(parts))) AS nr
      FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{lines.SENTENCES}') AS parts FROM documents)),
    placed AS (
      SELECT *, coalesce(sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
        trim(regexp_replace(lower(unit), '\s+', ' ', 'g')) AS plain FROM units),
    ranked AS (
      SELECT *, len(regexp_extract_all(plain, '{lines.WORD}')) AS words,
        plain <> '' AND row_number() OVER (PARTITION BY plain ORDER BY doc_id, nr) > 1 AS again FROM placed),
    runs AS (SELECT *, nr - row_number() OVER (PARTITION BY doc_id, again ORDER BY nr) AS run FROM ranked),
    sized AS (SELECT *, again AND sum(words) OVER (PARTITION BY doc_id, again, run) >= {lines.RUN} AS cut FROM runs),
    spans AS (
      SELECT doc_id, string_agg(concat(start, ':', stop), ',' ORDER BY start) AS removed
      FROM (SELECT doc_id, run, min(start) AS start, max(start + length(unit)) AS stop FROM sized WHERE cut GROUP BY doc_id, run) GROUP BY doc_id),
    kept AS (SELECT doc_id, string_agg(unit, '' ORDER BY nr) FILTER (NOT cut) AS text, count(*) FILTER (cut) AS n_removed FROM sized GROUP BY doc_id)
    SELECT d.doc_id, coalesce(k.text, '') AS text, coalesce(k.n_removed, 0) AS n_removed, coalesce(s.removed, '') AS removed
    FROM documents AS d LEFT JOIN kept AS k ON k.doc_id = d.doc_id LEFT JOIN spans AS s ON s.doc_id = d.doc_id""",
)

R.add_run("op6_urls", "llm6", lambda spark, sf: urls.judge(table(spark, sf, "pages"), URL_RULES), None)

R.add_run("op7_main_text", "llm7", lambda spark, sf: pages.extract(table(spark, sf, "pages")), None)

R.add_run("op8_simhash", "llm8", lambda spark, sf: simhash.groups(table(spark, sf, "documents")), None)


def _rules(spark, sf: str) -> DataFrame:
    stats = staged(rules.statistics(table(spark, sf, "documents")), "statistics")
    judged = rules.judge(stats, rules.learn(stats, table(spark, sf, "labels")))
    return judged.select("doc_id", *rules.STATISTICS, "base_failed", "kept")


R.add_run("op9_quality_rules", "llm9", _rules, None)

R.add_run("op10_token_counts", "llm10", lambda spark, sf: tokens.document_counts(table(spark, sf, "documents")), None)

R.add_run(
    "op11_prefix_trie",
    "llm11",
    lambda spark, sf: trie.prefix_trie(table(spark, sf, "conversations")),
    """
    WITH said AS (
      SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS pos
      FROM conversations WHERE conv_id IS NOT NULL),
    convs AS (
      SELECT c, c - c % 100 AS base, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(c::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda acc, e: CASE WHEN e >= 0 THEN xor(acc, e) ELSE xor(acc >> 1, CASE WHEN acc & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295) % 6 AS h
      FROM (SELECT DISTINCT c FROM said)),
    parts AS (
      SELECT v.c, 0 AS part, s.pos, s.role, s.text FROM convs AS v JOIN said AS s ON s.c = v.base AND s.pos <= v.h
      UNION ALL SELECT v.c, 1, s.pos, s.role, s.text FROM convs AS v JOIN said AS s ON s.c = v.c AND s.pos > v.h),
    whole AS (SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS depth FROM parts),
    prefixes AS (
      SELECT c, depth, length(text) AS chars, string_agg(sha256(concat(length(role), ':', role, text)), ' ') OVER (PARTITION BY c ORDER BY depth) AS path FROM whole
      UNION ALL SELECT c, 0, 0, '' FROM convs),
    lengths AS (SELECT c, max(depth) AS length FROM prefixes GROUP BY c),
    nodes AS (
      SELECT path, p.depth, min(p.c) AS c, count(*) AS n_convs, any_value(chars) AS chars,
        sha256(coalesce(string_agg(p.c::VARCHAR, ',' ORDER BY p.c) FILTER (l.length = p.depth), '')) AS ends_sha256
      FROM prefixes AS p JOIN lengths AS l ON l.c = p.c GROUP BY path, p.depth),
    ups AS (
      SELECT n.*, up.path AS parent_path, parent.c AS parent_c FROM nodes AS n
        LEFT JOIN prefixes AS up ON up.c = n.c AND up.depth = n.depth - 1
        LEFT JOIN nodes AS parent ON parent.path = up.path AND parent.depth = n.depth - 1),
    families AS (SELECT u.*, (SELECT count(*) FROM ups AS k WHERE k.parent_path = u.path AND k.depth = u.depth + 1) AS n_children FROM ups AS u),
    totals AS (
      SELECT up.path, up.depth, sum((f.n_children = 0)::BIGINT) AS n_leaves, sum((f.n_convs - 1) * f.chars) AS saved
      FROM families AS f JOIN prefixes AS up ON up.c = f.c AND up.depth <= f.depth GROUP BY up.path, up.depth)
    SELECT f.c AS conv_id, f.depth, f.parent_c AS parent_conv_id, f.n_convs, f.n_children, t.n_leaves::BIGINT AS n_leaves, t.saved::BIGINT AS saved_tokens, f.ends_sha256
    FROM families AS f JOIN totals AS t ON t.path = f.path AND t.depth = f.depth""",
)

_INTEGERS = """
      SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""

R.add_run(
    "op12_top_k",
    "llm12",
    lambda spark, sf: topk.top_k(table(spark, sf, "embeddings"), F.col("id") % 50 == 0),
    f"""
    WITH vecs AS ({_INTEGERS}),
    scored AS (
      SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM vecs AS q JOIN vecs AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5""",
)


def _negatives(spark, sf: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf, "embeddings"), F.col("id") % 50 == 0, label)


R.add_run(
    "op13_hard_negatives",
    "llm13",
    _negatives,
    f"""
    WITH vecs AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, v FROM ({_INTEGERS}) WHERE label IS NOT NULL),
    scored AS (
      SELECT a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
      FROM vecs AS a JOIN vecs AS c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
    positives AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score
      FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nr FROM scored WHERE same) WHERE nr <= 5)
    SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
    FROM (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM positives AS p JOIN scored AS s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
    WHERE rank <= 3""",
)
