"""What is read, how often, and what reaches the scan; guards and parameters beside it."""

import random
import re

import pytest
from pyspark.sql import functions as F

from objcat.errors import Refused
from objcat.operators import audit, filters, integrity, keyfilter, listing, preflight
from objcat.operators.filters import FilterSet
from objcat.plans import compare, recovery, transfer


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def stored(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}")
    return spark.read.parquet(f"{folder}/{name}")


def test_manifests_are_read_once_each(spark, tmp_path):
    e = stored(spark, tmp_path, "e", [("a", 1, "x"), ("caf\u00e9", 2, "y"), ("gone", 3, "z"), ("d", 4, "w")], "path string, size long, hash string")
    a = stored(spark, tmp_path, "a", [("a", 1, "x"), ("cafe\u0301", 2, "y"), ("new", 3, "z"), ("d", 5, "w")], "path string, size long, hash string")
    found = compare.compare_manifest(e, a)
    plan = plan_of(found)
    assert plan.count("Relation [") + plan.count("Relation[") == 2 and len(re.findall(r"\bJoin ", plan)) == 1
    assert {tuple(r) for r in found.collect()} == {
        ("a", "a", "identical"), ("caf\u00e9", "cafe\u0301", "respelled"), ("gone", None, "missing"), ("new", "new", "unexpected"), ("d", "d", "differing"),
    }


def test_scrub_hashes_only_what_it_samples(spark):
    n = 200
    digest = integrity.digest(F.concat(F.lit("t"), F.col("id")))
    catalog = spark.range(n).select(F.concat(F.lit("p"), "id").alias("path"), F.concat(F.lit("k"), "id").alias("object_key"), F.length(F.concat(F.lit("t"), "id")).cast("long").alias("size"), digest.alias("hash"))
    store = spark.range(n).select(F.concat(F.lit("k"), "id").alias("object_key"), F.concat(F.lit("t"), "id").alias("content"))
    wanted = integrity.scrub_sample(catalog, 10, 7).count()
    report = integrity.scrub(catalog, store, 10, 7)
    assert plan_of(report).count("Join LeftSemi") == 1
    rows = report.collect()
    assert len(rows) == wanted and {r["status"] for r in rows} == {"ok"} and 0 < wanted < n


def test_scrub_moves_no_body(spark, tmp_path):
    n = 400
    ids = spark.range(n).select(F.concat(F.lit("p"), "id").alias("path"), F.concat(F.lit("k"), "id").alias("object_key"), F.concat(F.lit("t"), "id").alias("content"))
    ids.select("path", "object_key", F.length("content").cast("long").alias("size"), integrity.digest("content").alias("hash")).write.parquet(f"{tmp_path}/catalog")
    ids.select("object_key", "content").write.parquet(f"{tmp_path}/store")
    catalog, store = spark.read.parquet(f"{tmp_path}/catalog"), spark.read.parquet(f"{tmp_path}/store")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        report = integrity.scrub(catalog, store, 20, 7)
        shown = report._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        rows = report.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    moved = re.findall(r"\) Exchange\n(?:Input[^\n]*|Output[^\n]*)", shown)
    assert moved and not any("content#" in m for m in moved)
    assert {r["path"] for r in rows} == {r["path"] for r in integrity.scrub_sample(catalog, 20, 7).collect()} and {r["status"] for r in rows} == {"ok"}


def test_bitmaps_lose_no_key_and_keep_few_others(spark):
    keys = spark.range(3000).select((F.col("id") * 7).alias("k"))
    rows = spark.range(30_000).select(F.col("id").alias("key"), F.lit("x").alias("k")).unionByName(spark.createDataFrame([(None, "x")], "key long, k string"))
    for bits, most in ((keyfilter.FILTER_BITS, 3100), (keyfilter.PIECE_BITS, 8000)):  # one small bitmap lets more through, and loses none
        found = {r["key"] for r in keyfilter.may_be_in(rows, "key", keys, "k", bits).collect()}
        assert set(range(0, 21_000, 7)) <= found and None not in found and len(found) <= most
    assert keyfilter.may_be_in(rows, "key", keys.limit(0), "k").count() == 0
    pieces = keyfilter.bitmaps(spark.range(100_000), "id", keyfilter.PIECE_BITS * 4).collect()
    assert len(pieces) == 4 and all(len(r["_bitmap"]) == 4096 for r in pieces)


def test_rules_as_a_table_decide_as_expressions_do(spark, monkeypatch):
    draw = random.Random(3)
    names = ["a", "bc", "target", "work", "\u00e9", "x-1", "x-12", "log", "A1", "q r"]
    found = {"/".join(draw.choice(names) for _ in range(draw.randint(1, 4))) + draw.choice(["", ".txt", ".bin", "-7.bin", "-17.bin"]) for _ in range(400)}
    parts = ["*", "**", "?", "[ab]*", "{a,bc}", "a", "bc", "target", "work", "\u00e9", "x-*", "x-1*", "*-7.bin", "*.txt", "*og*", "log.txt", "*-1?", "q r", "A1"]
    lines = [f"{draw.choice('+-')} {draw.choice(['', '/'])}{'/'.join(draw.choice(parts) for _ in range(draw.randint(1, 3)))}{draw.choice(['', '', '/'])}" for _ in range(300)]
    inv = spark.createDataFrame([(p, draw.random() < 0.3, draw.randint(0, 9)) for p in sorted(found)] + [("a", False, None)], "path string, is_dir boolean, size long")
    rules = FilterSet.build(rules_from=["\n".join(lines)], max_size=6, max_depth=3, now=0)
    for frame in (inv, inv.drop("is_dir")):
        several = []
        for most in (10_000, 10):
            monkeypatch.setattr(filters, "EXPRESSIONS", most)
            several.append([sorted(map(str, made.collect())) for made in (rules.admit(frame), rules.flag(frame), rules.explain(frame))])
        assert several[0] == several[1]


def test_ten_thousand_rules_are_no_expression(spark):
    lines = [f"- *-{n}.bin" for n in range(10_000)]
    inv = spark.range(50).select(F.concat(F.lit("d/x-"), F.col("id") * 1000, F.lit(".bin")).alias("path"))
    few, many = (FilterSet.build(rules_from=["\n".join(lines[:n])], now=0).admit(inv) for n in (600, 10_000))
    assert len(plan_of(many)) < 2 * len(plan_of(few))
    assert sorted(r["path"] for r in many.collect()) == sorted(f"d/x-{n * 1000}.bin" for n in range(10, 50))


def test_reports_read_their_input_once(spark, tmp_path):
    verdicts = ["followed", "broken", "not-followed"]
    made = [(f"l{i:03}", verdicts[i % 3]) for i in range(100)]
    links = stored(spark, tmp_path, "links", made, "path string, verdict string").repartition(7)
    report = listing.link_report(links, sample=4)
    assert plan_of(report).count("Relation ") == 1 and "Sort" not in plan_of(report)
    row = report.first()
    assert (row["followed"], row["skipped"], row["broken"], row["unnamed"]) == (34, 33, 33, 96)
    assert [(n["path"], n["verdict"]) for n in row["notes"]] == made[:4]
    empty = listing.link_report(links.limit(0)).first()
    assert (empty["followed"], empty["unnamed"], empty["notes"]) == (0, 0, [])

    plan = stored(spark, tmp_path, "plan", [(a, f"p{i}", f"p{i}", i, "r") for i, a in enumerate(["copy", "update", "delete"] * 9)], "action string, source string, dest string, size long, reason string")
    found = transfer.immutable_violations(plan, quoted=2)
    assert plan_of(found).count("Relation ") == 1
    assert tuple(found.first()) == (18, "update p1, update p10", 16)
    kept = transfer.apply_budget(plan, 20)
    assert {r["dest"] for r in kept.filter("action <> 'delete'").collect()} == {"p0", "p1", "p10"} and kept.filter("action = 'delete'").count() == 9


def test_rules_that_name_text_reach_the_scan_at_any_number(spark, tmp_path):
    inv = stored(spark, tmp_path, "inv", [("a/x-7-1.bin",), ("a/y.txt",), ("x-7-.bin",), ("b/q-7-z.bins",)], "path string")
    rules = FilterSet.build(rules_from=["".join(f"- *-{n}-*.bin\n" for n in range(5, 45)) + "- ???\n"], now=0)
    kept = rules.admit(inv)
    assert sorted(r["path"] for r in kept.collect()) == ["a/y.txt", "b/q-7-z.bins"]
    one = FilterSet.build(rules_from=["+ *-7-*.bin\n- **\n"], now=0).admit(inv)
    pushed = one._jdf.queryExecution().executedPlan().toString()
    assert "StringEndsWith(path,.bin)" in pushed and "StringContains(path,-7-)" in pushed
    assert sorted(r["path"] for r in one.collect()) == ["a/x-7-1.bin", "x-7-.bin"]


def test_case_collisions_block_on_a_host_that_folds_case(spark):
    inv = spark.createDataFrame([("A",), ("a",), ("b:c",)], "path string")

    def levels(**how):
        return {(r["problem"], r["severity"]) for r in preflight.preflight(inv, audience="here", **how).collect()}

    assert levels(ignores_case=True) == {("case-collision", "blocking"), ("illegal-name", "portability")}
    assert levels(windows=True) == {("case-collision", "blocking"), ("illegal-name", "blocking")}
    assert levels() == {("case-collision", "portability"), ("illegal-name", "portability")}


def test_backup_counts_with_a_path_list(spark):
    native = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("../c", 1, 1)], "native string, size long, mtime long")
    only = spark.createDataFrame([("a",)], "path string")
    assert tuple(recovery.backup_counts(native, FilterSet(only=only)).first()) == (3, 1, 1)


def test_roots_that_overlap_are_refused():
    for a, b in (("s3://x/a", "s3://x/a/b"), ("s3://x/a/", "s3://x/a"), ("/d/e", "/d")):
        with pytest.raises(Refused):
            transfer.ensure_apart(a, b)
    transfer.ensure_apart("s3://x/a", "s3://x/ab")


def test_audit_window_as_text(spark):
    log = spark.createDataFrame([("1970-01-01T00:00:10Z",), ("1970-01-03T00:00:00Z",), ("?",)], "time string")
    kept = log.filter(audit.admits(since="1d", now=200_000)).collect()
    assert [r["time"] for r in kept] == ["1970-01-03T00:00:00Z", "?"]
    assert log.filter(audit.admits(until="1970-01-02")).count() == 2
    with pytest.raises(Refused):
        audit.admits(since="soon")
