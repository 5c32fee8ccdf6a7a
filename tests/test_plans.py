import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from objcat.errors import Refused
from objcat.functions.paths import nfc
from objcat.operators import listing
from objcat.plans import compare, recovery, replicate, transfer
from objcat.plans.transfer import Policy


def statuses(src, dst, *args, **kw):
    return {r["path"]: r["status"] for r in compare.check(src, dst, *args, **kw).collect()}


def actions(plan):
    return {r["dest"]: (r["action"], r["reason"]) for r in plan.collect()}


def test_check_by_fields(inventory):
    src = inventory(("m", 1, 10, "A"), ("w", 1, 10, "a"), ("t", 1, 10, "a"), ("z", 1, 10, "a"), ("s", 1, 10, "a"), ("n", None, 10, None), ("u", 1, None, "a"), ("v", 1, None, "a"))
    dst = inventory(("m", 1, 10, "a"), ("w", 1, 11, "a"), ("t", 1, 12, "a"), ("z", 2, 10, "a"), ("d", 1, 10, "a"), ("n", 1, 10, "a"), ("u", 1, 10, "b"), ("v", 2, 10, "a"))
    assert statuses(src, dst) == {
        "m": "match", "w": "match", "t": "differ", "z": "differ", "s": "missing-on-dst",
        "d": "missing-on-src", "n": "error", "u": "error", "v": "differ",
    }
    assert statuses(src, dst, window=2)["t"] == "match"
    assert statuses(src, dst, "size")["u"] == "match"
    assert statuses(src, dst, "checksum")["m"] == "match" and statuses(src, dst, "checksum")["n"] == "error"
    assert "d" not in statuses(src, dst, one_way=True)
    row = compare.check_summary(compare.check(src, dst), "size+mtime").first()
    assert tuple(row) == (9, 2, 3, 1, 1, 2, False)
    with pytest.raises(Refused):
        compare.check(src, dst, "guess")


def test_lost_objects_count_as_missing(spark, inventory):
    keys = spark.createDataFrame([("k1",), ("k1",)], "object_key string")
    rows = [("a", "k1", 1), ("b", "k2", 1), ("c", None, 1)]
    cat = spark.createDataFrame(rows, "path string, object_key string, size long")
    sure = compare.confirm(cat, keys)
    assert {r["path"]: r["object_missing"] for r in sure.collect()} == {"a": False, "b": True, "c": False}
    other = inventory(("a", 1), ("b", 1), ("c", 1))
    assert statuses(sure, other, "size") == {"a": "match", "b": "missing-on-src", "c": "match"}
    assert statuses(other, sure, "size")["b"] == "missing-on-dst"
    assert statuses(sure, inventory(("a", 1)), "size")["b"] == "error"
    assert actions(transfer.copy_plan(other.withColumn("mtime", F.lit(1)), sure.withColumn("mtime", F.lit(1).cast("long"))))["b"] == ("copy", "destination-object-missing")


def test_decisions(inventory):
    src = inventory(("new", 1, 1), ("same", 1, 100), ("size", 1, 100), ("time", 1, 100), ("nosize", None, 100), ("notime", 1, None), ("older", 1, 100))
    dst = inventory(("same", 1, 101), ("size", 2, 100), ("time", 1, 50), ("nosize", 1, 100), ("notime", 1, 5), ("older", 2, 200), ("extra", 1, 1))
    plan = actions(transfer.sync_plan(src, dst))
    assert plan == {
        "new": ("copy", "missing-at-destination"), "same": ("skip", "identical"), "size": ("update", "size-differs"),
        "time": ("update", "modified"), "nosize": ("update", "size-not-recorded"), "notime": ("update", "modified"),
        "older": ("update", "size-differs"), "extra": ("delete", "not-at-source"),
    }
    assert actions(transfer.copy_plan(src, dst, Policy(update=True)))["older"] == ("skip", "destination-newer")
    assert actions(transfer.copy_plan(src, dst, Policy(size_only=True)))["notime"] == ("skip", "identical")
    assert set(actions(transfer.copy_plan(src, dst, Policy(ignore_existing=True))).values()) == {("copy", "missing-at-destination"), ("skip", "exists")}
    assert set(actions(transfer.copy_plan(src, dst, Policy(traverse=False))).values()) == {("copy", "destination-not-listed")}
    with pytest.raises(PySparkException, match="no content hash"):
        transfer.copy_plan(src, dst, Policy(checksum=True)).collect()
    summary = transfer.plan_summary(transfer.sync_plan(src, dst)).first()
    assert tuple(summary) == (1, 5, 1, 1, 0, None)


def test_a_plan_applied_leaves_nothing_to_do(inventory):
    src = inventory(*[(f"d{i % 3}/f{i}", i, 1000 + i, f"h{i}") for i in range(60)])
    dst = inventory(*[(f"d{i % 3}/f{i}", i + (i % 4 == 0), 1000 + i + (i % 5 == 0) * 9, f"h{i}") for i in range(20, 80)])
    plan = transfer.sync_plan(src, dst).cache()
    moved = plan.filter("action IN ('copy', 'update')").select(F.col("source").alias("path"))
    kept = dst.join(plan.filter("action = 'skip'").select(F.col("dest").alias("path")), "path", "left_semi")
    applied = kept.unionByName(src.join(moved, "path", "left_semi"))
    assert set(statuses(src, applied, "checksum").values()) == {"match"}
    assert set(statuses(src, applied).values()) == {"match"}
    assert transfer.sync_plan(src, applied).filter("action <> 'skip'").isEmpty()


def test_directories_and_order(spark):
    def entries(*rows):
        return spark.createDataFrame(list(rows), "path string, size long, mtime long, kind string")

    src = entries(("b", 0, None, "dir"), ("c", 0, None, "dir"), ("a/f", 1, 1, "file"))
    dst = entries(("c", 0, None, "dir"), ("gone", 0, None, "dir"), ("z", 1, 1, "file"))
    plan = transfer.sync_plan(src, dst, Policy(create_empty_dirs=True))
    assert actions(plan) == {"b": ("mkdir", "empty-source-dir"), "c": ("skip", "identical"), "a/f": ("copy", "missing-at-destination"), "z": ("delete", "not-at-source")}
    assert actions(transfer.copy_plan(src, dst))["b"] == ("skip", "missing-at-destination")

    def order(mode):
        return [r["dest"] for r in transfer.order_plan(plan, mode).collect()]

    assert order("before") == ["z", "b", "a/f"] and order("after") == ["b", "a/f", "z"] and order("during") == ["a/f", "b", "z"]
    with pytest.raises(Refused):
        transfer.order_plan(plan, "sometime")


def test_guards(inventory):
    src, dst = inventory(("a", 1, 1)), inventory(*[(f"x{i:02d}", 1, 1) for i in range(12)])
    plan = transfer.sync_plan(src, dst)
    row = transfer.immutable_violations(plan).first()
    assert (row["refused"], row["more"]) == (12, 2) and row["quoted"].startswith("delete x00, delete x01")
    with pytest.raises(Refused):
        transfer.ensure_immutable(plan)
    transfer.ensure_immutable(transfer.copy_plan(src, dst))
    transfer.guard_empty_source(plan)
    emptied = transfer.sync_plan(src.limit(0), dst)
    with pytest.raises(Refused):
        transfer.guard_empty_source(emptied)
    transfer.guard_empty_source(emptied, force=True)
    assert transfer.mass_deletion(plan, dst).first()["alarm"]
    assert not transfer.mass_deletion(transfer.copy_plan(src, dst), dst).first()["alarm"]


def test_budget(inventory):
    plan = transfer.copy_plan(inventory(("a", 5, 1), ("b", 0, 1), ("c", 7, 1), ("d", 1, 1), ("e", 0, 1)), inventory(("b", 0, 1)))
    assert sorted(actions(transfer.apply_budget(plan, 11))) == ["a", "b"]
    assert sorted(actions(transfer.apply_budget(plan, 12))) == ["a", "b", "c"]
    assert sorted(actions(transfer.apply_budget(plan, 13))) == ["a", "b", "c", "d", "e"]


def test_move_and_exact_name(spark, inventory):
    src, dst = inventory(("a", 1, 1), ("b", 2, 1), ("c", 3, 1)), inventory(("c", 3, 1), ("other", 2, 1))
    outcomes = spark.createDataFrame([("a", "success"), ("b", "file_not_found"), ("c", "success")], "path string, result string")
    moved = [(r["action"], r["source"], r["dest"]) for r in transfer.move_plan(src, dst, outcomes).collect()]
    assert sorted(moved) == [("copy", "a", "a"), ("copy", "b", "b"), ("delete", "a", ""), ("skip", "c", "c")]
    row = transfer.copyto_plan(src, dst, "b", "other").first()
    assert (row["action"], row["source"], row["dest"]) == ("skip", "b", "other")
    assert transfer.copyto_plan(src, dst, "b", "fresh").first()["action"] == "copy"


def test_replicate(spark):
    def store(*rows):
        return spark.createDataFrame(list(rows), "object_key string, size long")

    src, dst = store(("a", 1), ("b", 2), ("c", 3)), store(("b", 2), ("c", 4), ("x", 9))
    got = {r["key"]: (r["action"], r["reason"]) for r in replicate.replicate_plan(src, dst).collect()}
    assert got == {"a": ("replicate", "missing-at-destination"), "b": ("skip", "exists"), "c": ("replicate", "size-differs")}
    assert tuple(replicate.replicate_summary(src, dst, "strict").first()) == (3, 2, 1, 0, 4, 6, 1)
    with pytest.raises(Refused):
        replicate.replicate_plan(src, dst, "hope")


# Two names in decomposed form, one of them a folder's; one file without bytes, one deep, one large.
TREE = [
    ("index.csv", 11), ("blank.dat", 0), ("maps/two words.svg", 12), ("maps/tiles/z 3/x7.png", 13),
    ("people/Zo\u00eb.vcf", 14), ("people/Ange\u0301lique.vcf", 15), ("mu\u0308nchen/plan.svg", 16), ("people/\u0416\u0435\u043d\u044f.vcf", 17),
    ("a/b/c/d/e/f/g/h/i/leaf.bin", 18), ("dump.sql", 30_000_000),
]


def test_restore_drill(spark):
    rows = [(p, s, f"h{s}") for p, s in TREE]
    expected = spark.createDataFrame(rows, "path string, size long, hash string")
    actual = expected.withColumn("path", nfc("path"))
    got = [r["status"] for r in compare.compare_manifest(expected, actual).collect()]
    assert sorted(got) == ["identical"] * 8 + ["respelled"] * 2
    damaged = actual.filter("path <> 'index.csv'").withColumn("hash", F.when(F.col("path") == "blank.dat", "bad").otherwise(F.col("hash")))
    damaged = damaged.unionByName(spark.createDataFrame([("new", 1, "x")], "path string, size long, hash string"))
    by_path = {r["path"]: r["status"] for r in compare.compare_manifest(expected, damaged).collect()}
    assert by_path["index.csv"] == "missing" and by_path["blank.dat"] == "differing" and by_path["new"] == "unexpected"


def test_superseded(spark):
    old = spark.createDataFrame([("a", "k1"), ("b", "k2"), ("c", "k3")], "path string, object_key string")
    new = spark.createDataFrame([("a", "k1"), ("b", "k9")], "path string, object_key string")
    assert [tuple(r) for r in compare.superseded(old, new).collect()] == [("b", "k2", "k9")]
    versions = spark.createDataFrame([("a", "k1", 1), ("a", "k2", 2), ("a", "k3", 3), ("b", "j", 1)], "path string, object_key string, version int")
    assert sorted(r["object_key"] for r in compare.superseded_versions(versions).collect()) == ["k1", "k2"]


def test_backup_and_restore(spark, inventory):
    rows = [("ok.txt", 1), ("bad\\name", 2), ("café", 3), ("café", 4), ("naïve", 5), ("../up", 6)]
    native = spark.createDataFrame([(n, s, 1) for n, s in rows], "native string, size long, mtime long")
    plan = [(r["source"], r["dest"]) for r in recovery.backup_plan(native, "v").collect()]
    assert plan == [("naïve", "v/naïve"), ("ok.txt", "v/ok.txt")]
    assert tuple(recovery.backup_counts(native).first()) == (6, 0, 2)

    cat = inventory(("t/a", 1, 1), ("t/b", None, 1), ("t/c", 3, 1), ("u/d", 4, 1))
    existing = spark.createDataFrame([("b",)], "path string")
    findings = spark.createDataFrame([("c", "blocking"), ("a", "portability")], "path string, severity string")
    plan = recovery.restore_plan(cat, existing, findings, "/out/", "r", "t")
    assert [tuple(r) for r in plan.collect()] == [
        ("restore", "r:t/a", "/out/a", 1, None), ("overwrite", "r:t/b", "/out/b", None, "exists"), ("skip", "r:t/c", "/out/c", 3, "blocking"),
    ]
    with pytest.raises(Refused):
        recovery.gate_overwrites(plan)
    with pytest.raises(Refused):
        recovery.gate_overwrites(plan, overwrite=True, immutable=True)
    recovery.gate_overwrites(plan, overwrite=True)
    assert listing.size_totals(plan.select("size")).first()["unmeasured"] == 1


def test_a_field_a_table_lacks_is_unknown(spark, inventory):
    bare = spark.createDataFrame([("a", 1), ("b", 2)], "path string, size long")
    full = inventory(("a", 1, 5, "h"), ("b", 3, 5, "h"))
    assert statuses(bare, full) == {"a": "error", "b": "differ"}
    assert statuses(bare, full, "size") == {"a": "match", "b": "differ"}
    assert actions(transfer.copy_plan(bare, full))["a"] == ("update", "modified")
