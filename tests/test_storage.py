import json
from concurrent.futures import ThreadPoolExecutor

import pytest

from objcat.errors import Refused
from objcat.operators.listing import children
from objcat.plans import compare, transfer
from objcat.sources import commits, listing, records, sinks


def test_object_listing(spark, tmp_path):
    names = {"a.txt": "abc", "d/e/f g%.bin": "", "d/é.txt": "xy", "d/.hidden": "1", "_x/y": "12"}
    for name, body in names.items():
        place = tmp_path / "root" / name
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_text(body)
    (tmp_path / "root" / "d" / "loop").symlink_to(tmp_path / "root")
    found = listing.scan_objects(spark, str(tmp_path / "root"))
    assert {r["path"]: r["size"] for r in found.collect()} == {n: len(b) for n, b in names.items()}
    assert all(r["mtime"] > 1_600_000_000 for r in found.collect())
    flat = listing.scan_objects(spark, f"file://{tmp_path}/root", recursive=False)
    assert [r["path"] for r in flat.collect()] == ["a.txt"]


def test_catalog_rebuild(spark, tmp_path):
    names = spark.createDataFrame([("a", "k1"), ("b", "k2")], "path string, object_key string")
    headers = spark.createDataFrame([("k1", 5, 9, "h")], "object_key string, size long, mtime long, hash string")
    catalog, rebuilt = listing.rebuild_catalog(names, headers)
    assert tuple(rebuilt.first()) == (2, 1, 1)
    place = str(tmp_path / "catalog")
    catalog.write.parquet(place)
    assert {r["path"]: r["size"] for r in listing.read_catalog(spark, place).collect()} == {"a": 5, "b": None}


def test_path_list(spark, tmp_path):
    place = tmp_path / "list.txt"
    place.write_text("# head\n\n a/b \n; note\na//b\nc\\d\n/\n")
    assert sorted(r["path"] for r in listing.read_path_list(spark, str(place)).collect()) == ["a/b", "c/d"]
    place.write_text("a\n\nb/../c\n../d\n")
    with pytest.raises(Refused, match="line 3"):
        listing.read_path_list(spark, str(place))


def test_lines_keep_their_numbers_across_splits(spark, tmp_path):
    place = tmp_path / "long.txt"
    place.write_text("".join(f"line {i}\n" if i % 7 else "\n" for i in range(1, 5001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = listing.numbered_lines(spark, str(place))
        assert lines.rdd.getNumPartitions() >= 1
        rows = lines.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 5000 and all(r["value"] == (f"line {r['line']}" if r["line"] % 7 else "") for r in rows)
    filled = sorted((r["line"], r["pos"]) for r in rows if r["value"])
    assert [p for _, p in filled] == list(range(len(filled)))


def test_manifest(spark, tmp_path):
    df = spark.createDataFrame([("a b", "a" * 64), ("c", "B" * 64)], "path string, hash string")
    for binary in (False, True):
        place = str(tmp_path / f"m{binary}")
        records.write_manifest(df, place, binary)
        back = {r["path"]: r["hash"] for r in records.read_manifest(spark, place).collect()}
        assert back == {"a b": "a" * 64, "c": "B" * 64}
    (tmp_path / "bad.txt").write_text("zz  x\nnothing\n")
    assert sorted(r["problem"] for r in records.read_manifest(spark, str(tmp_path / "bad.txt")).collect()) == ["malformed-digest", "malformed-line"]
    with pytest.raises(Refused):
        records.read_manifest(spark, "x", "crc32")


def test_listing_json(spark, inventory):
    row = records.lsjson(inventory(("d/a", None, -1, ""), ), "d").first()
    assert row.asDict() == {"Path": "a", "Name": "a", "Size": None, "ModTime": "1969-12-31T23:59:59Z", "IsDir": False, "Hashes": {}}


def test_check_lists(spark, inventory, tmp_path):
    result = compare.check(inventory(("a", 1, 1), ("b", 1, 1), ("e", None, 1)), inventory(("a", 1, 1), ("c", 1, 1), ("e", 1, 1)))
    sinks.write_check(result, combined=str(tmp_path / "all"), match=str(tmp_path / "m"), missing_on_dst=str(tmp_path / "d"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "all")).collect()) == ["! e", "+ b", "- c", "= a"]
    assert [r[0] for r in spark.read.text(str(tmp_path / "m")).collect()] == ["a"]
    with pytest.raises(Refused):
        sinks.write_check(result, match=str(tmp_path / "x"), differ=str(tmp_path / "x") + "/")
    with pytest.raises(Refused):
        sinks.write_check(result, error=str(tmp_path / "x"))


def test_plan_documents(spark, inventory, tmp_path):
    plan = transfer.sync_plan(inventory(("a", None, 1), ("b", 1, 1)), inventory(("b", 1, 1), ("c", 1, 1)))
    sinks.write_plan(plan, str(tmp_path / "p"))
    rows = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "p" / "actions")).collect()]
    assert {r["dest"]: r["size"] for r in rows} == {"a": None, "c": 1}


def test_verified_write(spark, inventory, tmp_path, monkeypatch):
    place = str(tmp_path / "table")
    first = sinks.verified_write(inventory(("a", 1), ("b", None)), place)
    assert (first.rows, first.bytes) == (2, 1)
    sinks.verified_write(inventory(("c", 5)), place)
    assert sorted(r["path"] for r in sinks.read_verified(spark, place, check=True).collect()) == ["a", "b", "c"]
    sinks.verified_write(inventory(("d", 5)), place, mode="overwrite")
    assert [r["path"] for r in sinks.read_verified(spark, place).collect()] == ["d"]

    real = sinks.stored_figures
    monkeypatch.setattr(sinks, "stored_figures", lambda table, *a: real(table.limit(0), *a))
    with pytest.raises(Refused, match="nothing was published"):
        sinks.verified_write(inventory(("e", 5)), place)
    monkeypatch.undo()
    assert [r["path"] for r in sinks.read_verified(spark, place).collect()] == ["d"]

    live = sinks.read_verified(spark, place).inputFiles()[0].removeprefix("file:")
    table = spark.createDataFrame([("d", 6, None, None)], "path string, size long, mtime long, hash string")
    table.write.mode("append").parquet(live.rsplit("/", 1)[0])
    with pytest.raises(Refused, match="no longer holds"):
        sinks.read_verified(spark, place, check=True)


def test_two_writers_lose_nothing_and_folds_keep_order(spark, inventory, tmp_path, monkeypatch):
    place = str(tmp_path / "table")
    log = commits.CommitLog(spark, f"{place}/log")
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(lambda n: log.append({"n": n}), range(24)))
    assert sorted(numbers) == list(range(24)) == log.numbers()
    assert not log.claim(5, {"n": "late"}) and log.last()[0] == 23

    # The clock runs back, and more commits are made than one fold holds.
    clock = iter(range(100, 0, -1))
    monkeypatch.setattr(sinks.datetime, "datetime", type("Clock", (), {"now": staticmethod(lambda tz: _At(next(clock)))}))
    for n in range(23):
        sinks.verified_write(inventory((f"p{n}", n)), place, mode="overwrite" if n in (0, 4, 12) else "append")
    assert sorted(r["path"] for r in sinks.read_verified(spark, place, check=True).collect()) == sorted(f"p{n}" for n in range(12, 23))
    kept = commits.CommitLog(spark, f"{place}/commits")
    fold, after = kept.tail()
    assert [n for n, _ in after] == [20, 21, 22] and len(fold["live"]) == 8 and len(kept.numbers()) == 13


class _At:
    def __init__(self, n):
        self.n = n

    def isoformat(self):
        return f"{self.n:05}"


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_directory_is_found_by_statistics(spark, tmp_path):
    rows = [(f"d{i % 50}/f{i}", f"k{i}", i + 1, 1, "h") for i in range(2000)]
    catalog = spark.createDataFrame(rows, "path string, object_key string, size long, mtime long, hash string")
    sinks.write_catalog(catalog, str(tmp_path / "c"))
    found = children(listing.read_catalog(spark, str(tmp_path / "c")), "d7").select("path", "size")
    assert found.count() == 40 and "EqualTo(parent,d7)" in plan_text(found)
    assert "ReadSchema: struct<path:string,size:bigint,hash:string,parent:string>" in plan_text(found)


def test_bucketed_inventories_are_compared_in_place(spark, inventory, tmp_path):
    inv = inventory(*[(f"d{i % 9}/f{i}", i, i) for i in range(500)])
    spark.sql(f"CREATE DATABASE IF NOT EXISTS kept LOCATION '{tmp_path}/kept'")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("kept.src", "kept.dst"):
            sinks.save_inventory(inv, name, 4)
        result = compare.check(spark.table("kept.src"), spark.table("kept.dst"))
        assert "Exchange" not in plan_text(result)
        assert {r["status"] for r in result.collect()} == {"match"}
        assert "Exchange" not in plan_text(transfer.sync_plan(spark.table("kept.src"), spark.table("kept.dst")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP DATABASE kept CASCADE")
