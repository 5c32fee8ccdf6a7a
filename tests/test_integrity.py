import hashlib

import pytest

from objcat.errors import Refused
from objcat.operators import chunks, integrity


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def verdicts(spark):
    catalog = [("a", "k1", 3, sha("abc").upper()), ("b", "k2", 3, sha("xyz")), ("c", "k3", 3, sha("abc")), ("d", "k4", 3, sha("abc")), ("e", "k5", 0, ""), ("f", "k6", 4, sha("abc")), ("g", "k7", 0, sha(""))]
    store = [("k1", b"abc"), ("k2", b"abc"), ("k4", None), ("k5", b"abc"), ("k6", b"abc"), ("k7", b"")]
    cat = spark.createDataFrame(catalog, "path string, object_key string, size long, hash string")
    return integrity.verify(cat, spark.createDataFrame(store, "object_key string, content binary"))


def test_verify(verdicts):
    got = {r["path"]: (r["status"], r["size"]) for r in verdicts.collect()}
    assert got == {"a": ("ok", 3), "b": ("corrupt", 3), "c": ("missing", 3), "d": ("unreadable", 3), "e": ("unverifiable", None), "f": ("corrupt", 4), "g": ("ok", 0)}
    row = integrity.verify_summary(verdicts).first()
    assert (row["examined"], row["verified"], row["failed"], row["bytes"], row["unmeasured"], row["worst"], row["outcome"]) == (7, 2, 5, None, 1, "corrupt", "failed")


def test_an_empty_run_is_not_a_pass(verdicts):
    nothing = verdicts.limit(0)
    row = integrity.verify_summary(nothing).first()
    assert (row["bytes"], row["worst"], row["outcome"]) == (0, "ok", "unverified")
    with pytest.raises(Refused):
        integrity.ensure_verified(nothing)


def test_stopping(verdicts):
    def shown(df):
        return sorted(r["path"] for r in df.collect())

    assert shown(integrity.fail_fast(verdicts)) == ["a", "b"]
    assert shown(integrity.error_budget(verdicts, 3)) == ["a", "b", "c", "d"]
    assert shown(integrity.error_budget(verdicts, 0)) == shown(integrity.error_budget(verdicts, 9)) == list("abcdefg")


def test_scrub(spark, verdicts):
    inv = spark.createDataFrame([(f"p{i}", 1) for i in range(2000)], "path string, size long")
    some = {r["path"] for r in integrity.scrub_sample(inv, 30, 5).collect()}
    assert 450 < len(some) < 750
    assert some == {f"p{i}" for i in range(2000) if int(hashlib.md5(f"5:p{i}".encode()).hexdigest()[:8], 16) % 100 < 30}
    assert some < {r["path"] for r in integrity.scrub_sample(inv, 60, 5).collect()}
    assert integrity.scrub_sample(inv, 100, 5).count() == 2000
    for percent in (0, 101):
        with pytest.raises(Refused):
            integrity.scrub_sample(inv, percent, 5)

    def grade(df):
        return integrity.scrub_report(verdicts.select("path", "size"), df).first()

    assert grade(verdicts)["health"] == "damaged"
    assert grade(verdicts.filter("status = 'ok'"))["health"] == "healthy"
    assert grade(verdicts.filter("path IN ('a', 'b')").selectExpr("*", "true AS repaired"))["health"] == "degraded"
    empty = grade(verdicts.limit(0))
    assert (empty["health"], empty["skipped"], empty["bytes"]) == ("unverified", 7, 0)


def test_recorded_digests_are_used(spark):
    df = spark.createDataFrame([("a", b"abc", "known"), ("b", b"abc", None)], "path string, content binary, known string")
    assert {r["path"]: r["hash"] for r in integrity.hashsum(df, recorded="known").collect()} == {"a": "known", "b": sha("abc")}
    assert {r["path"]: r["hash"] for r in integrity.hashsum(df, algo="blake3", recorded="known").collect()} == {"a": "known", "b": None}
    with pytest.raises(Refused):
        integrity.hashsum(df, algo="blake3")


SIZES = {"zero": 0, "one": 1, "less": 4095, "full": 4096, "more": 4097, "three": 3 * 4096}


@pytest.fixture(scope="module")
def objects(spark):
    return spark.createDataFrame(list(SIZES.items()), "object_key string, size long")


def test_chunk_grid(spark, objects):
    rows = chunks.chunk_grid(objects, 4096).collect()
    count = {k: sum(r["object_key"] == k for r in rows) for k in SIZES}
    assert count == {"zero": 0, "one": 1, "less": 1, "full": 1, "more": 2, "three": 3}
    assert all(sum(r["length"] for r in rows if r["object_key"] == k) == s for k, s in SIZES.items())
    last = [r for r in rows if r["object_key"] == "more" and r["chunk"] == 1][0]
    assert (last["offset"], last["length"], last["stored_offset"], last["stored_length"]) == (4096, 1, 4112, 17)
    whole = {tuple(r) for r in rows}
    assert {tuple(r) for r in chunks.chunk_grid(objects, 4096, block=2).collect()} == whole
    assert chunks.clamp_chunk(1) == 4096 and chunks.clamp_chunk(10**9) == 16 << 20 and chunks.clamp_chunk(None) == 1 << 20


def test_chunk_span(spark, objects):
    asked = [("three", 0, 1), ("three", 4095, 2), ("three", 100, None), ("three", 99999, 5), ("three", 4096, 10**9), ("zero", 0, 5), ("three", 5, 0)]
    requests = spark.createDataFrame(asked, "object_key string, offset long, length long")
    got = {(r["offset"], r["length"], r["object_key"]): tuple(r)[3:] for r in chunks.chunk_span(requests, objects, 4096).collect()}
    assert got[(0, 1, "three")] == (0, 1, 0, 4112, 0, 1)
    assert got[(4095, 2, "three")] == (0, 2, 0, 8224, 4095, 2)
    assert got[(100, None, "three")] == (0, 3, 0, 3 * 4112, 100, 3 * 4096 - 100)
    assert got[(4096, 10**9, "three")] == (1, 2, 4112, 8224, 0, 8192)
    assert got[(99999, 5, "three")] == got[(0, 5, "zero")] == got[(5, 0, "three")] == (0, 0, 0, 0, 0, 0)


def test_samples_and_runs(spark):
    objects = spark.createDataFrame([("a", 100 * 4096), ("b", 5), ("c", 0), ("d", 2 * 4096)], "object_key string, size long")
    sample = integrity.sample_chunks(objects, 10, 3, 4096)
    picks = {}
    for r in sample.collect():
        picks.setdefault(r["object_key"], []).append(r["chunk"])
    assert len(picks["a"]) == len(set(picks["a"])) == 12 and {0, 99} <= set(picks["a"])
    assert picks["b"] == [0] and sorted(picks["d"]) == [0, 1] and "c" not in picks
    again = {(r["object_key"], r["chunk"]) for r in integrity.sample_chunks(objects, 10, 3, 4096).collect()}
    assert again == {(k, c) for k, v in picks.items() for c in v}
    rows = spark.createDataFrame([("o", c) for c in (0, 1, 2, 3, 4, 7, 9, 10)], "object_key string, chunk long")
    assert sorted((r["first"], r["count"]) for r in chunks.coalesce_runs(rows, 3).collect()) == [(0, 3), (3, 2), (7, 1), (9, 2)]


def test_lengths(spark):
    rows = [("a", 0, 4096, 10, 999), ("b", 4097, 4096, 10, 10 + 4097 + 32), ("c", 4097, 4096, 10, 10 + 4097 + 64), ("d", 4097, 4096, 10, 4139 + 1)]
    df = spark.createDataFrame(rows, "object_key string, size long, chunk_size long, payload_start long, stored_size long")
    assert {r["object_key"]: r["ok"] for r in integrity.confirm_length(df).collect()} == {"a": True, "b": True, "c": True, "d": False}
    plan = spark.createDataFrame([("x", 5), ("y", None), ("z", 3)], "dest string, size long")
    landed = spark.createDataFrame([("x", 4), ("y", 9), ("z", 3)], "path string, size long")
    assert [tuple(r) for r in integrity.confirm_restored(plan, landed).collect()] == [("x", 5, 4)]


def test_slices(spark):
    df = spark.createDataFrame([("p", b"0123456789"), ("q", b"")], "path string, content binary")

    def cut(**kw):
        return [bytes(r["content"]) for r in chunks.cat(df, **kw).orderBy("path").collect()]

    assert cut() == [b"0123456789", b""]
    assert cut(head=3) == [b"012", b""] and cut(tail=4) == [b"6789", b""] and cut(tail=99) == [b"0123456789", b""]
    assert cut(offset=8) == [b"89", b""] and cut(offset=99) == [b"", b""] and cut(offset=-3, count=2) == [b"78", b""]
    assert cut(tail=0) == [b"", b""] and cut(count=2) == [b"01", b""]
    for bad in ({"head": 1, "tail": 1}, {"head": 1, "offset": 1}, {"tail": 1, "count": 1}, {"head": -1}):
        with pytest.raises(Refused):
            chunks.resolve_slice("size", **bad)


def test_run_summary(spark):
    rows = [("a", "copy", "success", 10, 10, 1000), ("b", "update", "checksum_mismatch", 30, 0, 1000), ("c", "delete", "success", 5, 0, 0), ("d", "skip", "success", 5, 0, 0)]
    df = spark.createDataFrame(rows, "path string, action string, result string, size long, bytes long, elapsed_ms long")
    assert tuple(chunks.run_summary(df).first()) == (1, 10, 1, 1, 1, 1, 0, 25.0, 5.0)
    still = chunks.run_summary(df.filter("action = 'skip'")).first()
    assert still["percent"] is None and still["average_rate"] is None


def test_a_huge_object_is_spread_before_it_is_expanded(spark):
    one = spark.createDataFrame([("huge", 4096 * 5000)], "object_key string, size long")
    grid = chunks.chunk_grid(one, 4096, block=100)
    assert grid.count() == 5000
    per_task = [n for n in grid.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(per_task) > 1 and max(per_task) < 5000


def test_a_cut_run_reads_bodies_once(spark):
    catalog = spark.createDataFrame([(f"p{i}", f"k{i}", 1, hashlib.sha256(b"x").hexdigest()) for i in range(6)], "path string, object_key string, size long, hash string")
    store = spark.createDataFrame([(f"k{i}", b"x" if i != 3 else b"y") for i in range(6)], "object_key string, content binary")
    cut = integrity.fail_fast(integrity.verify(catalog, store))
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "sha2" not in plan and "Join" not in plan
    assert sorted((r["path"], r["status"]) for r in cut.collect()) == [("p0", "ok"), ("p1", "ok"), ("p2", "ok"), ("p3", "corrupt")]
