import pytest

from objcat.errors import Refused
from objcat.operators import removal
from objcat.operators.filters import FilterSet

MARK = ".objcat-dir"
ROWS = [("only/" + MARK, 0), ("gone/" + MARK, 0), ("gone/a.txt", 3), ("busy/" + MARK, 0), ("busy/a.txt", None), ("busy/b.log", 5), ("gone/deep/x/" + MARK, 0)]


def items(df):
    return [(r["path"], r["kind"]) for r in df.collect()]


def test_delete_takes_only_the_markers_it_empties(inventory):
    inv = inventory(*ROWS)
    filters = FilterSet.build(include=["*.txt"], now=0)
    assert sorted(items(removal.select_delete(inv, "", filters))) == [("busy/a.txt", "object"), ("gone/a.txt", "object")]
    with_dirs = items(removal.select_delete(inv, "", filters, rmdirs=True))
    assert with_dirs == [("busy/a.txt", "object"), ("gone/a.txt", "object"), ("gone/" + MARK, "directory")]
    inside = items(removal.select_delete(inv, "gone", filters, rmdirs=True))
    assert inside == [("gone/a.txt", "object")]


def test_exact_object(inventory):
    inv = inventory(*ROWS)
    assert items(removal.select_deletefile(inv, "busy/b.log")) == [("busy/b.log", "object")]
    for path in ("busy", "nowhere"):
        with pytest.raises(Refused):
            removal.select_deletefile(inv, path)


def test_purge(inventory):
    inv = inventory(*ROWS)
    assert items(removal.select_purge(inv, "gone")) == [("gone/a.txt", "object"), ("gone/deep/x/" + MARK, "directory"), ("gone/" + MARK, "directory")]
    with pytest.raises(Refused):
        removal.select_purge(inv, "nowhere")


def test_rmdir(inventory):
    inv = inventory(*ROWS)
    assert items(removal.select_rmdir(inv, "only")) == [("only/" + MARK, "directory")]
    assert items(removal.select_rmdir(inv, "gone/deep/x")) == [("gone/deep/x/" + MARK, "directory")]
    for path, word in (("busy", "busy/a.txt"), ("gone/deep", "gone/deep/x"), ("nowhere", "not exist")):
        with pytest.raises(Refused, match=word):
            removal.select_rmdir(inv, path)


def test_rmdirs(inventory):
    inv = inventory(*ROWS)
    assert items(removal.select_rmdirs(inv)) == [("gone/deep/x/" + MARK, "directory"), ("only/" + MARK, "directory")]
    assert items(removal.select_rmdirs(inv, "only", leave_root=True)) == []


def test_debris_ages(spark, inventory):
    now, day = 1_000_000, 86400
    rows = [(f"d/.objcat-staging.{i}", 1, t) for i, t in enumerate([now - day + 1, now - day, now - day - 1, None, now + 50])]
    inv = inventory(*rows, ("d/report.tmp.2024.csv", 1, 0))
    got = {r["path"][-1]: (r["status"], r["reason"]) for r in removal.debris_staging(inv, now).collect()}
    assert got == {"0": ("held", "too-young"), "1": ("reclaim", None), "2": ("reclaim", None), "3": ("held", "age-unknown"), "4": ("held", "too-young")}
    uploads = spark.createDataFrame([("a/k", "u1", 0), ("b/k", "u2", 0)], "object_key string, upload_id string, started long")
    row = removal.debris_multipart(uploads, now, scope="a").collect()
    assert [(r["path"], r["size"], r["kind"]) for r in row] == [("a/k", None, "multipart")]


def test_orphans_need_a_complete_catalog(spark):
    objects = spark.createDataFrame([("k1", 1, 0), ("k2", 2, 0)], "object_key string, size long, mtime long")
    cat = spark.createDataFrame([("a", "k1")], "path string, object_key string")
    assert [r["path"] for r in removal.debris_orphans(objects, cat, cat, 10**6).collect()] == ["k2"]
    with pytest.raises(Refused):
        removal.debris_orphans(objects, cat, cat.union(cat), 10**6)


def test_totals(spark):
    rows = [("removed", 5), ("removed", None), ("would-remove", 7), ("absent", 1), ("failed", None), ("held", 9), ("held", None)]
    row = removal.removal_totals(spark.createDataFrame(rows, "status string, size long")).first()
    assert tuple(row) == (2, 1, 1, 1, 2, 9, None, 12, 1)
