import pytest

from objcat.errors import Refused
from objcat.operators import listing
from objcat.operators.filters import FilterSet
from objcat.schema import as_inventory, catalog_inventory

ROWS = [("a.txt", 3), ("d/b.txt", 4), ("d/e/c.txt", None), ("d/e/f/g", 10), ("h/i", 0)]


def test_byte_order(inventory):
    names = ["a", "a-b", "a/b", "a/z", "a/é", "\uffee", "\U0001f600"]
    got = [r["path"] for r in listing.ls(inventory(*[(n,) for n in reversed(names)])).collect()]
    assert got == names


def test_unknown_is_null_and_nothing_is_zero(inventory):
    some = listing.size_totals(inventory(*ROWS)).first()
    assert tuple(some) == (5, None, 17, 1)
    assert tuple(listing.size_totals(inventory(("x", 1)).limit(0)).first()) == (0, 0, 0, 0)
    usage = {r["remote"]: r["bytes"] for r in listing.usage(inventory(*ROWS).selectExpr("split(path, '/')[0] AS remote", "size")).collect()}
    assert usage == {"a.txt": 3, "d": None, "h": 0}
    with pytest.raises(Refused):
        listing.usage(inventory(*ROWS), "guessed")


def test_roll_up(inventory):
    inv = inventory(*ROWS)
    assert [tuple(r) for r in listing.lsd(inv, None).collect()] == [("d", 3, None), ("d/e", 2, None), ("d/e/f", 1, 10), ("h", 1, 0)]
    assert [r["path"] for r in listing.lsd(inv, 1).collect()] == ["d", "h"]
    assert [tuple(r) for r in listing.lsd(inv.filter("path LIKE 'd/%'"), 1, root="d").collect()] == [("d/e", 2, None)]
    dirs = {r["dir"]: r["objects"] for r in listing.infer_dirs(inv).collect()}
    assert dirs == {"d": 3, "d/e": 2, "d/e/f": 1, "h": 1}


def test_parents_come_before_children_and_siblings_in_order(inventory):
    inv = inventory(("a/x",), ("a-b/x",), ("a/c/x",))
    assert [r["path"] for r in listing.lsd(inv, None).collect()] == ["a", "a/c", "a-b"]


def test_tree(inventory):
    nodes = {r["path"]: r for r in listing.tree(inventory(*ROWS)).collect()}
    assert nodes["d"]["bytes"] is None and nodes["d/e/f"]["bytes"] == 10 and not nodes["a.txt"]["is_dir"]
    assert [nodes[p]["position"] for p in ("a.txt", "d", "h")] == [1, 2, 3] and nodes["h"]["is_last"]
    cut = {r["path"]: r["is_dir"] for r in listing.tree(inventory(*ROWS), level=2).collect()}
    assert cut == {"a.txt": False, "d": True, "d/b.txt": False, "d/e": True, "h": True, "h/i": False}
    only = listing.tree(inventory(*ROWS), dirs_only=True)
    assert sorted(r["path"] for r in only.collect()) == ["d", "d/e", "d/e/f", "h"]
    assert tuple(listing.tree_counts(listing.tree(inventory(*ROWS))).first()) == (4, 5)
    clash = listing.tree(inventory(("x", 1), ("x/y", 2))).orderBy("path").collect()
    assert [(r["path"], r["is_dir"], r["bytes"]) for r in clash] == [("x", False, 3), ("x/y", False, 2)]


def test_listings_agree(inventory):
    inv = inventory(*[(f"t{i % 3}/u{i % 5}/f{i}", i) for i in range(100)])
    total = listing.size_totals(inv).first()["bytes"]
    top = listing.lsd(inv, 1).collect()
    assert sum(r["bytes"] for r in top) == total
    drawn = listing.tree(inv, level=1).collect()
    assert {r["path"]: r["bytes"] for r in drawn} == {r["path"]: r["bytes"] for r in top}
    assert listing.ls(inv).agg({"size": "sum"}).first()[0] == total


def test_one_directory(inventory):
    inv = inventory(*ROWS)
    assert [r["path"] for r in listing.children(inv, "d").collect()] == ["d/b.txt"]
    assert [r["path"] for r in listing.children(inv, "").collect()] == ["a.txt"]
    assert [r["dir"] for r in listing.child_dirs(inv, "").collect()] == ["d", "h"]
    assert [r["dir"] for r in listing.child_dirs(inv, "d").collect()] == ["d/e"]
    assert listing.has_dir(inv, "d/e").first()["exists"] and not listing.has_dir(inv, "d/b").first()["exists"]
    assert listing.stat(inv, "h/i").count() == 1 and listing.stat(inv, "h").count() == 0


def test_catalog(spark):
    rows = [("a", "k1", 0, 1, ""), ("b", "k2", 0, 1, "h"), ("c", "k3", 7, 1, "h")]
    cat = spark.createDataFrame(rows, "path string, object_key string, size long, mtime long, hash string")
    assert tuple(listing.catalog_totals(cat).first()) == (3, 7, 1, None)
    assert tuple(listing.catalog_totals(cat.filter("path <> 'a'")).first()) == (2, 7, 0, 7)
    assert {r["path"]: r["size"] for r in catalog_inventory(cat).collect()} == {"a": None, "b": 0, "c": 7}
    adapted = as_inventory(cat, "path").first()
    assert adapted["size"] is None and adapted["object_missing"] is False


def test_reports_are_bounded_and_say_so(spark):
    verdicts = ["followed", "broken", "not-followed", "cycle"]
    df = spark.createDataFrame([(f"p{i:03d}", verdicts[i % 4]) for i in range(100)], "path string, verdict string")
    row = listing.link_report(df).first()
    assert (row["followed"], row["skipped"], row["broken"], row["unnamed"], len(row["notes"])) == (25, 50, 25, 36, 64)
    assert row["notes"][0]["path"] == "p000"
    special = spark.createDataFrame([("a", "fifo"), ("b", None)], "path string, kind string")
    row = listing.special_report(special).first()
    assert (row["skipped"], row["unnamed"], len(row["notes"])) == (1, 0, 1)


def test_seen_and_matched(inventory):
    row = listing.listing_stats(inventory(*ROWS), FilterSet.build(include=["*.txt"], now=0)).first()
    assert tuple(row) == (5, 3)


def test_a_crowded_directory_is_numbered_in_pieces(inventory):
    inv = inventory(*[(f"crowd/f{i:04d}", 1) for i in range(400)], *[(f"d{i % 9}/g{i}", 1) for i in range(60)])
    rows = listing.tree(inv).collect()
    crowd = [(r["name"], r["position"], r["is_last"]) for r in rows if r["parent"] == "crowd"]
    assert len(rows) == 470 and sorted(crowd) == [(f"f{i:04d}", i + 1, i == 399) for i in range(400)]
