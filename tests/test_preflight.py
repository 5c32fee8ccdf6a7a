import pytest

from objcat.errors import Refused
from objcat.operators import preflight


def test_names(inventory):
    inv = inventory(("con.txt",), ("d/a:b",), ("dot./x",), ("t\tb",), ("fine/COM10.txt",), ("com1",), ("end ",), ("x/nul.tar.gz",))
    got = sorted((r["path"], r["issue"], r["detail"]) for r in preflight.name_issues(inv).collect())
    assert got == [
        ("com1", "reserved", "COM1"), ("con.txt", "reserved", "CON"), ("d/a:b", "illegal-char", ":"), ("dot./x", "trailing", ""),
        ("end ", "trailing", ""), ("t\tb", "control", "U+0009"), ("x/nul.tar.gz", "reserved", "NUL"),
    ]


def test_collisions(spark, inventory):
    inv = inventory(("A.txt",), ("a.txt",), ("a.TXT",), ("x",), ("x/y",), ("x/z/w",), ("b",))
    assert sorted((r["path"], r["first"]) for r in preflight.case_collisions(inv).collect()) == [("a.TXT", "A.txt"), ("a.txt", "A.txt")]
    assert sorted((r["path"], r["ancestor"]) for r in preflight.type_conflicts(inv).collect()) == [("x/y", "x"), ("x/z/w", "x")]
    names = spark.createDataFrame([("café",), ("café",), ("plain",), ("ü",)], "native string")
    assert [tuple(r) for r in preflight.nfc_collisions(names).collect()] == [("café", 2)]
    assert sorted(r["native"] for r in preflight.collision_members(names).collect()) == ["café", "café"]


def test_findings(spark, inventory):
    inv = inventory(("A.txt",), ("a.txt",), ("con",), ("t\tb",), ("x",), ("x/y",), ("l" * 261,))
    found = preflight.preflight(inv, names=spark.createDataFrame([("é",), ("é",)], "native string")).collect()
    assert [(r["path"][:5], r["problem"], r["severity"]) for r in found] == [
        ("a.txt", "case-collision", "portability"), ("con", "illegal-name", "portability"), ("lllll", "path-too-long", "portability"),
        ("t\tb", "illegal-name", "blocking"), ("x/y", "directory-file-conflict", "blocking"), ("é", "normalisation-collision", "blocking"),
    ]
    here = preflight.preflight(inv, audience="here", windows=True)
    assert {r["path"] for r in preflight.blocked_paths(here).collect()} == {"a.txt", "con", "l" * 261, "t\tb", "x/y"}
    assert preflight.preflight(inventory(("short",)), root="/" + "r" * 254).first()["problem"] == "path-too-long"
    with pytest.raises(Refused):
        preflight.severity("problem", "issue", "everyone")


def test_links_and_specials(spark):
    df = spark.createDataFrame([("unread",), ("missing",), ("inside",), ("outside",)], "t string")
    rows = df.select(*[preflight.link_verdict(p, "t") for p in preflight.LINK_POLICIES]).collect()
    assert [tuple(r) for r in rows] == [
        ("not-followed", "not-followed", "not-followed"), ("not-followed", "broken", "broken"),
        ("not-followed", "followed", "followed"), ("not-followed", "followed", "out-of-tree"),
    ]
    modes = spark.createDataFrame([(0o10644,), (0o140755,), (0o20666,), (0o60660,), (0o100644,), (0o40755,), (0o120777,), (0o644,)], "m int")
    assert [r[0] for r in modes.select(preflight.special_kind("m")).collect()] == ["fifo", "socket", "char-device", "block-device", None, None, None, "unknown"]
    names = spark.createDataFrame([("a",), ("a/b",), ("..",)], "name string")
    assert tuple(preflight.unrepresentable(names).first()) == (3, 2)
