import random
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from objcat.errors import PatternError, Refused
from objcat.operators.filters import FilterSet, Rule
from objcat.operators.globs import glob_match
from objcat.operators.rule_index import RuleIndex


def matches(pattern: str, text: str) -> bool:
    """A plain matcher: tries every way to read the pattern against the text."""

    def split_choice(p):
        depth, parts, start, i = 0, [], 1, 0
        while i < len(p):
            c = p[i]
            if c == "\\":
                i += 1
            elif c == "[":
                end = p.index("]", i + (3 if p[i + 1] in "!^" else 2))
                i = end
            elif c == "{":
                depth += 1
            elif c == "," and depth == 1:
                parts.append(p[start:i])
                start = i + 1
            elif c == "}":
                depth -= 1
                if depth == 0:
                    return [*parts, p[start:i]], p[i + 1 :]
            i += 1
        raise AssertionError(p)

    @lru_cache(None)
    def go(p: str, t: str) -> bool:
        if not p:
            return not t
        if p.startswith("**"):
            return go(p[2:], t) or (bool(t) and go(p, t[1:]))
        if p[0] == "*":
            return go(p[1:], t) or (bool(t) and t[0] != "/" and go(p, t[1:]))
        if p[0] == "?":
            return bool(t) and t[0] != "/" and go(p[1:], t[1:])
        if p[0] == "{":
            options, rest = split_choice(p)
            return any(go(o + rest, t) for o in options)
        if p[0] == "[":
            negated = p[1] in "!^"
            start = 2 if negated else 1
            end = p.index("]", start + 1)
            body, hit, i = p[start:end], False, 0
            while i < len(body):
                if i + 2 < len(body) and body[i + 1] == "-":
                    hit |= bool(t) and body[i] <= t[0] <= body[i + 2]
                    i += 3
                else:
                    hit |= bool(t) and body[i] == t[0]
                    i += 1
            return bool(t) and t[0] != "/" and hit != negated and go(p[end + 1 :], t[1:])
        if p[0] == "\\":
            return bool(t) and t[0] == p[1] and go(p[2:], t[1:])
        return bool(t) and t[0] == p[0] and go(p[1:], t[1:])

    return go(pattern, text)


def test_random_globs_agree_with_a_plain_matcher(spark):
    rng = random.Random(11)
    pieces = ["a", "b", "/", "*", "**", "?", "[ab]", "[!a]", "[a-c]", "[,-1]", "{a,b/}", "{,ab}", "{a*,{b,c}?}", ".", "\\*", "-"]
    patterns = sorted({"".join(rng.choices(pieces, k=rng.randint(1, 6))) for _ in range(150)})
    texts = sorted({"".join(rng.choices("abc/.-*", k=rng.randint(0, 7))) for _ in range(200)})
    df = spark.createDataFrame([(t,) for t in texts], "t string").cache()
    for chunk in range(0, len(patterns), 30):
        part = patterns[chunk : chunk + 30]
        rows = df.select("t", *[glob_match("t", p).alias(str(i)) for i, p in enumerate(part)]).collect()
        for row in rows:
            for i, p in enumerate(part):
                assert row[str(i)] == matches(p, row["t"]), (p, row["t"])


@pytest.mark.parametrize(
    ("pattern", "position", "word"),
    [
        ("", 1, "empty"),
        ("[z-a]", 2, "reversed"),
        ("x[a", 2, "unclosed class"),
        ("{a", 1, "unclosed alternation"),
        ("a\\", 2, "trailing"),
        ("[[:alpha:]]", 2, "named"),
        ("[\\d]", 2, "named"),
        ("{" * 17 + "a" + "}" * 17, 17, "deep"),
        ("a" * 1025, 1025, "long"),
    ],
)
def test_bad_patterns_are_refused_with_a_position(pattern, position, word):
    with pytest.raises(PatternError) as caught:
        Rule("include", pattern + ("/" if False else ""))
    assert caught.value.position == position and word in caught.value.problem


def test_a_class_never_matches_a_slash(spark):
    df = spark.createDataFrame([("a/b",), ("a.b",)], "t string")
    rows = df.select(*[glob_match("t", p).alias(str(i)) for i, p in enumerate(["a[!x]b", "a[+-9]b", "a[/]b"])]).collect()
    assert [tuple(r) for r in rows] == [(False, False, False), (True, True, False)]


def kept(spark, filters, *paths):
    df = spark.createDataFrame([(p, None, None) for p in paths], "path string, size long, mtime long")
    return sorted(r["path"] for r in filters.admits_enumerated(df).collect())


def test_anchors(spark):
    paths = ["a.jpg", "x/a.jpg", "x/y/a.jpg", "xy/a.jpg"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")

    def hits(pattern):
        return [r[0] for r in df.select(Rule("include", pattern).predicate(F.col("path"))).collect()]

    assert hits("a.jpg") == [True, True, True, True]
    assert hits("/a.jpg") == [True, False, False, False]
    assert hits("x/*.jpg") == [False, True, False, False]
    assert hits("y/a.jpg") == [False, False, True, False]
    assert hits("/x/**") == [False, True, True, False]
    assert hits("x/") == [False] * 4


def test_first_match_wins(spark):
    filters = FilterSet.build(rules_from=["- work/**/target/\n+ work/**\n- **\n"], now=0)
    assert kept(spark, filters, "work/a/target/x.o", "work/a/src/x.c", "other/y", "work/target") == ["work/a/src/x.c", "work/target"]


def test_include_closes_and_rule_lines_do_not(spark):
    names = ["a.jpg", "b.png", "c.txt"]
    assert kept(spark, FilterSet.build(include=["*.jpg"], exclude=["*.png"], now=0), *names) == ["a.jpg"]
    assert kept(spark, FilterSet.build(rules=["+ *.jpg", "- *.png"], now=0), *names) == ["a.jpg", "c.txt"]
    assert kept(spark, FilterSet.build(rules_from=["- *\n!\n- *.png\n# done\n"], now=0), *names) == ["a.jpg", "c.txt"]


def test_directory_only_exclude_is_not_rescued(spark):
    filters = FilterSet.build(rules=["+ keep/x", "- keep/"], now=0)
    assert kept(spark, filters, "keep/x", "a/keep/y", "keeper/z") == ["keeper/z"]
    assert kept(spark, FilterSet.build(rules=["- **/"], now=0), "a/b", "c") == []


def test_limits_let_unknown_values_pass_and_refuse_nonsense(spark):
    rows = [("a", None, None), ("b", 5, 50), ("c", 5000, 5000)]
    df = spark.createDataFrame(rows, "path string, size long, mtime long")
    filters = FilterSet.build(min_size="1k", max_age=6000, min_age=1000, now=10_000)
    assert [(r["path"], r["action"], r["reason"]) for r in filters.explain(df).orderBy("path").collect()] == [
        ("a", "include", "unmatched"),
        ("b", "exclude", "too-old"),
        ("c", "include", "unmatched"),
    ]
    assert [r["path"] for r in filters.admit(df).orderBy("path").collect()] == ["a", "c"]
    for bad in ({"min_size": "10"}, {"min_size": "2k", "max_size": "1k"}, {"min_age": "2d", "max_age": "1d"}, {"max_depth": -2}, {"rules": ["x *"]}, {"rules": ["+"]}):
        with pytest.raises(Refused):
            FilterSet.build(now=0, **bad)


def test_explain_without_any_limit(spark):
    df = spark.createDataFrame([("a", 1, 1)], "path string, size long, mtime long")
    row = FilterSet().explain(df).first()
    assert (row["action"], row["reason"], row["position"]) == ("include", "unfiltered", None)


def test_path_list_directories(spark):
    only = spark.createDataFrame([("a/b/c",), ("x",)], "path string")
    rows = [("a/b/c", False), ("a", True), ("a/b", True), ("ab", True), ("", True), ("y", False), ("x", False), ("x", True)]
    df = spark.createDataFrame([(p, None, None, d) for p, d in rows], "path string, size long, mtime long, is_dir boolean")
    filters = FilterSet.build(only=only, rules=["- c/"], now=0)
    got = {(r["path"], r["is_dir"]) for r in filters.admits_enumerated(df).collect()}
    assert got == {("a/b/c", False), ("a", True), ("a/b", True), ("", True), ("x", False), ("x", True)}
    reasons = {(r["path"], r["is_dir"]): r["reason"] for r in filters.explain(df).collect()}
    assert reasons[("y", False)] == "not-listed" and reasons[("x", False)] == "unmatched"


def test_thousands_of_rules(spark):
    lines = [f"{'+' if (i // 50) % 2 else '-'} /d{i}/*x{i}*.dat" for i in range(2000)]
    filters = FilterSet.build(rules_from=["\n".join(lines)], now=0)
    rows = [(f"d{i}/ax{i}b.dat", None, None) for i in range(0, 2000, 7)] + [("other", None, None)]
    df = spark.createDataFrame(rows, "path string, size long, mtime long")
    kept = {r["path"] for r in filters.admit(df).collect()}
    assert kept == {f"d{i}/ax{i}b.dat" for i in range(0, 2000, 7) if (i // 50) % 2} | {"other"}
    places = {r["path"]: r["position"] for r in filters.explain(df).collect()}
    assert places["d7/ax7b.dat"] == 8 and places["d1995/ax1995b.dat"] == 1996 and places["other"] is None


def test_rules_and_limits_reach_the_scan(spark, tmp_path):
    place = str(tmp_path / "inv")
    rows = [(f"a/b{i}", i, i) for i in range(10)] + [("c/d.txt", 5, 5)]
    spark.createDataFrame(rows, "path string, size long, mtime long").write.parquet(place)
    inv = spark.read.parquet(place)

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    top = plan(FilterSet.build(rules=["+ /a/**", "- **"], min_size="3B", now=0).admit(inv).select("path"))
    assert "StringStartsWith(path,a/)" in top and "GreaterThanOrEqual(size,3)" in top
    assert "ReadSchema: struct<path:string,size:bigint>" in top
    assert "StringEndsWith(path,.txt)" in plan(FilterSet.build(include=["*.txt"], now=0).admit(inv).select("path"))


def test_many_changes_of_action(spark):
    lines = [f"{'+' if i % 2 else '-'} /d{i}/**" for i in range(600)]
    filters = FilterSet.build(rules_from=["\n".join(lines)], now=0)
    assert kept(spark, filters, *[f"d{i}/x" for i in range(0, 600, 37)], "y") == sorted([f"d{i}/x" for i in range(0, 600, 37) if i % 2] + ["y"])


def test_rule_table_is_sent_to_the_paths(spark):
    # Equal rules, of which the first decides; equal paths, which are decided each; a null path; rules for directories.
    lines = [line for n in range(1, 301) for line in (f"- *-{n}.bin", f"+ {n % 20}-*", f"- sub{n % 7}/")]
    found = FilterSet.build(rules_from=["\n".join(lines)], now=0)
    rows = [("x/a-5.bin", False), ("x/a-5.bin", False), ("x/3-7.bin", False), ("y/19-z", False), ("sub3", True), ("sub3", False), ("none", False), (None, False), ("sub3", None)]
    inv = spark.createDataFrame(rows, "path string, is_dir boolean")
    explained = found.explain(inv).select("path", "is_dir", "action", "position")
    expected = [("x/a-5.bin", False, "exclude", 13)] * 2 + [("x/3-7.bin", False, "include", 8), ("y/19-z", False, "include", 56), ("sub3", True, "exclude", 9)]
    expected += [("sub3", False, "include", None), ("none", False, "include", None), (None, False, "include", None), ("sub3", None, "include", None)]
    order = lambda r: tuple(str(v) for v in r)
    assert sorted((tuple(r) for r in explained.collect()), key=order) == sorted(expected, key=order)
    index = RuleIndex(found.rules)
    assert [f[0] for f in index.filed if f[1] == "include"] == [3 * n - 1 for n in range(1, 21)] and len(index.filed) == 300 + 20 + 7
    plan = explained._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [_key" in plan and "SortAggregate" not in plan
