import datetime
import random

from pyspark.sql import functions as F

from objcat.functions import paths, redact, units

NFD = "cafe\u0301"


def test_nfc_and_clean(value_of):
    assert value_of(paths.nfc, "abc", NFD, None) == ["abc", "café", None]
    got = value_of(paths.clean_path, "a//b\\c/./d", "a/../b", "", "/x/", NFD + "/n", "..a/b..")
    assert got == ["a/b/c/d", None, "", "x", "café/n", "..a/b.."]


def test_parent_dir_use(value_of):
    got = value_of(paths.classify_parent_dir, "a/b", "a/../b", "..", "a/../../b", "a/b/../..", "x\\..\\y")
    plain = [g and (g["kind"], g["resolved"]) for g in got]
    assert plain == [None, ("inside", "b"), ("escapes", None), ("escapes", None), ("inside", ""), ("inside", "y")]


def test_component_tests(value_of):
    assert value_of(lambda c: paths.is_under("a", c), "a", "a/b", "ab", "") == [True, True, False, False]
    assert value_of(lambda c: paths.is_under("", c), "a") == [True]
    assert value_of(lambda c: paths.is_under("a/", c), "a", "a/x") == [True, True]
    assert value_of(paths.file_name, "a/b", "b", "a/") == ["b", "b", ""]
    assert value_of(paths.parent, "a/b/c", "b", "é/x") == ["a/b", "", "é"]
    assert value_of(paths.depth, "a/b", "a", "", "/a//b") == [2, 1, 0, 2]
    assert value_of(paths.ancestors, "a/b/c", "a") == [["", "a", "a/b"], [""]]
    assert value_of(paths.directories, "a/b/c", "a") == [["a", "a/b"], []]
    assert value_of(paths.component_suffixes, "a/b/c") == [["a/b/c", "b/c", "c"]]
    assert value_of(lambda c: paths.relative_to("a/b", c), "a/b/c", "a/b", "x/y", "a/bc") == ["c", "b", "x/y", "a/bc"]
    assert value_of(lambda c: paths.relative_to("", c), "a/b") == ["a/b"]
    assert value_of(lambda c: paths.join_path(F.lit("p"), c), "x") == ["p/x"]
    assert value_of(lambda c: paths.join_path(F.lit(""), c), "x") == ["x"]
    assert value_of(paths.is_marker, ".objcat-dir", "a/.objcat-dir", "a/x.objcat-dir") == [True, True, False]
    assert value_of(paths.is_staging_key, "a/.objcat-staging.7", "report.tmp.2024.csv") == [True, False]


def test_path_problem(value_of):
    cases = {
        "ok/path.txt": None,
        "": "empty",
        "é" * 2100: "too-long",
        "/a": "edge-separator",
        "a/": "edge-separator",
        "a\x01\\b": "control",
        "a\\b\x01": "backslash",
        "é\x85": "control",
        "é\ufdd0": "noncharacter",
        "é\u0378": "unassigned",
        "C:/x": "drive-letter",
        "a//b": "empty-segment",
        "a/./b": "dot-segment",
        "a/" + "é" * 128: "segment-too-long",
        "été/ok": None,
    }
    assert value_of(paths.path_problem, *cases) == list(cases.values())


def test_logical_component(value_of):
    got = value_of(paths.to_logical_component, "a.txt", "a/b", "a\\b", "..", NFD)
    assert [(g["name"], g["problem"]) for g in got] == [
        ("a.txt", None),
        (None, "separator"),
        (None, "separator"),
        (None, "parent-dir"),
        ("café", None),
    ]


def test_parse_size(value_of):
    cases = {
        "10": (10, False, None),
        "1.5K": (1536, False, None),
        " 10 GiB ": (10 * 2**30, False, None),
        "10GB": (10 * 10**9, False, None),
        "2pb": (2 * 10**15, False, None),
        "off": (None, True, None),
        "OFF": (None, True, None),
        "0": (None, True, None),
        "0k": (0, False, None),
        "-5k": (None, False, "negative"),
        "x": (None, False, "invalid"),
        "": (None, False, "invalid"),
        "5 parsecs": (None, False, "unknown-suffix"),
        "1e3": (None, False, "unknown-suffix"),
        "99999999P": (2**63 - 1, False, None),
    }
    got = value_of(units.parse_size, *cases)
    assert [tuple(g) for g in got] == list(cases.values())


def test_parse_age(value_of):
    cases = {
        "30": (30, False, None),
        "90m": (5400, False, None),
        "6M": (6 * 2592000, False, None),
        "1.5h": (5400, False, None),
        "1500ms": (1, False, None),
        "1e3s": (1000, False, None),
        "0": (None, True, None),
        "0d": (None, True, None),
        "Off": (None, True, None),
        "inf": (None, True, None),
        "-1d": (None, False, "negative"),
        "ms": (None, False, "invalid"),
        "5D": (None, False, "invalid"),
        "5f": (None, False, "invalid"),
        "": (None, False, "invalid"),
    }
    assert [tuple(g) for g in value_of(units.parse_age, *cases)] == list(cases.values())


def test_format_bytes(spark):
    cases = [0, 1023, 1024, 1152, 10239, 10240, 1536 * 1024, 2**40, 5 * 2**50 + 7, 2**62, 1015, 9999, 99950, 999_999]
    df = spark.createDataFrame([(c,) for c in cases], "b long")
    rows = df.select(units.format_bytes("b").alias("i"), units.format_bytes("b", "si").alias("s")).collect()

    def printed(count, names, base):
        if count < base:
            return f"{count} {names[0]}"
        value, index = float(count), 0
        while value >= base and index + 1 < len(names):
            value, index = value / base, index + 1
        return f"{value:.{2 if value < 10 else 1}f} {names[index]}"

    assert [r["i"] for r in rows] == [printed(c, units.IEC_UNITS, 1024) for c in cases]
    assert [r["s"] for r in rows] == [printed(c, units.SI_UNITS, 1000) for c in cases]


def test_format_bytes_random(spark):
    rng = random.Random(5)
    cases = [rng.randrange(2 ** rng.randrange(1, 63)) for _ in range(3000)] + [n * 5 for n in range(200, 4000)]
    df = spark.createDataFrame([(c,) for c in cases], "b long")
    got = {r["b"]: (r["i"], r["s"]) for r in df.select("b", units.format_bytes("b").alias("i"), units.format_bytes("b", "si").alias("s")).collect()}
    for count, printed in got.items():
        for text, names, base in zip(printed, (units.IEC_UNITS, units.SI_UNITS), (1024, 1000)):
            value, index = float(count), 0
            while value >= base and index + 1 < len(names):
                value, index = value / base, index + 1
            expected = f"{count} B" if count < base else f"{value:.{2 if value < 10 else 1}f} {names[index]}"
            assert text == expected, count


def test_parse_time(value_of):
    def at(*parts):
        return int(datetime.datetime(*parts, tzinfo=datetime.timezone.utc).timestamp())

    cases = {
        "now": 1000,
        "NOW": 1000,
        "@-5": -5,
        "@ 12": 12,
        "2h": 1000 - 7200,
        "+1d": 1000 - 86400,
        "2024-02-29": at(2024, 2, 29),
        "2023-02-29": None,
        "2024-2-9 7:5": at(2024, 2, 9, 7, 5),
        "2024-01-02T03:04:05Z": at(2024, 1, 2, 3, 4, 5),
        "2024-01-02t03:04:05.999z": at(2024, 1, 2, 3, 4, 5),
        "2024-01-02T03:04:05+05:30": at(2024, 1, 2, 3, 4, 5) - 19800,
        "2024-01-02T03:04:05-0530": at(2024, 1, 2, 3, 4, 5) + 19800,
        "2024-01-02T03:04:05+05": at(2024, 1, 2, 3, 4, 5) - 18000,
        "2024-01-02T23:59:60Z": at(2024, 1, 3),
        "2024-01-02T24:00:00Z": None,
        "2024-01-02T03:04:05+5:30": None,
        "2024-01-02T03:04:05+24:00": None,
        "1969-12-31": None,
        "9999-12-31": at(9999, 12, 31),
        "10000-01-01": None,
        "2024-01-02T": None,
        "2024,1,2,3,4,5,": None,
        "yesterday": None,
        "": None,
    }
    assert dict(zip(cases, value_of(lambda c: units.parse_time(c, 1000), *cases))) == cases


def test_rfc3339(spark):
    seconds = [0, -1, 1704067200, -2208988800, 253402300799]
    df = spark.createDataFrame([(s,) for s in seconds], "s long")
    got = [r[0] for r in df.select(units.rfc3339("s")).collect()]
    epoch = datetime.datetime(1970, 1, 1)
    assert got == [(epoch + datetime.timedelta(seconds=s)).strftime("%Y-%m-%dT%H:%M:%SZ") for s in seconds]


def test_digest_form(value_of):
    assert value_of(lambda c: units.is_hex_digest(c, "sha1"), "a" * 40, "A" * 40, "g" * 40, "a" * 39, "a" * 40 + "\n") == [
        True,
        True,
        False,
        False,
        False,
    ]


def test_redaction(value_of):
    assert value_of(redact.escape_controls, "plain", "a\tb\x9fc", "😀\x00") == ["plain", "a\\u0009b\\u009fc", "😀\\u0000"]
    urls = ["http://h/p?Token=1&b=2", "http://h/p", "http://h/?password", "h?x-amz-signature=a=b&c", "h?a=1&"]
    assert value_of(redact.redact_url, *urls) == [
        "http://h/p?Token=<redacted>&b=2",
        "http://h/p",
        "http://h/?password",
        "h?x-amz-signature=<redacted>&c",
        "h?a=1&",
    ]
    import hashlib

    mark = "sha256:" + hashlib.sha256(b"u:p@q").hexdigest()[:8]
    got = value_of(redact.redact_remote, "s3://u:p@q@host/b@c?secret=1", "host:path@x", "s3://host/a@b", "s3://u:p@q@host")
    assert got == [f"s3://{mark}@host/b@c?secret=<redacted>", "host:path@x", "s3://host/a@b", f"s3://{mark}@host"]
