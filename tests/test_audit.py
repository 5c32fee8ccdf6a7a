import hashlib
import json

import pytest
from pyspark.sql import functions as F

from objcat.errors import Refused
from objcat.operators import audit
from objcat.sources import records
from objcat.streaming.audit import follow_audit, read_audit_stream

SEP = "\x1f"


def sealed_rows(count=8, chain="c"):
    """A second implementation of the canonical form, used as the witness."""
    rows, prev = [], "0" * 64
    for i in range(count):
        row = {
            "v": 2, "index": i, "time": f"2024-01-{i + 1:02d}T00:00:00Z", "op": "copy", "result": "success", "direction": "in",
            "path": f"d/f{i}", "size": i, "bytes": i * 10, "objects": 1, "plaintext_hash": "", "ciphertext_hash": "", "remote": "r", "prev": prev,
        }
        text = SEP.join(str(row[k]) for k in ("v", "prev", "index", "time", "op", "result", "path", "size", "plaintext_hash", "ciphertext_hash", "remote", "direction", "bytes", "objects"))
        row["hash"] = prev = hashlib.sha256(text.encode()).hexdigest()
        rows.append(row)
    return rows


SCHEMA = "chain string, pos long, v int, index long, time string, op string, result string, direction string, path string, size long, bytes long, objects long, plaintext_hash string, ciphertext_hash string, remote string, prev string, hash string"


def log_of(spark, rows, chain="c"):
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    full = [tuple({"chain": chain, "pos": i, **r}[n] for n in names) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def rehash(row):
    text = SEP.join(str(row[k]) for k in ("v", "prev", "index", "time", "op", "result", "path", "size", "plaintext_hash", "ciphertext_hash", "remote", "direction", "bytes", "objects"))
    return {**row, "hash": hashlib.sha256(text.encode()).hexdigest()}


def test_seal_agrees_with_the_witness_and_continues(spark):
    rows = sealed_rows(300)
    entries = log_of(spark, rows).drop("v", "index", "prev", "hash")
    made = audit.seal(entries, "chain", "pos").orderBy("pos").collect()
    assert [(r["index"], r["prev"], r["hash"]) for r in made] == [(r["index"], r["prev"], r["hash"]) for r in rows]
    heads = spark.createDataFrame([("c", 100, rows[99]["hash"])], "chain string, records long, head string")
    rest = audit.seal(entries.filter("pos >= 100"), "chain", "pos", heads).orderBy("pos").collect()
    assert [r["hash"] for r in rest] == [r["hash"] for r in rows[100:]]


def first_break(spark, rows, **kw):
    return audit.verify_chain(log_of(spark, rows), **kw).first()


def test_intact_and_legacy(spark):
    rows = sealed_rows()
    row = first_break(spark, rows)
    assert (row["verdict"], row["records"], row["head"]) == ("intact", 8, rows[-1]["hash"])
    legacy = {**rows[0], "v": None}
    text = SEP.join(str(legacy[k]) for k in ("prev", "index", "time", "op", "result", "path", "size", "plaintext_hash", "ciphertext_hash", "remote"))
    legacy["hash"] = hashlib.sha256(text.encode()).hexdigest().upper()
    assert first_break(spark, [legacy])["verdict"] == "intact"
    assert first_break(spark, [{**legacy, "bytes": 999}])["verdict"] == "intact"


def forge(rows, name):
    r = list(rows)
    if name == "middle removed":
        return r[:3] + r[4:]
    if name == "swapped":
        return r[:3] + [r[4], r[3]] + r[5:]
    if name == "duplicated":
        return r[:4] + [r[3]] + r[4:]
    if name == "edited":
        return r[:3] + [{**r[3], "path": "x"}] + r[4:]
    if name == "edited and rehashed":
        return r[:3] + [rehash({**r[3], "path": "x"})] + r[4:]
    if name == "direction":
        return r[:3] + [{**r[3], "direction": "out"}] + r[4:]
    if name == "bytes":
        return r[:3] + [{**r[3], "bytes": 1}] + r[4:]
    if name == "future version":
        return r[:3] + [{**r[3], "v": 3}] + r[4:]
    if name == "malformed":
        return r[:3] + [{**r[3], "hash": "nonsense"}] + r[4:]
    if name == "renumbered":
        return r[:3] + [rehash({**x, "index": x["index"] - 1}) for x in r[4:]]
    raise AssertionError(name)


@pytest.mark.parametrize(
    ("name", "kind", "position"),
    [
        ("middle removed", "index-discontinuity", 3), ("swapped", "index-discontinuity", 3), ("duplicated", "index-discontinuity", 4),
        ("edited", "content-mismatch", 3), ("edited and rehashed", "broken-link", 4), ("direction", "content-mismatch", 3),
        ("bytes", "content-mismatch", 3), ("future version", "unsupported-version", 3), ("malformed", "malformed-hash", 3),
        ("renumbered", "broken-link", 3),
    ],
)
def test_forgeries(spark, name, kind, position):
    row = first_break(spark, forge(sealed_rows(), name))
    assert (row["verdict"], row["kind"], row["position"], row["line"], row["head"]) == ("broken", kind, position, position + 1, None)


def test_order_only_positions_are_numbered(spark):
    rows = sealed_rows()
    sparse = log_of(spark, rows).withColumn("pos", F.col("pos") * 10 + 5)
    assert audit.verify_chain(sparse, dense=False).first()["verdict"] == "intact"
    assert audit.verify_chain(sparse.filter("pos <> 35"), dense=False).first()["position"] == 3


def test_anchors(spark):
    rows = sealed_rows()
    log = log_of(spark, rows)

    def against(records, digest, kept=None):
        anchors = spark.createDataFrame([("c", records, digest)], "chain string, records long, head string")
        row = audit.compare_anchor(log if kept is None else log.filter(F.col("pos") < kept), anchors).first()
        return row["comparison"], row["records"], row["appended"], row["missing"]

    head, earlier = rows[-1]["hash"], rows[4]["hash"]
    assert against(8, head.upper()) == ("match", 8, None, None)
    assert against(None, head) == ("match", 8, None, None)
    assert against(5, earlier) == ("advanced", 8, 3, None)
    assert against(None, earlier) == ("advanced", 8, 3, None)
    assert against(8, head, kept=6) == ("truncated", 6, None, 2)
    assert against(None, head, kept=6) == ("absent", 6, None, None)
    assert against(5, rows[2]["hash"]) == ("diverged", 8, None, None)
    assert against(0, "0" * 64) == ("advanced", 8, 8, None)
    assert against(None, "0" * 64) == ("advanced", 8, 8, None)
    assert against(3, earlier, kept=0) == ("truncated", 0, None, 3)
    verdict = audit.audit_verdict(log.filter("pos < 6"), spark.createDataFrame([("c", 8, head)], "chain string, records long, head string")).first()
    assert (verdict["verdict"], verdict["kind"], verdict["proves"]) == ("head-mismatch", "truncated", "integrity,order")
    assert audit.audit_verdict(log).first()["proves"] == "integrity,order"


def test_anchor_text(value_of):
    digest = "a" * 64
    got = value_of(audit.parse_anchor, f"8:{digest}", f" {digest} ", f"x:{digest}", "8:zz")
    assert [tuple(g) for g in got] == [(8, digest, None), (None, digest, None), (None, None, "not-a-count"), (None, None, "not-a-hash")]


def test_listing(spark):
    rows = sealed_rows()
    rows[2]["time"] = "some day"
    log = log_of(spark, rows)
    got = audit.audit_list(log, since=1704326400, until=1704585600).collect()  # 4 and 7 January
    assert [r["pos"] for r in got] == [2, 3, 4, 5]
    assert [r["pos"] for r in audit.audit_list(log, limit=3).collect()] == [5, 6, 7]
    assert audit.audit_list(log, path="d/f1").count() == 1
    for bad in ({"direction": "up"}, {"path": "a/../b"}):
        with pytest.raises(Refused):
            audit.audit_list(log, **bad)


def test_log_files_round_trip(spark, tmp_path):
    rows = sealed_rows(40)
    lines = [json.dumps({k: v for k, v in r.items() if v not in ("", None)}) for r in rows]
    lines.insert(10, "")
    (tmp_path / "good.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "bad.jsonl").write_text("\n".join([*lines[:20], "not json", *lines[20:]]) + "\n")
    (tmp_path / "empty.jsonl").write_text("")
    log = records.read_audit(spark, str(tmp_path / "*.jsonl"))
    got = {r["chain"].rsplit("/", 1)[1]: r for r in audit.verify_chain(log).collect()}
    assert got["good.jsonl"]["verdict"] == "intact" and got["good.jsonl"]["records"] == 40
    assert (got["bad.jsonl"]["kind"], got["bad.jsonl"]["line"]) == ("not-a-record", 21)

    out = str(tmp_path / "export")
    records.write_audit(log_of(spark, rows), out)
    back = records.read_audit_export(spark, out)
    row = audit.verify_chain(back).first()
    assert (row["chain"], row["verdict"], row["head"]) == ("c", "intact", rows[-1]["hash"])


def test_following_a_growing_log(spark, tmp_path):
    source, out = tmp_path / "log", str(tmp_path / "out")
    source.mkdir()
    rows = sealed_rows(6)
    for part in range(3):
        (source / f"{part}.json").write_text("\n".join(json.dumps(r) for r in rows[part * 2 : part * 2 + 2]))
    stream = follow_audit(read_audit_stream(spark, str(source)), path="d", since=1704240000)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck"))
    query.trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["index"] for r in spark.read.parquet(out).collect()) == [2, 3, 4, 5]


def test_coverage_and_outcomes(spark):
    log = spark.createDataFrame([("copy", "success"), ("warp", "fatal_error"), ("ls", "odd")], "op string, result string")
    states = {r["op"]: r["state"] for r in audit.audit_coverage(log).collect()}
    assert (states["copy"], states["warp"], states["ls"], states["sync"], states["size"]) == ("covered", "unruled", "exempt-but-seen", "unseen", "covered")
    codes = {r["result"]: (r["code"], r["stops"]) for r in audit.outcome_counts(log).collect()}
    assert codes == {"success": (0, False), "fatal_error": (7, True), "odd": (None, False)}


def test_listing_the_last_records_moves_no_more_than_those(spark):
    # A chain with most of the records, ties at the cut, a null chain, and a time that cannot be read.
    rows = [("a", n, "2024-01-05") for n in range(500)] + [("a", 499, "x"), ("a", 498, "2024-01-05"), ("a", 498, "2024-01-05"), ("b", 7, "2024-01-05")]
    rows += [(None, 1, "2024-01-05"), (None, 2, "2024-01-05"), (None, 3, "2024-01-05"), (None, 4, "2025-01-05"), (None, 0, "2024-01-05")]
    log = spark.createDataFrame(rows, "chain string, pos long, time string").withColumn("path", F.lit("d/f"))
    shown = audit.audit_list(log, limit=3, since=1704326400, until=1704585600)
    got = [(r["chain"], r["pos"]) for r in shown.collect()]
    assert got == [(None, 1), (None, 2), (None, 3), *[("a", 498)] * 3, *[("a", 499)] * 2, ("b", 7)]
    plan = shown._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "WindowGroupLimit" in plan
    # The text of a time is taken apart once, however many fields are read from it.
    whole = log.filter(audit.admits(since=1704326400, until=1704585600))._jdf.queryExecution().optimizedPlan().toString()
    assert whole.count("split(") == 1
