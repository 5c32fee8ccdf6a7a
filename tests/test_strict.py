"""Values that must not be lost, replaced or end the run: forged lines, far times, names with ASCII composed forms."""

import json
import os
import subprocess
import sys
import time

import pytest

from objcat.operators import integrity, preflight, removal
from objcat.plans import compare, transfer
from objcat.sources import records
from objcat.streaming.audit import follow_audit, read_audit_stream

GOOD = {"v": 2, "index": 0, "time": "2024-01-01T00:00:00Z", "op": "put", "result": "success", "size": 3, "prev": "0" * 64, "hash": "f" * 64}
FORGED = [
    json.dumps(GOOD | {"size": "lots"}),
    json.dumps(GOOD | {"bytes": 1.5}),
    json.dumps(GOOD | {"bytes": None}),
    json.dumps(GOOD | {"bytes": {"a": 1}}),
    json.dumps(GOOD | {"objects": -1}),
    json.dumps(GOOD | {"path": 7}),
    json.dumps(GOOD | {"path": None}),
    json.dumps(GOOD)[:-1] + ', "size": 3}',
    json.dumps(GOOD)[:-1],
    json.dumps({k: v for k, v in GOOD.items() if k != "hash"}),
    "[1, 2]",
]


def test_forged_lines_are_no_records(spark):
    rows = [("c", i, i, line) for i, line in enumerate([json.dumps(GOOD), *FORGED])]
    parsed = records.parse_audit(spark.createDataFrame(rows, "chain string, pos long, line long, value string"))
    got = {r["pos"]: r["corrupt"] for r in parsed.collect()}
    assert got[0] is None and [got[i] for i in range(1, len(rows))] == FORGED


def test_stream_keeps_broken_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text("\n".join([json.dumps(GOOD), json.dumps(GOOD | {"op": "delete"}), *FORGED]) + "\n")
    wanted = follow_audit(read_audit_stream(spark, str(tmp_path)), op="put")
    running = wanted.writeStream.format("memory").queryName("strict").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "_state")).start()
    running.awaitTermination(60)
    rows = spark.table("strict").collect()
    assert sum(r["corrupt"] is None for r in rows) == 1 and sorted(r["corrupt"] for r in rows if r["corrupt"]) == sorted(FORGED)


@pytest.mark.parametrize("far", [2**63 - 1, -(2**63)])
def test_far_times(spark, inventory, far):
    src, dst = inventory(("a", 1, far), ("b", 1, 5), ("c", 1, None)), inventory(("a", 1, -5), ("b", 1, 5), ("c", 1, 5))
    for one, other in ((src, dst), (dst, src)):
        assert {r["path"]: r["status"] for r in compare.check(one, other).collect()} == {"a": "differ", "b": "match", "c": "error"}
        for policy in (transfer.Policy(), transfer.Policy(update=True)):
            assert transfer.copy_plan(one, other, policy).count() >= 2
    held = spark.createDataFrame([(far,)], "mtime long").select(removal.age_verdict("mtime", 1_700_000_000).alias("v")).first()["v"]
    assert held["status"] == (removal.HELD if far > 0 else removal.RECLAIM)


def test_hashsum_keeps_rows_without_a_digest(spark):
    df = spark.createDataFrame([("a", "x", b"1"), ("b", None, b"2")], "path string, hash string, content binary")
    assert sorted((r["path"], r["hash"]) for r in integrity.hashsum(df, algo="blake3", recorded="hash").collect()) == [("a", "x"), ("b", None)]


def test_foreign_digests_are_not_corrupt(spark):
    catalog = spark.createDataFrame([("a", "k", 1, "00", "blake3")], "path string, object_key string, size long, hash string, algo string")
    store = spark.createDataFrame([("k", b"1")], "object_key string, content binary")
    assert integrity.verify(catalog, store).first()["status"] == "unverifiable"


def test_names_whose_composed_form_is_ascii_collide(spark):
    names = spark.createDataFrame([("\u212a.txt",), ("K.txt",), ("plain",), ("plain",)], "native string")
    assert [(r["logical"], r["natives"]) for r in preflight.nfc_collisions(names).collect()] == [("K.txt", 2)]
    assert {r["native"] for r in preflight.collision_members(names).collect()} == {"\u212a.txt", "K.txt"}


def test_staged_tables_go_when_the_application_ends(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        "from pyspark.sql import SparkSession; from objcat.session import staged; import os;"
        f"s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', 'file://{tmp_path}').getOrCreate();"
        f"assert staged(s.range(5), 'five').count() == 5 and os.listdir('{tmp_path}'); s.stop()"
    )
    subprocess.run([sys.executable, "-c", code], check=True, timeout=90, env=os.environ | {"PYTHONPATH": root})
    time.sleep(1)
    assert not [name for name in os.listdir(tmp_path) if name.startswith("five-")]
