import os
import random

from pyspark.sql import functions as F

from objcat.operators import listing
from objcat.streaming import catalog


def changes(count=600, seed=9):
    rng = random.Random(seed)
    rows = []
    for seq in range(count):
        path = rng.choice(["hot/file"] * 40 + [f"d{i % 5}/e{i % 3}/f{i}" for i in range(60)])
        kind = "put" if rng.random() < 0.7 else "delete"
        size = rng.choice([0, 5, 9, 100])
        blank = kind == "delete" or rng.random() < 0.1
        rows.append((seq, path, kind, None if kind == "delete" else 0 if blank else size, "" if blank else f"h{size}"))
    return rows


def replay(spark, tmp_path, batches, label):
    source, out = tmp_path / f"{label}-in", str(tmp_path / f"{label}-out")
    source.mkdir()
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, catalog.CHANGES).coalesce(1).write.parquet(str(source / f"part{number}"))
    feed = spark.readStream.schema(catalog.CHANGES).option("maxFilesPerTrigger", 1).parquet(str(source / "*"))
    catalog.stream_catalog(feed, out, str(tmp_path / f"{label}-ck")).awaitTermination()
    return out


def truth(rows):
    state = {}
    for _, path, kind, size, digest in sorted(rows):
        state.pop(path, None)
        if kind == "put":
            state[path] = None if size == 0 and digest == "" else size
    dirs = {}
    for path in state:
        parts = path.split("/")
        for n in range(1, len(parts)):
            key = "/".join(parts[:n])
            dirs[key] = dirs.get(key, 0) + 1
    return state, dirs


def test_replay_equals_batch(spark, tmp_path):
    rows = changes()
    state, dirs = truth(rows)
    batches = [rows[i : i + 150] for i in range(0, len(rows), 150)]
    out = replay(spark, tmp_path, batches, "ordered")
    totals = catalog.stream_totals(spark, out).first()
    blank = sum(v is None for v in state.values())
    assert (totals["objects"], totals["bytes"], totals["unmeasured"]) == (len(state), sum(v or 0 for v in state.values()), blank)
    assert {r["dir"]: r["objects"] for r in catalog.stream_dirs(spark, out).collect()} == dirs

    left = catalog.batch_state(spark.createDataFrame(rows, catalog.CHANGES))
    assert {r["path"] for r in left.collect()} == set(state)
    batch = listing.catalog_totals(left.withColumn("hash", F.coalesce("hash", F.lit("")))).first()
    assert (batch["objects"], batch["bytes"], batch["unmeasured"]) == (totals["objects"], totals["bytes"], totals["unmeasured"])


def test_late_and_repeated_changes_do_no_harm(spark, tmp_path):
    rows = changes(200, seed=2)
    state, dirs = truth(rows)
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    out = replay(spark, tmp_path, [shuffled[:100], shuffled[50:], rows[:40]], "late")
    assert catalog.stream_totals(spark, out).first()["objects"] == len(state)
    assert {r["dir"]: r["objects"] for r in catalog.stream_dirs(spark, out).collect()} == dirs


def test_a_batch_is_applied_once_and_files_stay_few(spark, tmp_path):
    rows, out = changes(400, seed=4), str(tmp_path / "out")
    frame = spark.createDataFrame(rows, catalog.CHANGES)
    parts = [frame.filter(F.col("seq") % 7 == n) for n in range(7)]
    for number, part in enumerate(parts):
        catalog.apply_changes(part, out, number, "q", buckets=4)
        catalog.apply_changes(part, out, number, "q", buckets=4)  # run again
    state, dirs = truth(rows)
    assert catalog.stream_totals(spark, out).first()["objects"] == len(state)
    assert {r["dir"]: r["objects"] for r in catalog.stream_dirs(spark, out).collect()} == dirs
    files = [f for _, _, names in os.walk(out) for f in names if f.endswith(".parquet")]
    assert len(files) <= 2 * 2 * 4 and len(os.listdir(f"{out}/commits")) <= 2 * 2  # with checksum files
    # Another query that starts over brings nothing new; one that failed before its commit leaves nothing behind that counts.
    catalog.apply_changes(frame, out, 0, "other", buckets=4)
    assert catalog.stream_totals(spark, out).first()["objects"] == len(state)
    catalog.apply_changes(frame.limit(0), out, 7, "q", buckets=4)
    assert {r["dir"]: r["objects"] for r in catalog.stream_dirs(spark, out).collect()} == dirs


def test_totals_before_any_batch(spark, tmp_path):
    assert tuple(catalog.stream_totals(spark, str(tmp_path)).first()) == (0, 0, 0, 0)
    assert catalog.stream_dirs(spark, str(tmp_path)).count() == 0
