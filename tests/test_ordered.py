import random

from pyspark.sql import functions as F

from objcat.operators import ordered
from objcat.operators.ordered import first_over_limit, with_position


def test_large_groups_are_numbered_like_small_ones(spark):
    rng = random.Random(3)
    rows = [("hot", f"{i:05d}") for i in range(900)] + [(f"g{i % 40}", f"{i}") for i in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k string")
    groups = {}
    for g, k in sorted(rows):
        groups.setdefault(g, []).append(k)
    plain = {(g, k): n for g, keys in groups.items() for n, k in enumerate(keys, 1)}
    found = with_position(df, ["g"], ["k"]).collect()
    assert len(found) == len(rows) and {(r["g"], r["k"]): r["position"] for r in found} == plain

    by_value = with_position(df.withColumn("n", F.col("k").cast("int")), ["g"], ["n"], piece=F.floor(F.col("n") / 100)).collect()
    assert len(by_value) == len(rows) and all(r["position"] == (r["n"] + 1 if r["g"] == "hot" else r["n"] // 40 + 1) for r in by_value)


def test_budget_cut_equals_a_running_sum(spark, monkeypatch):
    monkeypatch.setattr(ordered, "PIECE_ROWS", 5)  # the range of the cut is cut again
    rng = random.Random(4)
    rows = sorted((f"p{rng.randrange(10**6)}é{i}", rng.randrange(1, 50)) for i in range(700))
    df = spark.createDataFrame(rows, "path string, size long")
    for limit in (0, 10, 3000, 9000, 10**9):
        spent, cut = 0, None
        for path, size in sorted(rows, key=lambda r: r[0].encode()):
            if spent + size > limit:
                cut = path
                break
            spent += size
        assert first_over_limit(df, "path", "size", limit) == cut
