"""Change points against a plain segmentation, planted levels, and joins that deal heavy keys only."""

import random

import pytest
from pyspark.sql import functions as F

from answergauge.operators.changes import LEAST_RATIO, LEAST_RUNS, model_changes, ordered_runs
from answergauge.operators.salting import heavy_keys, salted_join

FIELDS = "model_name string, execute_time string, batch_id string, avg_total_score double"


def batches(spark, scores):
    """Scores by model, in order of execution."""
    rows = [
        (model, f"2024-01-{1 + i // 1440:02d} {i // 60 % 24:02d}:{i % 60:02d}:00", f"b{i}", s)
        for model, series in scores.items()
        for i, s in enumerate(series)
    ]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, FIELDS).repartition(3)


def plain(series):
    """First runs of new levels, counted from 1."""
    points = [round(s * 100) for s in series if s is not None]

    def split(first, last):
        part = points[first:last]
        n, best = len(part), None
        for k in range(LEAST_RUNS, n - LEAST_RUNS + 1):
            a, b = sum(part[:k]) / k, sum(part[k:]) / (n - k)
            gain = k * (n - k) / n * ((a - b) * (a - b))
            if best is None or gain > best[0]:
                best = (gain, k)
        if best is None or best[0] <= 0:
            return []
        gain, k = best
        inside = max(sum(p * p for p in part) - sum(part) * sum(part) / n - gain, 0.0)
        if gain * (n - 2) < LEAST_RATIO * inside:
            return []
        return split(first, first + k) + [first + k + 1] + split(first + k, last)

    return split(0, len(points))


def found(df, **options):
    out = {}
    for r in model_changes(df, **options).collect():
        out.setdefault(r["model_name"], []).append(r["run"])
    return {m: sorted(runs) for m, runs in out.items()}


def test_equals_plain_segmentation(spark):
    rng = random.Random(5)

    def steps(*levels):
        return [round(min(100, max(0, rng.gauss(mean, 4))), 2) for mean, n in levels for _ in range(n)]

    scores = {
        "falls": steps((80, 40), (60, 50)),
        "twice": steps((50, 30), (75, 25), (40, 45)),
        "flat": steps((70, 90)),
        "short": steps((90, 2), (10, 2)),
        None: steps((30, 20), (60, 20)),
        "gaps": [None, 50.0, 50.0, None, 50.0, 90.0, 90.0, 90.0, None],
        "constant": [33.33] * 50,
    }
    want = {m: plain(s) for m, s in scores.items()}
    assert found(batches(spark, scores)) == {m: runs for m, runs in want.items() if runs}
    assert len(want["falls"]) == 1 and abs(want["falls"][0] - 41) <= 1  # noise may move it
    assert want["gaps"] == [4] and not want["constant"] and len(want["twice"]) >= 2


def test_figures_of_a_change(spark):
    row = model_changes(batches(spark, {"m": [80.0] * 6 + [50.5] * 4})).first()
    assert (row.run, row.batch_id, row.runs_before, row.runs_after) == (7, "b6", 6, 4)
    assert (row.mean_before, row.mean_after, row.change, row.ratio) == (80.0, 50.5, -29.5, None)
    assert model_changes(batches(spark, {"m": [80.0] * 6 + [50.5] * 4}), least_runs=6).count() == 0
    assert model_changes(batches(spark, {"m": [1.0]}).limit(0)).count() == 0


def test_one_large_model_is_numbered_in_pieces(spark):
    rng = random.Random(6)
    series = [round(rng.uniform(0, 100), 2) for _ in range(3000)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = ordered_runs(batches(spark, {"big": series, "small": [1.0, 2.0]}))
        got = {r["batch_id"]: r for r in rows.where("model_name = 'big'").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    points, at = [round(s * 100) for s in series], 0
    for i, p in enumerate(points):
        row = got[f"b{i}"]
        assert (row["run"], row["sum"], row["all_runs"], row["all_sum"]) == (i + 1, at, 3000, sum(points))
        at += p
    assert got["b2999"]["all_squares"] == sum(p * p for p in points)


@pytest.fixture
def skewed(spark):
    key = "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 100 = 1 THEN NULL ELSE concat('k', id % 500) END AS k"
    return spark.range(6000).selectExpr(key, "id")


def test_heavy_keys(spark, skewed):
    assert heavy_keys(skewed, ["k"], 8) == [("hot", 3)]
    assert heavy_keys(skewed.where("k <> 'hot'"), ["k"], 8) == []
    assert heavy_keys(skewed.limit(0), ["k"], 8) == [] and heavy_keys(skewed.where("k = 'hot'"), ["k"], 8) == [("hot", 8)]


def test_only_heavy_keys_are_repeated(spark, skewed):
    few = skewed.select("k").distinct().withColumn("v", F.length("k"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = salted_join(few, skewed, ["k"], ["id"], pieces=8)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        assert sorted(joined.columns) == ["id", "k", "v"]
        assert joined.exceptAll(few.join(skewed, "k").select(*joined.columns)).count() == 0
        assert joined.count() == skewed.where("k IS NOT NULL").count()
        assert "_salt" not in salted_join(few, skewed.where("k <> 'hot'"), ["k"], ["id"], pieces=8)._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
