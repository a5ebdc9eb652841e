"""The verdict on two batches: intervals hold planted changes, reruns agree."""

import hashlib
import math
import random

from answergauge.sources.history import REPLICATES, poisson_bounds, regression_verdict


def details(spark, pairs):
    rows = []
    for i, (old, new) in enumerate(pairs):
        rows += [("a", i, old, old is not None), ("b", i, new, new is not None)]
    return spark.createDataFrame(rows, "batch_id string, case_pos long, total_score double, success_flag boolean").repartition(3)


def plain(pairs, seed=1, confidence=0.95):
    """The same bootstrap in plain Python."""
    bounds = poisson_bounds()
    changes = {i: round(new * 10000) - round(old * 10000) for i, (old, new) in enumerate(pairs) if None not in (old, new)}
    means = []
    for r in range(REPLICATES):
        n = total = 0
        for i, change in changes.items():
            u = int(hashlib.md5(f"{seed}:{i}:{r // 8}".encode()).hexdigest()[4 * (r % 8) :][:4], 16)
            w = sum(u >= b for b in bounds)
            n, total = n + w, total + w * change
        if n:
            means.append(total / n / 10000)
    means.sort()
    tail = (1 - confidence) / 2
    at = lambda share: means[math.floor((len(means) - 1) * share)]
    return len(changes), sum(changes.values()) / len(changes) / 10000, at(tail), at(1 - tail)


def test_bounds_are_those_of_poisson():
    shares = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(8)]
    assert [b / 65536 for b in poisson_bounds()] == [round(s * 65536) / 65536 for s in shares][: len(poisson_bounds())]


def test_equals_plain_bootstrap_and_reruns_agree(spark):
    rng = random.Random(3)
    pairs = [(round(rng.uniform(0, 100), 2), round(rng.uniform(0, 100), 2)) for _ in range(60)] + [(None, 5.0), (7.0, None)]
    rows = [regression_verdict(details(spark, pairs), "a", "b").first() for _ in range(2)]
    assert tuple(rows[0])[:4] == plain(pairs) and rows[0] == rows[1]
    assert regression_verdict(details(spark, pairs), "a", "b", seed=2).first()["lower"] != rows[0]["lower"]


def test_verdicts(spark):
    rng = random.Random(4)
    old = [round(rng.uniform(20, 80), 2) for _ in range(80)]
    by = lambda shift: [(o, round(o + shift + rng.uniform(-3, 3), 2)) for o in old]
    said = {shift: regression_verdict(details(spark, by(shift)), "a", "b").first() for shift in (-5, 0, 5)}
    assert {s: r["verdict"] for s, r in said.items()} == {-5: "worse", 0: "no clear change", 5: "better"}
    assert all(r["lower"] <= r["mean_change"] <= r["upper"] for r in said.values())
    assert regression_verdict(details(spark, by(-5)), "a", "b", margin=6.0).first()["verdict"] == "no clear change"


def test_nothing_in_common(spark):
    row = regression_verdict(details(spark, [(1.0, None), (None, 2.0)]), "a", "b").first()
    assert tuple(row) == (0, None, None, None, "no common cases")
