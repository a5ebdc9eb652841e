"""Top-k search against brute force, over many small tiles."""

import math
import random

import pytest

import compare
from answergauge.llm import queries, topk

FOLDER = "/root/testdata/sf0.001"


def brute(rows, is_query, k):
    vectors = [
        (i, [math.floor(256 * x) for x in v])
        for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, a in vectors:
        if is_query(q):
            found = sorted(
                (-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b)))), i)
                for i, b in vectors
                if i != q and len(a) == len(b)
            )[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(found, 1)]
    return sorted(out)


def searched(spark, rows, k=5):
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, id int")
    found = topk.search(table.where("vec_id % 5 = 0"), table, k)
    return sorted(tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in found.collect())


def test_small_tiles_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 7)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 4)
    monkeypatch.setattr(topk, "GROUP_SHARDS", 2)
    monkeypatch.setattr(topk, "FAN", 3)
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.1, -0.25, 0.5, 0.0]) for _ in range(3)]) for i in range(150)]
    rows += [(200, None), (205, []), (210, [1.0, None, 2.0]), (215, [math.nan, 1.0, 1.0]), (220, [math.inf, 0.0, 0.0])]
    rows += [(None, [1.0, 1.0, 1.0]), (225, [1.0, 2.0]), (226, [3.0, 1.0]), (230, [1e9, -1e9, 1e9]), (231, [1e18, 1e18, 1e18])]
    rows += [rows[7]]
    assert searched(spark, rows) == brute(rows, lambda q: q % 5 == 0, 5)


def test_no_candidates_and_empty(spark):
    assert searched(spark, [(5, [1.0])]) == []
    assert searched(spark, []) == []


@pytest.mark.skipif(not __import__("os").path.isdir(FOLDER), reason="no test data")
def test_query_equals_sql(spark):
    con = compare.connect(FOLDER)
    assert compare.difference(queries.op3_exact_topk(spark, FOLDER), con, queries.OP3_SQL) is None


def test_grid_gives_every_task_a_pair_of_groups():
    assert topk.grid(0, 0, 8) == (1, 1) and topk.grid(1, 1, 8) == (1, 1)
    for shards, blocks, tasks in ((13, 2, 8), (13, 2, 200), (1, 30, 8), (200, 5, 64), (5000, 300, 200), (3, 3, 1)):
        s, b = topk.grid(shards, blocks, tasks)
        assert 1 <= s <= shards and 1 <= b <= blocks
        assert s * topk.GROUP_SHARDS >= shards and b * topk.GROUP_BLOCKS >= blocks
        assert s * b >= min(tasks, shards * blocks)
    assert topk.grid(5000, 300, 200) == (313, 19)


def test_groups_do_not_change_results(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(120)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    monkeypatch.setattr(topk, "SHARD_ROWS", 6)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 4)
    got = []
    for split in ((1, 1), (3, 1), (1, 4), (5, 3)):
        monkeypatch.setattr(topk, "grid", lambda *_, split=split: split)
        got.append(sorted(map(tuple, topk.search(vectors.where("vec_id % 3 = 0"), vectors).collect())))
    assert len(got[0]) == 200 and all(g == got[0] for g in got)
