"""Mixing: water-filling against a plain loop, selection near the targets, edge rows."""

import random
import re

import pytest

from answergauge.llm import mixing

SCHEMA = "doc_id long, text string, source string, _size string, size int"


def plain_targets(sizes, weights, share, epochs):
    """Clamp and deal out again, source by source, until nothing is above."""
    wanted, clamped = share * sum(sizes.values()), {}
    while True:
        free = {s: weights[s] for s in sizes if s not in clamped}
        if not free:
            return clamped
        rest = wanted - sum(clamped.values())
        level = rest / sum(free.values())
        over = [s for s in free if level * weights[s] > epochs * sizes[s]]
        if not over:
            return clamped | {s: level * weights[s] for s in free}
        clamped |= {s: float(epochs * sizes[s]) for s in over}


def docs(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        source = rng.choice([None, "a", "a", "a", "a", "b", "c", "é", "Z"])
        rows.append((i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 60))), source, "x", 1))
    rows += [(400, None, "a", None, None), (401, "", None, None, None), (402, None, "empty", None, None)]
    rows += [(None, "one two", "b", None, None), (7, rows[7][1], rows[7][2], None, None)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_targets_and_taken_words(spark):
    rows, table = docs(spark)
    mixture, tickets = mixing.mix(table)
    got = mixture.plan(tickets).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want = plain_targets(sizes, weights, 1.5, 2.0)
    state = {r["_mix_source"]: r["_mix_target"] for r in mixture.state.collect()}
    assert state == pytest.approx(want)
    assert all(0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["size"] * r["repeats"] for r in got)
    source_of = {r[0]: r[2] for r in rows}
    by_source = {}
    for r in got:
        by_source[source_of[r["doc_id"]]] = by_source.get(source_of[r["doc_id"]], 0) + r["taken"]
    for source, taken in by_source.items():
        assert abs(taken - want[source]) <= max(3, 0.02 * want[source])
    again = mixing.mix(table)
    assert sorted(map(repr, again[0].plan(again[1]).collect())) == sorted(map(repr, got))


def test_rows_come_as_often_as_planned(spark):
    _, table = docs(spark)
    mixture, tickets = mixing.mix(table)
    planned = sum(r["repeats"] for r in mixture.plan(tickets).collect())
    rows = mixture.rows(table)
    assert rows.columns == table.columns and rows.count() == planned


def test_weights_from_a_table_and_more_than_all(spark):
    _, table = docs(spark)
    weights = spark.createDataFrame([("a", 3.0), (None, 1.0)], "source string, weight double")
    mixture, tickets = mixing.mix(table, weights, share=0.1)
    assert {r["_mix_source"] for r in mixture.state.where("_mix_target > 0").collect()} == {"a", None}
    mixture, tickets = mixing.mix(table, share=5.0)
    assert all(r["taken"] == 2 * r["size"] for r in mixture.plan(tickets).collect())


def test_a_long_text_at_the_cut_and_equal_rows(spark):
    """Sources of many short texts and a long one, and a source of one row many times: all come near their targets."""
    rng = random.Random(8)
    rows = []
    for source in "abcdefgh":
        rows += [(len(rows) + i, "w " * rng.randint(10, 60), source) for i in range(300)]
        rows.append((len(rows), "w " * 4000, source))
    rows += [(99999, "w " * 100, "z")] * 41
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(text) // 2
    weights = spark.createDataFrame([(s, float(n)) for s, n in sizes.items()], "source string, weight double")
    mixture, tickets = mixing.mix(table, weights, share=0.5)
    taken = {}
    for r in mixture.plan(tickets).collect():
        taken[r["source_size"]] = taken.get(r["source_size"], 0) + r["taken"]
    assert len(taken) == len(sizes)
    for source, size in sizes.items():
        assert abs(taken[size] - size / 2) <= (50 if source == "z" else 0.005 * size)
    assert mixture.rows(table).where("source = 'z'").count() in (20, 21)


def test_empty_table(spark):
    mixture, tickets = mixing.mix(spark.createDataFrame([], SCHEMA))
    assert mixture.plan(tickets).count() == 0


def test_no_python_in_the_plan(spark):
    mixture, tickets = mixing.mix(docs(spark)[1])
    plan = mixture.plan(tickets)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
