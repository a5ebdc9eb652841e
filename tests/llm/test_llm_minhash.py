"""Sampling against its definition, classes against brute force."""

import random

import numpy as np

from answergauge.llm import weighted_minhash as near
from answergauge.llm.hashing import ODD, mix


def plain_keys(hashes, weights):
    odd, r, c, beta, _, _ = near._draws(near.BANDS * near.ROWS)
    keys = np.zeros(near.BANDS, np.uint64)
    for k in range(near.BANDS * near.ROWS):
        i = ((hashes * odd[k]) >> np.uint64(64 - near.DRAW_BITS)).astype(int)
        t = np.floor(np.log(weights) / r[k][i] + beta[k][i])
        y = np.exp(r[k][i] * (t - beta[k][i]))
        a = c[k][i] / (y * np.exp(r[k][i]))
        best = np.lexsort((hashes, a))[:1]
        sample = mix(hashes[best] + t[best].astype(np.int64).astype(np.uint64) * ODD)
        keys[k // near.ROWS] = mix(keys[[k // near.ROWS]] * ODD + sample + np.uint64(k // near.ROWS + 1))[0]
    return keys.view(np.int64)


def test_limits_do_not_change_the_samples():
    rng = np.random.default_rng(3)
    sizes = [1, 2, 40, 700]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    hashes = rng.integers(0, 1 << 63, sum(sizes), np.uint64)
    weights = rng.uniform(1, 2, sum(sizes)) * rng.integers(1, 9, sum(sizes))
    got = near.band_keys(hashes, weights, bounds)
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        assert got[i].tolist() == plain_keys(hashes[a:b], weights[a:b]).tolist()


def test_only_equal_values_are_sorted(monkeypatch):
    """Most samples have one least value a text; sorting all that come near it took most of the time."""
    rng = np.random.default_rng(5)
    sizes = [1, 3000, 500, 2, 900]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    hashes = rng.integers(0, 1 << 63, sum(sizes), np.uint64)
    weights = np.ones(sum(sizes))  # so that shingles of one cell of the tables tie
    sort, seen = np.lexsort, []
    with monkeypatch.context() as patched:
        patched.setattr(np, "lexsort", lambda columns: seen.append(len(columns[0])) or sort(columns))
        got = near.band_keys(hashes, weights, bounds)
    assert seen and sum(seen) < 2 * len(sizes) * near.BANDS * near.ROWS
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        assert got[i].tolist() == plain_keys(hashes[a:b], weights[a:b]).tolist()


def test_shingles_are_five_words():
    same = [b"a b c d e f", b"a  b\tc d\ne f", b"b c d e f", b"x", b"", None, b"one two", b"one two three four five"]
    hashes, bounds = near.shingles(same)
    sets = [set(hashes[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]
    assert [len(s) for s in sets] == [2, 2, 1, 1, 0, 0, 1, 1]
    assert sets[0] == sets[1] and sets[2] < sets[0] and sets[3] != sets[6]


def brute(rows, idf):
    """Components over all pairs of texts with a weighted similarity of 0.8."""
    texts = sorted({t for _, t in rows if t and t.split()})
    sets = [near.shingles([t.encode()])[0] for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if near.weighted_jaccard(sets[i], sets[j], idf) >= 0.8:
                root[find(i)] = find(j)
    of = {t: find(i) for i, t in enumerate(texts)}
    least = {}
    for i, t in rows:
        if t in of and i is not None:
            least[of[t]] = min(i, least.get(of[t], i))
    return sorted(((str(i), str(least[of[t]] if t in of else i)) for i, t in rows))


def rows_of(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, n = [], 0
    for group in range(12):
        words = [word() for _ in range(rng.choice([60, 150, 400]))]
        for copy in range(rng.choice([1, 2, 6, 25])):
            own = list(words)
            for _ in range(copy % 3):
                own[rng.randrange(len(own))] = word()
            rows.append((n * 3 % 997, " ".join(own)))
            n += 1
    return rows + [(1001, None), (1002, ""), (1003, ""), (1004, " \n"), (1005, "two words"), (1006, "two words"), (None, rows[5][1])]


def test_classes(spark):
    for seed in (1, 2):
        rows = rows_of(seed)
        table = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
        idf = near.inverse_document_frequencies(near._texts(table, "text"))
        got = near.classes(table).collect()
        assert sorted((str(r["doc_id"]), str(r["class_id"])) for r in got) == brute(rows, idf)


def test_one_of_each_class_stays(spark):
    rows = rows_of(3)
    rows.append(rows[0])
    table = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    kept = near.deduplicate(table)
    assert kept.columns == table.columns
    got = sorted(str(r["doc_id"]) for r in kept.collect())
    classes = near.classes(table).collect()
    assert got == sorted({str(r["class_id"]) for r in classes})


def test_empty_table(spark):
    table = spark.createDataFrame([], "doc_id long, text string")
    assert near.classes(table).count() == 0 and near.deduplicate(table).count() == 0


def test_families_over_a_shared_template(spark):
    """Pairs of texts around 0.82 in buckets full of other pairs, which are alike to about 0.7 over a template."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    template, rows = [word() for _ in range(118)], []
    for family in range(200):
        base = template + [word() for _ in range(6)]
        rows += [(2 * family + copy, " ".join(base + [word() for _ in range(9)])) for copy in (0, 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    idf = near.inverse_document_frequencies(near._texts(table, "text"))
    want = brute(rows, idf)
    assert sum(i != c for i, c in want) > 150 and len({c for _, c in want}) > 150
    got = near.classes(table).collect()
    assert sorted((str(r["doc_id"]), str(r["class_id"])) for r in got) == want
