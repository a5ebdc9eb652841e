"""The lattice against an enumeration of all segmentations, and the counts against plain ones."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from answergauge.llm import lattice_lm, queries
from answergauge.llm.common import id_remainder

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lattice():
    return lattice_lm.Lattice(PATH)


def segmentations(word, pieces):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in pieces:
            for rest in segmentations(word[n:], pieces):
                yield [word[:n], *rest]


def test_marginal_is_the_sum_over_all_segmentations(lattice):
    p = {piece: w for piece, w in zip(lattice.pieces[1:], lattice.prior[1:])}
    words = [b"the", b"x", "né".encode(), b"aaa", "日".encode(), b"nation"]
    logs = lattice.log_probabilities(words, np.log(lattice.prior))
    for word, log in zip(words, logs):
        want = sum(math.prod(p[s] for s in cut) for cut in segmentations(b" " + word, p))
        assert log == pytest.approx(math.log(want))


def test_expected_uses(lattice):
    words, counts = [b"the", b"nation", b"aaaa"], np.array([3.0, 1.0, 2.0])
    p = {piece: w for piece, w in zip(lattice.pieces[1:], lattice.prior[1:])}
    want = Counter()
    for word, n in zip(words, counts):
        cuts = [(math.prod(p[s] for s in cut), cut) for cut in segmentations(b" " + word, p)]
        total = sum(w for w, _ in cuts)
        for w, cut in cuts:
            for s in cut:
                want[s] += n * w / total
    got = lattice.expected(words, counts, np.log(lattice.prior))
    assert {lattice.pieces[i]: got[i] for i in np.flatnonzero(got > 1e-15)} == pytest.approx(
        {k: v for k, v in want.items() if v > 1e-15}, rel=1e-6
    )
    assert math.isclose(sum(got[i] * len(s) for i, s in enumerate(lattice.pieces)), sum(c * (len(w) + 1) for w, c in zip(words, counts)))


def test_weights_sum_to_one(lattice):
    assert math.isclose(np.exp(lattice.weights(np.zeros(len(lattice.pieces)))).sum(), 1.0)


def plain(rows):
    """Per row (held_out, n_tokens, n_known, N, base) in plain Python."""
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    cut = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, words in cut if not held(i) for w in words)
    n, v = sum(c.values()), len(c)
    return sorted(
        (str(i), held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6))
        for i, ws in cut
    )


def plain_scores(rows):
    """(id, log10 of the model's probability) in plain Python, but for the lattice, which has tests of its own."""
    cut = [(i, (t or "").encode().lower().split()) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, words in cut if not held(i) for w in words)
    ends = sum(not held(i) for i, _ in cut)
    total, lattice = sum(c.values()) + ends, lattice_lm.Lattice(PATH)
    log_p = np.log(lattice.prior)
    for _ in range(lattice_lm.ROUNDS):
        log_p = lattice.weights(lattice.expected(sorted(c), np.ones(len(c)), log_p))
    words = sorted({w for _, ws in cut for w in ws})
    pieces = dict(zip(words, lattice.log_probabilities(words, log_p) / math.log(10)))
    once, twice = (sum(n == k for n in c.values()) for k in (1, 2))
    d = once / (once + 2 * twice)
    left = d * len(c) / total

    def log(w):
        return math.log10((c[w] - d) / total + left * 10 ** pieces[w]) if c[w] else math.log10(left) + pieces[w]

    # All words of the training texts, what is left for others, and the end have a probability of 1 together.
    assert math.isclose(sum((n - d) / total for n in c.values()) + left + ends / total, 1)
    return sorted((str(i), round(sum(map(log, ws)) + math.log10(ends / total), 5)) for i, ws in cut)


def scored(df):
    rows = df.collect()
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    return sorted(
        (str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows
    )


def test_counts_and_base_with_few_frequent_words(spark):
    rows = [(i, f"The cat{i % 7} sat ON word{i} the É{i % 3}\x0b mat") for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \t "), (None, "the null"), (3, rows[3][1]), (104, "z" * 3000), (105, "a b")]
    table = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, word string")
    got = lattice_lm.score(table, id_remainder("doc_id", 7) == 2, PATH, frequent=3)
    assert scored(got) == plain(rows)
    all_looked_up = lattice_lm.score(table, id_remainder("doc_id", 7) == 2, PATH)
    for made in (got, all_looked_up):
        assert sorted((str(r["doc_id"]), round(r["score"], 5)) for r in made.collect()) == plain_scores(rows)
    assert scored(lattice_lm.score(table.limit(0), id_remainder("doc_id", 7) == 2, PATH)) == []


def test_likelier_than_shuffled_letters(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    from pyspark.sql import functions as F

    both = table.unionAll(table.select(F.col("doc_id") + F.lit(1_000_000), F.reverse("text")))
    rows = lattice_lm.score(both, F.col("doc_id") >= 1_000_000, PATH).collect()
    per = lambda held: sum(r["score"] for r in rows if r["held_out"] == held) / sum(r["n_tokens"] for r in rows if r["held_out"] == held)
    assert per(False) > per(True) + 0.5


def test_query_on_the_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    scores = queries.op4_lattice_score(spark, folder)
    assert scored(scores) == plain(rows)
    assert sorted((str(r["doc_id"]), round(r["score"], 5)) for r in scores.collect()) == plain_scores(rows)


def test_without_training_rows_the_prior_weights_hold(spark, lattice):
    table = spark.createDataFrame([(1, "the nation")], "doc_id long, text string")
    from pyspark.sql import functions as F

    (row,) = lattice_lm.score(table, F.lit(True), PATH).collect()
    logs = lattice.log_probabilities([b"the", b"nation"], np.log(lattice.prior)).sum() + math.log(lattice.prior[0])
    assert row["score"] == pytest.approx(logs / math.log(10)) and row["train_tokens"] == 0


def in_log_space(lattice, words, log_p):
    edges = lattice.edges(words)
    return lattice.forward(edges, log_p)[edges[4] + edges[5]]


def test_words_of_all_lengths_have_the_logs_of_the_log_space(lattice, monkeypatch):
    log_p = np.log(lattice.prior)
    words = [b"", b"\0\xff", b"the", "Straße".encode(), "日本".encode() * 20, b"nation", b"z" * 3000, b"a", b"the", b"of" * 30]
    words += [b"ab" * 9 + b"c" * n for n in range(40)]
    assert lattice.log_probabilities(words, log_p) == pytest.approx(in_log_space(lattice, words, log_p), rel=1e-12)
    counts = np.arange(1.0, len(words) + 1)
    both = lattice.expected(words, counts, log_p)
    assert both == pytest.approx(lattice._expected_of_long(words, counts, log_p), rel=1e-9, abs=1e-12)
    # The much slower log space is for long words alone.
    monkeypatch.setattr(lattice, "edges", None)
    lattice.log_probabilities([b"the", b"nation" * 4], log_p), lattice.expected([b"the", b"nation" * 4], np.ones(2), log_p)


def test_words_of_texts_with_odd_bytes():
    import pyarrow as pa

    texts = [None, b"", b" \t ", b"\x0bThe \xff\xfe\x00 CAT\x0c\r\nthe", "É\xa0\x1c\x85 ß x".encode(), b"a", b"the  A "]
    place, words = lattice_lm.tokens(pa.array(texts, pa.binary()))
    got = list(zip(place.tolist(), words.to_pylist()))
    assert got == [(i, w) for i, t in enumerate(texts) for w in (t or b"").lower().split()]
    place, words = lattice_lm.tokens(pa.array(texts, pa.binary()).slice(3, 2))
    assert list(zip((place + 3).tolist(), words.to_pylist())) == [g for g in got if g[0] in (3, 4)]
    assert len(lattice_lm.tokens(pa.array([None, b""], pa.binary()))[0]) == 0


def test_counts_of_tasks_with_many_words(spark, monkeypatch):
    monkeypatch.setattr(lattice_lm, "SLICE_BYTES", 100)
    monkeypatch.setattr(lattice_lm, "COUNTER_ENTRIES", 20)
    rows = [(f"The cat{i % 7} word{i} {'x ' * (i % 3)}",) for i in range(60)] + [(None,), ("",)]
    table = spark.createDataFrame(rows, "text string").coalesce(1)
    got = {bytes(r["word"]): r["c"] for r in lattice_lm.word_counts(table, "text").collect()}
    assert got == Counter(w for (t,) in rows if t for w in t.lower().encode().split())
