"""Source divergence: whole numbers as in plain Python, with digests of any width."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__
import compare
from answergauge.llm import divergence

FOLDER = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, least=10, top=10):
    """The contract in plain Python; rows are (text, lang, source)."""
    docs = [(Counter(TERM.findall((t or "").translate(LOWER))), lang or "", source or "") for t, lang, source in rows]
    out = []
    for lang in {d[1] for d in docs}:
        held, n_lang, by_source = Counter(), Counter(), {}
        for words, of, source in docs:
            if of == lang:
                held.update(words.keys())
                n_lang.update(words)
                by_source.setdefault(source, Counter()).update(words)
        kept = [w for w in held if held[w] >= least]
        v = len(kept)

        def chances(counts):
            total = sum(counts[w] for w in kept)
            return {w: 1 + 10**9 * (counts[w] + 2) // (total + 2 * v) for w in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        q, ps = chances(n_lang), {s: chances(c) for s, c in by_source.items()}
        for s, p in ps.items():
            pairs = [(sum(f(p[w], o[w]) for w in kept), other) for other, o in ps.items() if other != s]
            terms = [(f(p[w], q[w]), w) for w in kept if by_source[s][w] > 0 and p[w] > q[w]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                for rank, (value, item) in enumerate(found[: top if part == "term" else None], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def audited(df, **options):
    found = divergence.audit(df, **options).select("lang", "source", "part", "item", "value", "rank")
    return sorted(tuple(r) for r in found.collect())


def random_rows(n, seed):
    rng = random.Random(seed)
    words = ["a", "Bé", "bÉ", "ça", "x1y", "the", "日本", "_no_", "ZZ", "é" * 90, "ab" * 300, "q"] + [f"w{c}" for c in "abcdefgh"]
    texts = lambda: " ".join(rng.choice(words[: rng.randint(3, len(words))]) for _ in range(rng.randint(0, 30)))
    # One source holds a third of all rows; ranges of sources differ by language.
    source = lambda: rng.choice(["hot"] * 3 + ["s1", "s2", "s3", "S1", None, ""])
    return [(rng.choice([texts(), texts(), None, "", "12 34"]), rng.choice(["en", "en", "fr", None]), source()) for _ in range(n)]


def table(spark, rows):
    made = [(t, lang, s, i, "x") for i, (t, lang, s) in enumerate(rows)]
    return spark.createDataFrame(made, "text string, lang string, source string, doc_id long, digest string").repartition(3)


@pytest.mark.parametrize("bits, least", [(64, 10), (64, 1), (3, 10), (4, 2)])
def test_equals_brute_force_with_digests_of_any_width(spark, bits, least):
    rows = random_rows(250, bits * least)
    assert audited(table(spark, rows), digest_bits=bits, least_documents=least) == plain(rows, least)


def test_salt_changes_nothing(spark, monkeypatch):
    rows = random_rows(200, 7)
    want = audited(table(spark, rows))
    monkeypatch.setattr(divergence, "SALTS", 1)
    assert audited(table(spark, rows)) == want == plain(rows)


def test_edge_tables(spark):
    assert audited(table(spark, random_rows(5, 1)).limit(0)) == []
    assert audited(table(spark, [(None, None, None)])) == []
    none_kept = [("a b", "en", "s1"), ("a", "en", "s2"), (None, "en", None)]
    assert audited(table(spark, none_kept)) == plain(none_kept) and len(plain(none_kept)) == 6
    same = [("one two two", "en", s) for s in ("s1", "s2") for _ in range(6)]  # repeated rows, ties of all values
    assert audited(table(spark, same)) == plain(same)
    long = [("word " * 400_000 + "end", "en", "s1")] + [("word end other", "en", s) for s in "ab" for _ in range(6)]
    assert audited(table(spark, long)) == plain(long)


def test_terms_of_a_slice():
    texts = ["Ab c", None, "", "é1É", "x"]
    whole = pa.array([None if t is None else t.encode() for t in ["skipped", *texts]], pa.binary())
    terms = divergence.Terms(whole.slice(1), 64)
    want = [(row, w) for row, t in enumerate(texts) for w in TERM.findall((t or "").translate(LOWER))]
    assert [(int(r), terms.text(i).decode()) for i, r in enumerate(terms.row)] == want
    assert len(np.unique(terms.digest)) == len({w for _, w in want})


def test_query_equals_sql(spark):
    name = "op12_source_divergence"
    df = __spark_entry__.queries()[name](spark, FOLDER)
    assert compare.difference(df, compare.connect(FOLDER), __spark_entry__.oracle_sql()[name]) is None
