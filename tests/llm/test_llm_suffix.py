"""Repeated strings against a set of all windows."""

import hashlib
import random

import numpy as np
import pyarrow.compute as pc
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from answergauge.llm import queries, suffix_dedup


def brute(docs):
    """docs: (id, text). A window's place is its document's id and its start; the least place of a string stays."""
    last = (1 << 63) - 1
    first, out = {}, []
    for key, data in docs:
        for i in range(len(data) - 99):
            place = (last if key is None else key, i)
            first[data[i : i + 100]] = min(place, first.get(data[i : i + 100], place))
    for key, data in docs:
        removed = np.zeros(len(data), bool)
        for i in range(len(data) - 99):
            if first[data[i : i + 100]] != (last if key is None else key, i):
                removed[i : i + 100] = True
        kept = np.frombuffer(data, np.uint8)[~removed].tobytes()
        spans = int((np.diff(np.concatenate([[0], removed.astype(int)])) == 1).sum())
        out.append((str(key), len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def cut(df):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


def rows_of(seed):
    rng = random.Random(seed)
    passage = "abcdefghij" * 40
    rows = [(1, "x" * 50), (2, None), (3, ""), (4, "a" * 1000), (5, "a" * 99), (6, "a" * 100), (7, passage)]
    rows += [(8, "zz" + passage[5:300] + "é" * 80), (9, "é" * 80), (4, "a" * 1000), (None, passage), (6, "b" + "a" * 150)]
    base = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    for i in range(10, 60):
        a = rng.randint(0, 2500)
        t = base[a : a + rng.randint(50, 500)]
        p = rng.randint(0, len(t) - 1)
        rows.append((i, "".join(rng.choice("xyzw ") for _ in range(rng.randint(0, 200))) + t[:p] + rng.choice(["", "Q"]) + t[p:]))
    return rows


def test_small_documents_in_small_slices(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 5000)
    for seed in (1, 2):
        rows = rows_of(seed)
        table = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, digest string")
        got = cut(suffix_dedup.remove_repeats(table.repartition(5)))
        assert got == brute([(i, (t or "").encode()) for i, t in rows])


def test_a_hot_anchor_is_split(spark, monkeypatch):
    """One short phrase in many different surroundings, and some texts that repeat one another around it."""
    most = 20000
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", most)
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("bcdefgh ") for _ in range(n))

    def gram(t):
        words = np.frombuffer(t.encode(), "<u8")
        return int(suffix_dedup.mix(words[:1] * suffix_dedup.ODD + suffix_dedup.mix(words[1:]))[0])

    phrase = min((text(16) for _ in range(3000)), key=gram)  # the anchor of nearly all windows that hold it
    rows = [(i, text(rng.randint(80, 120)) + phrase + text(rng.randint(80, 120))) for i in range(600)]
    rows += [(600 + i, "Q" + rows[7 * i][1][30:]) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    whole = suffix_dedup._sort_bucket

    def bounded(group):
        held = sum(int.from_bytes(b[:8], "little") for b in group["blob"].to_pylist() if b is not None)
        assert held < 4 * most, held
        return whole(group)

    monkeypatch.setattr(suffix_dedup, "_sort_bucket", bounded)
    assert cut(suffix_dedup.remove_repeats(table)) == brute([(i, t.encode()) for i, t in rows])


def test_slices_are_packed_together(spark, monkeypatch):
    """A bucket gets one blob from several slices, in which runs keep their documents."""
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 1000)
    monkeypatch.setattr(suffix_dedup, "PACK_BYTES", 12000, raising=False)
    rows = rows_of(3) + [((1 << 62) + i, f"{i}" + t) for i, t in rows_of(4)[-20:]]
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert cut(suffix_dedup.remove_repeats(table)) == brute([(i, (t or "").encode()) for i, t in rows])
    columns = table.select(
        F.coalesce("doc_id", F.lit(int(suffix_dedup.LAST_ID))).alias("id"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
        F.lit(b"").alias("digest"),
    )
    dealt = columns.mapInArrow(suffix_dedup._deal(2, np.zeros(0, np.int64)), suffix_dedup._SPAN).toArrow()
    blobs = dealt.filter(pc.is_valid(dealt["bucket"]))
    assert sum(len(t or "") for _, t in rows) > 15 * 1000
    assert 2 < blobs.num_rows < 15  # three or more packs of both buckets
    named = dealt.filter(pc.is_valid(dealt["id"]))
    ids = dict(zip(zip(named["slice"].to_pylist(), named["doc"].to_pylist()), named["id"].to_pylist()))
    assert sorted(ids.values()) == sorted(suffix_dedup.LAST_ID if i is None else i for i, _ in rows)
    head, _ = suffix_dedup._unpacked(blobs["blob"], blobs["slice"].to_pylist())
    assert [ids[doc >> 32, doc & 0xFFFFFFFF] for doc in head["doc"].tolist()] == head["id"].tolist()


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r[0], (r[1] or "").encode()) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert cut(queries.op5_suffix_dedup(spark, folder)) == brute(docs)


def test_empty_table(spark):
    assert cut(suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string"))) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=100, max_size=160), min_size=1, max_size=8), st.integers(0, 3))
def test_deep_shallow_sorting(texts, groups):
    data = np.frombuffer("".join(texts).encode() + bytes(8), np.uint8)
    starts, place, group, at = [], [], [], 0
    for n, t in enumerate(texts):
        for i in range(len(t) - 99):
            starts.append(at + i)
            group.append(n % (groups + 1))
            place.append(n * 1000 + i)
        at += len(t)
    starts, place, group = map(np.array, (starts, place, group))
    got = suffix_dedup.repeated_windows(data, starts, group, place)
    first, want = {}, []
    keyed = [(g, data[s : s + 100].tobytes()) for s, g in zip(starts, group)]
    for k, p in zip(keyed, place):
        first[k] = min(first.get(k, p), p)
    want = [p != first[k] for k, p in zip(keyed, place)]
    assert got.tolist() == want


def test_windows_lie_in_exactly_one_run():
    rng = np.random.default_rng(1)
    sizes = [0, 99, 100, 101, 5000, 30, 700]
    data = rng.integers(97, 100, sum(sizes)).astype(np.uint8)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    start, windows, anchor, _ = suffix_dedup.runs_of(data, bounds)
    covered = [i for s, n in zip(start, windows) for i in range(s, s + n)]
    assert covered == [i for a, b in zip(bounds[:-1], bounds[1:]) for i in range(a, b - 99)]
    assert all(s + n - 1 <= a <= s + 84 for s, n, a in zip(start, windows, anchor))
