"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

Shingles are five words, weighted by their number in the text times an inverse document frequency between 1 and
1 + ``IDF_SPAN``, narrow enough for groups of many copies, whose common shingles are frequent, to stay together.
Document frequencies are counted over all documents, in a fixed number of hashed buckets. Each text draws
``BANDS * ROWS`` weighted samples; texts that agree on a whole band become candidates, and candidates
are verified by the weighted Jaccard similarity of their full shingle vectors.

Equal texts are one node from the start. Within a bucket, every node is first compared with one centre, and again
with other centres in ``ROUNDS`` rounds, which is linear in the bucket and unites large groups. What is then left
apart in one bucket is settled exactly: every pair of two components that shares a bucket is verified, unless
filters that lose no pair (prefixes of the rarest shingles, and the weight from the first common one on) rule it out.

Cases: NULL texts and texts without a word are classes of their own; texts of fewer than five words have one
shingle, of all their words; repeated rows share a class; the class is named by its smallest id, NULL
ids being passed over; very long texts cost time and memory in proportion; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answergauge.llm.common import WORD, give_back, in_slices, materialised, ship_package
from answergauge.llm.hashing import ODD, Ranges, mix

SHINGLE = 5
BANDS, ROWS = 18, 4
SIMILARITY = 0.8
IDF_SPAN = 0.5
ROUNDS = 3
BUCKET_BITS = 18
DRAW_BITS = 14
FILTER_BITS = 20
SLICE_BYTES = 1 << 20

_U = np.uint64
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def shingles(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, text after text and sorted within each, and the bounds of the texts."""
    held = [t or b"" for t in texts]
    data = np.frombuffer(b"\n".join(held) + b"\n", np.uint8)
    space = _SPACES[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space])))
    starts, ends = edge[0::2], edge[1::2]
    words = Ranges(data)(starts, ends)
    text_ends = np.cumsum([len(t) + 1 for t in held])
    last = np.searchsorted(starts, text_ends)
    first = np.concatenate([[0], last[:-1]])
    counts = last - first
    windows = np.maximum(counts - SHINGLE + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(windows)])
    total = np.zeros(max(0, len(words)), np.uint64)
    for j in range(min(SHINGLE, len(words))):
        total[: len(words) - j] += words[j:] * _U((2 * j + 1) * 0xD1342543DE82EF95 & (2**64 - 1))
    owner = np.repeat(np.arange(len(held)), windows)
    at = np.arange(bounds[-1]) - bounds[owner] + first[owner]
    out = mix(total[at])
    for i in np.flatnonzero((counts > 0) & (counts < SHINGLE)):
        joined = b" ".join(held[i].split())
        out[bounds[i]] = mix(np.array([hash_bytes(joined)], np.uint64))[0]
    for a, b in zip(bounds[:-1], bounds[1:]):
        out[a:b].sort()
    return out, bounds


def hash_bytes(value: bytes) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(value, digest_size=8).digest(), "little")


def _weighted(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes within each text, how often each stands, and the new bounds."""
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = hashes[1:] != hashes[:-1]
    fresh[bounds[:-1][bounds[:-1] < len(hashes)]] = True
    at = np.flatnonzero(fresh)
    return hashes[at], np.diff(np.append(at, len(hashes))), np.searchsorted(at, bounds)


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(64 - BUCKET_BITS)).astype(np.int64)


@lru_cache(maxsize=1)
def _draws(samples: int) -> tuple[np.ndarray, ...]:
    """Per sample a multiplier, and tables of the draws r, c, beta and of the least value c * exp(-r)."""
    rng = np.random.default_rng(6)
    size = (samples, 1 << DRAW_BITS)
    odd = rng.integers(0, 1 << 63, samples, np.uint64) * _U(2) + _U(1)
    r, c = rng.gamma(2, 1, size), rng.gamma(2, 1, size)
    return odd, r, c, rng.random(size), (c * np.exp(-r)).astype(np.float32), c.astype(np.float32)


def band_keys(hashes: np.ndarray, weights: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The band keys of each text (none may be without shingles).

    Each sample takes the shingle with the least value a = c / (y e^r), where S e^-r < y <= S for a weight S. As
    a lies between c e^-r / S and c / S, only shingles whose lower limit is not above the text's least
    upper limit need the exact value."""
    odd, r, c, beta, low, high = _draws(BANDS * ROWS)
    sizes, n = np.diff(bounds), len(bounds) - 1
    owner = np.repeat(np.arange(n), sizes)
    inverse = (1.0 / weights).astype(np.float32)
    keys = np.zeros((n, BANDS), np.uint64)
    place, value = np.empty_like(hashes), np.empty(len(hashes), np.float32)  # used again for every sample
    at = place.view(np.int64)
    for k in range(BANDS * ROWS):
        np.multiply(hashes, odd[k], out=place)
        np.right_shift(place, _U(64 - DRAW_BITS), out=place)
        np.multiply(np.take(high[k], at, out=value, mode="clip"), inverse, out=value)
        limit = np.minimum.reduceat(value, bounds[:-1]) * np.float32(1.0001)
        np.multiply(np.take(low[k], at, out=value, mode="clip"), inverse, out=value)
        near = np.flatnonzero(value <= np.repeat(limit, sizes))
        i, s, text = at[near], weights[near], owner[near]
        ri, bi = r[k][i], beta[k][i]
        t = np.floor(np.log(s) / ri + bi)
        a = c[k][i] / np.exp(ri * (t - bi) + ri)
        least = np.minimum.reduceat(a, np.searchsorted(text, np.arange(n)))  # of each text; it has one near at least
        chosen = np.flatnonzero(a == least[text])
        if len(chosen) > n:  # the smaller hash of those with the same value
            order = chosen[np.lexsort((hashes[near[chosen]], text[chosen]))]
            chosen = order[np.searchsorted(text[order], np.arange(n))]
        sample = mix(hashes[near[chosen]] + t[chosen].astype(np.int64).astype(np.uint64) * ODD)
        b = k // ROWS
        keys[:, b] = mix(keys[:, b] * ODD + sample + _U(b + 1))
    return keys.view(np.int64)


def weighted_jaccard(a: np.ndarray, b: np.ndarray, idf: np.ndarray) -> float:
    """Of two texts' sorted shingle hashes, each as often as it stands."""
    ua, na = np.unique(a, return_counts=True)
    ub, nb = np.unique(b, return_counts=True)
    wa, wb = na * idf[bucket(ua)], nb * idf[bucket(ub)]
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    both = np.minimum(wa[ia], wb[ib]).sum()
    return float(both / (wa.sum() + wb.sum() - both)) if len(a) and len(b) else 0.0


def node_of(text: Column) -> Column:
    """128 bits of the text's digest: equal texts are one node. NULL for texts without a word."""
    digest = F.substring(F.unhex(F.sha2(text.cast("string").cast("binary"), 256)), 1, 16)
    return F.when(text.cast("string").rlike(WORD), digest)


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    """Node and text of all rows that take part."""
    ship_package(docs.sparkSession)
    text = F.col(text_col).cast("string")
    return docs.select(node_of(F.col(text_col)).alias("node"), text.cast("binary").alias("text")).where(
        F.col("node").isNotNull()
    )


def inverse_document_frequencies(texts: DataFrame) -> np.ndarray:
    """Per bucket, 1 + IDF_SPAN * ln((N + 1) / (df + 1)) / ln(N + 2), over all texts. Each task sends one vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(1 << BUCKET_BITS, np.int64), 0
        for part in in_slices(batches, "text", SLICE_BYTES):
            hashes, bounds = shingles(part.column("text").to_pylist())
            # Sorted hashes have sorted buckets, so a text's repeats of a bucket stand together.
            at, _, _ = _weighted(bucket(hashes), bounds)
            counts += np.bincount(at, minlength=len(counts))
            total += part.num_rows
        give_back()
        yield pa.RecordBatch.from_pydict(
            {
                "piece": pa.array(range(64), pa.int32()),
                "counts": pa.array([list(c) for c in counts.reshape(64, -1)], pa.list_(pa.int64())),
                "total": pa.array([total] * 64, pa.int64()),
            }
        )

    per_task = texts.mapInArrow(run, "piece int, counts array<long>, total long")
    at = per_task.select("piece", "total", F.posexplode("counts").alias("at", "n"))
    sums = at.groupBy("piece", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out, total = np.zeros((64, (1 << BUCKET_BITS) // 64)), 0
    for piece, place, n, total in sums.collect():  # one row a bucket
        out[piece, place] = n
    return 1 + IDF_SPAN * np.log((total + 1) / (out.ravel() + 1)) / np.log(total + 2)


def _signatures(texts: DataFrame, idf) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_slices(batches, "text", SLICE_BYTES):
            hashes, times, bounds = _weighted(*shingles(part.column("text").to_pylist()))
            keys = band_keys(hashes, times * idf.value[bucket(hashes)], bounds)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("node"),
                    pa.ListArray.from_arrays(
                        np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.ravel())
                    ),
                ],
                names=["node", "keys"],
            )
        _draws.cache_clear()
        give_back()

    return texts.mapInArrow(run, "node binary, keys array<long>")


def _vectors(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, hashes: the sorted shingle hashes of each of ``nodes``. A bitmap of fixed size keeps most other
    texts from being hashed again; the join that follows is exact."""
    place = F.pmod(F.xxhash64("node"), F.lit(1 << FILTER_BITS)).cast("int")
    marked = np.zeros(1 << FILTER_BITS, bool)
    found = [r[0] for r in nodes.select(place.alias("p")).distinct().collect()]  # at most 2**FILTER_BITS numbers
    marked[found] = True
    held = texts.sparkSession.sparkContext.broadcast(np.packbits(marked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(held.value).astype(bool)
        for batch in batches:
            some = batch.filter(pa.array(bits[batch.column("place").to_numpy()]))
            for part in in_slices([some], "text", SLICE_BYTES):
                hashes, bounds = shingles(part.column("text").to_pylist())
                packed = [hashes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                seen = dict(zip(part.column("node").to_pylist(), packed))  # copies once
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.binary())], names=["node", "hashes"]
                )
                part = packed = seen = None
            some = None
        give_back()

    made = texts.withColumn("place", place).mapInArrow(run, "node binary, hashes binary")
    return made.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("hashes").alias("hashes"))


def _verified(pairs: DataFrame, vectors: DataFrame, idf, least: float) -> DataFrame:
    """The pairs (a, b) with a weighted Jaccard similarity of at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_slices([batch], "ha", SLICE_BYTES):
                similar = [
                    weighted_jaccard(np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U), idf.value)
                    for x, y in zip(part.column("ha"), part.column("hb"))
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column("a"), part.column("b"), pa.array(similar, pa.float64())], names=["a", "b", "similarity"]
                )
        give_back()

    of_a = vectors.select(F.col("node").alias("a"), F.col("hashes").alias("ha"))
    of_b = vectors.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))
    compared = pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "ha", "hb")
    return compared.mapInArrow(run, "a binary, b binary, similarity double").where(F.col("similarity") >= least)


def components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels (node, label) after uniting the components that ``edges`` (a, b) link: every label becomes the
    smallest it is linked to, directly or over others. Rounds take the smallest neighbouring label, then follow
    labels to their labels, until nothing changes."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    named = labels.select(F.col("node").alias("b"), F.col("label").alias("to"))
    origin = labels.select(F.col("node").alias("a"), F.col("label").alias("root"))
    # Work on the labels themselves from here on: few, one for each component so far.
    links = materialised(both.join(named, "b").join(origin, "a").select("root", "to").where("root != to").distinct())
    roots = materialised(links.select("root", F.col("root").alias("top")).distinct())
    while True:
        near = links.join(roots.select(F.col("root").alias("to"), F.col("top").alias("t")), "to").groupBy("root")
        lower = roots.join(near.agg(F.min("t").alias("t")), "root").select("root", F.least("top", "t").alias("top"))
        lower = materialised(lower)
        jump = lower.select(F.col("root").alias("top"), F.col("top").alias("next"))
        moved = materialised(lower.join(jump, "top").select("root", F.col("next").alias("top")))
        changed = moved.join(roots.withColumnRenamed("top", "was"), "root").where("top != was").limit(1).count()
        roots = moved
        if not changed:
            break
    final = roots.select(F.col("root").alias("label"), "top")
    return materialised(labels.join(final, "label", "left").select("node", F.coalesce("top", "label").alias("label")))


def node_classes(
    docs: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per distinct text with a word: node, copy_of (the smallest id with that text), label (names the
    class of near-duplicates)."""
    texts = _texts(docs, text_col)
    idf = docs.sparkSession.sparkContext.broadcast(inverse_document_frequencies(texts))  # 2**BUCKET_BITS numbers
    signed = materialised(_signatures(texts, idf)).select("node", F.explode("keys").alias("key"))
    shared = (
        signed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo != hi").select("key")
    )
    members = materialised(signed.join(shared, "key", "left_semi").distinct())
    nodes = materialised(members.select("node").distinct())
    vectors = materialised(_vectors(texts, nodes))
    labels = nodes.select("node", F.col("node").alias("label"))
    tested = None
    for round_ in range(ROUNDS):
        pairs = _star_pairs(members, labels, round_)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialised(pairs)
        if not pairs.limit(1).count():
            break
        tested = pairs if tested is None else tested.unionAll(pairs)
        labels = components(labels, materialised(_verified(pairs, vectors, idf, least)))
    pairs = _rest_pairs(members, labels, vectors, idf, least)
    if tested is not None:
        pairs = pairs.join(tested, ["a", "b"], "left_anti")
    pairs = materialised(pairs)
    if pairs.limit(1).count():
        labels = components(labels, materialised(_verified(pairs, vectors, idf, least)))
    copies = (
        docs.select(node_of(F.col(text_col)).alias("node"), F.col(id_col).alias("id"))
        .where(F.col("node").isNotNull())
        .groupBy("node")
        .agg(F.min("id").alias("copy_of"))
    )
    named = copies.join(labels, "node", "left")
    return materialised(named.select("node", "copy_of", F.coalesce("label", "node").alias("label")))


def classes(
    docs: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: the id, ``copy_of`` (the smallest id with an equal text) and ``class_id`` (the smallest id of
    the near-duplicates it belongs to)."""
    named = node_classes(docs, least, id_col, text_col)
    smallest = named.groupBy("label").agg(F.min("copy_of").alias("class_id"))
    of_node = materialised(named.join(smallest, "label").select("node", "copy_of", "class_id"))
    rows = docs.select(F.col(id_col).alias("_id"), node_of(F.col(text_col)).alias("node"))
    alone = rows.where(F.col("node").isNull()).select(
        F.col("_id").alias(id_col), F.col("_id").alias("copy_of"), F.col("_id").alias("class_id")
    )
    joined = rows.where(F.col("node").isNotNull()).join(of_node, "node")
    return joined.select(F.col("_id").alias(id_col), "copy_of", "class_id").unionAll(alone)


def deduplicate(
    docs: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class the row with the smallest id stays, once;
    texts that take no part stay. All columns are kept; names that begin with ``_near`` are reserved."""
    named = node_classes(docs, least, id_col, text_col)
    chosen = (
        named.groupBy("label")
        .agg(F.min(F.struct(F.col("copy_of").isNull().alias("last"), "copy_of", "node")).alias("one"))
        .select(F.col("one.node").alias("_near_n"), F.col("one.copy_of").alias("_near_i"))
    )
    with_node = docs.withColumn("_near_node", node_of(F.col(text_col)))
    # Node and id together: the ids spread the copies of one text.
    match = (F.col("_near_node") == F.col("_near_n")) & F.col(id_col).eqNullSafe(F.col("_near_i"))
    kept = with_node.where(F.col("_near_node").isNotNull()).join(materialised(chosen), match, "left_semi")
    once = kept.dropDuplicates(["_near_node", id_col])
    return once.unionByName(with_node.where(F.col("_near_node").isNull())).drop("_near_node")


def _star_pairs(members: DataFrame, labels: DataFrame, round_: int) -> DataFrame:
    """Pairs to compare: in each bucket, one node of every component with that of the bucket's centre.
    The centre is the same node in all buckets in round 0, and drawn per bucket and round after it."""
    rank = F.xxhash64("node") if round_ == 0 else F.xxhash64(F.lit(round_), "key", "node")
    labelled = members.join(labels, "node").withColumn("rank", rank)
    one = labelled.groupBy("key", "label").agg(F.min(F.struct("rank", "node")).alias("one"))
    centre = (
        one.groupBy("key")
        .agg(F.min(F.struct("one", "label")).alias("centre"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        .where("lo != hi")
        .select("key", F.col("centre.one.node").alias("c"), F.col("centre.label").alias("c_label"))
    )
    met = one.join(centre, "key").where("label != c_label").select(F.col("one.node").alias("n"), "c")
    return met.select(F.least("n", "c").alias("a"), F.greatest("n", "c").alias("b")).distinct()


def _shingle_weights(vectors: DataFrame, idf) -> DataFrame:
    """node, hash, weight: one row per distinct shingle of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_slices(batches, "hashes", SLICE_BYTES):
            packed = part.column("hashes").to_pylist()
            bounds = np.concatenate([[0], np.cumsum([len(p) // 8 for p in packed])]).astype(np.int64)
            hashes, times, bounds = _weighted(np.frombuffer(b"".join(packed), _U), bounds)
            owner = np.repeat(np.arange(len(packed)), np.diff(bounds))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("node").take(pa.array(owner)),
                    pa.array(hashes.view(np.int64)),
                    pa.array(times * idf.value[bucket(hashes)], pa.float64()),
                ],
                names=["node", "hash", "weight"],
            )
        give_back()

    return vectors.mapInArrow(run, "node binary, hash long, weight double")


def _rest_pairs(members: DataFrame, labels: DataFrame, vectors: DataFrame, idf, least: float) -> DataFrame:
    """All pairs of nodes that share a bucket, are in different components and may have a similarity of ``least``.

    Such a pair has an overlap of at least ``least`` times either weight. All common shingles stand at or after
    the first common one, with the rarest first; so that one lies where the weight from it on is as much, in both
    texts, and only such shingles are joined on. Two nodes alone in a bucket have met in round 0."""
    slack = 1 - 1e-9
    labelled = members.join(labels, "node")
    unsettled = (
        labelled.groupBy("key")
        .agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"))
        .where("lo != hi and n > 2")
        .select("key")
    )
    nodes = materialised(
        labelled.join(unsettled, "key", "left_semi")
        .groupBy("node")
        .agg(F.first("label").alias("label"), F.collect_list("key").alias("keys"))  # at most BANDS keys
    )
    weighed = materialised(_shingle_weights(vectors.join(nodes.select("node"), "node", "left_semi"), idf))
    shared = weighed.groupBy("hash").agg(F.count("*").alias("df")).where("df > 1")
    of_node = Window.partitionBy("node")  # as long as the node's text
    onward = of_node.orderBy(F.col("df").desc_nulls_last(), F.col("hash").desc())
    first = (
        weighed.join(shared, "hash", "left")
        .select(
            "node", "hash", "df", F.sum("weight").over(of_node).alias("total"), F.sum("weight").over(onward).alias("onward")
        )
        .where(F.col("df").isNotNull() & (F.col("onward") >= F.col("total") * (least * slack)))
        .drop("df")
    )
    postings = materialised(first.join(nodes, "node"))
    # Components first, then their nodes: pairs within a component are never made.
    groups = postings.groupBy("hash", F.col("label").alias("other")).agg(
        F.max("onward").alias("most"), F.min("total").alias("lightest")
    )
    share = least / (1 + least) * slack
    met = postings.join(groups, "hash").where(
        (F.col("label") < F.col("other"))
        & (F.least("onward", "most") >= (F.col("total") + F.col("lightest")) * share)
    )
    others = postings.select(
        "hash",
        F.col("label").alias("other"),
        F.col("node").alias("n"),
        F.col("keys").alias("n_keys"),
        F.col("total").alias("n_total"),
        F.col("onward").alias("n_onward"),
    )
    both = met.drop("most", "lightest").join(others, ["hash", "other"]).where(
        (F.least("onward", "n_onward") >= (F.col("total") + F.col("n_total")) * share)
        & F.arrays_overlap("keys", "n_keys")
    )
    return both.select(F.least("node", "n").alias("a"), F.greatest("node", "n").alias("b")).distinct()
