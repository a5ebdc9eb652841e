"""Audit of sources: how far the terms of a source diverge from those of the others of its language, and which do it.

Strings are materialised late. Texts are cut into terms and counted by 64-bit digests of terms and of (language, source)
groups: only numbers of fixed width are shuffled. Which digests are kept is decided on them (a digest stands in at least
as many documents as any of its terms). Only kept digests then fetch their text, as the least and the greatest string
that has them: where these differ, several terms share the digest, and it is split by counting its strings exactly. In the
end the text is joined to the rows that are given out.

Divergences are sums of floor((p - q)^2 / (p + q)) in whole numbers. The sum over all terms of a pair of sources comes from
three parts: terms that both have (pairs within a term, summed up in the task that holds the term), terms that one has
(from the histogram of its counts), and the constant of those that neither has. So absent terms are never listed.

Cases: NULL and empty texts have no terms, but their group counts; a NULL language or source is the empty one; repeated
rows and ids are documents each; ties of values go by the bytes of the item; very long texts are cut in slices of whole
documents; an empty table gives no rows; only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answergauge.llm.common import in_slices, materialised, ship_package
from answergauge.llm.hashing import BASES, Ranges

LEAST_DOCUMENTS = 10
TOP_TERMS = 10
UNIT = 1_000_000_000
SLICE_BYTES = 1 << 20
HELD_ROWS = 1 << 19
# Bits that tell which digests are kept; broadcast as 1 MB. Strings of other digests with these bits go with them.
FILTER_BITS = 1 << 23
LONG_TERM = 128
PAIR_CELLS = 1 << 19
SALTS = 16

_TERM_BYTE = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


class Terms:
    """The terms of a slice of texts: row, bytes from ``start`` to ``end`` of ``data``, digest."""

    def __init__(self, texts: pa.Array, bits: int):
        texts = pc.fill_null(texts, b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        if texts.buffers()[2] is None or offsets[-1] == offsets[0]:
            data = np.zeros(0, np.uint8)
        else:
            data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        self.data = _LOWER[data]
        inside = np.concatenate([[False], _TERM_BYTE[data], [False]])
        breaks = np.zeros(len(data) + 1, bool)  # where a text begins, a term does not go on
        breaks[offsets] = True
        before, here = inside[:-1], inside[1:]
        self.start = np.flatnonzero(here & (~before | breaks))
        self.end = np.flatnonzero(before & (~here | breaks))
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.shift = np.uint64(64 - bits)
        self.digest = self._hashes(BASES[0]) >> self.shift

    def _hashes(self, base: int) -> np.ndarray:
        out = Ranges(self.data, base)(self.start, self.end)
        # The polynomials of all bases agree on some very long strings.
        for i in np.flatnonzero(self.end - self.start > LONG_TERM):
            out[i] = xxhash.xxh64_intdigest(self.text(i), seed=base & 0xFFFFFFFF)
        return out

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def second(self) -> np.ndarray:
        """Another hash, independent of the digest."""
        return self._hashes(BASES[1])


def _summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Values summed by equal keys."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    return [k[at] for k in keys], [np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values]


def _with_keys(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """The documents as ``lang_key``, ``grp``, ``text``, and the groups: ``lang``, ``source`` and their keys, which
    tell all groups and all languages apart."""
    named = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.col(text_col).cast("string").cast("binary").alias("text"),
    )
    groups = materialised(named.select("lang", "source").distinct())
    for seed in itertools.count():
        keys = {
            "lang_key": F.xxhash64(F.lit(seed), "lang"),
            "grp": F.xxhash64(F.lit(seed), "lang", "source"),
        }
        keyed = groups.withColumns(keys)
        found = keyed.agg(
            F.count_distinct("lang") == F.count_distinct("lang_key"), F.count("*") == F.count_distinct("grp")
        ).first()
        if all(found):
            return named.select(*[k.alias(n) for n, k in keys.items()], "text"), keyed


def _digest_counts(texts: DataFrame, bits: int) -> DataFrame:
    """digest, lang_key, grp, n, docs: what a task has counted, combined within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        names = ["digest", "lang_key", "grp", "n", "docs"]

        def combined() -> tuple:
            columns = [np.concatenate(c) for c in zip(*held)]
            keys, sums = _summed(columns[:3], columns[3:])
            return (*keys, *sums)

        for part in in_slices(batches, "text", SLICE_BYTES):
            terms = Terms(part.column("text"), bits)
            lang, group = (part.column(c).to_numpy() for c in ("lang_key", "grp"))
            # By digest and row; then by digest and group.
            digest = terms.digest.view(np.int64)
            order = np.argsort(digest, kind="stable")
            digest, row = digest[order], terms.row[order]
            new = np.ones(len(order), bool)
            new[1:] = (digest[1:] != digest[:-1]) | (row[1:] != row[:-1])
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(order)))
            keys, sums = _summed([digest[at], group[row[at]]], [n, np.ones(len(at), np.int64)])
            of = dict(zip(group.tolist(), lang.tolist()))
            which, back = np.unique(keys[1], return_inverse=True)
            langs = np.array([of[g] for g in which.tolist()], np.int64)[back]
            held.append((keys[0], langs, keys[1], *sums))
            if sum(len(h[0]) for h in held) > HELD_ROWS:
                held = [combined()]
                if len(held[0][0]) > HELD_ROWS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], names=names)
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in combined()], names=names)

    return texts.mapInArrow(run, "digest long, lang_key long, grp long, n long, docs long")


def _kept(counts: DataFrame, least_documents: int, *key: str) -> DataFrame:
    """Counts by term and group of the terms that stand in enough documents of their language, with ``lang_n``. All
    rows of a digest meet in one partition, at most one a group after the first aggregate."""
    summed = (
        counts.repartition("digest")
        .groupBy(*key, "lang_key", "grp")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )
    term = Window.partitionBy(*key, "lang_key")
    return (
        summed.withColumns({"_docs": F.sum("docs").over(term), "lang_n": F.sum("n").over(term)})
        .where(F.col("_docs") >= least_documents)
        .drop("_docs", "docs")
    )


def _filter_of(digests: DataFrame) -> np.ndarray:
    """A bitmap in which the bit of each digest is set: ``FILTER_BITS`` bits, whatever the number of digests."""
    place = F.pmod("digest", F.lit(FILTER_BITS)) + 1  # buckets count from 1
    per_bucket = digests.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")
    )
    out = np.zeros(FILTER_BITS, bool)
    for bucket, bits in per_bucket.collect():  # FILTER_BITS / 32,768 rows
        found = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
        out[(bucket - 1) * len(found) : bucket * len(found)] = found
    return np.packbits(out)


def _passes(digest: np.ndarray, packed: np.ndarray) -> np.ndarray:
    bit = (digest.view(np.int64) % FILTER_BITS).astype(np.int64)
    return (packed[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1


def _strings(texts: DataFrame, digests: DataFrame, bits: int) -> DataFrame:
    """digest, least, greatest: the least and the greatest string of each of ``digests`` (and of some more)."""
    wanted = texts.sparkSession.sparkContext.broadcast(_filter_of(digests))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, bytes] = {}
        greatest: dict[int, bytes] = {}  # where it is another one

        def flushed() -> pa.RecordBatch:
            keys = list(least)
            columns = [least.values(), [greatest.get(k, least[k]) for k in keys]]
            batch = pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), *[pa.array([v.decode() for v in c], pa.string()) for c in columns]],
                names=["digest", "least", "greatest"],
            )
            least.clear()
            greatest.clear()
            return batch

        for part in in_slices(batches, "text", SLICE_BYTES):
            terms = Terms(part.column("text"), bits)
            hit = np.flatnonzero(_passes(terms.digest, wanted.value))
            digest, second = terms.digest[hit].view(np.int64), terms.second()[hit]
            order = np.lexsort((second, digest))
            digest, second = digest[order], second[order]
            new = np.ones(len(order), bool)
            new[1:] = (digest[1:] != digest[:-1]) | (second[1:] != second[:-1])
            first = np.flatnonzero(new)
            for key, i in zip(digest[first].tolist(), hit[order[first]].tolist()):
                known = least.get(key)
                if known is None:
                    least[key] = terms.text(i)
                elif len(known) != terms.end[i] - terms.start[i] or known != terms.text(i):
                    text = terms.text(i)
                    greatest[key] = max(greatest.get(key, known), text)
                    least[key] = min(known, text)
            if len(least) > HELD_ROWS // 2:
                yield flushed()
        yield flushed()

    found = texts.select("text").mapInArrow(run, "digest long, least string, greatest string")
    return found.groupBy("digest").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest"))


def _split(texts: DataFrame, shared: DataFrame, bits: int, least_documents: int) -> DataFrame:
    """Exact counts of the strings of shared digests."""
    wanted = texts.sparkSession.sparkContext.broadcast(_filter_of(shared))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_slices(batches, "text", SLICE_BYTES):
            terms = Terms(part.column("text"), bits)
            lang, group = (part.column(c).to_pylist() for c in ("lang_key", "grp"))
            hit = np.flatnonzero(_passes(terms.digest, wanted.value)).tolist()
            seen = Counter((int(terms.row[i]), int(terms.digest[i : i + 1].view(np.int64)[0]), terms.text(i)) for i in hit)
            n, docs = Counter(), Counter()
            for (row, digest, text), times in seen.items():
                n[digest, text, row_key := (lang[row], group[row])] += times
                docs[digest, text, row_key] += 1
            rows = [(d, t.decode(), k[0], k[1], c, docs[d, t, k]) for (d, t, k), c in n.items()]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*rows)) or [()] * len(kinds)
            names = ["digest", "term", "lang_key", "grp", "n", "docs"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    out = "digest long, term string, lang_key long, grp long, n long, docs long"
    counts = texts.mapInArrow(run, out).join(shared.select("digest"), "digest", "left_semi")
    return _kept(counts, least_documents, "digest", "term")


def term_counts(texts: DataFrame, bits: int, least_documents: int) -> tuple[DataFrame, DataFrame]:
    """Counts of kept terms by group (digest, ``term`` where the digest is shared, lang_key, grp, n, lang_n), and the
    strings of the digests."""
    kept = materialised(_kept(_digest_counts(texts, bits), least_documents, "digest"))
    strings = materialised(_strings(texts, kept.select("digest"), bits))
    whole = kept.withColumn("term", F.lit(None).cast("string"))
    shared = strings.where(F.col("least") != F.col("greatest"))
    if shared.isEmpty():
        return whole, strings
    split = _split(texts, shared, bits, least_documents).select(*whole.columns)
    return materialised(whole.join(shared.select("digest"), "digest", "left_anti").unionByName(split)), strings


def _chance(n: Column | str, total: str, kept_terms: str) -> Column:
    """1 + floor(UNIT * (n + 2) / (total + 2 * kept_terms)), 0 if there is no kept term."""
    F_n = F.col(n) if isinstance(n, str) else n
    above = (F_n + 2).cast("decimal(19,0)") * F.lit(UNIT).cast("decimal(10,0)")
    below = (F.col(total) + 2 * F.col(kept_terms)).cast("decimal(20,0)")
    return F.when(F.col(kept_terms) > 0, F.call_function("div", above, below) + 1).otherwise(0)


def _distance(p: Column | str, q: Column | str) -> Column:
    p, q = (F.col(x) if isinstance(x, str) else x for x in (p, q))
    return F.when(p + q > 0, F.call_function("div", (p - q) * (p - q), p + q)).otherwise(0)


def _shared_terms(kept: DataFrame) -> DataFrame:
    """a, b (a < b), value: over the terms that both groups have, the sum of f(pa, pb) - f(pa, p0b) - f(p0a, pb) + f(p0a,
    p0b). Rows of one term stand together, at most one a group; the pairs of a term are summed up in blocks."""

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // (p + q)

    def sums(table: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
        digest, lang, group, p, p0 = (table.column(c).to_numpy() for c in ("digest", "lang_key", "grp", "p", "p0"))
        term = table.column("term").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        new = np.ones(len(digest), bool)
        new[1:] = (digest[1:] != digest[:-1]) | (lang[1:] != lang[:-1]) | (term[1:] != term[:-1])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(digest)))
        if not last:  # the last term may go on
            at, size = at[:-1], size[:-1]
        groups, code = np.unique(group, return_inverse=True)
        pairs, values = [], []
        for k in np.unique(size[size > 1]).tolist():
            starts = at[size == k]
            step = max(1, PAIR_CELLS // k)
            for i in range(0, len(starts), step):
                index = starts[i : i + step, None] + np.arange(k)
                P, P0, G = p[index], p0[index], code[index]
                for j in range(k - 1):
                    a, a0, b, b0 = P[:, j : j + 1], P0[:, j : j + 1], P[:, j + 1 :], P0[:, j + 1 :]
                    value = f(a, b) - f(a, b0) - f(a0, b) + f(a0, b0)
                    key, back = np.unique(G[:, j : j + 1] * len(groups) + G[:, j + 1 :], return_inverse=True)
                    total = np.zeros(len(key), np.int64)
                    np.add.at(total, back.ravel(), value.ravel())
                    pairs.append(key)
                    values.append(total)
        rest = table.slice(int(at[-1] + size[-1]) if len(at) else 0) if not last else table.slice(len(digest))
        if not pairs:
            return None, rest
        (key,), (value,) = _summed([np.concatenate(pairs)], [np.concatenate(values)])
        columns = [groups[key // len(groups)], groups[key % len(groups)], value]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "value"]), rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            more = pa.Table.from_batches([batch])
            table = more if table is None else pa.concat_tables([table, more])
            if table.num_rows:
                out, table = sums(table.combine_chunks(), False)
                if out is not None:
                    yield out
        if table is not None and table.num_rows:
            out, _ = sums(table.combine_chunks(), True)
            if out is not None:
                yield out

    order = ["digest", "lang_key", "term", "grp"]
    dealt = kept.select(*order, "p", "p0").repartition("digest").sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "a long, b long, value long")


def audit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least_documents: int = LEAST_DOCUMENTS,
    top_terms: int = TOP_TERMS,
    digest_bits: int = 64,
) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``: how far each source lies from each other one of its
    language (``pair``) and the terms that set it apart from its language (``term``, the first ``top_terms``)."""
    ship_package(docs.sparkSession)
    texts, groups = _with_keys(docs, text_col, lang_col, source_col)
    kept, strings = term_counts(texts, digest_bits, least_documents)

    terms = kept.groupBy("lang_key", "digest", "term").agg(F.sum("n").alias("n"))
    of_lang = terms.groupBy("lang_key").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"))
    of_group = kept.groupBy("grp").agg(F.sum("n").alias("total"), F.count("*").alias("present"))
    filled = {c: F.coalesce(c, F.lit(0)) for c in ("v", "lang_total", "total", "present")}
    groups = groups.join(of_lang, "lang_key", "left").join(of_group, "grp", "left").withColumns(filled)
    groups = materialised(groups.withColumn("p0", _chance(F.lit(0), "total", "v")))

    measured = kept.join(groups.select("grp", "total", "lang_total", "v", "p0"), "grp").withColumns(
        {"p": _chance("n", "total", "v"), "q": _chance("lang_n", "lang_total", "v")}
    )
    measured = materialised(measured.select("digest", "term", "lang_key", "grp", "p", "p0", "q"))
    return _pairs(measured, groups).unionByName(_terms(measured, groups, strings, top_terms))


def _pairs(measured: DataFrame, groups: DataFrame) -> DataFrame:
    # What a's terms are worth against each b of the language as if b had none of them. One more row a group takes those
    # terms out of the constant, which all V terms have once per pair.
    histogram = measured.groupBy("lang_key", "grp", "p").agg(F.count("*").alias("n"))
    constant = groups.select("lang_key", "grp", F.col("p0").alias("p"), (-F.col("present")).alias("n"), F.col("v").alias("once"))
    rows = histogram.withColumn("once", F.lit(0)).unionByName(constant)
    # A language may have most of the rows: its rows are dealt to several tasks, the groups go to each of them.
    left = rows.withColumnRenamed("grp", "a").withColumn("salt", F.pmod(F.xxhash64("a", "p"), F.lit(SALTS)))
    right = groups.select(
        "lang_key", F.col("grp").alias("b"), F.col("p0").alias("b0"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    )
    alone = left.join(right, ["lang_key", "salt"]).where(F.col("a") != F.col("b"))
    times = F.col("n") + F.when(F.col("a") < F.col("b"), F.col("once")).otherwise(0)
    alone = alone.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (times * _distance("p", "b0")).alias("value"))
    sums = alone.unionByName(_shared_terms(measured)).groupBy("a", "b").agg(F.sum("value").alias("value"))
    sums = materialised(sums)
    both = sums.unionByName(sums.select(F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    named = both.join(groups.select(F.col("grp").alias("a"), "lang", "source"), "a")
    named = named.join(groups.select(F.col("grp").alias("b"), F.col("source").alias("item")), "b")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return named.select("lang", "source", F.lit("pair").alias("part"), "item", "value", place.alias("rank"))


def _terms(measured: DataFrame, groups: DataFrame, strings: DataFrame, top: int) -> DataFrame:
    above = measured.where(F.col("p") > F.col("q")).select("digest", "term", "grp", _distance("p", "q").alias("value"))
    # Values decide first, with all ties; only what is left gets its text.
    by_value = F.rank().over(Window.partitionBy("grp").orderBy(F.desc("value")))
    best = above.withColumn("_place", by_value).where(F.col("_place") <= top).drop("_place")
    texts = strings.select("digest", "least")
    named = best.join(texts, "digest", "left").withColumn("item", F.coalesce("term", "least"))
    place = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("value"), "item"))
    named = named.withColumn("rank", place).where(F.col("rank") <= top)
    named = named.join(groups.select("grp", "lang", "source"), "grp")
    return named.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
