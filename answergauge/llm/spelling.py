"""Spelling variants: words one edit apart, and the more frequent form that each stands for.

Asymmetric q-chunks: of two words the shorter one (either, if they are equally long) gives two disjoint chunks, its halves;
the other one gives positional grams. One edit touches at most one half, so the other half recurs in the longer word: the
first half at the same place, the second one shifted by the difference in length, zero or one. No other gram can stand within
shift one of a chunk that one edit has left whole, so of all positional grams those two are joined. Candidates are
verified exactly. A pair that shares both halves (a letter put in between) counts by the first.

Candidate pairs never become rows. Words that share a chunk meet in one task as a tile, in which all pairs are verified at
once on packed bytes (every letter of the alphabet fits one). Chunks of many words are dealt to several tiles, each of bounded
size, so that every pair of blocks meets in exactly one of them. A task gives one row per word: the number of its near words
and the best of them.

Forms lead to words at least twice as frequent, so they have no cycles, and a chain has at most as many links as a count has
binary digits; roots are found by doubling pointers.

Cases: NULL and empty texts have no words; a NULL id is written as nothing in the hash; repeated rows count as often as
they stand; very long words are words like others; ties of counts go to the word first in code-point order; an empty table
gives no rows; only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answergauge.llm.common import in_slices, materialised, ranked, ship_package

LEAST_LETTERS = 5
LEAST_COUNT = 3
DELETE_ONE_IN = 97
FORM_RATIO = 2
SLICE_BYTES = 4 << 20
COUNTER_ENTRIES = 300_000
BLOCK = 2048
HELD_ROWS = 1 << 16
PAIRS_AT_ONCE = 1 << 19

_RUN = rf"[a-zÀ-ÿ]{{{LEAST_LETTERS},}}"
_U = np.uint64
_LOW, _HIGH = _U(0x7F7F7F7F7F7F7F7F), _U(0x8080808080808080)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: runs of letters, A to Z lower-cased, of at least ``LEAST_LETTERS`` letters and ``LEAST_COUNT``
    occurrences. A run loses one letter in each document whose id gives it a hash that ``DELETE_ONE_IN`` divides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A run that is too short stays too short.
        runs, total = re.compile(_RUN).findall, Counter()

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"]
            )
            total.clear()
            return batch

        for part in in_slices(batches, "text", SLICE_BYTES):
            for key, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
                start = zlib.crc32(f"{key or ''}:".encode())
                for word, n in Counter(runs((text or b"").lower().decode(errors="replace"))).items():
                    h = zlib.crc32(word.encode(), start)
                    if not h % DELETE_ONE_IN:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < LEAST_LETTERS:
                            continue
                    total[word] += n
            if len(total) > COUNTER_ENTRIES:
                yield flushed()
        yield flushed()

    chosen = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    counts = chosen.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= LEAST_COUNT)


def _pieces(words: DataFrame) -> DataFrame:
    """The two chunks of each word (``longer`` false) and its two grams for chunks of words one letter shorter."""
    size = F.length("word")

    def pieces(of: Column, longer: bool) -> list[Column]:
        half = F.floor(of / 2).cast("int")
        ends = {0: F.left("word", half), 1: F.right("word", of - half)}
        return [
            F.struct(text.alias("chunk"), F.lit(which).alias("which"), of.cast("int").alias("size"), F.lit(longer).alias("longer"))
            for which, text in ends.items()
        ]

    grams = F.when(size > LEAST_LETTERS, F.array(*pieces(size - 1, True)))
    all_of = F.concat(F.array(*pieces(size, False)), F.coalesce(grams, F.array().cast(_ARRAY)))
    return words.select("id", "n", F.encode("word", "ISO-8859-1").alias("letters"), F.inline(all_of))


_ARRAY = "array<struct<chunk: string, which: int, size: int, longer: boolean>>"
_CHUNK = ["chunk", "which", "size"]


def _tiles(pieces: DataFrame, block: int) -> DataFrame:
    """Each piece in the tiles that it belongs to. ``part`` is 0 for the words on the left of a tile, 1 for others as long,
    2 for longer ones; ``inner`` tells whether those on the left also meet each other. A chunk with few words is one tile; the
    words of any other are dealt to blocks, and every two blocks have a tile."""
    sizes = pieces.groupBy(*_CHUNK).agg(
        F.count_if(~F.col("longer")).alias("shorts"), F.count_if("longer").alias("longs")
    )
    hot = sizes.where((F.col("shorts") > block) | (F.col("longs") > block)).select(
        *_CHUNK, *[F.ceil(F.col(c) / block).cast("int").alias(c) for c in ("shorts", "longs")]
    )
    joined = pieces.join(hot, _CHUNK, "left").withColumns(
        {"shorts": F.greatest(F.coalesce("shorts", F.lit(1)), F.lit(1)), "longs": F.greatest(F.coalesce("longs", F.lit(1)), F.lit(1))}
    )
    whole = (F.col("shorts") == 1) & (F.col("longs") == 1)
    many = F.when(F.col("longer"), F.col("longs")).otherwise(F.col("shorts"))
    own = F.pmod(F.xxhash64("id"), many).cast("int")

    def tile(left, right, inner, part) -> Column:
        return F.struct(left.alias("left"), right.alias("right"), inner.alias("inner"), part.cast("int").alias("part"))

    def upto(n: str) -> Column:
        return F.sequence(F.lit(0), F.col(n) - 1)

    alone = F.array(tile(F.lit(0), F.lit(0), F.lit(True), F.when(F.col("longer"), 2).otherwise(0)))
    among = F.transform(upto("shorts"), lambda j: tile(F.least(own, j), F.greatest(own, j), own == j, (j < own).cast("int")))
    # Tiles with longer words are told from the others by a negative right side.
    beside = F.transform(upto("longs"), lambda j: tile(own, -1 - j, F.lit(False), F.lit(0)))
    below = F.transform(upto("shorts"), lambda i: tile(i, -1 - own, F.lit(False), F.lit(2)))
    chosen = F.when(whole, alone).when(F.col("longer"), below).otherwise(F.concat(among, beside))
    return joined.select("id", "n", "letters", *_CHUNK, F.inline(chosen))


def _flags(x: np.ndarray) -> np.ndarray:
    """The high bit of every byte that is not zero."""
    return (((x & _LOW) + _LOW) | x) & _HIGH


def _packed(letters: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 64-bit numbers, the first byte lowest; one column at least."""
    rows, width = letters.shape
    columns = max(1, -(-width // 8))
    out = np.zeros((rows, columns * 8), np.uint8)
    out[:, :width] = letters
    return out.view("<u8")


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Do packed rows differ in exactly one byte?"""
    bits = np.zeros(len(a), np.uint8)
    for c in range(a.shape[1]):
        bits += np.minimum(np.bitwise_count(_flags(a[:, c] ^ b[:, c])), 2)
        np.minimum(bits, 2, out=bits)
    return bits == 1


def one_inserted(a: np.ndarray, head: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Does the longer row, given without its last (``head``) and without its first byte (``tail``), come from ``a``
    by one more byte? And is its head equal to ``a``?"""
    good, same = np.ones(len(a), bool), np.ones(len(a), bool)
    for c in range(a.shape[1]):
        first, last = _flags(a[:, c] ^ head[:, c]), _flags(a[:, c] ^ tail[:, c])
        # Up to the first difference from the head, the tail need not agree.
        lowest = first & (~first + _U(1))
        good &= np.where(same, (first == 0) | (last < lowest), last == 0)
        same &= first == 0
    return good, same


def _pairs(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for every j from lo[i] to hi[i], in portions."""
    n = np.maximum(hi - lo, 0)
    ends = np.cumsum(n)
    start = 0
    while start < len(n):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS_AT_ONCE, "right")))
        count = n[start:stop]
        i = np.repeat(np.arange(start, stop), count)
        j = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + lo[i]
        if len(i):
            yield i, j
        start = stop


def _near(letters: np.ndarray, longer: np.ndarray, rows: tuple, which: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs among words of one size that share one half (the first, if ``which`` is 0). ``rows`` has for each
    word on a left side: its place in ``letters``, and the ranges of the words to meet, as long and longer."""
    half = letters.shape[1] // 2
    of = (lambda m: m[:, half:]) if which == 0 else (lambda m: m[:, : half + m.shape[1] - letters.shape[1]])
    left, same_lo, same_hi, long_lo, long_hi = rows
    short = _packed(of(letters))
    for i, j in _pairs(same_lo, same_hi):
        hit = one_replaced(short[left[i]], short[j])
        yield left[i[hit]], j[hit]
    rest = of(longer)
    head, tail = _packed(rest[:, :-1]), _packed(rest[:, 1:])
    for i, j in _pairs(long_lo, long_hi):
        hit, by_first = one_inserted(short[left[i]], head[j], tail[j])
        if which == 1:
            hit &= ~by_first
        yield left[i[hit]], -1 - j[hit]


def _links(table: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
    """Near words within the tiles of a table sorted by tile, and what is left for the next one."""
    keys = ["chunk", "which", "size", "left", "right", "inner"]
    new = np.ones(table.num_rows, bool)
    for key in keys:
        column = table.column(key).combine_chunks()
        same = pc.equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
        new[1:] = same & new[1:] if key == "chunk" else new[1:] & same
    new[1:] = ~new[1:]
    at = np.flatnonzero(new)
    stop = table.num_rows if last else int(at[-1])
    rest, table = table.slice(stop), table.slice(0, stop)
    if not stop:
        return None, rest
    at = at[at < stop]
    ends = np.append(at[1:], stop)
    ids, counts, part, size, which = (table.column(c).to_numpy() for c in ("id", "n", "part", "size", "which"))
    inner = table.column("inner").to_numpy()
    words = table.column("letters").combine_chunks()
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)
    tile = np.repeat(np.arange(len(at)), ends - at)
    # Where the parts 0, 1 and 2 of each tile end; rows are sorted by part within a tile.
    n = [np.bincount(tile[part == p], minlength=len(at)) for p in range(3)]
    end0, end1 = at + n[0], at + n[0] + n[1]
    found_a, found_b = [], []
    for length in np.unique(size).tolist():
        for side in (0, 1):
            rows = np.flatnonzero((size == length) & (which == side))
            shorts, longs = rows[part[rows] < 2], rows[part[rows] == 2]
            if not len(shorts):
                continue
            place = np.zeros(stop, np.int64)  # of a row among those of its length
            place[shorts], place[longs] = np.arange(len(shorts)), np.arange(len(longs))
            left = shorts[part[shorts] == 0]
            t = tile[left]
            first = np.where(inner[t_first := at[t]], left + 1, end0[t])
            until = np.where(inner[t_first], end0[t], end1[t])

            def among(bound: np.ndarray, base: np.ndarray) -> np.ndarray:
                return np.searchsorted(base, bound)

            spans = (place[left], among(first, shorts), among(until, shorts), among(end1[t], longs), among(ends[t], longs))
            short_letters = data[offsets[shorts][:, None] + np.arange(length)]
            long_letters = data[offsets[longs][:, None] + np.arange(length + 1)]
            for a, b in _near(short_letters, long_letters, spans, side):
                found_a.append(shorts[a])
                longer = b < 0
                other = np.empty(len(b), np.int64)
                other[~longer], other[longer] = shorts[b[~longer]], longs[-1 - b[longer]]
                found_b.append(other)
    a, b = (np.concatenate(f) if f else np.zeros(0, np.int64) for f in (found_a, found_b))
    if not len(a):
        return None, rest
    of, near = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.lexsort((ids[near], -counts[near], ids[of]))
    of, near = of[order], near[order]
    start = np.flatnonzero(np.append(True, ids[of][1:] != ids[of][:-1]))
    columns = [ids[of[start]], np.diff(np.append(start, len(of))), counts[near[start]], ids[near[start]]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "n_near", "best_n", "best"]), rest


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """Of words (``id`` in code-point order, ``word``, ``n``) those with near ones: id, n_near, best_n, best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows > HELD_ROWS:
                out, rest = _links(pa.Table.from_batches(held).combine_chunks(), False)
                if out is not None:
                    yield out
                held, rows = rest.combine_chunks().to_batches(), rest.num_rows
        if rows:
            out, _ = _links(pa.Table.from_batches(held).combine_chunks(), True)
            if out is not None:
                yield out

    order = [*_CHUNK, "left", "right", "inner"]
    tiles = _tiles(_pieces(words), block).repartition(*order).sortWithinPartitions(*order, "part")
    found = tiles.mapInArrow(run, "id long, n_near long, best_n long, best long")
    # Numbers of fixed width throughout, so both are hash aggregates.
    by_count = found.repartition("id").groupBy("id", "best_n").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return by_count.groupBy("id").agg(
        F.sum("n_near").alias("n_near"), F.max("best_n").alias("best_n"), F.max_by("best", "best_n").alias("best")
    )


def _roots(forms: DataFrame) -> DataFrame:
    """id, root: where the forms (id, form) lead in the end. Each turn doubles the reach of every pointer."""
    reach = materialised(forms.select("id", F.col("form").alias("root")))
    while True:
        step = reach.select(F.col("id").alias("_at"), F.col("root").alias("_on"))
        further = reach.join(step, F.col("root") == F.col("_at"), "left")
        if further.where(F.col("_on").isNotNull()).isEmpty():
            return reach
        reach = materialised(further.select("id", F.coalesce("_on", "root").alias("root")))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``."""
    ship_package(docs.sparkSession)
    words = materialised(ranked(word_counts(docs, id_col, text_col), F.col("word"), name="id"))
    near = materialised(near_words(words, block))
    judged = words.join(near, "id", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)))
    has_form = F.col("best_n") >= FORM_RATIO * F.col("n")
    judged = judged.withColumns({"form": F.when(has_form, F.col("best")), "form_n": F.when(has_form, F.col("best_n"))})
    judged = materialised(judged.drop("best", "best_n"))
    roots = _roots(judged.where(F.col("form").isNotNull()))
    named = words.select(F.col("id").alias("_id"), F.col("word").alias("_word"))
    formed = judged.where(F.col("form").isNotNull()).join(roots, "id")
    formed = formed.join(named.toDF("_id", "_form"), F.col("form") == F.col("_id")).drop("_id")
    formed = formed.join(named.toDF("_id", "_root"), F.col("root") == F.col("_id")).drop("_id")
    formed = formed.select("word", F.col("_form").alias("form"), F.col("_root").alias("root"), "n", "n_near", "form_n")
    alone = judged.where(F.col("form").isNull()).select(
        "word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n"
    )
    return formed.unionByName(alone)
