"""Repeated byte strings by deep-shallow suffix sorting: every byte in a string of ``WIDTH`` bytes that also starts earlier.

Dealing out. A window (a string of ``WIDTH`` bytes) is anchored at its least k-gram in hash order; equal windows have
equal anchors at equal places. Windows that follow each other with one anchor are a run. Runs are dealt to
buckets by their anchor, so equal windows meet, and a text is sent as about three times its bytes whatever
repeats in it. Runs that a task sees twice are settled there and sent once, which keeps anchors of
frequent passages small. Anchors whose runs would still be more than a bucket, as their surroundings differ, are hot:
each of their windows is dealt alone, by the anchor's place in it and the hash of the whole window, which equal windows share.

Sorting. In a bucket, anchors with one run are done; equal runs are settled at once. Of the others, the suffixes at
all windows are sorted: multikey quicksort by words of eight bytes to the shallow depth, then, for groups with longer
common prefixes, blind tries, built level by level over all groups: each node compares its members with its first,
skips to the first place where any differs, and branches on that byte. Windows equal to the end are repeats of the
earliest of them.

Spans come back to their documents by a join. Cases: a NULL text is empty; documents are ordered by id, rows without id
are last and count as one id; rows with one id are one document, and a string at the same place of two of them is
no repeat, so rows equal in id and text get equal results; windows are judged on the input, so copies of copies go as well; periodic texts have many short runs, most of them equal;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answergauge.llm.common import in_slices, materialised, ship_package
from answergauge.llm.hashing import BASES, ODD, Ranges, mix

WIDTH = 100
GRAM = 16
SHALLOW = 32
PLACE_BITS = 31
SLICE_BYTES = 2 << 20
PACK_BYTES = 16 << 20
BUCKET_BYTES = 16 << 20
SENT_PER_BYTE = 3.4
HOT_BITS = 20
LAST_ID = np.iinfo(np.int64).max

_U = np.uint64
_PLACE = _U((1 << PLACE_BITS) - 1)
# What is known of each run of a blob, column by column: the document's id and its number in the slices packed with
# it (both as differences), the run's place in it, its windows and where its anchor lies. The anchor itself is in the bytes.
_HEAD = (("id", np.int64), ("doc", np.int32), ("at", np.int32), ("windows", np.uint8), ("offset", np.uint8))
_DIFFERENCES = ("id", "doc")


def runs_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, place and hash of the anchor of every run in texts that lie one after the
    other in ``data``."""
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < WIDTH:
        return none, none, none, np.zeros(0, np.uint64)
    buffer = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((n,), "<u8", buffer, 0, (1,)).copy()
    count = n - GRAM + 1
    grams = mix(words[:count] * ODD + mix(words[8 : 8 + count]))  # _grams at every place
    least = (grams & ~_PLACE) | np.arange(count, dtype=np.uint64)
    width, span = WIDTH - GRAM + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    mark = np.zeros(n + 1, np.int8)
    long = bounds[1:] - bounds[:-1] >= WIDTH
    mark[bounds[:-1][long]] += 1
    mark[bounds[1:][long] - WIDTH + 1] -= 1
    window = np.flatnonzero(np.cumsum(mark[: n - WIDTH + 1], dtype=np.int8) > 0)
    if not len(window):
        return none, none, none, np.zeros(0, np.uint64)
    anchor = (least[window] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (np.diff(window) != 1) | (np.diff(anchor) != 0)]))
    counts = np.diff(np.append(first, len(window)))
    return window[first], counts, anchor[first], grams[anchor[first]]


def classed(keys: tuple[np.ndarray, ...], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows that agree in all ``keys``: which row has the least ``place``, and whether a row is not that place."""
    order = np.lexsort((place, *keys))
    same = np.ones(len(order), bool)
    for key in keys:
        same[1:] &= key[order][1:] == key[order][:-1]
    if len(same):
        same[0] = False
    leader = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    leads = np.empty(len(order), np.int64)
    leads[order] = leader
    return leads, place != place[leads]


def gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of several ranges, one after the other."""
    shift = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
    return data[np.repeat(starts - shift, sizes) + np.arange(sizes.sum())]


def repeated_windows(data: np.ndarray, starts: np.ndarray, groups: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which windows (at ``starts`` in ``data``) equal a window of the same group with a smaller place.

    ``data`` must go on for eight bytes after the last window."""
    repeats = np.zeros(len(starts), bool)
    words = np.ndarray((len(data) - 7,), ">u8", np.ascontiguousarray(data), 0, (1,))
    active, group = np.arange(len(starts)), groups

    def split(members: np.ndarray, group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Groups refined by value, in order; members left alone are sorted already and go."""
        order = np.lexsort((value, group))
        members, group, value = members[order], group[order], value[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (value[1:] != value[:-1])
        group = np.cumsum(fresh) - 1
        many = np.bincount(group, minlength=1)[group] > 1
        return members[many], group[many]

    active, group = split(active, group, np.zeros(len(active), np.uint64))
    for depth in range(0, SHALLOW, 8):  # shallow: multikey quicksort by words
        active, group = split(active, group, words[starts[active] + depth].astype(np.uint64))
    depths = [*range(SHALLOW, WIDTH - 8, 8), WIDTH - 8]
    while len(active):  # deep: one level of all blind tries
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.append(first, len(group)))
        leader = np.repeat(active[first], sizes)
        differ = np.full(len(active), WIDTH, np.int64)
        for depth in depths:
            still = np.flatnonzero(differ == WIDTH)
            odd = words[starts[active[still]] + depth] != words[starts[leader[still]] + depth]
            differ[still[odd]] = depth
        inner = np.flatnonzero(differ < WIDTH)  # the first differing byte within the word
        exact = differ[inner].copy()
        for step in range(7):
            here = exact == differ[inner] + step
            at = inner[here]
            same = data[starts[active[at]] + exact[here]] == data[starts[leader[at]] + exact[here]]
            exact[np.flatnonzero(here)[same]] += 1
        differ[inner] = exact
        node = np.repeat(np.minimum.reduceat(differ, first), sizes)
        leaf = node == WIDTH
        if leaf.any():
            members, equal = active[leaf], group[leaf]
            _, later = classed((equal,), place[members])
            repeats[members[later]] = True
        active, group, node = active[~leaf], group[~leaf], node[~leaf]
        active, group = split(active, group, data[starts[active] + node].astype(np.uint64))
    return repeats


def _spans(starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges united where they meet or overlap, per owner."""
    if not len(starts):
        return starts, ends, owner
    order = np.lexsort((starts, owner))
    starts, ends, owner = starts[order], ends[order], owner[order]
    # Owners apart by more than any end, so that one running maximum serves all.
    step = int(ends.max()) + 1
    rank = np.cumsum(np.concatenate([[0], np.diff(owner) != 0]))
    reach = np.maximum.accumulate(ends + rank * step)
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (starts + rank * step)[1:] > reach[:-1]
    fresh[1:] |= owner[1:] != owner[:-1]
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(starts)) - 1
    return starts[first], (reach - rank * step)[last], owner[first]


def _grams(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the k-grams at places of a text, of which ``words`` has the eight bytes from each place on."""
    return mix(words[at] * ODD + mix(words[at + 8]))


_SPAN = "bucket int, blob binary, slice long, doc int, id long, digest binary, starts array<long>, ends array<long>"
_ARROW_SPAN = pa.schema(
    [
        ("bucket", pa.int32()),
        ("blob", pa.binary()),
        ("slice", pa.int64()),
        ("doc", pa.int32()),
        ("id", pa.int64()),
        ("digest", pa.binary()),
        ("starts", pa.list_(pa.int64())),
        ("ends", pa.list_(pa.int64())),
    ]
)


def _batch(n: int, **columns) -> pa.RecordBatch:
    """Rows of ``_SPAN`` in which other columns are NULL."""
    made = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ARROW_SPAN]
    return pa.RecordBatch.from_arrays(made, schema=_ARROW_SPAN)


def _span_batch(starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
    """One row per owner (slice * 2**32 + document) with its united ranges."""
    starts, ends, owner = _spans(starts, ends, owner)
    first = np.flatnonzero(np.diff(owner, prepend=-1)) if len(owner) else np.zeros(0, np.int64)
    bounds = np.append(first, len(owner)).tolist()
    return _batch(
        len(first),
        slice=owner[first] >> 32,
        doc=(owner[first] & 0xFFFFFFFF).astype(np.int32),
        starts=[starts[a:b] for a, b in zip(bounds, bounds[1:])],
        ends=[ends[a:b] for a, b in zip(bounds, bounds[1:])],
    )


def _slice_runs(part: pa.RecordBatch) -> dict[str, np.ndarray]:
    """The bytes of a slice, the bounds of its texts and its runs: start, windows, place and hash of the anchor,
    document, and place by document and start; ``kept`` are the runs that no earlier one equals, ``later`` the repeats."""
    texts = part.column("text").to_pylist()
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    start, windows, anchor, gram = runs_of(data, bounds)
    doc = np.searchsorted(bounds, start, "right") - 1
    end = start + windows + (WIDTH - 1)
    _, rank = np.unique(part.column("id").to_numpy()[doc], return_inverse=True)
    place = (rank << PLACE_BITS) + start - bounds[doc]
    keys = tuple(Ranges(data, base)(start, end) for base in BASES) + (end - start, anchor - start)
    lead, later = classed(keys, place)
    kept = np.flatnonzero(lead == np.arange(len(lead)))
    return dict(
        data=data, bounds=bounds, start=start, windows=windows, anchor=anchor, gram=gram, doc=doc, place=place, kept=kept, later=later
    )


def _bin(gram: np.ndarray) -> np.ndarray:
    return (mix(gram ^ ODD) >> _U(64 - HOT_BITS)).astype(np.int64)


def hot_bins(texts: DataFrame, total: int) -> tuple[np.ndarray, int]:
    """The bins of anchors whose runs come to ``BUCKET_BYTES`` or more, and how many windows they have.

    A task reports the bins that hold at least their part, by its share of all bytes, of half that much. So all that
    goes unreported of a bin is below that half, and no such bin is missed; reported bins grow with the number of
    buckets, not of anchors."""
    half = BUCKET_BYTES / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass, many, held = np.zeros(1 << HOT_BITS), np.zeros(1 << HOT_BITS), 0
        for part in in_slices(batches, "text", SLICE_BYTES):
            runs = _slice_runs(part)
            windows, to = runs["windows"][runs["kept"]], _bin(runs["gram"][runs["kept"]])
            mass += np.bincount(to, windows + (WIDTH - 1), 1 << HOT_BITS)
            many += np.bincount(to, windows, 1 << HOT_BITS)
            held += len(runs["data"])
        at = np.flatnonzero((mass > 0) & (mass >= half * held / max(total, 1)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(mass[at].astype(np.int64)), pa.array(many[at].astype(np.int64))],
            names=["bin", "mass", "windows"],
        )

    reported = texts.mapInArrow(run, "bin long, mass long, windows long").groupBy("bin")
    hot = reported.agg(F.sum("mass").alias("mass"), F.sum("windows").alias("windows")).where(F.col("mass") >= half)
    found = hot.collect()  # at most 2 * SENT_PER_BYTE rows per BUCKET_BYTES of input
    return np.sort(np.array([r["bin"] for r in found], np.int64)), sum(r["windows"] for r in found)


def _planes(values: np.ndarray, kind: type, differ: bool) -> bytes:
    """All lowest bytes of the values, then the next ones: high bytes of small numbers are equal and compress well."""
    values = np.diff(values, prepend=values.dtype.type(0)) if differ else values
    return np.ascontiguousarray(values, kind).view(np.uint8).reshape(len(values), -1).T.tobytes()


def _from_planes(raw: pa.Buffer, at: int, n: int, kind: type, differ: bool) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
    values = np.ascontiguousarray(planes.T).view(kind).ravel().astype(np.int64)
    return np.cumsum(values) if differ else values


def _packed(runs: list[dict[str, np.ndarray]], buckets: int, number: int) -> Iterator[pa.RecordBatch]:
    """The runs of several slices as one blob per bucket; documents are numbered through all of them."""
    to = np.concatenate([r["to"] for r in runs])
    order = np.argsort(to, kind="stable")
    edges = np.searchsorted(to[order], np.arange(buckets + 1))
    data = np.concatenate([r["data"] for r in runs])
    shift = np.cumsum([0, *(len(r["data"]) for r in runs)])
    start = np.concatenate([r["start"] + by for r, by in zip(runs, shift)])[order]
    head = {name: np.concatenate([r[name] for r in runs])[order] for name, _ in _HEAD}
    numbers, blobs, held = [], [], 0
    for b in np.flatnonzero(np.diff(edges)).tolist():
        some = slice(edges[b], edges[b + 1])
        columns = b"".join(_planes(head[name][some], kind, name in _DIFFERENCES) for name, kind in _HEAD)
        body = gathered(data, start[some], head["windows"][some] + np.int64(WIDTH - 1))
        raw = np.int64(edges[b + 1] - edges[b]).tobytes() + columns + body.tobytes()
        numbers.append(b)
        blobs.append(len(raw).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(raw, asbytes=True))
        held += len(blobs[-1])
        if held > SLICE_BYTES:
            yield _batch(len(numbers), bucket=numbers, blob=blobs, slice=[number] * len(numbers))
            numbers, blobs, held = [], [], 0
    if numbers:
        yield _batch(len(numbers), bucket=numbers, blob=blobs, slice=[number] * len(numbers))


def _deal(buckets: int, hot: np.ndarray):
    """Texts to runs, packed per bucket; the spans that are settled within a slice; and which document is which.

    Slices are packed together, up to ``PACK_BYTES`` of text and heads, since short blobs, as many buckets give, compress badly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        waiting, docs, held = [], 0, 0
        for part in in_slices(batches, "text", SLICE_BYTES):
            ids = part.column("id").to_numpy()
            yield _batch(
                part.num_rows,
                slice=[number] * part.num_rows,
                doc=range(docs, docs + part.num_rows),
                id=part.column("id"),
                digest=part.column("digest"),
            )
            runs = _slice_runs(part)
            data, bounds, later = runs["data"], runs["bounds"], runs["later"]
            start, windows, anchor, doc = (runs[c] for c in ("start", "windows", "anchor", "doc"))
            at, size = start - bounds[doc], windows + (WIDTH - 1)
            owner = (number << 32) + docs + doc
            yield _span_batch(at[later], at[later] + size[later], owner[later])
            kept = runs["kept"]
            to = (runs["gram"][kept] % _U(buckets)).astype(np.int64)
            is_hot = np.isin(_bin(runs["gram"][kept]), hot)
            single = kept[is_hot]
            # Windows of hot anchors become runs of one window each, sent once per slice.
            own = np.repeat(single, windows[single])
            inside = np.arange(len(own)) - np.repeat(np.cumsum(windows[single]) - windows[single], windows[single])
            first = start[own] + inside
            offset = anchor[own] - first
            hashes = tuple(Ranges(data, base)(first, first + WIDTH) for base in BASES) if len(own) else (first, first)
            lead, later = classed((*hashes, offset), runs["place"][own] + inside)
            hit = np.flatnonzero(later)
            yield _span_batch((at[own] + inside)[hit], (at[own] + inside)[hit] + WIDTH, owner[own[hit]])
            sent = np.flatnonzero(lead == np.arange(len(lead)))
            spread = mix(hashes[0][sent].astype(np.uint64) + offset[sent].astype(np.uint64) * ODD) % _U(buckets)
            kept, to = kept[~is_hot], np.concatenate([to[~is_hot], spread.astype(np.int64)])
            start = np.concatenate([start[kept], first[sent]])
            windows = np.concatenate([windows[kept], np.ones(len(sent), np.int64)])
            anchor = np.concatenate([anchor[kept], anchor[own[sent]]])
            doc = np.concatenate([doc[kept], doc[own[sent]]])
            values = dict(id=ids[doc], doc=docs + doc, at=start - bounds[doc], windows=windows, offset=anchor - start)
            head = {name: values[name].astype(kind) for name, kind in _HEAD}
            waiting.append(dict(data=data, start=start, to=to.astype(np.int32), **head))
            docs += part.num_rows
            held += sum(v.nbytes for v in waiting[-1].values())
            if held >= PACK_BYTES:
                yield from _packed(waiting, buckets, number)
                number, waiting, docs, held = number + 1, [], 0, 0
        if waiting:
            yield from _packed(waiting, buckets, number)

    return run


def _unpacked(blobs: pa.ChunkedArray, slices: list[int]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The heads of all runs, with the slice of each, and their bytes, followed by sixteen more."""
    heads, bodies = [], []
    for blob, own in zip(blobs, slices):
        raw = blob.as_buffer()
        raw = pa.decompress(raw[8:], int.from_bytes(raw[:8].to_pybytes(), "little"), "zstd", asbytes=True)
        n, at = int(np.frombuffer(raw, np.int64, 1)[0]), 8
        head = {}
        for name, kind in _HEAD:
            head[name] = _from_planes(raw, at, n, kind, name in _DIFFERENCES)
            at += n * np.dtype(kind).itemsize
        head["doc"] += own << 32
        heads.append(head)
        bodies.append(np.frombuffer(raw, np.uint8, offset=at))
    return (
        {name: np.concatenate([h[name] for h in heads]) for name, _ in _HEAD},
        np.concatenate([*bodies, np.zeros(16, np.uint8)]),
    )


def _sort_bucket(table: pa.Table) -> pa.Table:
    """All spans that the runs of one bucket settle; rows without a bucket pass through."""
    packed = table.filter(pc.is_valid(table["bucket"]))
    if not packed.num_rows:
        return table.select(_ARROW_SPAN.names)
    head, data = _unpacked(packed["blob"], packed["slice"].to_pylist())
    sizes = head["windows"] + (WIDTH - 1)
    begin = np.cumsum(sizes) - sizes
    words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    _, number, times = np.unique(_grams(words, begin + head["offset"]), return_inverse=True, return_counts=True)
    some = np.flatnonzero(times[number] > 1)
    head, number = {name: values[some] for name, values in head.items()}, number[some]
    begin, sizes = begin[some], sizes[some]
    data = np.concatenate([gathered(data, begin, sizes), np.zeros(8, np.uint8)])
    begin = np.cumsum(sizes) - sizes
    _, rank = np.unique(head["id"], return_inverse=True)
    at = head["at"]
    place = (rank << PLACE_BITS) + at
    keys = tuple(Ranges(data, base)(begin, begin + sizes) for base in BASES)
    lead, later = classed((*keys, sizes, head["offset"], number), place)
    whole = np.flatnonzero(later)
    left = np.flatnonzero(lead == np.arange(len(lead)))
    left = left[np.bincount(number[left], minlength=1)[number[left]] > 1]
    windows = head["windows"][left]
    run = np.repeat(left, windows)
    inside = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    groups = number[run] * np.int64(2 * WIDTH) + head["offset"][run] - inside
    later = repeated_windows(data, begin[run] + inside, groups, place[run] + inside)
    hit, hit_at = run[later], (at[run] + inside)[later]
    starts, ends = np.concatenate([at[whole], hit_at]), np.concatenate([at[whole] + sizes[whole], hit_at + WIDTH])
    return pa.Table.from_batches([_span_batch(starts, ends, head["doc"][np.concatenate([whole, hit])])])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_bytes, n_removed, n_spans, kept (the remaining bytes), kept_sha256 and the spans."""
    ship_package(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(int(LAST_ID)))
    chosen = docs.select(F.col(id_col).alias("own_id"), order.alias("id"), text.alias("text")).withColumn(
        "digest", F.substring(F.unhex(F.sha2("text", 256)), 1, 16)
    )
    total = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    hot, hot_windows = hot_bins(chosen.select("id", "text"), total)
    buckets = max(1, -(-int(total * SENT_PER_BYTE + hot_windows * WIDTH) // BUCKET_BYTES))
    dealt = chosen.select("id", "digest", "text").mapInArrow(_deal(buckets, hot), _SPAN)
    # Rows of documents and of spans have no bucket; they go to groups of their own, which hand them on.
    spread = F.coalesce("bucket", -1 - F.pmod(F.xxhash64("slice", "doc"), F.lit(buckets)).cast("int"))
    found = dealt.groupBy(spread.alias("group")).applyInArrow(_sort_bucket, _SPAN)
    spans = materialised(found.select("slice", "doc", "id", "digest", "starts", "ends"))
    both = (F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends"))
    of_doc = spans.groupBy("slice", "doc").agg(F.max("id").alias("id"), F.max("digest").alias("digest"), *both)
    # Rows equal in id and text have equal spans.
    gathered_spans = (
        of_doc.where(F.size("starts") > 0)
        .groupBy("id", "digest")
        .agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends")))
    )
    joined = chosen.join(gathered_spans, ["id", "digest"], "left").select("own_id", "text", "starts", "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = pa.list_(pa.int64())
        for part in in_slices(batches, "text", SLICE_BYTES):
            out = []
            for text, starts, ends in zip(*(part.column(c).to_pylist() for c in ("text", "starts", "ends"))):
                a, b = np.array(starts or [], np.int64), np.array(ends or [], np.int64)
                a, b, _ = _spans(a, b, np.zeros(len(a), np.int64))
                edges = [0, *np.stack([a, b], 1).ravel().tolist(), len(text)]
                kept = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2]))
                out.append((len(text), len(text) - len(kept), len(a), kept, hashlib.sha256(kept).hexdigest(), a, b))
            columns = list(zip(*out))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), numbers, numbers)
            yield pa.RecordBatch.from_arrays(
                [part.column("own_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "starts", "ends"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    out = (
        f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, "
        "starts array<long>, ends array<long>"
    )
    return joined.mapInArrow(run, out).withColumnRenamed("id", id_col)
