"""Hierarchical packing of documents into training sequences of several context sizes.

A document's tokens are cut into full long windows; what is left of it is routed to the smallest tier (a power
of two) that holds it. Each tier packs sequences of its own size: the largest piece opens a sequence, its gap is
filled with the largest pieces that fit, mostly of shorter tiers, and a last gap by cutting a piece. So
sequences are exactly full, apart from one at the end of each partition. Sequences are then dealt to step
groups of equally many tokens.

Packing runs within the partitions of the scan, with a bounded buffer of open pieces: no shuffle, and a
lost task packs the same rows again in the same way. Cases: NULL and empty texts have the end token only; a
repeated row or a NULL id is a document of its own; a very long document gives many windows; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import os
import re
import unicodedata
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answergauge.llm.common import give_back, in_slices, ship_package

CONTEXT = 2048
SMALLEST_TIER = 64
STEP_TOKENS = 8 * CONTEXT
BUFFER_TOKENS = 128 * CONTEXT
SLICE_BYTES = 2 << 20
CACHE_ENTRIES = 50_000
WORD_ENTRIES = 100_000
ID_BYTES = 4

# A space between two others, or the last of several, does not begin a new piece of the pre-tokeniser.
_JOINED_SPACES = re.compile(r"\s (?:\s|\Z)")
# A line break between other characters is a piece of its own; beside other white space it may not be.
_JOINED_LINES = re.compile(r"\s\n|\n(?:\s|\Z)")


class _Kept(dict):
    """Values by key, made where missing, in two generations of bounded size: what a generation does not use goes."""

    def __init__(self, make, entries: int):
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > self.entries:
            self.old = dict(self)
            self.clear()


_PLAIN = r"\t\n\r\x20-\x7e\xa1-\u024f"


def _latin_pattern() -> re.Pattern:
    """The pre-tokeniser's pattern for characters of ``_PLAIN``: letters and numbers as classes of that range."""
    kinds = {c: unicodedata.category(c)[0] for c in map(chr, range(0x21, 0x250)) if re.match(f"[{_PLAIN}]", c)}
    letters, numbers = (re.escape("".join(c for c, k in kinds.items() if k == kind)) for kind in "LN")
    # The endings that are pieces, and the order of the branches. The endings come before the other
    # signs; of the others before the white space only one can match at a place, and the commonest stand first.
    return re.compile(
        rf" [{letters}]+|[{letters}]+|'(?:s|t|re|ve|m|ll|d)| ?[^\s{letters}{numbers}]+| ?[{numbers}]+|\s+(?!\S)|\s+"
    )


def _byte_letters() -> dict[int, str]:
    """The characters that a byte-level vocabulary writes for bytes: printable Latin-1 for itself, the others
    numbered on from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Token ids as packed little-endian 32-bit numbers.

    The pre-tokeniser never joins what stands before a space with what follows it (except within runs of white
    space, which go to the tokenizer whole), so the ids of a text are those of its space-led parts, one after
    the other, and those of a part are those of its words. Both recur, and are kept."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES, words: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tokenizer.model
        # Texts in Latin script are cut here, as the tokenizer's pattern does it; all others by the tokenizer.
        self.plain = re.compile(rf"[{_PLAIN}]*")
        self.cut = _latin_pattern().findall
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.space = self.letters[ord(" ")]
        self.packed = [i.to_bytes(ID_BYTES, "little") for i in range(max(self.tokenizer.get_vocab().values()) + 1)]
        # A word that is not kept costs as much as some ten that are, so more of them are kept than of the parts.
        self.words, self.parts = _Kept(self._word, words or entries), _Kept(self._part, entries)

    def rest(self) -> None:
        """What the next task of this worker starts with: the newer generation of words."""
        self.words.old = self.parts.old = {}
        self.parts.clear()

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():  # all but the space stand for themselves
            written = word.replace(" ", self.space)
        else:
            written = word.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.packed[t.id] for t in self.model.tokenize(written)])

    def _part(self, part: str) -> bytes:
        if self.plain.fullmatch(part):
            return b"".join(map(self.words.__getitem__, self.cut(part)))
        return self._whole(part)

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return b"".join([i.to_bytes(ID_BYTES, "little") for i in ids])

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for text in texts:
            if not text:
                out.append(b"")
            elif self.plain.fullmatch(text):  # cut once; its pieces are those of the whole text
                out.append(b"".join(map(self.words.__getitem__, self.cut(text))))
            elif "\0" in text or _JOINED_SPACES.search(text):
                out.append(self._whole(text))
            else:
                marked = text.replace(" ", "\0 ")
                if "\n" in text and not _JOINED_LINES.search(text):
                    marked = marked.replace("\n", "\0\n\0")
                out.append(b"".join(map(self.parts.__getitem__, marked.split("\0"))))
            self.words.trim()  # after each text, so that many short ones in one call keep no more
            self.parts.trim()
        return out


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(path, words=WORD_ENTRIES)


class Packer:
    """Packs pieces of documents; ``rows`` gathers (document, start, stop, sequence, offset, tier, step)."""

    def __init__(self, context: int, smallest: int, step_tokens: int):
        self.context, self.smallest, self.step_tokens = context, smallest, step_tokens
        self.waiting: list[tuple[int, int, int]] = []  # (length, document, start), sorted
        self.held = 0
        self.sequences = self.steps = 0
        self.open_steps: list[list[int]] = []  # [tokens left, step], few
        self.rows: list[tuple[int, int, int, int, int, int, int]] = []

    def add(self, document: int, tokens: int) -> None:
        start = 0
        while tokens - start >= self.context:
            self._emit([(self.context, document, start)], self.context)
            start += self.context
        if tokens > start:
            self._wait(tokens - start, document, start)

    def _wait(self, length: int, document: int, start: int) -> None:
        insort(self.waiting, (length, document, start))
        self.held += length

    def _take(self, at: int) -> tuple[int, int, int]:
        piece = self.waiting.pop(at)
        self.held -= piece[0]
        return piece

    def _tier(self, length: int) -> int:
        return max(self.smallest, 1 << (length - 1).bit_length())

    def pack(self, until: int) -> None:
        """Packs sequences, longest tier first, until at most ``until`` tokens wait."""
        while self.held > until:
            first = self._take(-1)
            tier = self._tier(first[0])
            while tier > self.smallest and tier - first[0] > self.held:
                tier //= 2  # too little is left to fill the gap: a shorter tier, with a cut
            if tier < first[0]:
                self._wait(first[0] - tier, first[1], first[2] + tier)
                first = (tier, first[1], first[2])
            pieces, gap = [first], tier - first[0]
            while gap and self.waiting:
                at = bisect_right(self.waiting, (gap, float("inf"), 0)) - 1
                if at >= 0:
                    pieces.append(self._take(at))
                else:
                    length, document, start = self._take(0)
                    self._wait(length - gap, document, start + gap)
                    pieces.append((gap, document, start))
                gap -= pieces[-1][0]
            self._emit(pieces, tier)

    def _emit(self, pieces: list[tuple[int, int, int]], tier: int) -> None:
        offset, step = 0, self._step(tier)
        for length, document, start in pieces:
            self.rows.append((document, start, start + length, self.sequences, offset, tier, step))
            offset += length
        self.sequences += 1

    def _step(self, tier: int) -> int:
        """The open step group with the least room that still holds ``tier`` tokens."""
        fits = [s for s in self.open_steps if s[0] >= tier]
        if fits:
            chosen = min(fits)
        else:
            chosen = [self.step_tokens, self.steps]
            self.steps += 1
            self.open_steps.append(chosen)
        chosen[0] -= tier
        if not chosen[0]:
            self.open_steps.remove(chosen)
        return chosen[1]


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 1,
    context: int = CONTEXT,
    smallest: int = SMALLEST_TIER,
    step_tokens: int = STEP_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: the document's id, ``start``, ``doc_tokens``, ``ids`` (packed), ``sequence_id``,
    ``offset``, ``tier`` (the sequence's size), ``step_id``."""
    ship_package(docs.sparkSession)
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    end = end_id.to_bytes(ID_BYTES, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = _encoder(tokenizer_path), Packer(context, smallest, step_tokens)
        base = TaskContext.get().partitionId() << 33
        texts: dict[int, tuple] = {}  # documents with waiting pieces: id, packed ids
        count, id_type = 0, None

        def ready() -> pa.RecordBatch:
            rows, packer.rows = packer.rows, []
            ids, packed, tokens = [], [], []
            for document, start, stop, *_ in rows:
                owner, held = texts[document]
                ids.append(owner)
                packed.append(held[start * ID_BYTES : stop * ID_BYTES])
                tokens.append(len(held) // ID_BYTES)
            waiting = {document for _, document, _ in packer.waiting}
            for document in texts.keys() - waiting:
                del texts[document]
            columns = list(zip(*rows)) or [()] * 7
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, id_type),
                    pa.array(columns[1], pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array(packed, pa.binary()),
                    pa.array([base + s for s in columns[3]], pa.int64()),
                    pa.array(columns[4], pa.int64()),
                    pa.array(columns[5], pa.int32()),
                    pa.array([base + s for s in columns[6]], pa.int64()),
                ],
                names=["id", "start", "doc_tokens", "ids", "sequence_id", "offset", "tier", "step_id"],
            )

        for part in in_slices(batches, "text", SLICE_BYTES):
            id_type = part.column("id").type
            for owner, ids in zip(part.column("id").to_pylist(), encoder(part.column("text").to_pylist())):
                texts[count] = (owner, ids + end)
                packer.add(count, len(ids) // ID_BYTES + 1)
                count += 1
            if packer.held > BUFFER_TOKENS:
                packer.pack(BUFFER_TOKENS // 2)
            yield ready()
        encoder.rest()
        if id_type is not None:
            packer.pack(0)
            yield ready()
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    out = f"id {kind}, start long, doc_tokens long, ids binary, sequence_id long, offset long, tier int, step_id long"
    return chosen.mapInArrow(run, out).withColumnRenamed("id", id_col)
