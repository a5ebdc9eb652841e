"""Lists of words that every task holds, and their search in Arrow arrays of texts.

``WordTrie`` finds the words that occur anywhere in a text. Words are cut into steps of eight bytes, the last one shorter, and all places
of the texts walk the trie together, so that a place costs a few array operations a step, whatever the number of words. Bytes
are compared, which for UTF-8 is the same as characters. ``HanPaths`` finds the path of highest probability through runs of Han characters.

A list is held up to ``HELD_BYTES``, which bounds what the driver collects and sends; callers have joins for longer ones."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answergauge.operators.layout import ship_package

HELD_BYTES = 32 << 20
# What an entry takes besides the bytes of its word.
ENTRY_BYTES = 64
# Places that walk together: their arrays fit into a core's cache.
BLOCK = 1 << 17
STEP = 8
# Texts times words of a block that are marked in a table; beyond that, pairs are sorted.
MOST_MARKS = 1 << 23
# Runs whose words a task remembers, and the longest of them.
REMEMBERED, LONGEST_REMEMBERED = 1 << 17, 64

_MIX, _MIX_NODE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
# Below the score of any path.
_NO_PATH = -(1 << 62)
# The characters of ``text.HAN``.
_HAN_RUN = re.compile("[\u4e00-\u9fff]+")
_MASKS = [np.uint64((1 << (8 * n)) - 1) for n in range(STEP + 1)]


def may_be_held(words: DataFrame) -> bool:
    """Whether ``word`` is short enough, as a whole, to be sent to every task. A session that switches broadcasts off has none."""
    if words.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold() < 0:
        return False
    return (words.agg(F.sum(F.octet_length("word") + ENTRY_BYTES)).first()[0] or 0) <= HELD_BYTES


class _Pairs:
    """Different pairs of a node and a step, each with a value, looked up many at a time."""

    def __init__(self, nodes: np.ndarray, steps: np.ndarray, values: np.ndarray):
        self.bits = np.uint64(64 - max(10, (4 * len(steps)).bit_length()))
        slots = self._slots(nodes, steps)
        order = np.argsort(slots, kind="stable")
        self.nodes, self.steps, self.values = nodes[order], steps[order], values[order]
        held = np.bincount(slots, minlength=1 << (64 - int(self.bits)))
        self.used = held > 0
        self.first = np.concatenate(([0], np.cumsum(held))).astype(np.int32)

    def _slots(self, nodes: np.ndarray | None, steps: np.ndarray) -> np.ndarray:
        mixed = steps if nodes is None else steps ^ (nodes * _MIX_NODE)
        return ((mixed * _MIX) >> self.bits).view(np.int64)

    def find(self, nodes: np.ndarray | None, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of these pairs are held, and their values. Without ``nodes``, all are at the root."""
        slots = self._slots(nodes, steps)
        left = np.flatnonzero(self.used[slots])
        at, end = self.first[slots[left]], self.first[slots[left] + 1]
        found, values = [], []
        while len(left):
            same = (self.steps[at] == steps[left]) & (self.nodes[at] == (0 if nodes is None else nodes[left]))
            found.append(left[same])
            values.append(self.values[at[same]])
            more = np.flatnonzero(~same & (at + 1 < end))
            left, at, end = left[more], at[more] + 1, end[more]
        return (np.concatenate(found), np.concatenate(values)) if found else (left, left)


def _steps_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each place of ``data`` but the last seven, as numbers."""
    return np.ndarray((len(data) - STEP + 1,), "<u8", data, strides=(1,))


def _once(numbers: list[np.ndarray]) -> np.ndarray:
    """All numbers, sorted, each once."""
    every = np.sort(np.concatenate([*numbers, np.zeros(0, np.int64)]), kind="stable")
    return every[np.diff(every, prepend=-1) > 0]


class WordTrie:
    """Finds words in texts; ``words`` are told apart by their place in the list, and may repeat or be empty."""

    def __init__(self, words: list[str]):
        self.words = pa.array(words, pa.string())
        numbers: dict[bytes, list[int]] = {}
        for i, word in enumerate(words):
            numbers.setdefault(word.encode(), []).append(i)
        self.empty = numbers.pop(b"", [])
        # Where words stand first, in order, and where they stand again.
        again = sorted((n[0], other) for n in numbers.values() for other in n[1:])
        self.again = np.array(again, np.int64).reshape(-1, 2)
        self.longest = max(map(len, numbers), default=0)
        data = np.frombuffer(b"".join(numbers) + bytes(STEP), np.uint8)
        size = np.array([len(w) for w in numbers], np.int64)
        start = np.cumsum(size) - size
        place = np.array([n[0] for n in numbers.values()], np.int64)
        node = np.zeros(len(size), np.uint64)
        ends: dict[int, list] = {}
        inner, nodes = [], 1
        while len(size):
            steps = _steps_at(data)[start]
            for n in range(1, STEP + 1):
                last = np.flatnonzero(size == n)
                if len(last):
                    ends.setdefault(n, []).append((node[last], steps[last] & _MASKS[n], place[last]))
            longer = np.flatnonzero(size > STEP)
            start, size, place = start[longer] + STEP, size[longer] - STEP, place[longer]
            pairs = np.rec.fromarrays([node[longer], steps[longer]], names="node,step")
            once, child = np.unique(pairs, return_inverse=True)
            numbered = np.arange(nodes, nodes + len(once))
            inner.append((once["node"], once["step"], numbered))
            node, nodes = numbered[child].astype(np.uint64), nodes + len(once)
        self.ends = {n: self._pairs(parts) for n, parts in sorted(ends.items())}
        self.inner = self._pairs(inner) if nodes > 1 else None

    @staticmethod
    def _pairs(parts: list) -> _Pairs:
        return _Pairs(*(np.concatenate(column) for column in zip(*parts)))

    def _hits(self, data: np.ndarray, places: int) -> Iterator[tuple[np.ndarray, np.ndarray, int | np.ndarray]]:
        """Places below ``places`` of ``data``, the words that begin there, and how many bytes each has."""
        every = _steps_at(np.concatenate((data, np.zeros(2 * STEP, np.uint8))))
        at, nodes, steps, depth = np.arange(places), None, every[:places].copy(), 0
        while len(at):
            for n, pairs in self.ends.items():
                found, words = pairs.find(nodes, steps & _MASKS[n])
                if len(found):
                    yield at[found], words, depth + n
            if self.inner is None:
                return
            found, nodes = self.inner.find(nodes, steps)
            depth += STEP
            at, nodes = at[found], nodes.astype(np.uint64)
            inside = np.flatnonzero(at + depth < len(data))
            at, nodes = at[inside], nodes[inside]
            steps = every[at + depth]

    def _again(self, met: np.ndarray) -> np.ndarray:
        """The pairs of the same texts with the places where their words stand again."""
        word = met % len(self.words)
        first = np.searchsorted(self.again[:, 0], word, "left")
        many = np.searchsorted(self.again[:, 0], word, "right") - first
        pair = np.repeat(np.arange(len(met)), many)
        nth = np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)
        return met[pair] - word[pair] + self.again[first[pair] + nth, 1]

    def found_in(self, texts: pa.Array) -> pa.ListArray:
        """The words that occur in each text, in the order of the list. NULL has none."""
        n_words, width = len(self.words), np.int32 if pa.types.is_string(texts.type) else np.int64
        offsets = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        begins, ends = offsets[:-1], offsets[1:]
        pairs = []
        for start in range(int(offsets[0]), int(offsets[-1]), BLOCK):
            stop = min(start + BLOCK, int(offsets[-1]))
            first, last = np.searchsorted(ends, start, "right"), np.searchsorted(begins, stop, "left")
            held = np.minimum(ends[first:last], stop) - np.maximum(begins[first:last], start)
            text = np.repeat(np.arange(last - first), held)
            marks = np.zeros((last - first) * n_words, bool) if (last - first) * n_words <= MOST_MARKS else None
            some = []
            for at, words, size in self._hits(data[start : min(stop + self.longest, int(offsets[-1]))], stop - start):
                own = text[at]
                inside = start + at + size <= ends[first + own]
                pair = own[inside] * n_words + words[inside]
                if marks is None:
                    some.append(pair)
                else:
                    marks[pair] = True
            met = _once(some) if marks is None else np.flatnonzero(marks)
            pairs.append(met + first * n_words)
        # A text may lie in several blocks.
        met = _once(pairs)
        if len(self.again):
            met = _once([met, self._again(met)])
        if self.empty:
            known = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False))
            met = _once([met, *(known * n_words + i for i in self.empty)])
        text, word = np.divmod(met, max(n_words, 1))
        lists = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(texts)))))
        return pa.ListArray.from_arrays(pa.array(lists, pa.int32()), self.words.take(pa.array(word)))


class HanPaths:
    """Segments runs of Han characters by ``weights``, whole numbers; a character that is no word has ``unseen``."""

    def __init__(self, words: list[str], weights: list[int], unseen: int):
        self.weights, self.unseen = dict(zip(words, weights)), unseen
        # The sizes of words of four characters and more by the first three; few lists of sizes are different.
        sizes: dict[str, set[int]] = {}
        for word in words:
            if len(word) > 3:
                sizes.setdefault(word[:3], set()).add(len(word))
        same: dict[tuple, tuple] = {}
        self.sizes = {begin: same.setdefault(t := tuple(sorted(of)), t) for begin, of in sizes.items()}
        # What was met before, also by earlier tasks of the same process: words at three characters, and the parts of runs.
        self.begins: dict[str, tuple] = {}
        self.known: dict[str, tuple[tuple, tuple]] = {}

    def _begin(self, three: str) -> tuple[list[tuple[int, int]], tuple[int, ...]]:
        """Sizes and weights of the words of up to three characters that begin there, and the sizes that longer ones have."""
        short = [(1, self.weights.get(three[0], self.unseen))]
        short += [(n, self.weights[three[:n]]) for n in range(2, len(three) + 1) if three[:n] in self.weights]
        if len(self.begins) >= REMEMBERED:
            self.begins.clear()
        self.begins[three] = short, self.sizes.get(three, ())
        return self.begins[three]

    def path(self, run: str) -> list[str]:
        """The words of the best path; ties go to the longer last word."""
        many, weight, begins = len(run), self.weights.get, self.begins.get
        score, back = [_NO_PATH] * (many + 1), [0] * (many + 1)
        score[0] = 0
        for at in range(many):
            here, three = score[at], run[at : at + 3]
            short, sizes = begins(three) or self._begin(three)
            # What is at an end already begins further left, so its last word is longer.
            for size, more in short:
                if here + more > score[at + size]:
                    score[at + size], back[at + size] = here + more, at
            for size in sizes:
                end = at + size
                if end > many:
                    break
                more = weight(run[at:end])
                if more is not None and here + more > score[end]:
                    score[end], back[end] = here + more, at
        words, end = [], many
        while end:
            words.append(run[back[end] : end])
            end = back[end]
        return words[::-1]

    def parts(self, run: str) -> tuple[tuple, tuple]:
        """Words of two characters and more, and the pairs of single characters that stand next to each other."""
        path = self.path(run)
        pairs = (a + b for a, b in zip(path, path[1:]) if len(a) == len(b) == 1)
        return tuple(w for w in path if len(w) > 1), tuple(pairs)

    def found_in(self, texts: pa.Array) -> pa.ListArray:
        """The parts of the different runs of each text, words before pairs, in the order in which they come; NULL has none."""
        known, found, lists = self.known, [], [0]
        for text in _texts(texts):
            words, pairs = [], []
            for run in dict.fromkeys(_HAN_RUN.findall(text or "")):
                parts = known.get(run)
                if parts is None:
                    parts = self.parts(run)
                    if len(run) <= LONGEST_REMEMBERED:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[run] = parts
                words += parts[0]
                pairs += parts[1]
            found += dict.fromkeys(words + pairs)
            lists.append(len(found))
        return pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.array(found, pa.string()))


def _texts(texts: pa.Array) -> list[str | None]:
    try:
        return texts.to_pylist()
    except UnicodeDecodeError:  # as Spark's own functions read such bytes
        return [None if t is None else t.decode(errors="replace") for t in texts.view(pa.binary()).to_pylist()]


def _found(text: Column, held: Broadcast) -> Column:
    """What the search that every task holds finds in ``text``."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in arrays:
            yield held.value.found_in(texts)

    return F.arrow_udf(run, "array<string>")(text)


def _sent(words: DataFrame, search: WordTrie | HanPaths) -> Callable[[Column], Column]:
    ship_package(words.sparkSession)
    held = words.sparkSession.sparkContext.broadcast(search)
    return lambda text: _found(text, held)


def words_in(words: DataFrame, order: list[str]) -> Callable[[Column], Column]:
    """A function from a text to those of ``word`` that occur in it, in the order of ``order``."""
    return _sent(words, WordTrie(words.orderBy(*order).select("word").toArrow()["word"].to_pylist()))


def han_words_in(lexicon: DataFrame) -> Callable[[Column], Column]:
    """A function from a text to the words of its runs of Han characters by ``word``, ``weight`` and ``unseen``."""
    rows = lexicon.select("word", "weight", "unseen").toArrow()
    unseen = rows["unseen"][0].as_py() if len(rows) else 0
    return _sent(lexicon, HanPaths(rows["word"].to_pylist(), rows["weight"].to_pylist(), unseen))
