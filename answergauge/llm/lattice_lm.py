"""Language-model scoring by the likelihood of the subword lattice.

The pieces and their order come from an existing vocabulary file (never trained); they give every piece a prior
weight. The weights are then re-estimated by rounds of expectation-maximisation over all segmentations of all distinct words
of the training texts. A text is its words, each led by a marker, and one end. A word's probability is the sum
over all its segmentations, by the forward recursion, in log space where the word is so long that its probability
could be too small for a double; the lattice is over UTF-8 bytes with every byte as a piece, so every text has a probability. Each word of the training texts is one more piece, of the whole word: it takes its
count less a discount, and what the discounts leave goes to the segmentations into pieces of the vocabulary. So what is
known grows with the corpus, and the probabilities of all texts sum to at most 1. Pieces do not cross words, so the
marginal of a text is the product over its words.

Next to it the operator gives a plain unigram baseline with add-one smoothing. Word counts are exact and over
all training texts. The most frequent words, a bounded table, are looked up in the tasks that read
the texts; the others are joined, so that no key of the join is hot. How many are looked up changes no result.

Cases: a NULL or empty text is one end; a NULL id counts as training; repeated rows count as often as they
stand; with no training rows all counts are 0 and the prior weights hold; very long words cost time and memory
in proportion; an empty table gives no rows; only the id and the text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answergauge.llm.common import give_back, in_slices, materialised, ship_package

FREQUENT = 50_000
FREQUENT_BYTES = 64
ROUNDS = 4
SLICE_BYTES = 8 << 20
COUNTER_ENTRIES = 400_000
CHUNK_BYTES = 1 << 17
LEAST_LOG = -600.0  # probabilities down to its exponential are computed as they are
LN10 = float(np.log(10))
MARKER = b" "
ROOT = 1


class Lattice:
    """The trie of the pieces. Piece 0 is the end of a text, 1 to 256 are the bytes."""

    def __init__(self, vocabulary: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        n = model.get_piece_size()
        prior = {bytes([b]): 1.0 / (n + 50) for b in range(256)}
        for i in range(n):
            if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
                continue
            piece = model.id_to_piece(i).replace("▁", " ").encode()
            usable = MARKER not in piece[1:] and piece == piece.lower()
            if usable:
                # The scores of this file fall by one from merge to merge: a rank.
                prior[piece] = max(prior.get(piece, 0.0), 1.0 / (50 - model.get_score(i)))
        self.pieces = [b""] + sorted(prior, key=lambda p: (len(p), p))
        weights = np.array([1.0 / 500] + [prior[p] for p in self.pieces[1:]])
        self.prior = weights / weights.sum()
        self.longest = max(map(len, self.pieces))
        nodes: list[dict[int, int]] = [{}, {}]  # 0, from which nothing leads elsewhere, and the root
        final = [-1, -1]
        for number, piece in enumerate(self.pieces[1:], 1):
            at = ROOT
            for byte in piece:
                if byte not in nodes[at]:
                    nodes[at][byte] = len(nodes)
                    nodes.append({})
                    final.append(-1)
                at = nodes[at][byte]
            final[at] = number
        self.final = np.array(final, np.int32)
        self.next = np.zeros((len(nodes), 256), np.int32)
        for at, children in enumerate(nodes):
            for byte, to in children.items():
                self.next[at, byte] = to

    def edges(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        """The lattices of all words: start node, end node, piece of every edge, ordered by how far the end lies
        in its word, then by end; and the bounds of these groups. Nodes are numbered on; a word has one more than bytes."""
        marked = [MARKER + w for w in words]
        lengths = np.fromiter(map(len, marked), np.int64, len(marked))
        data = np.frombuffer(b"".join(marked), np.uint8)
        first = np.concatenate([[0], np.cumsum(lengths)])
        word = np.repeat(np.arange(len(words)), lengths)
        inside = np.arange(len(data)) - first[word]
        room = lengths[word] - inside
        node = np.arange(len(data)) + word
        at, state = np.arange(len(data)), np.full(len(data), ROOT, np.int32)
        found = []
        for step in range(self.longest):
            state = self.next[state, data[at + step]]
            alive = state > 0
            at, state = at[alive], state[alive]
            piece = self.final[state]
            hit = piece >= 0
            start = at[hit]
            found.append((node[start], step + 1, inside[start], piece[hit]))
            more = room[at] > step + 1
            at, state = at[more], state[more]
            if not len(at):
                break
        starts = np.concatenate([f[0] for f in found])
        widths = np.concatenate([np.full(len(f[0]), f[1]) for f in found])
        depth = np.concatenate([f[2] for f in found]) + widths
        pieces = np.concatenate([f[3] for f in found])
        ends = starts + widths
        order = np.argsort(depth * np.int64(len(data) + len(words) + 1) + ends, kind="stable")
        starts, ends, pieces, depth = starts[order], ends[order], pieces[order], depth[order]
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(depth)) + 1, [len(depth)]])
        return starts, ends, pieces, bounds, first[:-1] + np.arange(len(words)), lengths

    @staticmethod
    def _sums(x: np.ndarray, groups: np.ndarray) -> np.ndarray:
        """log of the sums of exp(x) over runs that begin at ``groups``."""
        top = np.maximum.reduceat(x, groups)
        spread = np.repeat(top, np.diff(np.append(groups, len(x))))
        return top + np.log(np.add.reduceat(np.exp(x - spread), groups))

    def forward(self, lattice: tuple, log_p: np.ndarray) -> np.ndarray:
        starts, ends, pieces, bounds, first, lengths = lattice
        alpha = np.zeros(int(lengths.sum()) + len(lengths))
        weights = log_p[pieces]
        turn = np.concatenate([[True], ends[1:] != ends[:-1]]) if len(ends) else np.zeros(0, bool)
        for a, b in zip(bounds[:-1], bounds[1:]):
            groups = np.flatnonzero(turn[a:b])
            alpha[ends[a:b][groups]] = self._sums(alpha[starts[a:b]] + weights[a:b], groups)
        return alpha

    def _by_length(self, words: list[bytes], log_p: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """All words in chunks: their places in ``words``, and the bytes of words of one length, a column each. Words so
        long that their probability could be below the least come last, without such bytes."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        short = int(np.searchsorted(lengths[order], LEAST_LOG / log_p.min() - len(MARKER)))
        bounds = np.flatnonzero(np.diff(lengths[order[:short]], prepend=-1)).tolist() + [short]
        for start, stop in zip(bounds, bounds[1:]):
            size = int(lengths[order[start]]) + len(MARKER)
            for first in range(start, stop, max(1, CHUNK_BYTES // size)):
                places = order[first : min(stop, first + max(1, CHUNK_BYTES // size))]
                data = np.frombuffer(b"".join([MARKER + words[i] for i in places.tolist()]), np.uint8)
                yield places, np.ascontiguousarray(data.reshape(len(places), size).T)
        if short < len(words):
            yield order[short:], None

    def _forward(self, data: np.ndarray, node_p: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """For words of one length: the probability of every prefix, and for each end the first start that may lead
        there and the nodes reached from the starts, 0 where no piece goes on."""
        size, n = data.shape
        alpha, state, reached = np.zeros((size + 1, n)), np.full((size, n), ROOT, np.int32), []
        alpha[0] = 1.0
        for end in range(1, size + 1):
            start = max(0, end - self.longest)
            nodes = state[start:end] = self.next[state[start:end], data[end - 1]]
            alpha[end] = (alpha[start:end] * node_p[nodes]).sum(0)
            reached.append((start, nodes))
        return alpha, reached

    def _node_p(self, log_p: np.ndarray) -> np.ndarray:
        return np.append(np.exp(log_p), 0.0)[self.final]  # the last, where a node ends no piece

    def log_probabilities(self, words: list[bytes], log_p: np.ndarray) -> np.ndarray:
        """log of each word's probability, all segmentations together."""
        out, node_p = np.zeros(len(words)), self._node_p(log_p)
        for places, data in self._by_length(words, log_p):
            if data is not None:
                out[places] = np.log(self._forward(data, node_p)[0][-1])
                continue
            at = 0
            for part in _chunks([words[i] for i in places.tolist()]):
                lattice = self.edges(part)
                out[places[at : at + len(part)]] = self.forward(lattice, log_p)[lattice[4] + lattice[5]]
                at += len(part)
        return out

    def expected(self, words: list[bytes], counts: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece in words that occur ``counts`` times."""
        node_p, uses, total = self._node_p(log_p), np.zeros(len(self.final)), np.zeros(len(self.pieces))
        for places, data in self._by_length(words, log_p):
            if data is None:
                total += self._expected_of_long([words[i] for i in places.tolist()], counts[places], log_p)
                continue
            alpha, reached = self._forward(data, node_p)
            beta = np.zeros_like(alpha)
            beta[-1] = counts[places] / alpha[-1]
            for end in range(len(data), 0, -1):
                start, nodes = reached[end - 1]
                onward = node_p[nodes] * beta[end]
                beta[start:end] += onward
                uses += np.bincount(nodes.ravel(), (alpha[start:end] * onward).ravel(), len(uses))
        ends = np.flatnonzero(self.final >= 0)
        return total + np.bincount(self.final[ends], uses[ends], len(self.pieces))

    def _expected_of_long(self, words: list[bytes], counts: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        total, at = np.zeros(len(self.pieces)), 0
        for part in _chunks(words):
            lattice = self.edges(part)
            starts, ends, pieces, bounds, first, lengths = lattice
            alpha = self.forward(lattice, log_p)
            beta = np.full(len(alpha), -np.inf)
            beta[first + lengths] = 0.0
            weights = log_p[pieces]
            # An edge's end lies deeper than its start, so from the deepest ends back every end is complete.
            for a, b in zip(bounds[-2::-1], bounds[:0:-1]):
                np.logaddexp.at(beta, starts[a:b], weights[a:b] + beta[ends[a:b]])
            sizes = lengths + 1
            owner_log = np.repeat(alpha[first + lengths], sizes)
            owner_count = np.repeat(counts[at : at + len(part)], sizes)
            share = np.exp(alpha[starts] + weights + beta[ends] - owner_log[starts]) * owner_count[starts]
            total += np.bincount(pieces, share, len(self.pieces))
            at += len(part)
        return total

    def weights(self, expected: np.ndarray) -> np.ndarray:
        """log weights from expected counts, smoothed by one prior occurrence a piece on average."""
        smoothed = expected + self.prior * len(self.prior)
        return np.log(smoothed / smoothed.sum())


def _chunks(words: list[bytes]) -> Iterator[list[bytes]]:
    start, held = 0, 0
    for i, w in enumerate(words):
        if i > start and held + len(w) > CHUNK_BYTES:
            yield words[start:i]
            start, held = i, 0
        held += len(w) + 1
    if start < len(words):
        yield words[start:]


@lru_cache(maxsize=1)
def _lattice(vocabulary: str) -> Lattice:
    return Lattice(vocabulary)


def tokens(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The words of all texts (binary), in lower case in A-Z and cut at ASCII white space: the place of each word's text,
    and the words. NULL and empty texts have none."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.view(pa.string()), "")))
    words = cut.flatten()
    place = np.repeat(np.arange(len(texts)), np.diff(cut.offsets.to_numpy()))
    some = pc.greater(pc.binary_length(words), 0)  # white space at either end leaves an empty piece there
    return place[some.to_numpy(zero_copy_only=False)], words.filter(some).view(pa.binary()).dictionary_encode()


def word_counts(texts: DataFrame, text_col: str) -> DataFrame:
    """word, c: exact counts over all rows. Tasks combine before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def combined() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"])

        for part in in_slices(batches, "text", SLICE_BYTES):
            words = tokens(part.column("text"))[1]
            counts = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
            held.append(pa.table({"word": words.dictionary, "c": pa.array(counts, pa.int64())}))
            if sum(map(len, held)) > COUNTER_ENTRIES:
                held = [combined()]
                if len(held[0]) > COUNTER_ENTRIES:
                    yield from held.pop().to_batches()
        if held:
            yield from combined().to_batches()
        give_back()

    found = texts.select(F.col(text_col).cast("string").cast("binary").alias("text"))
    return found.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _most_frequent(counts: DataFrame, most: int) -> list:
    """Up to ``most`` of the most frequent words that are not too long. Counts are binned first (a bounded number
    of bins), so that the driver gets these words and no candidates of each task."""
    binned = counts.where(F.length("word") <= FREQUENT_BYTES).withColumn("bin", F.floor(F.log2("c") * 16).cast("int"))
    least, held = None, 0
    for number, words in sorted(binned.groupBy("bin").count().collect(), reverse=True):
        held += words
        if held > most:
            break
        least = number
    return binned.where(F.col("bin") >= least).select("word", "c").collect() if least is not None else []


def score(
    docs: DataFrame,
    is_held_out: Column,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    frequent: int = FREQUENT,
) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score and score, both log10."""
    spark = docs.sparkSession
    ship_package(spark)
    held_out = F.coalesce(is_held_out, F.lit(False))
    training = docs.where(~held_out)
    counts = materialised(word_counts(training, text_col))
    ends = training.count()
    n_words, distinct, once, twice = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)
    ).first()
    train_tokens, vocabulary_size = n_words + ends, distinct + (1 if ends else 0)
    divisor = train_tokens + vocabulary_size + 1
    # What each word's count leaves to the lattice, and the lattice's share of all probability.
    discount = once / (once + 2 * twice) if once and twice else 0.5
    left = discount * distinct / train_tokens if distinct else 1.0
    top = _most_frequent(counts, frequent)

    lattice = _lattice(vocabulary)
    top_words, top_counts = [bytes(r[0]) for r in top], np.array([r[1] for r in top], float)
    log_p = np.log(lattice.prior)
    for _ in range(ROUNDS if distinct else 0):
        log_p = _over_all_words(counts, vocabulary, log_p)
    pieces = lattice.log_probabilities(top_words, log_p)
    logs = np.log10((top_counts - discount) / max(1, train_tokens) + left * np.exp(pieces))
    base_logs = np.log10((top_counts + 1) / divisor)
    # At most ``frequent`` words of ``FREQUENT_BYTES`` bytes.
    known = spark.sparkContext.broadcast((pa.array(top_words, pa.binary()), base_logs, logs, log_p))
    end_base = float(np.log10((ends + 1) / divisor))
    end_log = float(np.log10(ends / train_tokens)) if ends else float(log_p[0] / LN10)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent_words, frequent_base, frequent_log, weights = known.value
        first = TaskContext.get().partitionId() << 33
        for part in in_slices(batches, "text", SLICE_BYTES):
            place, words = tokens(part.column("text"))
            code, word, rows = words.indices.to_numpy(), words.dictionary, part.num_rows
            at = pc.fill_null(pc.index_in(word, value_set=frequent_words), -1).to_numpy()
            hit = at[code] >= 0
            looked_up, there = at[code[hit]], place[hit]
            # The words that are not looked up, once a text.
            pairs, n = np.unique(place[~hit] * len(word) + code[~hit], return_counts=True)
            row, rare = np.divmod(pairs, max(1, len(word)))
            by_pieces = np.zeros(len(word))
            unknown = np.flatnonzero(at < 0)
            by_pieces[unknown] = _lattice(vocabulary).log_probabilities(word.take(pa.array(unknown)).to_pylist(), weights) / LN10
            key, blank = first + np.arange(rows), len(rare)
            first += rows
            sums = [
                np.bincount(place, minlength=rows) + 1,
                np.bincount(there, minlength=rows) + (1 if ends else 0),
                np.bincount(there, frequent_base[looked_up], rows) + end_base,
                np.bincount(there, frequent_log[looked_up], rows) + end_log,
            ]
            # A row of the text itself has a word of its own, which no text can hold, so such rows spread too.
            own = pa.array([b" %d" % k for k in key.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([key[row], key]), pa.int64()),
                    pa.concat_arrays([word.take(pa.array(rare)), own]),
                    pa.array(np.concatenate([n, np.zeros(rows, np.int64)]), pa.int64()),
                    pa.concat_arrays([pa.nulls(blank, part.column("id").type), part.column("id")]),
                    pa.concat_arrays([pa.nulls(blank, pa.bool_()), part.column("held_out")]),
                    pa.concat_arrays([pa.nulls(blank, pa.int64()), pa.array(sums[0], pa.int64())]),
                    pa.concat_arrays([pa.nulls(blank, pa.int64()), pa.array(sums[1], pa.int64())]),
                    pa.concat_arrays([pa.nulls(blank, pa.float64()), pa.array(sums[2])]),
                    pa.array(np.concatenate([by_pieces[rare], sums[3]])),
                ],
                names=["key", "word", "n", "id", "held_out", "n_tokens", "n_known", "base", "score"],
            )
        give_back()

    chosen = docs.select(
        F.col(id_col).alias("id"),
        held_out.alias("held_out"),
        F.col(text_col).cast("string").cast("binary").alias("text"),
    )
    kind = docs.schema[id_col].dataType.simpleString()
    rows = chosen.mapInArrow(
        run,
        f"key long, word binary, n long, id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double",
    )
    rare_counts = counts.select(F.col("word").alias("w"), "c")
    joined = rows.join(rare_counts, rows["word"] == rare_counts["w"], "left")
    c = F.coalesce("c", F.lit(0))
    own = F.col("n_tokens").isNotNull()
    # A row of a word has the log10 of its probability by pieces of the vocabulary.
    by_pieces = F.lit(math.log10(left)) + F.col("score")
    counted = F.lit(1.0 / max(1, train_tokens)) * (c - discount) + F.lit(left) * F.pow(F.lit(10.0), "score")
    whole = F.when(c > 0, F.log10(counted)).otherwise(by_pieces)
    return (
        joined.groupBy("key")
        .agg(
            F.max("id").alias(id_col),
            F.max("held_out").alias("held_out"),
            F.max("n_tokens").alias("n_tokens"),
            F.sum(F.when(own, F.col("n_known")).otherwise(F.when(c > 0, F.col("n")).otherwise(0))).alias("n_known"),
            F.lit(train_tokens).cast("long").alias("train_tokens"),
            F.sum(F.when(own, F.col("base")).otherwise(F.col("n") * F.log10((c + 1) / F.lit(divisor)))).alias("base_score"),
            F.sum(F.when(own, F.col("score")).otherwise(F.col("n") * whole)).alias("score"),
        )
        .drop("key")
    )


def _over_all_words(counts: DataFrame, vocabulary: str, log_p: np.ndarray) -> np.ndarray:
    """One round of expectation over the distinct words of the training texts, each once: every word leaves the same
    discount to its pieces. Tasks send sums per piece."""
    held = counts.sparkSession.sparkContext.broadcast(log_p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(vocabulary)
        total = np.zeros(len(lattice.pieces))
        for batch in batches:
            total += lattice.expected(batch.column("word").to_pylist(), np.ones(batch.num_rows), held.value)
        give_back()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"piece": at.astype(np.int32), "uses": total[at]})

    sums = counts.select("word").mapInArrow(run, "piece int, uses double").groupBy("piece").agg(F.sum("uses"))
    lattice = _lattice(vocabulary)
    found = np.zeros(len(lattice.pieces))
    for piece, uses in sums.collect():  # at most one row a piece
        found[piece] = uses
    return lattice.weights(found)
