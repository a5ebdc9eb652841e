"""Words of Han text by probability: the path of highest probability through the graph of all lexicon words.

The lexicon is a table of words and frequencies, joined and never written into a plan, so it may have any size: Spark
broadcasts it where its own size check allows, and else shuffles both sides by the first characters of words. Each
distinct run of Han characters is segmented once. Its graph falls apart wherever no word spans a gap; the best path is found
piece by piece, with a window of as many open ends as the longest word has characters. Scores are whole numbers
(millionths of a natural logarithm), so that ties are true ties: they go to the longer last word."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answergauge.functions.text import HAN, HAN_BREAK, ODD_SPACE, SPACED_WORD, WORDLIKE, has_han, literals, tokens
from answergauge.operators.held_words import han_words_in, may_be_held
from answergauge.operators.layout import once_and_again
from answergauge.rules import STOP_WORDS

MILLION = 1_000_000
# What stands between words of a path. No Han character, and no sign that a run can hold.
_GAP = " "
_EDGES = "array<struct<word: string, size: int, weight: bigint>>"


_DIGEST_BYTES = 32


def _digest(run: Column) -> Column:
    """The run's bytes if they are fewer than a digest has, which keeps the two apart."""
    return F.when(F.octet_length(run) < _DIGEST_BYTES, run.cast("binary")).otherwise(F.unhex(F.sha2(run, 256)))


def weighted_lexicon(words: DataFrame) -> DataFrame:
    """``word``, ``size`` and ``weight`` (millionths of the logarithm of its share) from ``word`` and ``freq``. Words
    that are not Han altogether, or never occur, are left out; frequencies of a repeated word add up."""
    used = words.where(F.col("word").rlike(f"^[{HAN}]+$") & (F.col("freq") > 0))
    used = used.groupBy("word").agg(F.sum(F.col("freq").cast("double")).alias("freq"))
    total = used.agg(F.sum("freq")).first()[0] or 1.0
    weight = F.floor(F.log(F.col("freq") / F.lit(total)) * MILLION)
    # One unseen occurrence, for characters that are no word of the lexicon.
    unseen = F.floor(F.log(F.lit(1.0) / F.lit(total)) * MILLION)
    return used.select("word", F.length("word").alias("size"), weight.alias("weight"), unseen.alias("unseen"))


def segment_runs(runs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``digest`` and ``path`` (words with blanks between them) of each distinct ``run``. ``lexicon`` is as made by
    ``weighted_lexicon``."""
    longest, unseen = lexicon.agg(F.coalesce(F.max("size"), F.lit(1)), F.coalesce(F.max("unseen"), F.lit(0))).first()
    longest = max(longest, 1)
    # Overlapping windows, one at each place, found in a single pass.
    windows = F.regexp_extract_all("run", F.lit(f"(?s)(?=(.{{1,{longest}}}))"), F.lit(1))
    spots = runs.select("run").distinct().select(_digest(F.col("run")).alias("digest"), F.posexplode(windows).alias("at", "window"))

    # Words of one and of two characters are looked up whole, longer ones by their first three.
    def looked_up(size: int) -> DataFrame:
        return lexicon.where(F.col("size") == size).select(F.col("word").alias(f"_word{size}"), F.col("weight").alias(f"_weight{size}"))

    longer = lexicon.where(F.col("size") > 2).groupBy(F.left("word", F.lit(3)).alias("_begin"))
    longer = longer.agg(F.collect_list(F.struct("word", "size", "weight")).alias("_words"))
    for size in (1, 2):
        spots = spots.join(looked_up(size), F.left("window", F.lit(size)) == F.col(f"_word{size}"), "left")
    spots = spots.join(longer, F.left("window", F.lit(3)) == F.col("_begin"), "left")
    two = F.struct(F.col("_word2").alias("word"), F.lit(2).alias("size"), F.col("_weight2").alias("weight"))
    more = F.coalesce(F.filter("_words", lambda w: F.startswith(F.col("window"), w["word"])), F.array().cast(_EDGES))
    here = F.concat(F.when(F.col("_word2").isNotNull(), F.array(two)).otherwise(F.array().cast(_EDGES)), more)
    found = spots.select(
        "digest", "at", "window", F.coalesce("_weight1", F.lit(unseen)).alias("single"), here.alias("here")
    )
    widest = F.aggregate("here", F.lit(1), lambda most, w: F.greatest(most, w["size"]))
    found = found.withColumns({"reach": F.col("at") + widest, "window": F.left("window", widest)})

    # A piece begins where nothing before it reaches further.
    order = Window.partitionBy("digest").orderBy("at")
    before = F.max("reach").over(order.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("_new", (F.coalesce(before, F.lit(0)) <= F.col("at")).cast("int"))
    found = found.withColumn("piece", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    node = F.struct("at", "window", "single", "here")
    pieces = found.groupBy("digest", "piece").agg(
        F.sort_array(F.collect_list(node)).alias("nodes"), F.max(F.col("reach") - F.col("at")).alias("widest")
    )
    places = F.sequence(F.lit(1), F.col("widest"))  # no open end lies further on

    def step(open_ends: Column, spot: Column) -> Column:
        """``open_ends[k]`` is the best path so far that ends k characters on; NULL where there is none."""

        def reached(k: Column) -> Column:
            weights = F.transform(F.filter(spot["here"], lambda w: w["size"] == k), lambda w: w["weight"])
            score = open_ends[0]["score"] + F.when(k == 1, spot["single"]).otherwise(F.try_element_at(weights, F.lit(1)))
            so_far = F.try_element_at(open_ends, k + 1)
            path = F.concat(open_ends[0]["path"], F.lit(_GAP), F.left(spot["window"], k))

            def better(ends: Column) -> Column:
                """``ends`` binds what is so far and the new score, which each test would else compute again."""
                known, new = ends["known"], ends["new"]
                more = new.isNotNull() & (known.isNull() | (new > known["score"]))
                return F.when(more, F.struct(new.alias("score"), path.alias("path"))).otherwise(known)

            return F.transform(F.array(F.struct(so_far.alias("known"), score.alias("new"))), better)[0]

        return F.transform(places, reached)

    start = F.transform(places, lambda k: F.when(k == 1, F.struct(F.lit(0).cast("bigint").alias("score"), F.lit("").alias("path"))))
    best = F.aggregate("nodes", start, step, lambda ends: ends[0]["path"])
    alone = F.concat(F.lit(_GAP), F.left(F.col("nodes")[0]["window"], F.lit(1)))
    paths = pieces.select("digest", "piece", F.when(F.size("nodes") == 1, alone).otherwise(best).alias("path"))
    parts = paths.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("piece", "path"))).alias("parts"))
    path = F.array_join(F.transform("parts", lambda p: p["path"]), "")
    return parts.select("digest", F.ltrim(path).alias("path"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def _runs(text: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[{HAN}]+"), F.lit(0))


def _with_places(runs: Column) -> Column:
    """Each different run once, with all its places. Sorted, equal runs stand together."""

    def grouped(found: Column) -> Column:
        def differs(i: Column) -> Column:
            return ~F.get(found, i - 1)["run"].eqNullSafe(F.get(found, i)["run"])

        def group(starts: Column) -> Column:
            def one(start: Column, k: Column) -> Column:
                size = F.coalesce(F.get(starts, k + 1), F.size(found)) - start
                places = F.transform(F.slice(found, start + 1, size), lambda r: r["at"])
                return F.struct(F.get(found, start)["run"].alias("run"), places.alias("_places"))

            return F.transform(starts, one)

        every = F.when(F.size(found) > 0, F.sequence(F.lit(0), F.size(found) - 1))
        return _let(F.filter(every, differs), group)

    at = F.transform(runs, lambda r, i: F.struct(r.alias("run"), i.alias("at")))
    return _let(F.sort_array(at), grouped)


def _with_first_places(runs: Column) -> Column:
    """Each different run once, in the order in which they come first."""
    once = F.array_distinct(runs)
    return F.transform(once, lambda r, i: F.struct(r.alias("run"), F.array(i).alias("_places")))


def _paths(texts: DataFrame, lexicon: DataFrame, keys: list[str], runs: Column, with_places: Callable[[Column], Column]) -> DataFrame:
    """The keys and ``runs``: the paths of the runs at their places. A run is looked up once a text, however often it
    stands there."""
    listed = texts.select(*keys, F.inline_outer(with_places(runs)))
    listed = listed.withColumn("digest", _digest(F.col("run")))
    paths = segment_runs(texts.select(F.explode(F.array_distinct(runs)).alias("run")), weighted_lexicon(lexicon))
    placed = listed.drop("run").join(paths, "digest", "left").groupBy(*keys)
    found = placed.agg(F.collect_list(F.when(F.col("_places").isNotNull(), F.struct("_places", "path"))).alias("_found"))
    spots = F.transform("_found", lambda f: F.transform(f["_places"], lambda p: F.struct(p.alias("at"), f["path"].alias("path"))))
    in_order = F.sort_array(F.flatten(spots))
    return found.select(*keys, F.transform(in_order, lambda r: r["path"]).alias("runs"))


def han_segments(texts: DataFrame, lexicon: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The keys, which tell rows apart, and ``runs``: the segmented Han runs of the text, in their order. Texts without
    Han characters, and NULLs, have none."""
    return _paths(texts, lexicon, keys, _runs(text), _with_places)


def _words(runs: Column) -> Column:
    """Words of two characters and more, and the pairs of the single characters that are left next to each other, so that
    words that the lexicon lacks count too."""
    words = F.flatten(F.transform(runs, lambda r: F.filter(F.split(r, _GAP), lambda w: F.length(w) >= 2)))
    # Blanks beside single characters go; those beside longer words stay.
    single = rf"(?<![{HAN}])[{HAN}](?:{_GAP}[{HAN}](?![{HAN}]))+"
    left = F.flatten(F.transform(runs, lambda r: F.regexp_extract_all(r, F.lit(single), F.lit(0))))
    pair = F.lit(rf"(?=([{HAN}]{{2}}))")
    pairs = F.flatten(F.transform(left, lambda r: F.regexp_extract_all(F.replace(r, F.lit(_GAP), F.lit("")), pair, F.lit(1))))
    return F.concat(words, pairs)


def segmented_tokens(texts: DataFrame, lexicon: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The keys and ``tokens``: the token set of each text, with Han words by probability. NULL gives NULL. Rows with the same keys
    share their Han words.

    A lexicon that every task can hold goes to the texts, and nothing is shuffled; runs and paths are as large as the texts, and more."""
    rows = texts.select(*keys, F.col(text).alias("_text"))
    words = weighted_lexicon(lexicon)
    if not may_be_held(words):
        return _tokens_by_joins(rows, lexicon, keys)
    once, again = once_and_again(rows, keys)
    in_runs = han_words_in(words)(F.when(has_han(F.col("_text")), F.col("_text")))
    found = _with_tokens(once.withColumn("_words", in_runs), keys, has_han(F.col("_text")))
    return found if again is None else found.unionByName(_tokens_by_joins(again, lexicon, keys))


def _tokens_by_joins(rows: DataFrame, lexicon: DataFrame, keys: list[str]) -> DataFrame:
    """``segmented_tokens`` of the column ``_text``, for lexicons of any size."""
    with_han = rows.where(has_han(F.col("_text")))
    # Words count once, so the places of further equal runs do not matter.
    segments = _paths(with_han, lexicon, keys, _runs("_text"), _with_first_places).withColumnsRenamed({k: f"_of_{k}" for k in keys})
    # A key may be NULL; rows are told apart by all of them.
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    joined = rows.join(segments, same, "left").withColumn("_words", _words(F.col("runs")))
    return _with_tokens(joined, keys, F.col("runs").isNotNull())


def _with_tokens(rows: DataFrame, keys: list[str], segmented: Column) -> DataFrame:
    """The keys and ``tokens`` of ``_text``; where it is ``segmented``, with ``_words`` for its Han characters."""
    rest = F.regexp_replace(F.regexp_replace("_text", HAN_BREAK, " "), ODD_SPACE, " ")
    words = F.filter("_words", lambda w: w.rlike(f"[{WORDLIKE}]"))
    spaced = F.regexp_extract_all(rest, F.lit(SPACED_WORD), F.lit(0))
    of_han = F.array_except(F.concat(words, spaced), literals(STOP_WORDS))
    return rows.select(*keys, F.when(segmented, of_han).otherwise(tokens(F.col("_text"))).alias("tokens"))


def add_segmented_tokens(
    df: DataFrame, lexicon: DataFrame, content: str = "answer_content", key: str = "case_pos"
) -> DataFrame:
    """What ``evaluate.add_tokens`` adds, with the Han words of answers, standard answers and keywords by probability.
    All texts of all cases are segmented in one go; ``key`` tells cases apart."""

    def part(kind: str, text: Column, at: Column = F.lit(0)) -> Column:
        return F.struct(F.lit(kind).alias("kind"), at.cast("int").alias("no"), text.alias("text"))

    keywords = F.transform("expect_keywords", lambda k, i: part("keyword", k, i))
    listed = F.concat(F.array(part("answer", F.col(content)), part("standard", F.col("standard_answer"))), keywords)
    pieces = df.select(key, F.inline(listed)).where(has_han(F.col("text")))
    found = segmented_tokens(pieces, lexicon, [key, "kind", "no"]).groupBy(key)
    found = found.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(" ", "kind", "no"), "tokens"))).alias("_han"))

    def of(name: Column, text: Column) -> Column:
        return F.coalesce(F.try_element_at("_han", name), tokens(text))

    return (
        df.join(found, key, "left")
        .withColumns(
            {
                "_answer_tokens": F.coalesce(of(F.lit("answer 0"), F.col(content)), F.array().cast("array<string>")),
                "_standard_tokens": of(F.lit("standard 0"), F.col("standard_answer")),
                "_keyword_tokens": F.transform("expect_keywords", lambda k, i: of(F.concat_ws(" ", F.lit("keyword"), i), k)),
            }
        )
        .withColumn("_answer_only", F.array_except("_answer_tokens", "_standard_tokens"))
        .drop("_han")
    )
