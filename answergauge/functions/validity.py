"""Is an answer usable (blank, short, repetitive), and is it free of banned words?"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from answergauge import texts
from answergauge.functions.text import fill_template, fixed2, literals
from answergauge.rules import Rules


SEARCHED_CHARS = 8
COUNTED_CHARS = 128


def _count_of(text: Column, char: Column) -> Column:
    """How often a character occurs. Byte lengths are known without reading the text."""
    removed = F.octet_length(text) - F.octet_length(F.replace(text, char, F.lit("")))
    return removed / F.octet_length(char)


def top_char_share(text: Column) -> Column:
    """Share of the commonest character in a non-empty text. Few distinct characters are each counted by a search of the
    text; else it is the longest run among the sorted characters, linear apart from the sort."""
    chars = F.array_distinct(F.split(text, ""))
    counted = F.array_max(F.transform(chars, lambda c: _count_of(text, c)))
    # The \1 is possessive: it never goes back, and so needs no stack.
    runs = F.regexp_extract_all(F.array_join(F.sort_array(F.split(text, "")), ""), F.lit(r"(?s)(.)\1*+"), F.lit(0))
    longest = F.array_max(F.transform(runs, lambda run: F.length(run)))
    return F.when(F.size(chars) <= COUNTED_CHARS, counted).otherwise(longest) / F.length(text)


def top_char_share_above(text: Column, limit: float) -> Column:
    """``top_char_share`` where it exceeds ``limit``, else anything not above it (NULL included).

    A character that fills more than ``(k-1)/k`` of a text must stand ``k`` times in a row somewhere
    (cut the text into blocks of ``k``: one block is full of it). So beyond a short length only the
    characters of such runs need counting, and ordinary prose has none."""
    if limit >= 1:
        return F.lit(None).cast("double")
    k = 1
    while k < 1000 and k / (k + 1) < limit:
        k += 1
    if k == 1:
        return top_char_share(text)
    full_block = (k - 1) / k
    # The last, incomplete block may hide up to k-1 more; from this length on that no longer matters.
    enough = math.ceil(full_block / (limit - full_block)) + 1
    in_runs = F.array_distinct(
        F.regexp_extract_all(text, F.lit(rf"(?s)(.)\1{{{k - 1}}}"), F.lit(1))
    )
    few = F.when(F.length(text) > enough, in_runs)
    counted = F.array_max(F.transform(few, lambda c: _count_of(text, c))) / F.length(text)
    # Each candidate is a search of the text; beyond a few, one sort is cheaper.
    return F.when(F.size(few) <= SEARCHED_CHARS, counted).otherwise(top_char_share(text))


def longest_phrase_run(text: Column, phrase_lengths: Sequence[int], more_than: int) -> Column:
    """The longest run of one phrase repeated back to back, as ``struct<times, phrase>``; NULL when no
    run has more than ``more_than`` repeats.

    For each length L the text is read in blocks of L from its start, so only runs that begin at a
    multiple of L are seen. ``\\G`` with a lazy skip steps block by block and finds the long runs only.
    Among equally long runs the shorter phrase wins, then the earlier one."""

    def runs(size: int) -> Column:
        block = "." * size  # faster than .{n}
        pattern = rf"(?s)\G(?:{block})*?(({block})\2{{{max(more_than, 0)},}})"
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        if more_than < 1:  # else a run that counts has two blocks anyway
            found = F.when(F.length(text) >= 2 * size, found).otherwise(literals(()))
        return F.transform(
            found,
            lambda run, i: F.struct(
                (F.length(run) / size).cast("int").alias("times"),
                F.lit(-size).alias("short_first"),
                (-i).alias("early_first"),
                F.left(run, F.lit(size)).alias("phrase"),
            ),
        )

    best = F.array_max(F.concat(*[runs(size) for size in phrase_lengths]))
    return F.when(best.isNotNull(), F.struct(best["times"].alias("times"), best["phrase"].alias("phrase")))


def validity_parts(stripped: Column, rules: Rules) -> dict[str, Column]:
    """The two measured parts of the verdict, to be projected before ``validity_msg`` uses them.
    Both are NULL where an earlier test already decides."""
    long_enough = F.length(stripped) >= max(rules.min_length, 1)
    share = F.when(long_enough, top_char_share_above(stripped, rules.max_repeat_rate))
    run = F.when(long_enough, longest_phrase_run(stripped, rules.phrase_lengths, rules.max_continuous_repeat))
    return {"_char_share": share, "_phrase_run": run}


def validity_msg(stripped: Column, share: Column, run: Column, rules: Rules) -> Column:
    """Text of the first failed test, or the pass text: blank, too short, one character too often,
    one phrase too often in a row."""
    text = F.coalesce(stripped, F.lit(""))
    return (
        F.when(text == "", texts.CODE_TEXTS[texts.EMPTY_ANSWER])
        .when(
            F.length(text) < rules.min_length,
            fill_template(texts.SHORT_TEXT, {"length": F.length(text), "limit": rules.min_length}),
        )
        .when(
            share > F.lit(float(rules.max_repeat_rate)),
            fill_template(texts.CHAR_REPEAT_TEXT, {"rate": fixed2(share), "limit": rules.max_repeat_rate}),
        )
        .when(
            run.isNotNull(),
            fill_template(
                texts.PHRASE_REPEAT_TEXT,
                {"phrase": run["phrase"], "times": run["times"], "limit": rules.max_continuous_repeat},
            ),
        )
        .otherwise(texts.VALID_TEXT)
    )


def banned_words(content: Column, rules: Rules) -> Column:
    """Every configured word that occurs in the raw text, in the order of the list. Each word is a search of the text, so
    lists beyond configuration size belong in a table (``operators.word_list``)."""
    if not rules.sensitive_words:
        return literals(())
    return F.filter(literals(rules.sensitive_words), lambda word: F.contains(content, word))


def compliance_msg(banned: Column, rules: Rules, any_words: bool | None = None) -> Column:
    """The banned words found, or a pass text. ``banned`` is projected beforehand; ``any_words`` tells whether there is a
    list at all, if the rules do not hold it."""
    if not (rules.sensitive_words if any_words is None else any_words):
        return F.lit(texts.COMPLIANCE_SKIPPED_TEXT)
    found = fill_template(texts.BANNED_TEXT, {"words": F.array_join(banned, ",")})
    return F.when(F.size(banned) > 0, found).otherwise(texts.COMPLIANT_TEXT)


def is_valid(message: Column) -> Column:
    return message == texts.VALID_TEXT


def is_compliant(message: Column) -> Column:
    return message.isin(texts.COMPLIANT_TEXT, texts.COMPLIANCE_SKIPPED_TEXT)
