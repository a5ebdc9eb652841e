"""Scores of an answer. Every function takes token arrays that were projected once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from answergauge import texts
from answergauge.functions.text import fill_template, is_blank, literals, percent1, round2, tokens
from answergauge.rules import Rules


def keyword_tokens(keywords: Column, lexicon: Sequence[str] = ()) -> Column:
    """The token set of every keyword."""
    return F.transform(keywords, lambda k: tokens(k, lexicon))


def relevance(content: Column, keywords: Column, kw_tokens: Column, answer_tokens: Column) -> Column:
    """Share of keywords found, 0 to 100. A keyword is found when the answer has all its tokens; a
    keyword without tokens when it occurs in the text as it stands."""
    # The keyword tokens that the answer has, in one pass over both: each keyword is then looked up among
    # these few. They are bound as a lambda variable, since an expression would be run per element.
    matched = F.array_intersect(F.flatten(kw_tokens), answer_tokens)

    def count_hits(found: Column) -> Column:
        hits = F.filter(
            F.arrays_zip(keywords.alias("word"), kw_tokens.alias("toks")),
            lambda k: F.when(F.size(k["toks"]) == 0, F.contains(content, k["word"])).otherwise(
                F.forall(k["toks"], lambda t: F.array_contains(found, t))
            ),
        )
        return F.size(hits)

    hits = F.element_at(F.transform(F.array(matched), count_hits), 1)
    return (
        F.when(is_blank(content), 0.0)
        .when(F.coalesce(F.size(keywords), F.lit(0)) == 0, 100.0)
        .otherwise(round2(hits / F.size(keywords) * 100))
    )


def completeness(
    content: Column, standard: Column, n_answer: Column, n_standard: Column, n_common: Column
) -> Column:
    """How much of the standard answer is covered, 0 to 100: 40% amount of words, 60% overlap."""
    amount = F.least(n_answer / n_standard, F.lit(1.0))
    overlap = n_common / n_standard
    return (
        F.when(is_blank(content), 0.0)
        .when(is_blank(standard) | (n_standard == 0), 80.0)
        .otherwise(round2((amount * F.lit(0.4) + overlap * F.lit(0.6)) * 100))
    )


def unsupported(answer_only: Column, rules: Rules) -> Column:
    """Answer tokens that are neither in the standard answer nor on the whitelist."""
    return F.array_except(answer_only, literals(rules.whitelist)) if rules.whitelist else answer_only


def extra_ratio(n_extra: Column, n_answer: Column) -> Column:
    return F.coalesce(n_extra / F.nullif(n_answer, F.lit(0)), F.lit(0.0))


def risk_level(content: Column, standard: Column, n_extra: Column, ratio: Column, rules: Rules) -> Column:
    """Risk that the answer claims things the standard answer does not. The share is tested first:
    many unsupported words are still a low risk in a long answer."""
    return (
        F.when(is_blank(content), texts.LEVEL_NONE)
        .when(is_blank(standard), texts.LEVEL_UNKNOWN)
        .when(n_extra == 0, texts.LEVEL_NONE)
        .when(ratio < F.lit(float(rules.extra_ratio_threshold)), texts.LEVEL_LOW)
        .when(n_extra <= rules.low_risk_threshold, texts.LEVEL_LOW)
        .when(n_extra <= rules.high_risk_threshold, texts.LEVEL_MEDIUM)
        .otherwise(texts.LEVEL_HIGH)
    )


def risk_msg(content: Column, level: Column, extra: Column, n_extra: Column, ratio: Column) -> Column:
    """Explanation of the level with a few of the unsupported words, in sorted order."""

    def told(template: str, sample_size: int) -> Column:
        sample = F.array_join(F.slice(F.sort_array(extra), 1, sample_size), ",")
        return fill_template(template, {"count": n_extra, "ratio": percent1(ratio), "sample": sample})

    return (
        F.when(is_blank(content), texts.BLANK_RISK_TEXT)
        .when(level == texts.LEVEL_UNKNOWN, texts.CODE_TEXTS[texts.NO_STANDARD])
        .when(level == texts.LEVEL_NONE, texts.NO_RISK_TEXT)
        .when(level == texts.LEVEL_LOW, told(texts.LOW_RISK_TEXT, texts.LOW_SAMPLE))
        .when(level == texts.LEVEL_MEDIUM, told(texts.MEDIUM_RISK_TEXT, texts.HIGHER_SAMPLE))
        .otherwise(told(texts.HIGH_RISK_TEXT, texts.HIGHER_SAMPLE))
    )


def level_score(level: Column) -> Column:
    score = F.lit(float(texts.OTHER_LEVEL_SCORE))
    for name, worth in texts.LEVEL_SCORES.items():
        score = F.when(level == name, float(worth)).otherwise(score)
    return score


def total_score(relevance: Column, completeness: Column, level: Column, rules: Rules) -> Column:
    """Weighted total. The third weight applies to the risk level."""
    return round2(
        relevance * F.lit(float(rules.weight_relevance))
        + completeness * F.lit(float(rules.weight_completeness))
        + level_score(level) * F.lit(float(rules.weight_compliance))
    )
