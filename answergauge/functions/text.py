"""Text columns: strip, number rendering, tokens, placeholders."""

from __future__ import annotations

import json
import operator
import re
from collections.abc import Mapping, Sequence
from functools import reduce
from string import Formatter
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from answergauge.rules import STOP_WORDS

# The 29 characters that count as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same characters as the inside of a regex class.
WS = (
    r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
HAN = r"\x{4e00}-\x{9fff}"
WORDLIKE = r"\p{L}\p{Nl}\p{No}"

# A whole run of non-white-space with two characters or more and at least one letter in it, in a text
# whose only white space is what Java's \s knows. Most words start with an ASCII letter and take the
# first branch, which tests one small class per character. The possessive quantifiers and the
# look-behind keep the search linear in the text.
SPACED_WORD = rf"(?<!\S)(?:[a-zA-Z]\S++|(?=\S\S)[^\s{WORDLIKE}]*+[{WORDLIKE}]\S*+)"

# The white space that \s does not know.
ODD_SPACE = (
    r"[\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# Odd white space that takes fewer than three bytes, and the range of all longer characters.
SHORT_ODD_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
SHORT_ODD_SPACE_NOT_ASCII = ("\x85", "\xa0")
LONG_CHARACTER = r"[\x{1680}-\x{10ffff}]"

# Han text: every overlapping pair of neighbouring characters.
HAN_PAIR = rf"(?=([{HAN}]{{2}}))"
# What separates the other words of a text that has Han characters: those and full-width punctuation.
HAN_BREAK = rf"[{HAN}\x{{3001}}-\x{{303f}}\x{{ff01}}-\x{{ff0f}}\x{{ff1a}}-\x{{ff20}}\x{{ff3b}}-\x{{ff40}}\x{{ff5b}}-\x{{ff65}}]+"


def strip(text: Column) -> Column:
    """Text without leading and trailing white space of all 29 kinds."""
    return F.trim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    """True for NULL and for text of nothing but white space."""
    return ~F.coalesce(text.rlike(f"[^{WS}]"), F.lit(False))


def fixed2(x: Column) -> Column:
    """Two decimals as text, rounding the binary value half to even."""
    return F.call_function("format_number", x, F.lit("0.00"))


def round2(x: Column) -> Column:
    """Two decimals as a double. ``F.round`` and ``F.bround`` round the decimal text of the
    number instead and differ on ties such as 2.675."""
    return fixed2(x).cast("double")


def plain_number(x: Column) -> Column:
    """A double as text with its shortest digits and at least one decimal, without an exponent below 1e16 (from
    there on, and below 0.0001, as Spark writes it)."""
    text = x.cast("string")
    whole = F.regexp_extract(text, r"^(-?)(\d)\.(\d+)E(\d+)$", 3)
    digits, power = F.length(whole), F.regexp_extract(text, r"E(\d+)$", 1).cast("int")
    sign_and_first = F.regexp_replace(text, r"^(-?\d)\..*$", "$1")
    fraction = F.when(digits > power, F.substr(whole, power + 1)).otherwise("0")
    body = F.rpad(F.substr(whole, F.lit(1), power), power, "0")
    plain = F.concat(sign_and_first, body, F.lit("."), fraction)
    return F.when(text.rlike(r"E\d") & (F.abs(x) < 1e16), plain).otherwise(text)


def percent1(ratio: Column) -> Column:
    """A ratio as a percentage with one decimal, e.g. 33.3%."""
    return F.call_function("format_number", ratio, F.lit("0.0%"))


def has_han(text: Column) -> Column:
    return text.rlike(f"[{HAN}]")


def _spaced_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SPACED_WORD), F.lit(0))


def han_tokens(text: Column, lexicon: Sequence[str] = ()) -> Column:
    """Distinct words of a text with Han characters, without stop words: the longest lexicon word at
    each place where a lexicon is given, and character pairs of all else; other scripts by white space."""
    if lexicon:
        longest_first = sorted({w for w in lexicon if w}, key=lambda w: (-len(w), w))
        words = "|".join(re.escape(w) for w in longest_first)
        found = F.regexp_extract_all(text, F.lit(f"{words}|[{HAN}]"), F.lit(0))
        found = F.filter(found, lambda w: (F.length(w) >= 2) & w.rlike(f"[{WORDLIKE}]"))
        # What stands between lexicon words is cut into pairs, so that unknown words count too.
        between = F.regexp_replace(text, words, " ")
        han = F.concat(found, F.regexp_extract_all(between, F.lit(HAN_PAIR), F.lit(1)))
    else:
        han = F.regexp_extract_all(text, F.lit(HAN_PAIR), F.lit(1))
    rest = _spaced_words(F.regexp_replace(F.regexp_replace(text, HAN_BREAK, " "), ODD_SPACE, " "))
    return F.array_except(F.concat(han, rest), literals(STOP_WORDS))


def needs_care(text: Column) -> Column:
    """True for texts that may have odd white space or Han characters. Byte searches and, outside of
    ASCII, one regex of a single range: much cheaper than the exact classes."""

    def has_any(chars: Sequence[str]) -> Column:
        return reduce(operator.or_, [F.contains(text, F.lit(c)) for c in chars])

    not_ascii = F.octet_length(text) != F.length(text)
    return (not_ascii & (text.rlike(LONG_CHARACTER) | has_any(SHORT_ODD_SPACE_NOT_ASCII))) | has_any(
        SHORT_ODD_SPACE
    )


def tokens(text: Column, lexicon: Sequence[str] = ()) -> Column:
    """The set of fact-bearing words of a text, as an array without repeats. NULL gives NULL.

    Stop words are Han words, so only the Han branch has any to remove."""
    return (
        F.when(~needs_care(text), F.array_distinct(_spaced_words(text)))
        .when(has_han(text), han_tokens(text, lexicon))
        .otherwise(F.array_distinct(_spaced_words(F.regexp_replace(text, ODD_SPACE, " "))))
    )


def literals(words: Sequence[str]) -> Column:
    """A constant array of strings, possibly empty. One JSON text instead of a literal per word keeps the
    building of a plan quick; the optimizer folds it into an array literal."""
    return F.from_json(F.lit(json.dumps(list(words))), "array<string>")


def fill_template(template: str, slots: Mapping[str, Any]) -> Column:
    """A ``{slot}`` template as one concatenation of columns and constants. The template is cut on the
    driver, so slot names inside the filled-in texts stay as they are."""
    pieces = []
    for literal, slot, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if slot is not None:
            if slot not in slots:
                raise ValueError(f"template slot {slot!r} is not one of {sorted(slots)}")
            value = slots[slot]
            pieces.append(value.cast("string") if isinstance(value, Column) else F.lit(str(value)))
    return F.concat(*pieces) if pieces else F.lit("")


def parse_json(text: Column) -> Column:
    """A JSON text as a variant, NULL unless all of it is one JSON value. The parser alone would take text
    after a value; inside a list and inside an object, no tail passes. The value is taken from the list."""
    in_list = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}")))
    return F.when(in_object.isNotNull(), F.try_variant_get(in_list, "$[0]", "variant"))


def fill_placeholders(text: Column, env: Mapping[str, str]) -> Column:
    """Replace ``${NAME}`` by its value in ``env``; unknown names stay. The text is cut into pieces
    first, so a value that looks like a placeholder is not expanded again."""
    if not env:
        return text
    known = F.create_map(*[F.lit(x) for name, value in env.items() for x in (f"${{{name}}}", value)])
    pieces = F.regexp_extract_all(text, F.lit(r"\$\{[\p{L}\p{N}_-]+\}|[^$]+|\$"), F.lit(0))
    filled = F.transform(pieces, lambda p: F.coalesce(F.try_element_at(known, p), p))
    return F.when(F.contains(text, F.lit("${")), F.array_join(filled, "")).otherwise(text)
