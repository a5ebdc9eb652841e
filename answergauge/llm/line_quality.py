"""Quality rules, line first: failing lines are removed, then documents that lose too much text are rejected.

Only DataFrame functions, row-local: no shuffle. Cases: a NULL text counts as one without words; an empty
text has no words and fails; lines without a word count for nothing; rows are judged alone, so repeated rows and
NULL ids need no rule; work is n log n in the words of a text at most; an empty table gives no rows; other
columns are kept by ``with_clean_text`` and ignored by ``measures``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answergauge.llm.common import WORD, let

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
MOST_LOST_PERCENT = 50
SYMBOLS = r"[#*$%&|<>]"

# Phrases of lines that say nothing of a document's subject, in lower case. Notices ...
NOTICES = (
    "accept cookies",
    "all rights reserved",
    "enable javascript",
    "licensed under",
    "privacy policy",
    "released under the",
    "terms of service",
    "terms of use",
    "uses cookies",
    "alle rechte vorbehalten",
    "cookies akzeptieren",
    "datenschutzerklärung",
    "javascript aktivieren",
    "nutzungsbedingungen",
    "verwendet cookies",
    "accepter les cookies",
    "conditions d'utilisation",
    "mentions légales",
    "politique de confidentialité",
    "tous droits réservés",
    "utilise des cookies",
    "aceptar cookies",
    "aviso legal",
    "condiciones de uso",
    "política de privacidad",
    "todos los derechos reservados",
    "utiliza cookies",
)
# ... and invitations, which sentences also use: they count in shorter lines only.
INVITATIONS = (
    "click here",
    "log in",
    "newsletter",
    "sign up",
    "hier klicken",
    "jetzt anmelden",
    "cliquez ici",
    "se connecter",
    "haga clic aquí",
    "iniciar sesión",
)
# A line is boilerplate if it has at most so many words for each of its phrases.
WORDS_PER_NOTICE = 15
WORDS_PER_INVITATION = 6
# A sentence's end in any script, also before closing quotes and brackets.
ENDING = r"[.!?…:;։؛؟۔।॥།။።។。！？：；｡][\"'”’»›)\]」』）】〉》]*[\x20\x09-\x0D]*$"
# Counted rather than matched as repeated groups, for which Java's regex engine would recurse in long lines.
SEPARATORS = r"[|>»•·]"
LEAST_SEPARATORS = 3
WORDS_PER_SEPARATOR = 4
SHOUTS = r"!!+"
LEAST_SHOUTS = 3
UNENDED_WORDS = 8
UNENDED_CHARS = 80  # scripts without blanks write long lines of few words


def phrases(of: tuple[str, ...]) -> str:
    """A pattern for the phrases as whole words. Two phrases with one character between them count once."""
    return rf"(?:^|[^\p{{L}}\p{{N}}])(?:{'|'.join(of)})(?:$|[^\p{{L}}\p{{N}}])"


def _windows(words: Column, of: Callable[[Column, Column], Column]) -> Column:
    """``of`` of each window of ``WINDOW`` words and its position from 1."""
    last = F.size(words) - (WINDOW - 1)
    positions = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(positions, lambda i: of(F.slice(words, i, WINDOW), i))


def _covered(words: Column) -> Column:
    """How many words lie in a window that occurs twice or more. Windows are told apart by 96 bits of hash."""

    def same(a: Column, b: Column) -> Column:
        return F.coalesce((a["a"] == b["a"]) & (a["b"] == b["b"]), F.lit(False))

    ordered = F.sort_array(
        _windows(words, lambda w, i: F.struct(F.xxhash64(w).alias("a"), F.hash(w).alias("b"), i.alias("i")))
    )
    repeated = let(
        ordered,
        lambda s: F.sort_array(
            F.filter(
                F.transform(
                    s, lambda x, at: F.when(same(x, F.get(s, at - 1)) | same(x, F.get(s, at + 1)), x["i"])
                ),
                lambda i: i.isNotNull(),
            )
        ),
    )
    widths = let(
        repeated,
        lambda p: F.transform(p, lambda i, at: F.least(F.lit(WINDOW), F.coalesce(F.get(p, at + 1) - i, F.lit(WINDOW)))),
    )
    return F.aggregate(widths, F.lit(0), lambda total, x: total + x)


def _of_words(text: Column) -> Column:
    def measured(words: Column) -> Column:
        hashes = _windows(words, lambda w, _: F.xxhash64(w))
        repeats = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.when(repeats, _covered(words)).otherwise(0).cast("long").alias("n_repeat_words"),
        )

    return let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), measured)


def fails(line: Column) -> Column:
    """Whether a line breaks a rule of punctuation, navigation or boilerplate."""

    def says(low: Column, words: Column, of: tuple[str, ...], per_phrase: int) -> Column:
        # A search by bytes first, since few lines hold a phrase at all.
        held = reduce(lambda a, b: a | b, [low.contains(p) for p in of])
        found = F.regexp_count(low, F.lit(phrases(of)))
        return held & let(found, lambda n: (n > 0) & (words <= n * per_phrase))

    def rules(low: Column, words: Column) -> Column:
        unended = (words < UNENDED_WORDS) & (F.length(low) < UNENDED_CHARS) & ~low.rlike(ENDING)
        symbols = F.regexp_count(low, F.lit(SYMBOLS)) * 2 > words
        separators, shouts = F.regexp_count(low, F.lit(SEPARATORS)), F.regexp_count(low, F.lit(SHOUTS))
        navigation = (separators >= LEAST_SEPARATORS) & (words <= separators * WORDS_PER_SEPARATOR)
        shouting = (shouts >= LEAST_SHOUTS) & (shouts * 2 > words)
        boilerplate = says(low, words, NOTICES, WORDS_PER_NOTICE) | says(low, words, INVITATIONS, WORDS_PER_INVITATION)
        return unended | boilerplate | symbols | navigation | shouting

    return let(F.lower(line), lambda low: let(F.regexp_count(low, F.lit(WORD)), lambda words: rules(low, words)))


def _of_lines(text: Column) -> Column:
    has_word = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def measured(lines: Column) -> Column:
        kept = F.filter(lines, lambda line: ~fails(line))
        return let(
            kept,
            lambda k: F.struct(
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                (F.size(lines) - F.size(k)).cast("long").alias("n_failed_lines"),
                F.length(F.array_join(lines, "")).cast("long").alias("chars"),
                F.length(F.array_join(k, "")).cast("long").alias("kept_chars"),
                F.array_join(k, "\n").alias("clean_text"),
            ),
        )

    return let(has_word, measured)


def with_clean_text(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns and a struct ``quality``: the base figures, ``base_failed``, the text of the lines that
    hold (``clean_text``) and ``kept``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words, lines = F.col("quality._words"), F.col("quality._lines")
    base_failed = (words["n_words"] < LEAST_WORDS) | (
        100 * words["n_repeat_words"] > MOST_REPEATED_PERCENT * words["n_words"]
    )
    holds = 100 * (lines["chars"] - lines["kept_chars"]) <= MOST_LOST_PERCENT * lines["chars"]
    symbols = F.regexp_count(text, F.lit(SYMBOLS)).cast("long")
    measured = docs.withColumn(
        "quality", F.struct(_of_words(text).alias("_words"), _of_lines(text).alias("_lines"), symbols.alias("_symbols"))
    )
    return measured.withColumn(
        "quality",
        F.struct(
            words["n_words"].alias("n_words"),
            words["word_chars"].alias("word_chars"),
            F.col("quality._symbols").alias("n_symbols"),
            lines["n_dup_lines"].alias("n_dup_lines"),
            words["n_repeat_words"].alias("n_repeat_words"),
            lines["n_failed_lines"].alias("n_failed_lines"),
            base_failed.alias("base_failed"),
            (~base_failed & holds).alias("kept"),
            lines["clean_text"].alias("clean_text"),
        ),
    )


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and all figures, without the texts."""
    judged = with_clean_text(docs.select(id_col, text_col), text_col)
    fields = [f for f in judged.schema["quality"].dataType.names if f != "clean_text"]
    return judged.select(id_col, *[f"quality.{f}" for f in fields])
