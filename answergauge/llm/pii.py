"""Personal data by anchor expansion.

An Aho-Corasick automaton runs once over each whole text and finds the anchors: at-signs, schemes and
identifier cues. Parsers expand each anchor to the left or right and check what they find. Digits, whose
anchors are the digits themselves, are found by linear patterns. Spans count code points, end exclusive.

Cases: a NULL or empty text has no spans; rows are independent, so repeated rows, NULL ids and ties need no
rule; long texts are read in one linear pass; other columns are passed through or ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answergauge.llm.common import give_back, in_slices, schema_of, ship_package

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("mailbox", "login", "iban", "ssn", "account", "secret")
KINDS = BASE_KINDS + ADDED_KINDS
SLICE_BYTES = 4 << 20

SPANS = "array<struct<kind:string,start:int,end:int>>"

# Anchors and what expands them. Words are looked for in a copy of the text whose letters A to Z are lower-cased.
AT_SIGNS = ("@", "(at)", "[at]")
SCHEMES = ("http://", "https://", "ftp://", "ssh://")
IBAN_CUES = ("iban",)
SSN_CUES = ("ssn", "social security")
SECRET_CUES = (
    "password", "passwort", "passwd", "pwd", "contraseña", "mot de passe", "secret", "token", "bearer",
    "api key", "api_key", "api-key", "apikey", "access key", "access_key", "access-key", "private_key", "auth_key",
)
KEY_BEGINNINGS = ("akia", "asia", "sk_live_", "sk_test_", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xox", "aiza", "-----begin")
ACCOUNT_CUES = ("account", "acct", "passport", "konto", "compte", "cuenta")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive: every pattern is linear in the text, and each gives what the greedy one would.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

WIDE_DOMAIN = re.compile(r"(?:[^\W_]|-)++(?:\.(?:[^\W_]|-)++)++")
LOGIN = re.compile(r"[^\s/@:?#\"'<>]++:[^\s/@?#\"'<>]++@[A-Za-z0-9.-]++")
IBAN = re.compile(r"[^0-9\n]{0,24}?([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
SSN = re.compile(r"[^0-9\n]{0,24}?([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
# The value of a secret: in quotes, or with a digit in it.
SECRET = re.compile(r"[\"'\])]?\s{0,3}(?:[:=]=?>?|\bis\b)\s{0,3}(?:([\"'])([^\s\"']{6,}+)\1|([^\s\"'<>,;]{8,}+))")
BEARER = re.compile(r"\s++([A-Za-z0-9._~+/-]{16,}+=*+)")
# How keys of some services are formed.
KEY = re.compile(
    r"A[KS]IA[0-9A-Z]{16}(?![0-9A-Za-z])|sk_(?:live|test)_[0-9A-Za-z]{16,}+|gh[pos]_[0-9A-Za-z]{36}(?![0-9A-Za-z])"
    r"|github_pat_[0-9A-Za-z_]{22,}+|glpat-[0-9A-Za-z_-]{20,}+|xox[abprs]-[0-9A-Za-z-]{10,}+|AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"
)
PEM_BEGIN = re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----")
PEM_END = re.compile(r"-----END [A-Z ]{0,30}PRIVATE KEY-----")
ACCOUNT = re.compile(r"(?: ?(?:number|no\.?|nr\.?|id|#))?[\s:#=]{1,4}([0-9](?:[ -]?[0-9]){6,17})(?![0-9])", re.I)


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for role, words in (
        ("at", AT_SIGNS),
        ("scheme", SCHEMES),
        ("iban", IBAN_CUES),
        ("ssn", SSN_CUES),
        ("account", ACCOUNT_CUES),
        ("secret", SECRET_CUES),
        ("key", KEY_BEGINNINGS),
    ):
        for word in words:
            found.add_word(word, (role, len(word)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _iban_end(text: str, start: int, end: int) -> int | None:
    """The end of the longest valid number that begins at ``start``."""
    while end > start:
        bare = text[start:end].replace(" ", "")
        if len(bare) < 15:
            return None
        if len(bare) <= 34 and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1:
            return end
        end -= 1
        while text[end - 1] == " ":
            end -= 1
    return None


def _secret(text: str, after: int, cue: str) -> tuple[tuple[int, int] | None, int]:
    """The value that follows a cue such as ``token =``, and how far the text was read. A mere mention has none."""
    if cue == "bearer":
        m = BEARER.match(text, after)
        return (m.span(1) if m and any("0" <= c <= "9" for c in m[1]) else None), (m.end() if m else after)
    m = SECRET.match(text, after)
    if m is None:
        return None, after
    if m[1]:
        return m.span(2), m.end()
    value = m[3].rstrip(".)]}!?")
    plausible = len(value) >= 8 and any("0" <= c <= "9" for c in value)
    return ((m.start(3), m.start(3) + len(value)) if plausible else None), m.end()


def _key(text: str, begin: int, closings: list[int]) -> tuple[int, int] | None:
    """A key that begins at ``begin``, or a private key in armour with all its lines; ``closings`` is where armour ends."""
    if begin and text[begin - 1].isalnum():
        return None
    if m := KEY.match(text, begin):
        return m.span()
    if m := PEM_BEGIN.match(text, begin):
        at = bisect_right(closings, m.end())
        return begin, closings[at] if at < len(closings) else m.end()
    return None


def _local_start(text: str, at: int, least: int, fits) -> int:
    start = at
    while start > least and fits(text[start - 1]):
        start -= 1
    return start


def spans_of(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text, by kind as in ``KINDS``, then by start."""
    if not text:
        return []
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    email_end = 0
    low = text if text.islower() and text.isascii() else text.encode("utf-8", "replace").lower().decode()
    read_to = armour_end = 0
    closings = [m.end() for m in PEM_END.finditer(text)] if "-----END" in text else []
    for last, (role, width) in _automaton().iter(low):
        begin, after = last + 1 - width, last + 1
        if role == "at":
            email = None
            if width == 1 and begin >= email_end:
                start = _local_start(text, begin, email_end, LOCAL.__contains__)
                tail = DOMAIN.match(text, after) if start < begin else None
                if tail:
                    email, email_end = (start, tail.end()), tail.end()
                    found["email"].append(email)
            # Marked-up at-signs, with blanks around them, and names beyond ASCII, which the plain form does not cover.
            if width > 1:
                while begin and text[begin - 1] == " ":
                    begin -= 1
                while text.startswith(" ", after):
                    after += 1
            start = _local_start(text, begin, 0, lambda c: c.isalnum() or c in "._%+-")
            tail = WIDE_DOMAIN.match(text, after) if start < begin else None
            if tail and text[start:begin].strip("._%+-") and tail.group().rpartition(".")[2].isalpha():
                if email is None or start < email[0] or tail.end() > email[1]:
                    found["mailbox"].append((start, tail.end()))
        elif role == "scheme":
            if m := LOGIN.match(text, after):
                found["login"].append((after, m.end()))
        elif role == "iban":
            if (m := IBAN.match(text, after)) and (end := _iban_end(text, m.start(1), m.end(1))):
                found["iban"].append((m.start(1), end))
        elif role == "ssn":
            m = SSN.match(text, after)
            if m and m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
                found["ssn"].append((m.start(1), m.end()))
        elif role == "secret":
            if begin >= read_to:  # what follows a cue inside a value is part of that value, or as little a secret
                value, read_to = _secret(text, after, low[begin:after])
                if value:
                    found["secret"].append(value)
        elif role == "key":
            if begin >= armour_end and (value := _key(text, begin, closings)):
                found["secret"].append(value)
                armour_end = value[1]
        elif m := ACCOUNT.match(text, after):
            found["account"].append(m.span(1))
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m.group().split("."))):
            found["ip"].append(m.span())
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found["card"].append(m.span())
    for m in PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            found["phone"].append(m.span())
    return [(kind, s, e) for kind in KINDS for s, e in sorted(set(found[kind]))]


def redacted(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each run of overlapping spans replaced by the kind of its first, longest span."""
    if not spans:
        return text
    parts, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            parts += [text[done:start], f"[{kind.upper()}]"]
        elif end > done:
            pass  # the rest of an overlapping span goes too
        done = max(done, end)
    return "".join(parts) + text[done:]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and ``spans``, all personal data of the whole text."""
    ship_package(docs.sparkSession)
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_slices(batches, "text", SLICE_BYTES):
            rows = [
                [{"kind": k, "start": s, "end": e} for k, s, e in spans_of(text)]
                for text in part.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(rows, kind)], names=["id", "spans"])
            part = rows = None
        give_back()

    out = f"id {docs.schema[id_col].dataType.simpleString()}, spans {SPANS}"
    return chosen.mapInArrow(run, out).select(F.col("id").alias(id_col), "spans")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns, with the personal data in the text replaced by names of kinds in brackets."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_slices(batches, text_col, SLICE_BYTES):
            texts = [redacted(t, spans_of(t)) for t in part.column(text_col).to_pylist()]
            at = part.schema.get_field_index(text_col)
            yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))
            part = texts = None
        give_back()

    return docs.mapInArrow(run, schema_of(docs))


def digest(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of the spans of these kinds, comma-joined, in the order in which they stand."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(
        F.transform(
            chosen,
            lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")),
        ),
        ",",
    )
