"""Chat formatting: records of many layouts become canonical turns, and turns become training text with a loss mask.

A record is one JSON object. Its nested field paths are hashed; the hash (the schema's fingerprint) selects a declarative
mapping, which says where the turns of that layout stand. Fields that no layout knows are left out of the hash, so
records may carry anything besides. A conversation is one or more records, in the order of a column. Each turn is marked
by a template whose control strings are escaped inside texts, so that the formatted text can be read back exactly; the
loss mask is a list of spans, one per text of the assistant.

Formatting is row-local. Only the reader, which gives digests of whole conversations, deals rows out by conversation,
sorts them, and hashes them as a stream: a conversation that holds a third of all rows is never in memory whole.

Cases: a NULL or empty text is an empty turn; a NULL role is an empty one; rows of NULL ids are one conversation with the
id NULL; a NULL place sorts first; turns that stand at one place go by their formatted text, and repeated rows count as
often as they stand; records that are no JSON object, or of an unknown layout, give one row without a layout and no turn; an
empty table gives no rows; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answergauge.llm.common import in_slices, ship_package

SLICE_BYTES = 4 << 20
Path = tuple  # keys from the outermost in; EACH stands for the items of a list
EACH = 0


@dataclass(frozen=True)
class Messages:
    """A list with a turn per item."""

    at: Path
    role: str
    text: str

    def shapes(self) -> Iterator[frozenset[Path]]:
        items = self.at + (EACH,)
        for some in _subsets([items + (self.role,), items + (self.text,)]):
            yield frozenset([items]) | some

    def turns(self, record: dict) -> Iterator[tuple]:
        items = _at(record, self.at)
        for item in items if isinstance(items, list) else ():
            item = item if isinstance(item, dict) else {}
            yield item.get(self.role), item.get(self.text)


@dataclass(frozen=True)
class Fields:
    """One turn, of the fields that are there, with a blank line between them."""

    role: str
    fields: tuple[Path, ...]

    def shapes(self) -> Iterator[frozenset[Path]]:
        return (s for s in _subsets(self.fields) if s)

    def turns(self, record: dict) -> Iterator[tuple]:
        found = [_at(record, path) for path in self.fields]
        if any(value is not _ABSENT for value in found):
            yield self.role, "\n\n".join(_text(v) for v in found if v is not _ABSENT and v not in (None, ""))


@dataclass(frozen=True)
class Named:
    """One turn whose role stands in the record."""

    role: Path
    text: Path

    def shapes(self) -> Iterator[frozenset[Path]]:
        yield frozenset([self.role, self.text])
        yield frozenset([self.role])

    def turns(self, record: dict) -> Iterator[tuple]:
        if _at(record, self.role) is not _ABSENT:
            text = _at(record, self.text)
            yield _at(record, self.role), None if text is _ABSENT else text


@dataclass(frozen=True)
class Layout:
    """Where the turns of a record stand, in their order, and which roles have other names there."""

    name: str
    parts: tuple
    roles: tuple[tuple[str, str], ...] = ()

    def shapes(self) -> Iterator[frozenset[Path]]:
        """Every set of field paths that a record of this layout can have: any of its parts, but at least one."""
        for chosen in itertools.product(*[[frozenset(), *part.shapes()] for part in self.parts]):
            if any(chosen):
                yield frozenset().union(*chosen)

    def turns(self, record: dict) -> list[tuple[str, str]]:
        names = dict(self.roles)
        found = [(_text(role), _text(text)) for part in self.parts for role, text in part.turns(record)]
        return [(names.get(role, role), text) for role, text in found]


def _fields(role: str, *names: str) -> Fields:
    return Fields(role, tuple((n,) for n in names))


LAYOUTS = (
    Layout("turn", (Named(("role",), ("text",)),)),
    Layout("messages", (_fields("system", "system"), Messages(("messages",), "role", "content"))),
    Layout(
        "conversations",
        (_fields("system", "system"), Messages(("conversations",), "from", "value")),
        (("human", "user"), ("gpt", "assistant")),
    ),
    Layout("prompt", (_fields("system", "system"), _fields("user", "prompt"), _fields("assistant", "completion"))),
    Layout("prompt and response", (_fields("user", "prompt"), _fields("assistant", "response"))),
    Layout(
        "instruction",
        (_fields("system", "system"), _fields("user", "instruction", "input"), _fields("assistant", "output")),
    ),
    Layout("question", (_fields("user", "context", "question"), _fields("assistant", "answer"))),
    Layout(
        "call log",
        (
            Messages(("request", "messages"), "role", "content"),
            Fields("assistant", (("reply", "message", "content"),)),
        ),
    ),
)

_ABSENT = object()


def _subsets(paths: Iterable[Path]) -> list[frozenset[Path]]:
    return [frozenset(p for p, keep in zip(paths, kept) if keep) for kept in itertools.product((True, False), repeat=len(paths))]


def _at(record, path: Path):
    for key in path:
        if not isinstance(record, dict) or key not in record:
            return _ABSENT
        record = record[key]
    return record


def _text(value) -> str:
    if value is None:
        return ""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def field_paths(value, at: Path = ()) -> set[Path]:
    """The paths of all leaves and lists of a JSON value."""
    if isinstance(value, dict):
        return set().union(*[field_paths(v, at + (k,)) for k, v in value.items()])
    if isinstance(value, list):
        return {at + (EACH,)}.union(*[field_paths(v, at + (EACH,)) for v in value])
    return {at}


def fingerprint(paths: Iterable[Path]) -> int:
    """A signed 64-bit hash of a set of field paths."""
    listed = json.dumps(sorted(paths, key=json.dumps)).encode()
    return int.from_bytes(hashlib.blake2b(listed, digest_size=8).digest(), "little", signed=True)


class Mappings:
    """The mappings by fingerprint. Of two layouts that share a shape the earlier one holds."""

    def __init__(self, layouts: tuple[Layout, ...]):
        shapes = [(shape, layout) for layout in layouts for shape in layout.shapes()]
        self.known = frozenset().union(*[shape for shape, _ in shapes])
        self.by_print: dict[int, Layout] = {}
        for shape, layout in shapes:
            self.by_print.setdefault(fingerprint(shape), layout)
        self.prints: dict[frozenset[Path], int] = {}

    def of(self, text: str | None) -> tuple[int, str | None, list[tuple[str, str]]]:
        """Fingerprint, layout and turns of a record."""
        try:
            record = json.loads(text) if text else None
            shape = frozenset(field_paths(record) & self.known)
        except (ValueError, RecursionError):  # no JSON, or nested beyond reason
            record, shape = None, frozenset()
        if shape not in self.prints:
            self.prints[shape] = fingerprint(shape)
        layout = self.by_print.get(self.prints[shape])
        return self.prints[shape], layout and layout.name, layout.turns(record) if layout else []


def turns_of(
    records: DataFrame,
    id_col: str = "conv_id",
    order_col: str = "turn",
    record_col: str = "record",
    layouts: tuple[Layout, ...] = LAYOUTS,
) -> DataFrame:
    """A row per turn: the record's id and place, ``item`` (place in the record), role and text, ``layout`` and
    ``fingerprint``. A record of an unknown layout gives one row whose layout and turn are NULL."""
    ship_package(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mappings = Mappings(layouts)
        for part in in_slices(batches, "record", SLICE_BYTES):
            rows, turns = [], []
            for row, text in enumerate(part.column("record").to_pylist()):
                mark, name, found = mappings.of(text)
                for item, (role, said) in enumerate(found):
                    turns.append((item, role, said, name, mark))
                if not found:
                    turns.append((0, None, None, name, mark))
                rows += [row] * max(1, len(found))
            taken = pa.array(rows, pa.int64())
            kinds = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip(list(zip(*turns)) or [()] * len(kinds), kinds)]
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(taken), part.column("place").take(taken), *columns],
                names=["id", "place", "item", "role", "text", "layout", "fingerprint"],
            )

    chosen = records.select(
        F.col(id_col).alias("id"), F.col(order_col).alias("place"), F.col(record_col).cast("string").alias("record")
    )
    kinds = [chosen.schema[c].dataType.simpleString() for c in ("id", "place")]
    out = f"id {kinds[0]}, place {kinds[1]}, item int, role string, text string, layout string, fingerprint long"
    return chosen.mapInArrow(run, out).withColumnsRenamed({"id": id_col, "place": order_col})


@dataclass(frozen=True)
class Template:
    """``opening`` role ``named`` text ``closing``. The control strings are those that open and close a turn; inside
    a text each gets one more backslash before it than it had."""

    opening: str = "### "
    named: str = ":\n"
    closing: str = "\n</turn>\n"

    @property
    def controls(self) -> tuple[str, str]:
        return self.opening, self.closing.strip()

    def escape(self, text: Column) -> Column:
        for control in self.controls:
            text = F.replace(text, F.lit(control), F.lit("\\" + control))
        return text

    def escape_role(self, role: Column) -> Column:
        """Roles stand on one line."""
        return F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))

    def unescape(self, text: str) -> str:
        for control in self.controls:
            text = text.replace("\\" + control, control)
        return text

    def unescape_role(self, role: str) -> str:
        return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)

    def parse(self, text: str) -> Iterator[tuple[str, int, int]]:
        """Role, start and end of the (escaped) text of each turn of a formatted text."""
        at = 0
        while at < len(text):
            if not text.startswith(self.opening, at):
                raise ValueError(f"no turn begins at {at}")
            colon = text.index(self.named, at)
            start = colon + len(self.named)
            end = text.index(self.closing, start)
            yield self.unescape_role(text[at + len(self.opening) : colon]), start, end
            at = end + len(self.closing)


TEMPLATE = Template()


def format_turns(
    turns: DataFrame, template: Template = TEMPLATE, learnt_roles: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """Adds to rows of ``turns_of`` the ``formatted`` text of the turn and ``loss``, the spans of it (code points,
    end exclusive) that are learnt. A conversation's text is that of its turns, one after the other. Rows without a
    turn go."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(template.opening), template.escape_role(role), F.lit(template.named))
    spans = F.struct(F.length("_head").alias("start"), (F.length("_head") + F.length("_body")).alias("end"))
    nothing = F.array().cast("array<struct<start: int, end: int>>")
    return (
        turns.where(F.col("role").isNotNull())
        .withColumns({"_head": head, "_body": template.escape(text)})
        .withColumns(
            {
                "formatted": F.concat("_head", "_body", F.lit(template.closing)),
                "loss": F.when(role.isin(*learnt_roles), F.array(spans)).otherwise(nothing),
            }
        )
        .drop("_head", "_body")
    )


class _Digest:
    """What is read back of one conversation, turn by turn."""

    def __init__(self, template: Template):
        self.template = template
        self.turns = self.loss_chars = self.formatted_chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, loss: list[dict]) -> None:
        for role, start, end in self.template.parse(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{self.template.unescape(formatted[start:end])}\n".encode())
        for span in loss:
            learnt = self.template.unescape(formatted[span["start"] : span["end"]])
            self.loss.update(learnt.encode())
            self.loss_chars += len(learnt)
        self.formatted_chars += len(formatted)

    def row(self) -> tuple:
        return self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


def read_back(
    formatted: DataFrame, template: Template = TEMPLATE, id_col: str = "conv_id", order_col: str = "turn"
) -> DataFrame:
    """Per conversation, from its formatted text and loss mask alone: ``n_turns``, ``turns_sha256``, ``loss_chars``,
    ``loss_sha256``, ``formatted_chars``."""
    ship_package(formatted.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        current, digest, id_kind = None, None, None

        def made(done: list) -> pa.RecordBatch:
            ids, rows = [i for i, _ in done], list(zip(*[d.row() for _, d in done])) or [()] * len(kinds)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, id_kind), *[pa.array(c, k) for c, k in zip(rows, kinds)]], names=names
            )

        for part in in_slices(batches, "formatted", SLICE_BYTES):
            id_kind, done = part.column("id").type, []
            columns = (part.column(c).to_pylist() for c in ("id", "formatted", "loss"))
            for key, text, loss in zip(*columns):
                if digest is None or key != current:
                    if digest is not None:
                        done.append((current, digest))
                    current, digest = key, _Digest(template)
                digest.add(text, loss)
            yield made(done)
        if digest is not None:
            yield made([(current, digest)])

    rows = formatted.select(F.col(id_col).alias("id"), F.col(order_col).alias("place"), "item", "formatted", "loss")
    dealt = rows.repartition("id").sortWithinPartitions("id", "place", "item", "formatted")
    kind = rows.schema["id"].dataType.simpleString()
    out = f"id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return dealt.select("id", "formatted", "loss").mapInArrow(run, out).withColumnRenamed("id", id_col)
