"""Chat formatting: records of several layouts become turns, and turns become one marked text.

Layouts are declared, not coded. The field paths of a record that carry a value
(``messages[].role``, ``instruction``), sorted and hashed, are its fingerprint. A
declared layout has a fingerprint for each set of fields that it allows; looking up
a record's fingerprint names the layout whose mapping reads its turns. Paths that
no layout mentions (ids, sources, scores) are left out of the fingerprint.

A turn is written as ``### role: text</turn>`` and a newline. A backslash is put
before every backslash, ``###`` and ``</turn>`` of a text, so that no text can end a
turn or begin one, and the text comes back exactly. The loss mask covers the texts
of the assistant.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import chain, combinations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

TURN = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """Where a layout keeps its turns.

    ``turns`` lists (role, path) with one turn for each path that the record has; a
    path of several fields, joined by ``+``, is one turn with a blank line between them.
    ``each`` names an array instead, whose elements have the role at one path and the
    text at another. ``optional`` paths may be absent. ``roles`` renames roles.
    """

    name: str
    turns: tuple[tuple[str, str], ...] = ()
    each: tuple[str, str, str] | None = None
    optional: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict)

    def paths(self) -> tuple[str, ...]:
        own = [p for _, path in self.turns for p in path.split("+")]
        if self.each is not None:
            array, role, text = self.each
            inside = f"{array}[]." if array else ""  # without a name, the record itself is the one element
            own += [inside + role, inside + text]
        return tuple(dict.fromkeys(own))

    def shapes(self) -> Iterator[frozenset[str]]:
        """Every set of paths that a record of this layout may have."""
        always = frozenset(self.paths()) - frozenset(self.optional)
        for some in chain.from_iterable(combinations(self.optional, k) for k in range(len(self.optional) + 1)):
            yield always | frozenset(some)


# Public layouts of instruction data. The first layout with a fingerprint has it.
SHORT_ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
LAYOUTS = (
    Layout("row", each=("", "role", "text"), optional=("text",)),
    Layout("messages", turns=(("system", "system"),), each=("messages", "role", "content"), optional=("system", "messages[].content"), roles=SHORT_ROLES),
    Layout("conversations", turns=(("system", "system"),), each=("conversations", "from", "value"), optional=("system", "conversations[].value"), roles=SHORT_ROLES),
    Layout("instruction", turns=(("system", "system"), ("user", "instruction+input"), ("assistant", "output")), optional=("system", "input", "output")),
    Layout("prompt_completion", turns=(("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system", "completion")),
    Layout("prompt_response", turns=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Layout("question_answer", turns=(("system", "system"), ("user", "question"), ("assistant", "answer")), optional=("system", "answer")),
)


def fingerprint(paths: frozenset[str]) -> int:
    """63-bit hash of a set of field paths."""
    return xxhash.xxh3_64_intdigest("\n".join(sorted(paths)).encode()) >> 1


class LayoutTable:
    """The declared layouts by fingerprint, and the reading of a record."""

    def __init__(self, layouts: Sequence[Layout]):
        self.layouts: dict[int, Layout] = {}
        for layout in layouts:
            for shape in layout.shapes():
                self.layouts.setdefault(fingerprint(shape), layout)
        self.known = {p for layout in layouts for p in layout.paths()}

    def paths(self, value: object) -> frozenset[str]:
        """Field paths with a value; array elements share the path of their array and ``[]``."""
        found: set[str] = set()
        todo = [("", value)]
        while todo:
            path, own = todo.pop()
            if isinstance(own, dict):
                todo += [(f"{path}.{k}" if path else k, v) for k, v in own.items()]
            elif isinstance(own, list):
                todo += [(f"{path}[]", v) for v in own]
            elif own is not None:
                found.add(path)
        return frozenset(found & self.known)

    def read(self, value: object) -> tuple[int, str | None, list[dict] | None]:
        """Fingerprint, layout name and turns of a parsed record; no name and no turns for an unknown layout."""
        mark = fingerprint(self.paths(value))
        layout = self.layouts.get(mark)
        if layout is None or not isinstance(value, dict):
            return mark, None, None
        turns = []
        for role, path in layout.turns:
            parts = [_text(v) for p in path.split("+") if (v := _at(value, p)) is not None]
            if parts:
                turns.append({"role": role, "text": "\n\n".join(x for x in parts if x)})
        if layout.each is not None:
            array, role, text = layout.each
            rows = _at(value, array) if array else [value]
            for row in rows if isinstance(rows, list) else []:
                own = row if isinstance(row, dict) else {}
                name = _text(_at(own, role))
                turns.append({"role": layout.roles.get(name, name), "text": _text(_at(own, text))})
        return mark, layout.name, turns


def _at(value: object, path: str) -> object:
    for key in path.split("."):
        value = value.get(key) if isinstance(value, dict) else None
    return value


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def canonical_turns(records: DataFrame, id_col: str = "id", record_col: str = "record", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """(id, fingerprint, layout, turns) for every record; ``turns`` is an array of (role, text).

    A record is a JSON object as text, or any nested column (struct, map, variant),
    which is read as its JSON. A field that is null counts as absent, an empty array
    too. An array element without role or text has the empty role or text, where others
    of the array have one. An unknown layout, a text that is no JSON object, and a null
    record have layout and turns null, and keep their row; fingerprint is null where
    there is no JSON. Rows with equal ids each keep their row.
    """
    record = F.col(record_col)
    if not isinstance(records.schema[record_col].dataType, StringType):
        record = F.to_json(record)
    rows = records.select(F.col(id_col).alias("id"), record.alias("record"))
    table = LayoutTable(layouts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 1024):
                part = batch.slice(start, 1024)
                found = [table.read(value) if known else (None, None, None) for known, value in map(_parsed, part.column(1).to_pylist())]
                mark, name, turns = zip(*found)
                kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(mark, pa.int64()), pa.array(name, pa.string()), pa.array(turns, kind)],
                    names=["id", "fingerprint", "layout", "turns"],
                )

    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {id_type}, fingerprint bigint, layout string, turns {TURN}")


def _parsed(record: str | None) -> tuple[bool, object]:
    """Whether a record is JSON, and its value."""
    if record is None:
        return False, None
    try:
        return True, json.loads(record, parse_constant=str)
    except (ValueError, RecursionError):
        return False, None


HEAD, TAIL = "###", "</turn>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\|###|</turn>)", r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\|###|</turn>)", "$1")


def formatted_turns(turns: DataFrame, role_col: str = "role", text_col: str = "text", loss_roles: Sequence[str] = ("assistant",)) -> DataFrame:
    """``turns`` with piece, loss_start and loss_stop: what each turn adds to its conversation's text.

    Pieces of a conversation, one after the other, are its formatted text. The loss mask
    of a piece goes from loss_start to loss_stop (code points in the piece, end exclusive;
    both null for roles without loss). A null text or role is empty. A role may hold any
    characters: in it, colons and newlines are escaped too.
    """
    role = F.coalesce(F.col(role_col), F.lit(""))
    head = F.concat(F.lit(f"{HEAD} "), F.regexp_replace(role, r"(\\|###|</turn>|:|\n)", r"\\$1"), F.lit(": "))
    text = escaped(F.coalesce(F.col(text_col), F.lit("")))
    own = role.isin(list(loss_roles))
    start = F.length(head).cast("bigint")
    return turns.withColumns(
        {
            "piece": F.concat(head, text, F.lit(f"{TAIL}\n")),
            "loss_start": F.when(own, start),
            "loss_stop": F.when(own, start + F.length(text)),
        }
    )


# The head of a piece: the role goes up to the first colon that is not escaped.
_ROLE = r"(?s)^### ((?:[^\\:]++|\\.)*+): "


def read_turns(pieces: DataFrame, piece_col: str = "piece") -> DataFrame:
    """``pieces`` with role_read, text_read, null where a piece is no formatted turn."""
    piece = F.col(piece_col)
    role = F.regexp_extract(piece, _ROLE, 1)
    good = F.regexp_like(piece, F.lit(_ROLE)) & piece.endswith(f"{TAIL}\n")
    before = F.length(role) + F.lit(len(HEAD) + 3)
    text = F.substr(piece, before + F.lit(1), F.length(piece) - before - F.lit(len(TAIL) + 1))
    return pieces.withColumns(
        {
            "role_read": F.when(good, F.regexp_replace(role, r"\\(\\|###|</turn>|:|\n)", "$1")),
            "text_read": F.when(good, unescaped(text)),
        }
    )


def conversation_digests(pieces: DataFrame, id_col: str, order: Sequence[str]) -> DataFrame:
    """One row for each conversation, read back from its pieces alone.

    ``pieces`` has piece, loss_start and loss_stop. Returned: id, n_turns, turns_sha256 (of
    role, newline, text, newline of every turn), loss_chars and loss_sha256 (of the text
    under the mask, unescaped), formatted_chars. A conversation's pieces are sorted within
    one task and hashed as they come, so its length is not bounded by memory. Pieces of a
    null id are one conversation. Ties in ``order`` go by the piece.
    """
    masked = unescaped(F.substr(F.col("piece"), (F.col("loss_start") + 1).cast("int"), (F.col("loss_stop") - F.col("loss_start")).cast("int")))
    read = read_turns(pieces.withColumn("masked", masked))
    rows = (
        read.repartition(F.col(id_col))
        .sortWithinPartitions(F.col(id_col).asc_nulls_first(), *(F.col(c).asc_nulls_last() for c in order), "piece")
        .select(F.col(id_col).alias("id"), "role_read", "text_read", "masked", F.length("piece").cast("bigint").alias("size"))
    )
    id_type = rows.schema["id"].dataType.simpleString()
    names = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, now = False, None

        def closed() -> list:
            return [now, n, turns.hexdigest(), chars, loss.hexdigest(), size]

        for batch in batches:
            out = []
            for id_, role, text, under, more in zip(*(c.to_pylist() for c in batch.columns)):
                if not open_ or id_ != now:
                    if open_:
                        out.append(closed())
                    open_, now, n, chars, size = True, id_, 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                n, size = n + 1, size + more
                turns.update(f"{role}\n{text}\n".encode())
                if under is not None:
                    chars += len(under)
                    loss.update(under.encode())
            if out:
                yield _rows(out, batch.schema.field(0).type)
        if open_:
            yield _rows([closed()], batch.schema.field(0).type)

    def _rows(out: list, kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return rows.mapInArrow(
        run, f"id {id_type}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )


def formatted_conversations(pieces: DataFrame, id_col: str, order: Sequence[str]) -> DataFrame:
    """(id, formatted, loss): one text for each conversation, and the spans of its loss mask in code points.

    For conversations that are training examples, as a row must hold one whole;
    ``conversation_digests`` reads pieces of any number.
    """
    key = [F.col(c) for c in order]
    rows = pieces.groupBy(F.col(id_col).alias("id")).agg(
        F.sort_array(F.collect_list(F.struct(*key, "piece", "loss_start", "loss_stop"))).alias("rows")
    )
    sizes = F.transform("rows", lambda r: F.length(r["piece"]).cast("bigint"))
    begin = F.transform(F.sequence(F.lit(0), F.size("rows") - 1), lambda k: F.aggregate(F.slice(sizes, 1, k), F.lit(0).cast("bigint"), lambda a, x: a + x))
    spans = F.zip_with("rows", begin, lambda r, b: F.struct((b + r["loss_start"]).alias("start"), (b + r["loss_stop"]).alias("stop")))
    return rows.select("id", F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("formatted"), F.filter(spans, lambda s: s["start"].isNotNull()).alias("loss"))
