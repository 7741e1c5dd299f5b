"""Conversations as training text: turn markers, reversible escapes, typed content parts and a loss mask.

The template of a turn is ``### <Role>: <content> </turn>\\n``. Inside a content every backslash is doubled and every
control string (``###``, ``</turn>``, and ``<|`` of a placeholder) gets a backslash before it, so a marker in the output is
always the template's own and a content can be read back exactly. Each turn is formatted on its own, so formatting needs
no shuffle; only reading a whole conversation back sorts its turns, and streams over them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from columnscope.llm.storage import only

TURN_START, TURN_MIDDLE, TURN_END = "### ", ": ", " </turn>\n"
TRAINED_ROLES = frozenset({"assistant"})
_CONTROL = re.compile(r"\\|###|</turn>|<\|")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|<\|)")
_PLAIN_ROLE = re.compile("[a-z]+")
# What a part other than text takes in the model's context, in tokens.
PART_TOKENS = {"image": 576, "audio": 50, "document": 256}

PART_TYPE = T.ArrayType(T.StructType([
    T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()),
    T.StructField("units", T.LongType()),
]))


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


@dataclass
class Flattener:
    """Visits the parts of one content in order; text is escaped, every other part becomes a numbered placeholder.

    An image counts its tiles, an audio part its seconds, a document its pages (``units``, 1 if unknown), times the
    tokens of one. A part of an unknown type is kept as a placeholder of that type with no tokens.
    """

    tokens_per: dict[str, int] = field(default_factory=lambda: dict(PART_TOKENS))
    pieces: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    expanded: int = 0

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        handler: Callable = getattr(self, f"visit_{kind}", self.visit_other) if kind.isidentifier() else self.visit_other
        handler(kind, part)

    def visit_text(self, kind: str, part: dict) -> None:
        self.pieces.append(escape(part.get("text") or ""))

    def visit_other(self, kind: str, part: dict) -> None:
        tokens = self.tokens_per.get(kind, 0) * max(1, part.get("units") or 1)
        index = len(self.attachments)
        self.attachments.append({"index": index, "type": kind, "ref": part.get("ref"), "tokens": tokens})
        self.expanded += tokens
        self.pieces.append(f"<|{escape(kind)}:{index}|>")


def flatten(parts: list[dict] | None) -> Flattener:
    found = Flattener()
    for part in parts or []:
        if part is not None:
            found.visit(part)
    return found


def _shown(role: str) -> str:
    """A role of a-z with a capital; any other as = and the hex digits of its bytes."""
    return role.capitalize() if _PLAIN_ROLE.fullmatch(role) else "=" + role.encode("utf-8", "surrogatepass").hex()


def _role(shown: str) -> str:
    return bytes.fromhex(shown[1:]).decode("utf-8", "surrogatepass") if shown.startswith("=") else shown.lower()


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, escaped content) of every turn in a formatted text."""
    at = 0
    while at < len(formatted):
        middle, end = formatted.find(TURN_MIDDLE, at), formatted.find(TURN_END, at)
        if not formatted.startswith(TURN_START, at) or not 0 <= middle < end:
            raise ValueError(f"no turn begins at character {at}")
        yield _role(formatted[at + len(TURN_START):middle]), formatted[middle + len(TURN_MIDDLE):end]
        at = end + len(TURN_END)


TURN_SCHEMA = T.StructType([
    T.StructField("formatted", T.StringType()), T.StructField("loss_start", T.IntegerType()), T.StructField("loss_end", T.IntegerType()),
    T.StructField("expanded_tokens", T.LongType()),
    T.StructField("attachments", T.ArrayType(T.StructType([
        T.StructField("index", T.IntegerType()), T.StructField("type", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("tokens", T.LongType()),
    ]))),
])


def format_turns(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 parts: str | None = None) -> DataFrame:
    """One row a turn: the keys, its formatted text, the span under the loss mask in it (0, 0 for none), its attachments.

    The content is ``text``, or the typed ``parts`` where that column is given and not null. The text of a
    conversation is its turns' texts in order, with nothing between. A null role is the empty role, a null text is empty.
    Null or repeated keys are kept as they are; an empty table gives an empty result; other columns are not looked at.
    """
    names = {"conv": conversation, "turn": turn, "role": role, "text": text} | ({"parts": parts} if parts else {})
    held = only(df, **names)
    kinds = dict(held.dtypes)
    schema = T.StructType([held.schema["conv"], held.schema["turn"], held.schema["role"], *TURN_SCHEMA.fields])
    arrow = [pa.field("formatted", pa.string()), pa.field("loss_start", pa.int32()), pa.field("loss_end", pa.int32()), pa.field("expanded_tokens", pa.int64()),
             pa.field("attachments", pa.list_(pa.struct([("index", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])))]

    def run(batches):
        for batch in batches:
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            typed = batch.column("parts").to_pylist() if "parts" in kinds else [None] * batch.num_rows
            out: list[list] = [[] for _ in arrow]
            for r, t, p in zip(roles, texts, typed):
                content = flatten(p if p is not None else [{"type": "text", "text": t}])
                body, head = "".join(content.pieces), TURN_START + _shown(r or "") + TURN_MIDDLE
                span = (len(head), len(head) + len(body)) if r in TRAINED_ROLES else (0, 0)
                for column, value in zip(out, (head + body + TURN_END, *span, content.expanded, content.attachments)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), batch.column("turn"), batch.column("role")] + [pa.array(v, f.type) for v, f in zip(out, arrow)],
                names=["conv", "turn", "role"] + [f.name for f in arrow],
            )

    return held.mapInArrow(run, schema).withColumnsRenamed({"conv": conversation, "turn": turn, "role": role})


def digests(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """What the formatted turns of each conversation say when read back, hashed piece by piece.

    (conversation, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars). Turns are read in the order of
    ``turn`` (null first), equal ones by their formatted text. A conversation is streamed over, never held; a
    placeholder is read as it stands. Turns with a null conversation form one conversation.
    """
    kind = dict(turns.dtypes)[conversation]
    ordered = only(turns, conv=conversation, turn=turn, formatted="formatted", loss_start="loss_start", loss_end="loss_end")
    ordered = ordered.repartition("conv").sortWithinPartitions(F.col("conv"), F.col("turn"), F.col("formatted"))
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        state, current = None, None
        for batch in batches:
            done: list[tuple] = []
            for conv, formatted, a, b in zip(*[batch.column(c).to_pylist() for c in ("conv", "formatted", "loss_start", "loss_end")]):
                if state is None or conv != current:
                    if state is not None:
                        done.append(state.row(current))
                    state, current = _Reader(), conv
                state.add(formatted, a, b)
            if done:
                yield _record(done, names, batch.schema.field("conv").type)
            last = batch.schema.field("conv").type
        if state is not None:
            yield _record([state.row(current)], names, last)

    schema = f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.mapInArrow(run, schema).withColumnRenamed("conv", conversation)


def _record(rows: list[tuple], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


class _Reader:
    """Hashes of one conversation as its turns go by."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, formatted: str, loss_start: int, loss_end: int) -> None:
        self.chars += len(formatted)
        for role, content in read_turns(formatted):
            self.n += 1
            self.turns.update(f"{role}\n{unescape(content)}\n".encode("utf-8", "surrogatepass"))
        masked = unescape(formatted[loss_start:loss_end])
        self.loss_chars += len(masked)
        self.loss.update(masked.encode("utf-8", "surrogatepass"))

    def row(self, conv) -> tuple:
        return conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars
