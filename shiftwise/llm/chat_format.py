"""Chat formatting with typed content parts.

A turn's content is a list of parts: text, image, audio or document.  A visitor
flattens them in order: text is escaped, every other part becomes a numbered
placeholder; its reference and the tokens it will expand to are recorded beside
the text.  A turn then reads

    <|turn|>role\\nbody<|end|>\\n

and carries the spans (code points) under the loss mask: the text parts of the
assistant.  A conversation is its turns in order.  Each turn is formatted by
itself, so a conversation of any length needs no more than one turn in memory;
the reader walks the turns of a conversation in order with running digests.

Control strings inside texts are escaped by a backslash after their first
character; where backslashes already follow it, one is added.  So no text can
hold a control string, and removing one backslash restores every text.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftwise.llm.staging import ready, stage

TURN, END = "<|turn|>", "<|end|>\n"
_REST = r"(?=\|[a-z]+(?::[0-9]+)?\|>|/?s>|/?INST\])"
_CONTROL = re.compile(r"([<\[])(\\*)" + _REST)
_ESCAPED = re.compile(r"([<\[])\\(\\*)" + _REST)
_PLACEHOLDER = re.compile(r"<\|(image|audio|document):([0-9]+)\|>")


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text) if "\\" in text else text


def _escape_role(role: str) -> str:
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def _unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


@dataclass
class Flattener:
    """Visits the parts of a turn in order."""

    patch: int = 28  # pixels a side for each token of an image
    audio_rate: float = 12.5  # tokens a second
    page_tokens: int = 512  # tokens a page of a document
    text: str = ""
    spans: list = field(default_factory=list)  # of text parts
    attachments: list = field(default_factory=list)

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part['type']}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> None:
        escaped = escape(part.get("text") or "")
        self.spans.append((len(self.text), len(self.text) + len(escaped)))
        self.text += escaped

    def visit_image(self, part: dict) -> None:
        self._attach("image", part, math.ceil((part.get("width") or 0) / self.patch) * math.ceil((part.get("height") or 0) / self.patch))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil((part.get("seconds") or 0) * self.audio_rate))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part.get("pages") or 0) * self.page_tokens)

    def visit_unknown(self, part: dict) -> None:
        raise ValueError(f"unknown part {part['type']!r}")

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "at": len(self.text), "tokens": tokens})
        self.text += f"<|{kind}:{len(self.attachments) - 1}|>"


PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
_SEGMENT = pa.struct([("segment", pa.string()), ("spans", pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))),
                      ("attachments", pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("at", pa.int32()), ("tokens", pa.int64())]))), ("expanded_tokens", pa.int64())])
_SEGMENT_DDL = "segment string, spans array<struct<from:int,to:int>>, attachments array<struct<kind:string,ref:string,at:int,tokens:bigint>>, expanded_tokens bigint"


def text_part(text: Column) -> Column:
    """A plain text as a list of one part; a null is empty."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), null.cast("string").alias("ref"), null.cast("int").alias("width"),
                            null.cast("int").alias("height"), null.cast("double").alias("seconds"), null.cast("int").alias("pages")))


def format_turn(role: str | None, parts: list[dict] | None) -> dict:
    flat = Flattener()
    for kind, run in itertools.groupby(parts or (), key=lambda part: part["type"]):
        if kind == "text":  # neighbours are escaped together: a control string may begin in one and end in the next
            flat.visit({"type": kind, "text": "".join(part.get("text") or "" for part in run)})
        else:
            for part in run:
                flat.visit(part)
    head = f"{TURN}{_escape_role(role or '')}\n"
    spans = [{"from": len(head) + a, "to": len(head) + b} for a, b in flat.spans] if role == "assistant" else []
    for x in flat.attachments:
        x["at"] += len(head)
    return {"segment": head + flat.text + END, "spans": spans, "attachments": flat.attachments, "expanded_tokens": sum(x["tokens"] for x in flat.attachments)}


def format_turns(turns: DataFrame) -> DataFrame:
    """One row for each row of ``turns`` (conv_id, turn, role, parts): its segment, loss spans and attachments.

    Any other columns are left out.  A null role is empty, null parts are none.
    """
    turns = ready(turns).select("conv_id", "turn", "role", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [format_turn(*x) for x in zip(batch.column("role").to_pylist(), batch.column("parts").to_pylist(), strict=True)]
            out = pa.array(made, _SEGMENT)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), *out.flatten()], names=["conv_id", "turn", *(f.name for f in _SEGMENT)])

    kinds = {f.name: f.dataType.simpleString() for f in turns.schema}
    return turns.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, {_SEGMENT_DDL}")


def read_turn(segment: str) -> tuple[str, list[str], list[tuple[str, int]]]:
    """Role, texts and placeholders of a formatted turn."""
    if not (segment.startswith(TURN) and segment.endswith(END)):
        raise ValueError("not a formatted turn")
    role, _, body = segment[len(TURN):-len(END)].partition("\n")
    pieces = _PLACEHOLDER.split(body)
    return _unescape_role(role), [unescape(x) for x in pieces[::3]], [(kind, int(i)) for kind, i in zip(pieces[1::3], pieces[2::3], strict=True)]


class _Digest:
    def __init__(self) -> None:
        self.turns = self.loss_chars = self.chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, spans: list[dict]) -> None:
        role, texts, _ = read_turn(segment)
        self.turns += 1
        self.chars += len(segment)
        self.all.update(f"{role}\n{''.join(texts)}\n".encode("utf-8", "surrogatepass"))
        for span in spans or ():
            text = unescape(segment[span["from"]:span["to"]])
            self.loss_chars += len(text)
            self.loss.update(text.encode("utf-8", "surrogatepass"))


_DIGEST_DDL = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, what its formatted turns hold when read back.

    Turns are taken by ``turn`` (nulls first), equal ones by their segment.  Rows
    with a null ``conv_id`` are one conversation.  A conversation is walked by
    one task, because its digest is a chain, but never held in memory.
    """
    kind = ready(formatted).schema["conv_id"].dataType.simpleString()
    rows = formatted.select("conv_id", "turn", "segment", "spans").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, key = None, None
        for batch in batches:
            done = []
            for conv, segment, spans in zip(batch.column("conv_id").to_pylist(), batch.column("segment").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                if digest is None or conv != key:
                    if digest:
                        done.append((key, digest))
                    digest, key = _Digest(), conv
                digest.add(segment, spans)
            yield _told(done, batch.schema.field("conv_id").type)
        if digest:
            yield _told([(key, digest)], batch.schema.field("conv_id").type)

    return rows.mapInArrow(run, f"conv_id {kind}, {_DIGEST_DDL}")


def _told(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = [[k for k, _ in done], *([f(d) for _, d in done] for f in (lambda d: d.turns, lambda d: d.all.hexdigest(), lambda d: d.loss_chars, lambda d: d.loss.hexdigest(), lambda d: d.chars))]
    kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def format_conversations(turns: DataFrame) -> DataFrame:
    """Format (conv_id, turn, role, text), write the formatted turns, and tell what they hold when read back.

    Other columns are left out.  Null roles and texts are empty; a very long text
    is one turn's row, whole.  Equal rows are turns each.  A null ``conv_id`` is
    one conversation; an empty table gives no rows.
    """
    return digests(stage(format_turns(turns.withColumn("parts", text_part(F.col("text")))), "chat"))
