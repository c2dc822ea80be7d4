"""Chat formatting with typed content parts (operator 5).

A turn is a role and a list of parts: text, image, audio, document.  A visitor flattens the parts into one body:
texts are escaped, the others become numbered placeholders, and each attachment is recorded with its
reference and the tokens it expands to.  A turn is written as

    ### role:⏎body</turn>⏎

Control strings inside texts and roles (``##``, ``</turn>``, ``<|``, and ``:`` and line ends in a role) get a backslash inside
them, and a backslash is doubled; reading removes one backslash before any character.  The loss
mask covers the bodies of assistant turns.

Turns are formatted where they are read.  ``read_back`` sorts the formatted turns of a conversation inside
a partition and reads them as a stream, so no conversation is ever held whole.  (A digest of one
conversation is sequential: a conversation with very many turns is one long stream in one task of
constant memory.)

Defined cases: null texts, roles and kinds are empty strings; a part of an unknown kind with a text is a text, otherwise a
file of no tokens; turns with equal numbers are ordered by role and body; a null turn number comes
first; repeated rows are turns of their own; a null id is a conversation; an empty table gives an
empty result (but for what the query adds).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.llm import tables

HEAD, COLON, END = "### ", ":\n", "</turn>\n"
IMAGE_PATCH = 28  # pixels a token covers, both ways
AUDIO_RATE = 25  # tokens a second
PAGE_TOKENS = 768
ASSISTANT = "assistant"

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = pa.struct([("nth", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])

_CONTROL = re.compile(r"\\|#(?=#)|<(?=/turn>|\|)")
_IN_ROLE = re.compile(r"[:\n]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^:\\]|\\.)*):\n(.*)</turn>\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Visitor:
    """Walks the parts of one turn."""

    def __init__(self) -> None:
        self.body: list[str] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        kind = part.get("kind") or ""
        getattr(self, f"visit_{kind}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.body.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        w, h = part.get("width") or 0, part.get("height") or 0
        self._attach("image", part, math.ceil(w / IMAGE_PATCH) * math.ceil(h / IMAGE_PATCH))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil((part.get("seconds") or 0) * AUDIO_RATE))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part.get("pages") or 0) * PAGE_TOKENS)

    def visit_other(self, part: dict) -> None:
        if part.get("text") is not None:
            self.visit_text(part)
        else:
            self._attach("file", part, 0)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        nth = len(self.attachments)
        self.body.append(f"<|{kind}:{nth}|>")
        self.attachments.append({"nth": nth, "kind": kind, "ref": part.get("ref"), "tokens": tokens})


FORMATTED = (
    "conv_id long, turn long, formatted string, loss_start int, loss_end int, "
    "attachments array<struct<nth:int,kind:string,ref:string,tokens:long>>, expanded_tokens long"
)


def format_turns(turns: DataFrame) -> DataFrame:
    """Formatted turns of (conv_id, turn, role, parts); loss_start and loss_end are code points of ``formatted``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, lo, hi, files = [], [], [], []
            for role, parts in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                v = Visitor()
                for p in parts or []:
                    v.visit(p or {})
                name = _IN_ROLE.sub(lambda m: "\\" + m[0], escape(role or ""))
                head, body = f"{HEAD}{name}{COLON}", "".join(v.body)
                out.append(head + body + END)
                masked = role == ASSISTANT
                lo.append(len(head) if masked else 0)
                hi.append(len(head) + len(body) if masked else 0)
                files.append(v.attachments)
            yield tables.record([
                ("conv_id", pa.int64(), b.column(0)), ("turn", pa.int64(), b.column(1)),
                ("formatted", pa.string(), out), ("loss_start", pa.int32(), lo), ("loss_end", pa.int32(), hi),
                ("attachments", pa.list_(ATTACHMENT), files),
                ("expanded_tokens", pa.int64(), [sum(a["tokens"] for a in f) for f in files]),
            ])

    return turns.select("conv_id", "turn", "role", "parts").mapInArrow(work, FORMATTED)


def parse_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    m = _TURN.fullmatch(formatted)
    if not m:
        raise ValueError("not a formatted turn")
    return unescape(m[1]), unescape(m[2])


DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
    "n_attachments long, expanded_tokens long"
)


class _Digest:
    def __init__(self, conv: int | None):
        self.conv, self.n, self.loss, self.chars, self.files, self.tokens = conv, 0, 0, 0, 0, 0
        self.turns, self.masked = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, lo: int, hi: int, files: int, tokens: int) -> None:
        role, text = parse_turn(formatted)
        self.n += 1
        self.turns.update(f"{role}\n{text}\n".encode())
        part = unescape(formatted[lo:hi])
        self.masked.update(part.encode())
        self.loss += len(part)
        self.chars += len(formatted)
        self.files += files
        self.tokens += tokens

    def row(self) -> tuple:
        return (
            self.conv, self.n, self.turns.hexdigest(), self.loss, self.masked.hexdigest(), self.chars, self.files,
            self.tokens)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read from its formatted turns."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in DIGEST.split(", ")]
        types = [pa.string() if c.endswith("string") else pa.int64() for c in DIGEST.split(", ")]
        now: _Digest | None = None
        for b in batches:
            done = []
            for conv, text, lo, hi, files, tokens in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(conv)
                now.add(text, lo, hi, files, tokens)
            if done:
                yield tables.record([(n, t, list(c)) for n, t, c in zip(names, types, zip(*done, strict=True), strict=True)])
        if now is not None:
            yield tables.record([(n, t, [c]) for n, t, c in zip(names, types, now.row(), strict=True)])

    return (
        formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
        .select("conv_id", "formatted", "loss_start", "loss_end", F.size("attachments").alias("files"), "expanded_tokens")
        .mapInArrow(work, DIGEST)
    )


def text_turns(conversations: DataFrame) -> DataFrame:
    """Rows with a text column as turns of one text part."""
    part = F.struct(
        F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
        F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"),
    )
    return conversations.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = [("conv_id", "conv_id", "long"), ("turn", "turn", "long"), ("role", "role", "string"), ("text", "text", "string")]
    rows = tables.only(tables.read(spark, sf_dir, "conversations"), *named)
    hard = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], rows.schema)
    return read_back(format_turns(text_turns(rows.unionByName(extra))))
