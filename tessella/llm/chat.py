"""Chat formatting with typed content parts.

A conversation becomes one string: every turn is `<s>role`, a newline, its content and `</s>`, a newline. A turn's
content is a list of parts; a visitor takes each in order: text is escaped, and image, audio and document parts become
one placeholder (`<|image|>`, `<|audio|>`, `<|document|>`) whose attachment record holds kind, reference, the turn, the
placeholder's place in the string and the number of tokens that it expands to (image: patches of 14 x 14 pixels;
audio: 50 a second; document: 256 a page). The loss mask is the spans of assistant content.

Control strings inside texts and roles are escaped reversibly: ESC becomes ESC 0, and the k-th of CONTROLS becomes ESC
and the k-th letter. No control string then occurs inside a turn, so a formatted string can be read back exactly.

The string is written as pieces, one a turn, with places counted from the conversation's start. Rows are sorted by
conversation and turn, which spills, and pass by in Arrow batches: a task holds a batch and two counters however many
turns a conversation has. ``whole`` joins the pieces of conversations of ordinary size.

Edge cases: null text, role or part counts as empty; rows are ordered by turn (null first), ties by role and text;
repeated rows are turns of their own; rows with null conv_id are one conversation; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, ESC = "<s>", "</s>", "\u241b"
MEDIA = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
CONTROLS = (OPEN, CLOSE, *MEDIA.values(), "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
CODES = {ESC: "0"} | {c: chr(ord("a") + k) for k, c in enumerate(CONTROLS)}
BACK = {ESC + v: k for k, v in CODES.items()}
READ = re.compile(f"{ESC}[0a-{max(CODES.values())}]")
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: str) -> str:
    for control, code in CODES.items():
        text = text.replace(control, ESC + code)
    return text


def unescape(text: str) -> str:
    return READ.sub(lambda m: BACK[m[0]], text)


@dataclass
class Formatted:
    """What the visitor has written: pieces, loss spans (start, end) and attachments, in order."""

    pieces: list[str] = field(default_factory=list)
    size: int = 0
    loss: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[tuple[str, str, int, int, int]] = field(default_factory=list)

    def put(self, text: str) -> None:
        self.pieces.append(text)
        self.size += len(text)

    def visit(self, part: dict, turn: int) -> None:
        kind = part.get("type") or "text"
        getattr(self, f"visit_{kind}", self.visit_text)(part, turn)

    def visit_text(self, part: dict, turn: int) -> None:
        self.put(escape(part.get("text") or ""))

    def _attach(self, kind: str, part: dict, turn: int, tokens: int) -> None:
        self.attachments.append((kind, part.get("ref") or "", turn, self.size, tokens))
        self.put(MEDIA[kind])

    def visit_image(self, part: dict, turn: int) -> None:
        self._attach("image", part, turn, math.ceil((part.get("width") or 0) / 14) * math.ceil((part.get("height") or 0) / 14))

    def visit_audio(self, part: dict, turn: int) -> None:
        self._attach("audio", part, turn, math.ceil((part.get("seconds") or 0.0) * 50))

    def visit_document(self, part: dict, turn: int) -> None:
        self._attach("document", part, turn, 256 * (part.get("pages") or 0))

    def turn(self, number: int, role: str | None, parts: list[dict]) -> None:
        self.put(OPEN + escape(role or "").replace("\n", ESC + "n") + "\n")
        start = self.size
        for part in parts:
            self.visit(part, number)
        if role == "assistant":
            self.loss.append((start, self.size))
        self.put(CLOSE + "\n")

    @property
    def text(self) -> str:
        return "".join(self.pieces)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted string; placeholders stay in the text as they are."""
    out = []
    for block in formatted.split(CLOSE + "\n")[:-1]:
        role, _, text = block.removeprefix(OPEN).partition("\n")
        out.append((unescape(role.replace(ESC + "n", "\n")), unescape(text)))
    return out


def format_turns(turns: list[dict]) -> Formatted:
    """A conversation that is at hand as a list of turns."""
    out = Formatted()
    for number, t in enumerate(turns):
        out.turn(number, t["role"], t.get("parts") if t.get("parts") is not None else [{"text": t.get("text")}])
    return out


SPAN = pa.struct({"start": pa.int64(), "end": pa.int64()})
ATTACHMENT = pa.struct({"kind": pa.string(), "ref": pa.string(), "turn": pa.int32(), "at": pa.int64(), "tokens": pa.int64()})
_PIECE = pa.schema({"conv_id": pa.int64(), "seq": pa.int64(), "start": pa.int64(), "formatted": pa.string(), "loss": pa.list_(SPAN), "attachments": pa.list_(ATTACHMENT), "n_tokens_expanded": pa.int64()})
OUT = "conv_id long, seq long, start long, formatted string, loss array<struct<start:long,end:long>>, attachments array<struct<kind:string,ref:string,turn:int,at:long,tokens:long>>, n_tokens_expanded long"


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of rows (conv_id, turn, role, text, parts) that come sorted by conversation and turn."""
    conv, seq, start, first = None, 0, 0, True
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            rows = []
            for r in batch.slice(i, 256).to_pylist():
                if first or r["conv_id"] != conv:
                    conv, seq, start, first = r["conv_id"], 0, 0, False
                f = Formatted(size=start)
                f.turn(seq, r["role"], r["parts"] if r["parts"] is not None else [{"text": r["text"]}])
                rows.append(
                    {
                        "conv_id": conv,
                        "seq": seq,
                        "start": start,
                        "formatted": f.text,
                        "loss": [{"start": a, "end": b} for a, b in f.loss],
                        "attachments": [dict(zip(("kind", "ref", "turn", "at", "tokens"), a, strict=True)) for a in f.attachments],
                        "n_tokens_expanded": sum(a[4] for a in f.attachments),
                    }
                )
                seq, start = seq + 1, f.size
            yield pa.RecordBatch.from_pylist(rows, _PIECE)


def format_chat(rows: DataFrame, parts: str | None = None) -> DataFrame:
    """A piece for every row of ``rows`` (conv_id, turn, role, text): its number and place in the conversation, formatted
    string, loss spans, attachments and the tokens that they expand to. ``parts`` names an array column of PART structs to
    use instead of text where not null. A conversation's pieces are in one partition, in order."""
    content = (F.col(parts) if parts else F.lit(None)).cast(f"array<{PART}>")
    order = ["conv_id", "turn", "role", "text", "parts"]
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text", content.alias("parts"))
    return turns.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_format, OUT)


def whole(pieces: DataFrame) -> DataFrame:
    """One row per conversation out of its pieces; for conversations that fit in a task."""
    of = F.sort_array(F.collect_list(F.struct("seq", "formatted", "loss", "attachments", "n_tokens_expanded")))
    joined = pieces.groupBy("conv_id").agg(of.alias("p"))
    return joined.select(
        "conv_id", F.array_join("p.formatted", "").alias("formatted"), F.flatten("p.loss").alias("loss"), F.flatten("p.attachments").alias("attachments"),
        F.aggregate("p.n_tokens_expanded", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_tokens_expanded"),
    )


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, pa.int64() if k == "long" else pa.string()) for n, k in (c.split(" ") for c in DIGESTS.split(", "))])
    done, conv, n_turns, loss_chars, size, turns, loss = [], None, 0, 0, 0, None, None
    close = lambda: done.append((conv, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), size))
    emit = lambda: pa.RecordBatch.from_pylist([dict(zip(schema.names, d, strict=True)) for d in done], schema)
    for r in chain.from_iterable(b.slice(i, 256).to_pylist() for b in batches for i in range(0, b.num_rows, 256)):
        if len(done) >= 4096:
            yield emit()
            done.clear()
        if turns is None or r["conv_id"] != conv:
            if turns is not None:
                close()
            conv, n_turns, loss_chars, size, turns, loss = r["conv_id"], 0, 0, 0, hashlib.sha256(), hashlib.sha256()
        for role, text in read_back(r["formatted"]):
            turns.update(f"{role}\n{text}\n".encode("utf-8"))
            n_turns += 1
        for span in r["loss"]:
            text = unescape(r["formatted"][span["start"] - r["start"] : span["end"] - r["start"]])
            loss.update(text.encode("utf-8"))
            loss_chars += len(text)
        size += len(r["formatted"])
    if turns is not None:
        close()
        yield emit()


def digests(pieces: DataFrame, in_order: bool = False) -> DataFrame:
    """What can be read back from ``format_chat``'s output; ``in_order`` if it comes straight from there, not from disk."""
    named = pieces.select("conv_id", "seq", "start", "formatted", "loss")
    ordered = named if in_order else named.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return ordered.mapInArrow(_digest, DIGESTS)
