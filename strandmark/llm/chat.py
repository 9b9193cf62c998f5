"""Chat formatting with typed content parts (operator 2).

Format of a turn: ``<|role|>`` role ``<|text|>`` content ``<|end|>`` and a line feed. Content is text, with
``<|part|>`` between parts and a placeholder such as ``<|image:0|>`` for each attachment. In roles and texts every control
string, of this template or of other common ones, gets a backslash behind its first character; one that has
backslashes there already gets one more. So no text can look like a marker, and taking one away restores the text.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmark.llm.frames import map_rows

#: Control strings of common chat templates, as first character and rest.
CONTROLS = r"\||/?s>|/?INST\]|/?<SYS>>|<SYS>>|</SYS>>"
ESCAPE = regex.compile(rf"([<\[])(\\*)(?={CONTROLS})")
UNESCAPE = regex.compile(rf"([<\[])\\(\\*)(?={CONTROLS})")
TURN = regex.compile(r"<\|role\|>(.*?)<\|text\|>(.*?)<\|end\|>\n", regex.DOTALL)
ATTACHED = regex.compile(r"<\|(image|audio|document):(\d+)\|>")
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
FORMATTED = (
    "conv_id long, formatted string, loss array<struct<start:long,end:long>>, "
    "attachments array<struct<index:int,turn:long,kind:string,ref:string,tokens:long>>, n_turns long, attachment_tokens long"
)


def escape(text: str) -> str:
    return ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1\2", text)


@dataclass
class Flattener:
    """Visits the typed parts of one conversation in order; one method for each type of part."""

    patch: int = 14
    audio_rate: float = 25.0
    page_tokens: int = 512
    out: list[str] = field(default_factory=list)
    length: int = 0
    loss: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[tuple[int, int | None, str, str | None, int]] = field(default_factory=list)

    def put(self, text: str) -> None:
        self.out.append(text)
        self.length += len(text)

    def turn(self, number: int | None, role: str | None, parts: list[dict] | None) -> None:
        self.put(f"<|role|>{escape(role or '')}<|text|>")
        for i, part in enumerate(parts or []):
            if i:
                self.put("<|part|>")
            part = part or {}
            kind = part.get("type") or "text"
            visit = getattr(self, f"visit_{kind}", None)
            if visit is None:
                raise ValueError(f"unknown type of content part: {kind}")
            visit(part, number, role)
        self.put("<|end|>\n")

    def visit_text(self, part: dict, number: int | None, role: str | None) -> None:
        start = self.length
        self.put(escape(part.get("text") or ""))
        if role == "assistant" and self.length > start:
            self.loss.append((start, self.length))

    def attach(self, kind: str, part: dict, number: int | None, tokens: int) -> None:
        index = len(self.attachments)
        self.put(f"<|{kind}:{index}|>")
        self.attachments.append((index, number, kind, part.get("ref"), tokens))

    def visit_image(self, part: dict, number: int | None, role: str | None) -> None:
        self.attach("image", part, number, math.ceil((part.get("width") or 0) / self.patch) * math.ceil((part.get("height") or 0) / self.patch))

    def visit_audio(self, part: dict, number: int | None, role: str | None) -> None:
        self.attach("audio", part, number, math.ceil((part.get("seconds") or 0) * self.audio_rate))

    def visit_document(self, part: dict, number: int | None, role: str | None) -> None:
        self.attach("document", part, number, (part.get("pages") or 0) * self.page_tokens)


def text_parts(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, parts for a table whose turns are plain text."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (x.split(":") for x in PART[7:-1].split(",")[2:])))
    return turns.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def format_conversations(turns: DataFrame, patch: int = 14, audio_rate: float = 25.0, page_tokens: int = 512) -> DataFrame:
    """One row a conversation: formatted string, loss spans in code points, attachments with expanded token counts.

    ``turns`` has conv_id, turn, role and parts (array of PART); other columns aren't read. Turns go by number, ties by
    role and then parts, nulls first; repeated turns stay. Null roles and texts are empty, null parts are an empty turn; a
    null conv_id is a conversation of its own; an empty table gives no rows; an unknown type of part is an error.
    Conversations meet in one shuffle of the turns by conv_id. As a row holds a whole conversation, that must fit in a task.
    """

    def make():
        def work(rows: dict) -> dict:
            out = {n.split()[0]: [] for n in FORMATTED.replace(",struct", "").split(", ")}
            for conv, group in zip(rows["conv_id"], rows["turns"]):
                f = Flattener(patch, audio_rate, page_tokens)
                for t in group:
                    f.turn(t["turn"], t["role"], t["parts"])
                loss = [{"start": a, "end": b} for a, b in f.loss]
                attachments = [dict(zip(("index", "turn", "kind", "ref", "tokens"), a)) for a in f.attachments]
                for name, value in zip(out, (conv, "".join(f.out), loss, attachments, len(group), sum(a[4] for a in f.attachments)), strict=True):
                    out[name].append(value)
            return out

        return work

    grouped = turns.select("conv_id", F.struct("turn", "role", "parts").alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return map_rows(grouped, make, FORMATTED)


def parse(formatted: str) -> list[tuple[str, list[tuple[str, str | int]]]]:
    """(role, parts) of each turn; a part is ("text", text) or (kind, index of the attachment)."""
    turns, at = [], 0
    for m in TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn begins at {at}")
        inside = [(p, ATTACHED.fullmatch(p)) for p in m[2].split("<|part|>")]
        turns.append((unescape(m[1]), [(a[1], int(a[2])) if a else ("text", unescape(p)) for p, a in inside]))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn begins at {at}")
    return turns


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted strings hold: turns by parsing them, the loss text by their loss spans."""

    def make():
        def work(rows: dict) -> dict:
            out = {n: [] for n in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments")}
            for conv, text, loss in zip(rows["conv_id"], rows["formatted"], rows["loss"]):
                turns = parse(text)
                said = "".join(f"{role}\n{''.join(p[1] for p in parts if p[0] == 'text')}\n" for role, parts in turns)
                under = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                attached = sum(p[0] != "text" for _, parts in turns for p in parts)
                digests = [hashlib.sha256(x.encode()).hexdigest() for x in (said, under)]
                for name, value in zip(out, (conv, len(turns), digests[0], len(under), digests[1], len(text), attached), strict=True):
                    out[name].append(value)
            return out

        return work

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long"
    return map_rows(formatted.select("conv_id", "formatted", "loss"), make, schema)
