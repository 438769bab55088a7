"""Chat formatting of typed content parts.

A message is a list of parts: text, image, audio or document. A visitor flattens them in order: text is escaped, every
other part becomes one placeholder, and its reference, place and expanded token count are recorded. A turn is framed by
control strings; the frame and the placeholders are the only places where a control string can stand, as texts are
escaped reversibly.

Turns are formatted one by one, each with its part of the loss mask, so a conversation of any length is a stream of
turns and never one value.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>"
CONTROL, ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
TRAINED_ROLE = "assistant"
PARTS = ("array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>")
ATTACHMENTS = "array<struct<kind:string,ref:string,at:long,tokens:long>>"
PATCH, LONGEST_SIDE = 28, 1568           # pixels of an image that one token stands for; larger images are scaled down
AUDIO_TOKENS, PAGE_TOKENS = 25, 1024     # tokens of a second of sound, of a page


def escape(text: str) -> str:
    r"""One more backslash in every ``<\...|``, so no ``<|`` is left."""
    return CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """Roles stand on one line."""
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


@dataclass
class Flattened:
    """What the visitor writes: the text so far, and the attachments met.

    Texts that follow each other are escaped as one, or the end of one and the start of the next could form a control.
    """

    pieces: list[str] = field(default_factory=list)
    chars: int = 0
    attachments: list[tuple[str, str, int, int]] = field(default_factory=list)
    unescaped: list[str] = field(default_factory=list)

    def write_text(self, text: str) -> None:
        self.unescaped.append(text)

    def close_text(self) -> None:
        self._write(escape("".join(self.unescaped)))
        self.unescaped.clear()

    def write_attachment(self, kind: str, ref: str, tokens: int) -> None:
        self.close_text()
        self.attachments.append((kind, ref, self.chars, tokens))
        self._write(f"<|{kind}:{tokens}|>")

    def _write(self, text: str) -> None:
        self.pieces.append(text)
        self.chars += len(text)

    @property
    def text(self) -> str:
        return "".join(self.pieces)


class PartVisitor:
    """One method for each kind of part; another template overrides those it writes differently."""

    def visit(self, part: dict, out: Flattened) -> None:
        kind = part.get("type") or "text"
        method = getattr(self, f"visit_{kind}", self.visit_other)
        method(part, out)

    def attach(self, kind: str, part: dict, tokens: int, out: Flattened) -> None:
        out.write_attachment(kind, part.get("ref") or "", tokens)

    def visit_text(self, part: dict, out: Flattened) -> None:
        out.write_text(part.get("text") or "")

    def visit_image(self, part: dict, out: Flattened) -> None:
        wide, high = max(1, part.get("width") or 1), max(1, part.get("height") or 1)
        scale = min(1.0, LONGEST_SIDE / max(wide, high))
        self.attach("image", part, math.ceil(wide * scale / PATCH) * math.ceil(high * scale / PATCH), out)

    def visit_audio(self, part: dict, out: Flattened) -> None:
        seconds = part.get("seconds") or 0.0
        self.attach("audio", part, max(1, math.ceil(seconds * AUDIO_TOKENS)) if math.isfinite(seconds) else 1, out)

    def visit_document(self, part: dict, out: Flattened) -> None:
        self.attach("document", part, max(1, part.get("pages") or 1) * PAGE_TOKENS, out)

    def visit_other(self, part: dict, out: Flattened) -> None:
        """A part of an unknown type: its text as text; one token for what it refers to, or if it has no text."""
        self.visit_text(part, out)
        if part.get("ref") or not part.get("text"):
            self.attach("other", part, 1, out)


def flatten(parts, visitor: PartVisitor | None = None) -> Flattened:
    out, visitor = Flattened(), visitor or PartVisitor()
    for part in () if parts is None else parts:
        if part is not None:
            visitor.visit(part if isinstance(part, dict) else part.asDict(), out)
    out.close_text()
    return out


def format_turn(role: str | None, parts) -> tuple[str, int, int, list]:
    """(formatted turn, start and length of the part under the loss mask, attachments); places count code points."""
    content = flatten(parts)
    head = f"{START}{escape_role(role or '')}\n"
    masked = content.chars if role == TRAINED_ROLE else 0
    return (f"{head}{content.text}{END}\n", len(head), masked,
            [(kind, ref, len(head) + at, tokens) for kind, ref, at, tokens in content.attachments])


def _format(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        done = [format_turn(role, parts) for role, parts in zip(batch["role"], batch["parts"])]
        out = batch[["conv", "turn"]].copy()
        out["formatted"] = [d[0] for d in done]
        out["loss_start"] = [d[1] for d in done]
        out["loss_chars"] = [d[2] for d in done]
        out["attachments"] = [[dict(zip(("kind", "ref", "at", "tokens"), a)) for a in d[3]] for d in done]
        yield out


def text_part(text) -> Column:
    """A message that is one text, as typed parts."""
    empty = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"),
                            *[F.lit(None).cast(kind).alias(name) for name, kind in empty.items()])).cast(PARTS)


def format_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", parts_col: str | None = None) -> DataFrame:
    """One row per message: conversation, turn, ``formatted``, ``loss_start``, ``loss_chars``, ``attachments``.

    ``parts_col`` holds typed parts (``PARTS``); without it the message is one text part. A conversation is its rows in
    the order of turn, ties by ``formatted``. NULL roles and texts are empty, NULL turns come first, NULL conversations
    are one conversation, repeated messages are all formatted. Other columns are not read. No shuffle. Sizes that are
    NULL, not above zero, NaN or infinite count as the least, for audio one token. Parts of an unknown type become their
    text and, with a reference or without text, the attachment ``other`` of one token.
    """
    parts = F.col(parts_col).cast(PARTS) if parts_col else text_part(F.col(text_col))
    conv, turn = (df.schema[c].dataType.simpleString() for c in (conv_col, turn_col))
    rows = df.select(F.col(conv_col).cast("string").alias("conv"), F.col(turn_col).cast("string").alias("turn"),
                     F.col(role_col).cast("string").alias("role"), parts.alias("parts"))
    done = rows.mapInPandas(_format, "conv string, turn string, formatted string, loss_start long, loss_chars long, "
                                     f"attachments {ATTACHMENTS}")
    return done.select(F.col("conv").cast(conv).alias(conv_col), F.col("turn").cast(turn).alias(turn_col),
                       "formatted", "loss_start", "loss_chars", "attachments")


def read_turn(formatted: str, loss_start: int, loss_chars: int) -> tuple[str, str, str]:
    """(role, text, text under the loss mask) of a formatted turn without attachments, unescaped."""
    if not (formatted.startswith(START) and formatted.endswith(f"{END}\n")):
        raise ValueError("not a formatted turn")
    role, text = formatted[len(START):-len(END) - 1].split("\n", 1)
    return unescape_role(role), unescape(text), unescape(formatted[loss_start:loss_start + loss_chars])


class _Digest:
    """Running digests of one conversation."""

    def __init__(self):
        self.turns, self.loss, self.n, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, formatted: str, loss_start: int, loss_chars: int) -> None:
        role, text, learned = read_turn(formatted, loss_start, loss_chars)
        self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        self.loss.update(learned.encode("utf-8", "surrogatepass"))
        self.n, self.chars, self.loss_chars = self.n + 1, self.chars + len(formatted), self.loss_chars + len(learned)

    def row(self, conv) -> tuple:
        return conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


DIGESTS = "conv string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in DIGESTS.split(", ")]
    conv, digest = None, None
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            if digest is None or r.conv != conv:
                if digest:
                    out.append(digest.row(conv))
                conv, digest = r.conv, _Digest()
            digest.add(r.formatted, r.loss_start, r.loss_chars)
        yield pd.DataFrame(out, columns=names)
    if digest:
        yield pd.DataFrame([digest.row(conv)], columns=names)


def digest_chats(formatted: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """One row per conversation, read back from its formatted turns.

    A digest needs the turns in order, so a conversation is one task's; the turns stream through it, and only running
    digests are held.
    """
    conv = formatted.schema[conv_col].dataType.simpleString()
    turns = formatted.select(F.col(conv_col).cast("string").alias("conv"), F.col(turn_col).alias("turn"), "formatted",
                             "loss_start", "loss_chars")
    ordered = turns.repartition("conv").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "formatted")
    done = ordered.select("conv", "formatted", "loss_start", "loss_chars").mapInPandas(_digest, DIGESTS)
    return done.withColumn("conv", F.col("conv").cast(conv)).withColumnRenamed("conv", conv_col)
