"""Conversations formatted by a compiled template, with spans of what a model is trained to write, and read back.

Rows of a conversation are brought together in order and streamed through the template, so that neither a conversation nor
its formatted text is ever held whole: the text comes in parts.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.template import Escape, Template

#: Marks of the format: before a role, between role and text, after a text. They never occur unescaped inside a role or text.
START, MIDDLE, END = "### ", ": ", "</turn>"
#: Turns with their marks; the assistant's texts are what a model is trained to write.
TURNS = (
    "{% for m in messages %}### {{ m.role | escape }}: "
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}</turn>\n"
    "{% endfor %}"
)
#: Code points of a part, beyond which the next piece begins another one, and of a batch of parts.
PART, BATCH = 1_000_000, 4_000_000

_PARTS = "conv_id string, part long, text string, spans array<struct<start: long, end: long>>"


def turns_template() -> Template:
    return Template(TURNS, (START.strip(), MIDDLE, END))


def _rows(batches: Iterable[pd.DataFrame], *columns: str) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b[c] for c in columns), strict=True)


def _parts(pieces: Iterable[tuple[str, bool]]) -> Iterator[tuple[str, list[dict[str, int]]]]:
    """Texts of about PART code points with their marked spans, which touching pieces share. At least one part."""
    held: list[str] = []
    spans: list[dict[str, int]] = []
    size, none = 0, True
    for text, marked in pieces:
        if size > PART:
            yield "".join(held), spans
            held, spans, size, none = [], [], 0, False
        if marked and text:
            if spans and spans[-1]["end"] == size:
                spans[-1]["end"] = size + len(text)
            else:
                spans.append({"start": size, "end": size + len(text)})
        held.append(text)
        size += len(text)
    if size or none:
        yield "".join(held), spans


def formatted(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, part, text, spans of each conversation of conversations (conv_id, turn, role, text).

    Turns come in the order of turn, role and text, nulls first; a null role or text is an empty one; rows with a null conv_id
    are one conversation; repeated rows are turns of their own. The parts of a conversation, numbered from 0, give its text;
    spans are what lies in generation blocks, in code points within the part. A part ends after the piece that fills it, so
    a very long text is in one part. A template that looks at messages other than in one loop gets the whole
    conversation as a list. Rows of a conversation lie in one partition in the order of parts.
    """
    template = template or turns_template()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        size = 0
        for conv, rows in itertools.groupby(_rows(batches, "conv_id", "role", "text"), key=lambda r: r[0]):
            messages = ({"role": role or "", "text": text or ""} for _, role, text in rows)
            for k, (text, spans) in enumerate(_parts(template.render(messages))):
                out.append((conv, k, text, spans))
                size += len(text)
                if size > BATCH:
                    yield pd.DataFrame(out, columns=["conv_id", "part", "text", "spans"])
                    out, size = [], 0
        if out:
            yield pd.DataFrame(out, columns=["conv_id", "part", "text", "spans"])

    kind = conversations.schema["conv_id"].dataType
    rows = conversations.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").alias("_turn"), F.col("role").cast("string"), F.col("text").cast("string"))
    together = rows.repartition("conv_id").sortWithinPartitions("conv_id", "_turn", "role", "text").drop("_turn")
    return together.mapInPandas(run, _PARTS).withColumn("conv_id", F.col("conv_id").cast(kind))


_ENDS = {mark: re.compile(r"\\.|" + re.escape(mark), re.DOTALL) for mark in (MIDDLE, END + "\n")}


class Reader:
    """Turns of a formatted text that comes in parts."""

    def __init__(self) -> None:
        self.held: list[str] = []

    def feed(self, text: str) -> Iterator[tuple[str, str]]:
        """(role, text) of the turns that end in the text so far."""
        if "\n" not in text:
            self.held.append(text)
            return
        text, at = "".join([*self.held, text]), 0
        while turn := self._turn(text, at):
            role, content, at = turn
            yield role, content
        self.held = [text[at:]]

    def _turn(self, text: str, at: int) -> tuple[str, str, int] | None:
        at += len(START)
        found = []
        for mark, pattern in _ENDS.items():
            end = next((m for m in pattern.finditer(text, at) if m[0] == mark), None)
            if end is None:
                return None
            found.append(Escape.undo(text[at : end.start()]))
            at = end.end()
        return *found, at


def read_back(parts: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from the parts that formatted gives with its own template.

    parts: as formatted leaves them, the parts of a conversation in order within one partition. turns_sha256 is the digest
    of role, a line break, text and a line break of each turn; loss_sha256 that of all marked text, without escapes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for conv, rows in itertools.groupby(_rows(batches, "conv_id", "text", "spans"), key=lambda r: r[0]):
            reader, turns, loss = Reader(), hashlib.sha256(), hashlib.sha256()
            n = n_loss = size = 0
            for _, text, spans in rows:
                size += len(text)
                for role, content in reader.feed(text):
                    turns.update(f"{role}\n{content}\n".encode())
                    n += 1
                for s in spans:
                    marked = Escape.undo(text[s["start"] : s["end"]])
                    loss.update(marked.encode())
                    n_loss += len(marked)
            out.append((conv, n, turns.hexdigest(), n_loss, loss.hexdigest(), size))
            if len(out) == 10_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = parts.schema["conv_id"].dataType
    text = parts.select(F.col("conv_id").cast("string").alias("conv_id"), "text", "spans")
    return text.mapInPandas(run, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumn("conv_id", F.col("conv_id").cast(kind))
