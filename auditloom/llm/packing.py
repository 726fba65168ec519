"""Packing tokenised texts into sequences by vector bin packing.

A piece of a document needs tokens, one segment and loss-bearing tokens (those after the prompt of instruction data, in a
plain document all but the first, which nothing predicts), and a sequence has limits on all three. Open sequences are filled by the dot-product heuristic:
of the waiting pieces that fit, the one whose needs, weighted by what the sequence has left, are largest. Pieces may
be cut, so that a sequence is closed full.

Each partition is packed on its own in one pass over its texts, with a bounded number of waiting pieces and no
shuffle. What a partition has left at its end goes to sequences whose length is a power of two, which need no padding.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of a sequence, pieces in one, loss-bearing tokens in one.
TOKENS, SEGMENTS, LOSS = 2048, 64, 2048
#: The id after each document.
END = 1
#: Pieces that wait for a place in a task.
WAITING = 256
#: Runs of white space whose ids a worker remembers.
REMEMBERED = 10_000

#: White space of the tokenizer's pattern, and the pattern where no two white-space characters meet.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"

_RUN = re.compile(rf"([{SPACE}]+(?=[{SPACE}][^{SPACE}])|[{SPACE}]{{2,}}\Z)")
_PAIR = re.compile(rf"[{SPACE}]{{2}}")


@functools.cache
def _recent() -> re.Pattern:
    """Finds a character outside the plane 0 of Unicode 3.2, or one whose kind (letter, number, other) has changed since.

    Libraries of any Unicode version agree on the kind of all others.
    """
    kind = lambda c: c[0] if c[0] in "LN" else "other"
    old = unicodedata.ucd_3_2_0.category
    stable = [c for c in map(chr, range(0x10000)) if old(c) not in ("Cn", "Cs") and kind(old(c)) == kind(unicodedata.category(c))]
    return re.compile("[^" + "".join(map(re.escape, stable)) + "]")


@functools.cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks share the cores already
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@functools.cache
def _ranks(path: str) -> dict[bytes, int] | None:
    """Tokens with their ids, if the file is a byte-level BPE whose merges are ranked by id; otherwise nothing."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    odd = spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")
    if model.get("type") != "BPE" or not plain or odd:
        return None
    # Byte-level vocabularies write bytes that don't print as the characters from 256 on, in order.
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in printed)}
    vocab = model["vocab"]
    merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    if merged != sorted(set(merged)) or len(vocab) != 256 + len(merged) or not all(c in vocab for c in char):
        return None
    return {bytes(char[c] for c in token): i for token, i in vocab.items()}


class Encoder:
    """Ids of texts by a byte-level BPE.

    The same vocabulary is run by the faster of two public libraries: tiktoken takes tokens by rank, which gives the
    tokenizer's ids where its merges are ranked by id. The pattern that cuts words looks ahead only in runs of white
    space. A run but its last character is a word of its own, as is a whole run at the end of the text, so texts
    are cut there and need no looking ahead. Texts with characters that Unicode versions may class differently, and
    all texts of other tokenizers, are encoded by the tokenizer itself.
    """

    def __init__(self, path: str):
        self.tokenizer, self.runs, ranks = _tokenizer(path), {}, _ranks(path)
        if ranks:
            import tiktoken

            self.words, self.whole = (tiktoken.Encoding("own", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (PATTERN, r"(?s:.+)"))
        else:
            self.words = None

    def _run(self, space: str) -> list[int]:
        if space not in self.runs:
            if len(self.runs) > REMEMBERED:
                self.runs.clear()
            self.runs[space] = self.whole.encode_ordinary(space)
        return self.runs[space]

    def _cut(self, text: str) -> list[int]:
        parts = _RUN.split(text)  # words and runs in turn
        ids = [self._run(p) if k % 2 else self.words.encode_ordinary(p) for k, p in enumerate(parts) if p]
        return list(itertools.chain.from_iterable(ids))

    def encode(self, text: str) -> np.ndarray:
        if self.words is None or not text.isascii() and _recent().search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self._cut(text) if _PAIR.search(text) else self.words.encode_ordinary(text), np.uint32)


class Packer:
    """Sequences of one task. A piece is (document, start, ids, tokens of its document, place of its first loss-bearing id)."""

    def __init__(self, task: int, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS):
        self.most = np.array([tokens, segments, loss], float)
        self.tokens, self.segments, self.loss = tokens, segments, loss
        self.waiting: list[tuple] = []
        self.needs = np.zeros((0, 3))
        self.sequence = task << 32
        self.out: list[tuple] = []

    def add(self, doc: object, ids: np.ndarray, silent: int = 1) -> None:
        """Ids of a document, of which the first silent ones bear no loss. It is cut into pieces that fit alone."""
        start = 0
        while start < len(ids):
            end = min(len(ids), start + self.tokens, max(start, silent) + self.loss)
            piece = (doc, start, ids[start:end], len(ids), silent)
            if end - start == self.tokens:
                self._close([piece])
            else:
                self._wait(piece)
            start = end
        while len(self.waiting) > WAITING:
            self._fill()

    def _need(self, piece: tuple) -> list[int]:
        _, start, ids, _, silent = piece
        return [len(ids), 1, max(0, start + len(ids) - max(start, silent))]

    def _wait(self, piece: tuple) -> None:
        self.waiting.append(piece)
        self.needs = np.vstack([self.needs, [self._need(piece)]])

    def _take(self, k: int) -> tuple:
        self.needs = np.delete(self.needs, k, axis=0)
        return self.waiting.pop(k)

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, of, _ in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), of, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def _fill(self, tokens: int | None = None) -> None:
        """Closes one sequence of that many tokens (all that a sequence holds, by default) from the waiting pieces."""
        left = np.array([tokens or self.tokens, self.segments, self.loss], float)
        pieces = []
        while left[0] >= 1 and left[1] >= 1 and self.waiting:
            fits = (self.needs <= left).all(axis=1)
            gain = (self.needs / self.most) @ (left / self.most)
            if fits.any() and (left[1] > 1 or fits.all()):
                piece = self._take(int(np.where(fits, gain, -1).argmax()))
            else:
                # Nothing that waits is small enough, or one segment is left: cut the piece of which most fits.
                room = np.array([self._room(p, left) for p in self.waiting])
                k = int(np.where(fits, -1, room + gain / (1 + gain.max())).argmax())
                if room[k] and not fits[k]:
                    doc, start, ids, of, silent = self._take(k)
                    piece = (doc, start, ids[: room[k]], of, silent)
                    self._wait((doc, start + room[k], ids[room[k] :], of, silent))
                elif fits.any():
                    piece = self._take(int(np.where(fits, gain, -1).argmax()))
                else:
                    break
            pieces.append(piece)
            left -= self._need(piece)
        self._close(pieces)

    def _room(self, piece: tuple, left: np.ndarray) -> int:
        """How many of a piece's ids fit."""
        _, start, ids, _, silent = piece
        return int(min(len(ids), left[0], max(silent - start, 0) + left[2]))

    def finish(self) -> None:
        """Places what waits: full sequences while there is enough, then powers of two."""
        while (total := int(self.needs[:, 0].sum())) >= self.tokens and len(self.waiting):
            self._fill()
        while total:
            self._fill(1 << (total.bit_length() - 1))
            total = int(self.needs[:, 0].sum())


def pack(docs: DataFrame, tokenizer: str, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, prompt: str | None = None) -> DataFrame:
    """Packs docs (doc_id, text): a row for each piece.

    prompt: for instruction data, the column of what stands before the text. Its ids come before those of the text and
    bear no loss; a null prompt is empty. Without one, all ids but the document's first bear loss.

    doc_id, start (its document's ids before it), length, ids_crc32 (of its ids as little-endian unsigned 32-bit
    numbers), doc_tokens (with the end id), sequence_id and offset in the sequence. A null text counts as empty; an
    empty one has the end id alone. Rows that repeat a doc_id are documents of their own. sequence_id is the task's
    number times 2**32 plus a running number. A sequence keeps to all three limits. If segments or loss run out while only
    short pieces wait, it is closed early and is padded.
    tokenizer: path of a tokenizer file that every worker can read.
    """

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    columns = ["doc_id", "text", *([prompt] if prompt else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        packer = Packer(TaskContext.get().partitionId() if TaskContext.get() else 0, tokens, segments, loss)

        def ready() -> pa.RecordBatch:
            rows, packer.out = packer.out, []
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names=names)

        for batch in batches:
            for doc, text, *before in zip(*batch.columns, strict=True):  # one text at a time as Python's
                first = encoder.encode(before[0].as_py() or "") if before else np.zeros(0, np.uint32)
                ids = np.concatenate([first, encoder.encode(text.as_py() or ""), np.array([END], np.uint32)])
                packer.add(doc.as_py(), ids, max(len(first), 1))
            yield ready()
        packer.finish()
        yield ready()

    rows = docs.select(F.col("doc_id").cast("long"), *[F.col(c).alias(f"text{i}") for i, c in enumerate(columns[1:])])
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))
