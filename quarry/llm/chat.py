"""Chat formatting with offset-aligned loss masks.

Template: every turn is ``<|turn|>`` role ``<|text|>`` text ``<|end|>``. Control strings
inside roles and texts (the template's own and those of common chat formats) get a
backslash after their first character and every backslash is doubled, so the markers of a
rendered conversation are exactly those of the template and ``unescape`` gives the text
back.

Mask: a rendered conversation is encoded once with offsets. The markers are special
tokens, so no token crosses a border of a text; token spans are sorted, and the tokens of
an assistant text are the range between two binary searches for its span. The masked text
is read back from the token spans alone.

Markers also make the encoding of a whole equal to that of its parts cut before a turn, so
a long conversation is rendered and encoded in pieces of at least ``PIECE_CHARS``: a task
holds one piece, however long the conversation, and rows reach it sorted by Spark (which
spills).

Edge cases: a null role or text is empty; turns are ordered by turn, then role, then text,
nulls first (so ties and repeated rows have one order and are all kept); a null
conversation id is one conversation; an empty table gives an empty result; an empty
assistant text has no tokens and adds nothing; extra columns are ignored, whatever their
names.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.frames import col

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
PIECE_CHARS = 200_000

# Control strings of common chat formats.
CONTROL = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]

_TO_ESCAPE = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.DOTALL)


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"{TURN}{escape(role)}{TEXT}{escape(text)}{END}" for role, text in turns)


def parse(rendered: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn, start and end being the span of the escaped
    text in the rendered string."""
    for m in _TURN.finditer(rendered):
        yield unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)


class Encoder:
    """Byte-level BPE with the template's markers as special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, processors

        self.tok = Tokenizer.from_file(path)
        self.tok.add_special_tokens([TURN, TEXT, END])
        # keep a token's leading space in its span
        self.tok.post_processor = processors.ByteLevel(trim_offsets=False)

    def encode(self, rendered: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, n x 2 character spans)."""
        e = self.tok.encode(rendered, add_special_tokens=False)
        return np.array(e.ids, dtype=np.int64), np.array(e.offsets, dtype=np.int64).reshape(-1, 2)


def loss_mask(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True for the tokens that lie in one of the sorted, disjoint [start, end) ranges."""
    first = np.searchsorted(spans[:, 1], starts, side="right")
    stop = np.searchsorted(spans[:, 0], ends, side="left")
    delta = np.zeros(len(spans) + 1, dtype=np.int64)
    some = (starts < ends) & (first < stop)
    np.add.at(delta, first[some], 1)
    np.add.at(delta, stop[some], -1)
    return np.cumsum(delta[:-1]) > 0


def masked_ranges(spans: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The stretches of text that masked tokens cover, as sorted disjoint ranges. (Tokens
    that share the bytes of one character have equal spans: it is covered once.)"""
    s = spans[mask]
    if not len(s):
        return s
    reach = np.maximum.accumulate(s[:, 1])
    first = np.flatnonzero(np.append(True, s[1:, 0] > reach[:-1]))
    return np.stack([s[first, 0], reach[np.append(first[1:] - 1, len(s) - 1)]], axis=1)


def format_piece(turns: list[tuple[str, str]], enc: Encoder) -> dict:
    """Render and encode some turns: ``text``, ``ids``, ``spans``, ``mask``, and read
    back from these: ``turns`` and ``loss`` (the unescaped text under the mask)."""
    text = render(turns)
    ids, spans = enc.encode(text)
    back = list(parse(text))
    said = np.array([(a, b) for role, _, a, b in back if role == "assistant"], dtype=np.int64).reshape(-1, 2)
    mask = loss_mask(spans, said[:, 0], said[:, 1])
    loss = [unescape(text[a:b]) for a, b in masked_ranges(spans, mask)]
    return {"text": text, "ids": ids, "spans": spans, "mask": mask, "turns": [(r, t) for r, t, _, _ in back], "loss": loss}


def _sorted(conversations: DataFrame, conv_col, turn_col, role_col, text_col) -> DataFrame:
    rows = conversations.select(col(conv_col).cast("bigint").alias("conv_id"), col(turn_col).cast("bigint").alias("turn"),
                                col(role_col).alias("role"), col(text_col).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _pieces(batches, enc: Encoder):
    """(conversation, format_piece result or None at its end) over sorted rows."""
    now, turns, size, begun = None, [], 0, False
    for batch in batches:
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
            if begun and conv != now:
                if turns:
                    yield now, format_piece(turns, enc)
                yield now, None
                turns, size = [], 0
            elif size >= PIECE_CHARS:
                yield now, format_piece(turns, enc)
                turns, size = [], 0
            now, begun = conv, True
            turns.append((role or "", text or ""))
            size += len(role or "") + len(text or "")
    if begun:
        if turns:
            yield now, format_piece(turns, enc)
        yield now, None


def _stream(rows: DataFrame, tokenizer_path: str, make: Callable, schema: str) -> DataFrame:
    def run(batches):
        yield from make(_pieces(batches, Encoder(tokenizer_path)))
    return rows.mapInArrow(run, schema)


def format_conversations(conversations: DataFrame, tokenizer_path: str, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Training rows: ``conv_id``, ``piece`` (0, 1, ...), ``text`` (rendered), ``ids`` and
    ``loss`` (1 for tokens that count), one row per piece."""
    schema = "conv_id long, piece int, text string, ids array<int>, loss array<byte>"

    def make(pieces):
        n = 0
        for conv, p in pieces:
            if p is None:
                n = 0
                continue
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv], pa.int64()), pa.array([n], pa.int32()), pa.array([p["text"]]),
                 pa.array([p["ids"].astype(np.int32)], pa.list_(pa.int32())),
                 pa.array([p["mask"].astype(np.int8)], pa.list_(pa.int8()))],
                names=["conv_id", "piece", "text", "ids", "loss"])
            n += 1
    return _stream(_sorted(conversations, conv_col, turn_col, role_col, text_col), tokenizer_path, make, schema)


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
          "formatted_chars long, n_tokens long, loss_tokens long")


def digest(conversations: DataFrame, tokenizer_path: str, conv_col: str = "conv_id", turn_col: str = "turn",
           role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation, read back from the formatted pieces."""
    def make(pieces):
        rows, fresh = [], lambda: [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
        s = fresh()
        for conv, p in pieces:
            if p is None:
                rows.append((conv, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4], s[5], s[6]))
                s = fresh()
                if len(rows) >= 5000:
                    yield _batch(rows)
                    rows = []
                continue
            s[0] += len(p["turns"])
            s[1].update("".join(f"{r}\n{t}\n" for r, t in p["turns"]).encode("utf-8", "surrogatepass"))
            loss = "".join(p["loss"])
            s[2] += len(loss)
            s[3].update(loss.encode("utf-8", "surrogatepass"))
            s[4] += len(p["text"])
            s[5] += len(p["ids"])
            s[6] += int(p["mask"].sum())
        if rows:
            yield _batch(rows)
    return _stream(_sorted(conversations, conv_col, turn_col, role_col, text_col), tokenizer_path, make, DIGEST)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in DIGEST.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64() if kind == "long" else pa.string()) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)],
        names=[n for n, _ in fields])


#: The conversation that quotes control strings, added by the registered query.
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def query(conversations: DataFrame, tokenizer_path: str) -> DataFrame:
    names = ["conv_id", "turn", "role", "text"]
    probe = conversations.sparkSession.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return digest(conversations.select(*map(col, names)).unionByName(probe), tokenizer_path)
