"""Chat formatting by columnar byte assembly.

Segment lengths, offsets and scatter indices of a whole batch are computed with numpy, and headers and
contents are copied into one buffer that becomes an Arrow string column. A turn reads
``[INST] role [/INST]text</s>``. Inside roles and texts a backslash follows each ``<`` before ``/`` or a
backslash and each ``[`` before ``I``, ``/`` or a backslash; taking it out again restores them, and no
control string can occur in them.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm.words import raw_bytes

OPEN, CLOSE, END = b"[INST] ", b" [/INST]", b"</s>"
FORMATTED = "conv_id long, formatted string, loss array<struct<first: long, last: long>>"
BLOCK = 4 << 20
_ESCAPED = re.compile(r"([<\[])\\")


def _escapes(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Which bytes a backslash must follow."""
    follow = np.zeros(len(data), np.uint8)
    follow[:-1] = data[1:]
    follow[begins[1:][begins[1:] > begins[:-1]] - 1] = 0
    slash = (follow == 47) | (follow == 92)
    return ((data == 60) & slash) | ((data == 91) & (slash | (follow == 73)))


class _Column:
    """A content column: where its escaped bytes go within each row."""

    def __init__(self, column: pa.Array):
        self.data, self.begins = raw_bytes(column)
        self.mark = _escapes(self.data, self.begins)
        self.place = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(1 + self.mark, out=self.place[1:])
        self.sizes = np.diff(self.place[self.begins])

    def put(self, out: np.ndarray, at: np.ndarray) -> None:
        to = self.place[:-1] + np.repeat(at - self.place[self.begins[:-1]], np.diff(self.begins))
        out[to] = self.data
        out[to[self.mark] + 1] = 92


def assemble(role: pa.Array, text: pa.Array, conversation: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Formatted text and loss spans (code points) of each conversation.

    ``conversation`` holds the first row of each, and the number of rows.
    """
    roles, texts = _Column(role), _Column(text)
    sizes = len(OPEN) + roles.sizes + len(CLOSE) + texts.sizes + len(END)
    start = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(start[-1], np.uint8)
    at = start[:-1].copy()
    for piece in (OPEN, roles, CLOSE, texts, END):
        if isinstance(piece, bytes):
            out[at[:, None] + np.arange(len(piece))] = np.frombuffer(piece, np.uint8)
            at += len(piece)
        else:
            piece.put(out, at)
            at += piece.sizes
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    base = np.repeat(points[start[conversation[:-1]]], np.diff(conversation))
    last = start[1:] - len(END)
    spans = [points[last - texts.sizes] - base, points[last] - base]
    learn = np.array(role.fill_null("").to_pylist(), object) == "assistant" if len(role) else np.zeros(0, bool)
    counts = np.concatenate([[0], np.cumsum(learn)])[conversation]
    formatted = pa.StringArray.from_buffers(len(conversation) - 1, pa.py_buffer(start[conversation].astype(np.int32).tobytes()), pa.py_buffer(out))
    struct = pa.StructArray.from_arrays([pa.array(s[learn]) for s in spans], ["first", "last"])
    return formatted, pa.ListArray.from_arrays(pa.array(counts, pa.int32()), struct)


def _formatted(rows: pa.RecordBatch):
    """Formats whole conversations in blocks of about ``BLOCK`` bytes."""
    ids = rows.column("conv_id")
    key, missing = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (missing[1:] != missing[:-1])]))
    begins = np.append(first, rows.num_rows)
    size = np.zeros(rows.num_rows + 1, np.int64)
    for name in ("role", "text"):
        size += raw_bytes(rows.column(name))[1]
    total = size[begins]
    a = 0
    while a < len(first):
        b = max(a + 1, int(np.searchsorted(total, total[a] + BLOCK, side="right")) - 1)
        part = rows.slice(begins[a], begins[b] - begins[a])
        formatted, loss = assemble(part.column("role"), part.column("text"), begins[a : b + 1] - begins[a])
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(first[a:b])), formatted, loss], ["conv_id", "formatted", "loss"])
        a = b


def _format(batches):
    held: list[pa.RecordBatch] = []  # rows of the conversation that the next batch may go on with
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column("conv_id").to_pylist()
        cut = len(ids) - 1
        while cut and ids[cut - 1] == ids[-1]:
            cut -= 1
        same = bool(held) and held[0].column("conv_id")[0].as_py() == ids[0]
        if cut == 0 and (same or not held):
            held.append(b)
            continue
        whole = held + ([b.slice(0, cut)] if cut else [])
        yield from _formatted(pa.concat_batches(whole))
        held = [b.slice(cut)]
    if held:
        yield from _formatted(pa.concat_batches(held))


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, formatted, loss``: one row a conversation, with the code points to learn from.

    Turns are taken by number, nulls first; turns that share one follow by role and text, and repeated
    rows are all kept. A null role or text is empty. Rows without a conversation id form one
    conversation. Only the role ``assistant`` is learned from, its text alone. Other columns are ignored;
    an empty table gives no rows. A conversation is one value and is formatted in one task; its turns
    arrive there sorted, in batches.
    """
    rows = turns.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text")
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn").mapInArrow(_format, FORMATTED)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    out = []
    for turn in formatted.split(END.decode())[:-1]:
        role, _, text = turn[len(OPEN) :].partition(CLOSE.decode())
        out.append((unescape(role), unescape(text)))
    return out


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader gets back from ``formatted`` and ``loss``, as counts and digests."""

    def run(batches):
        for b in batches:
            columns = [[] for _ in range(5)]
            for text, loss in zip(b.column("formatted").to_pylist(), b.column("loss").to_pylist()):
                turns = parse(text)
                learned = "".join(unescape(text[s["first"] : s["last"]]) for s in loss)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                values = len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text)
                for c, v in zip(columns, values):
                    c.append(v)
            names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["conv_id", *names])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
