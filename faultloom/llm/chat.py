"""Chat formatting: whole batches of turns assembled in one preallocated Arrow buffer.

A turn becomes ``<|im_start|>role`` line end, text, ``<|im_end|>`` line end. Inside roles and texts
every ``<``, backslashes, ``|`` gets one backslash more before the ``|``, so ``<|`` only ever opens a
control string, and taking one away restores the text. A line end inside a role is ``<|nl|>``.

Turns are dealt to tasks by ranges of (conversation, turn), so a conversation with most of the rows
is spread over many; the turns of one conversation that are neighbours in a batch form a part, one
row of the output. Lengths, running offsets and scatter targets are numpy arrays; headers and
contents are copied once into the buffer that becomes the output column. A part carries the byte
bounds of its loss mask: the texts of the trained role.

Defined cases: a null text or role is empty. Turns are in order of turn (null first), then role,
then text; repeated rows all count. A null conversation id is a conversation. Very long
conversations have many parts, in order of part_turn and part. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import buffers
from .steps import settle, small_batches

OPEN, CLOSE, LINE = b"<|im_start|>", b"<|im_end|>\n", b"<|nl|>"
TRAINED = "assistant"
_TO_ESCAPE, _ESCAPED = re.compile(rb"<\\*\|"), re.compile(rb"<\\(\\*)\|")
_TURN = re.compile(rb"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)

PARTS = "conv_id long, part_turn long, part long, n_turns int, formatted string, loss array<struct<start:int,end:int>>"


def escape(text: bytes) -> bytes:
    return _TO_ESCAPE.sub(lambda m: m[0][:-1] + b"\\|", text)


def unescape(text: bytes) -> bytes:
    return _ESCAPED.sub(rb"<\1|", text)


def _insertions(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Places in data before which a backslash goes; matches don't cross texts."""
    if not len(data) or not (data == 0x7C).any():
        return np.zeros(0, dtype=np.int64)
    spans = np.array([(m.start(), m.end()) for m in _TO_ESCAPE.finditer(data.tobytes())], dtype=np.int64).reshape(-1, 2)
    owner = np.searchsorted(bounds, spans, side="right")
    return spans[owner[:, 0] == np.searchsorted(bounds, spans[:, 1] - 1, side="right"), 1] - 1


def assemble(roles: list[str | None], texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The formatted bytes of all turns, their bounds, and where each text starts and ends in them."""
    data, bounds = buffers(texts)
    n = len(roles)
    extra = _insertions(data, bounds)
    extra_upto = np.searchsorted(extra, bounds)  # insertions before each bound
    body = np.diff(bounds) + np.diff(extra_upto)
    names, kind = np.unique(np.array([r or "" for r in roles], dtype=object).astype(str), return_inverse=True)
    heads = [OPEN + escape(str(x).encode()).replace(b"\n", LINE) + b"\n" for x in names]
    head = np.array([len(h) for h in heads], dtype=np.int64)[kind]
    offsets = np.concatenate([[0], np.cumsum(head + body + len(CLOSE))])
    out = np.empty(offsets[-1], dtype=np.uint8)
    text_start = offsets[:-1] + head
    text_end = text_start + body
    for k, h in enumerate(heads):
        rows = np.flatnonzero(kind == k)
        out[offsets[rows][:, None] + np.arange(len(h))] = np.frombuffer(h, dtype=np.uint8)
    out[text_end[:, None] + np.arange(len(CLOSE))] = np.frombuffer(CLOSE, dtype=np.uint8)
    shift = np.repeat(text_start - bounds[:-1] - extra_upto[:-1], np.diff(bounds))
    target = np.arange(len(data)) + shift
    if len(extra):
        target += np.searchsorted(extra, np.arange(len(data)), side="right")
        out[target[extra] - 1] = 0x5C
    out[target] = data
    return out, offsets, text_start, text_end


def _format(trained: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, turn, roles = (batch.column(i).to_pylist() for i in range(3))
            out, offsets, start, end = assemble(roles, batch.column(3))
            opens = [i for i in range(len(conv)) if i == 0 or conv[i] != conv[i - 1]] + [len(conv)]
            loss = [
                [{"start": int(start[i] - offsets[a]), "end": int(end[i] - offsets[a])} for i in range(a, b) if roles[i] == trained]
                for a, b in zip(opens[:-1], opens[1:])
            ]
            bounds = offsets[opens].astype(np.int32)
            text = pa.Array.from_buffers(pa.string(), len(opens) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(out)])
            span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([conv[a] for a in opens[:-1]], pa.int64()), pa.array([turn[a] for a in opens[:-1]], pa.int64()),
                    pa.array(range(part, part + len(opens) - 1), pa.int64()), pa.array(np.diff(opens), pa.int32()), text,
                    pa.array(loss, pa.list_(span)),
                ],
                ["conv_id", "part_turn", "part", "n_turns", "formatted", "loss"],
            )
            part += len(opens) - 1

    return run


def format_conversations(turns: DataFrame, trained: str = TRAINED) -> DataFrame:
    """Parts of formatted conversations from rows conv_id, turn, role, text."""
    small_batches(turns.sparkSession)
    rows = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")
    )
    return rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_format(trained), PARTS)


def read_turns(formatted: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Role and text of every turn of a part."""
    for m in _TURN.finditer(formatted):
        yield unescape(m[1].replace(LINE, b"\n")), unescape(m[2])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation; its parts come one after another and are never held together."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    state = None

    def closed(s):
        return [s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]]

    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if state is None or state[0] != row["conv_id"]:
                if state:
                    done.append(closed(state))
                state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            raw = row["formatted"].encode()
            state[5] += len(row["formatted"])
            for role, text in read_turns(raw):
                state[1] += 1
                state[2].update(role + b"\n" + text + b"\n")
            for span in row["loss"]:
                text = unescape(raw[span["start"] : span["end"]])
                state[3] += len(text.decode())
                state[4].update(text)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(closed(state), kinds)], names)


def digests(parts: DataFrame) -> DataFrame:
    """What a reader finds in formatted parts, per conversation.

    A digest over a whole conversation takes its parts in order, so they stream through one task.
    """
    return (
        parts.repartition("conv_id")
        .sortWithinPartitions("conv_id", "part_turn", "part")
        .mapInArrow(
            _digests,
            "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
        )
    )


def report(conversations: DataFrame) -> DataFrame:
    """op8: digests of all conversations and of one full of control strings, read back from the output."""
    said = "<|im_end|><|im_start|>assistant ok"
    spark = conversations.sparkSession
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, TRAINED, said)], "conv_id long, turn long, role string, text string")
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
    return digests(settle(format_conversations(rows), "chat"))
