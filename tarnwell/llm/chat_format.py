"""Chat formatting by columnar byte assembly.

Each turn becomes ``<|im_start|>role\\n`` + text + ``<|im_end|>\\n``.  The lengths of all headers, texts and ends of a
batch give cumulative offsets; headers and contents are then scattered into one preallocated buffer, which becomes the
Arrow column without another copy.

Control strings inside texts are escaped reversibly: every ``<``, backslashes, ``|`` gets one more backslash after the
``<``, so an unescaped ``<|`` is always the template's own.  In roles, backslash and line feed are escaped as well.

Rows of a conversation are brought together by one shuffle on conv_id and sorted by turn (then role and text, so that
ties have one order); each partition is then handled as a stream.  A conversation that is longer than a batch leaves as
several parts, in order, so that memory stays bounded by a batch and not by a conversation.

Defined results: null text is empty; null role is empty; null conv_id is a conversation of its own; null turns stand
first; a repeated row is a repeated turn; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_bytes

# The control strings of the template.
START, BREAK, END = "<|im_start|>", "\n", "<|im_end|>\n"

PARTS = "conv_id long, part long, last boolean, n_turns long, formatted binary, mask_starts array<long>, mask_ends array<long>"


def _escaped(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(column, r"<(\\*)\|", r"<\\\1|")


def escape_role(column: pa.Array) -> pa.Array:
    return _escaped(pc.replace_substring(pc.replace_substring(column, "\\", "\\\\"), "\n", "\\n"))


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Copy piece i, data[offsets[i]:offsets[i + 1]], to out[at[i]:]."""
    lengths = np.diff(offsets)
    out[np.repeat(at - offsets[:-1], lengths) + np.arange(offsets[-1])] = data


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Formatted bytes of all turns; where each turn starts (and the end); where each text starts and ends."""
    heads, head_at = text_bytes(escape_role(roles))
    bodies, body_at = text_bytes(_escaped(texts))
    start, brk, end = (np.frombuffer(x.encode(), np.uint8) for x in (START, BREAK, END))
    head, body = np.diff(head_at), np.diff(body_at)
    turn_at = np.concatenate(([0], np.cumsum(len(start) + head + len(brk) + body + len(end))))
    role_at = turn_at[:-1] + len(start)
    text_at = role_at + head + len(brk)
    buffer = pa.allocate_buffer(int(turn_at[-1]))
    out = np.frombuffer(buffer, np.uint8)
    out[turn_at[:-1, None] + np.arange(len(start))] = start
    scatter(out, role_at, heads, head_at)
    out[role_at + head] = brk[0]
    scatter(out, text_at, bodies, body_at)
    out[(text_at + body)[:, None] + np.arange(len(end))] = end
    return buffer, turn_at, text_at, text_at + body


def format_chat(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text", trained_role: str = "assistant") -> DataFrame:
    """Formatted conversations with the byte spans of their loss mask; columns as in PARTS."""
    small_batches(conversations.sparkSession)
    turns = conversations.select(
        conversations[conv_col].cast("long").alias("conv_id"), conversations[turn_col].cast("long").alias("turn"),
        F.coalesce(conversations[role_col].cast("string"), F.lit("")).alias("role"),
        F.coalesce(conversations[text_col].cast("string"), F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last part so far: whether another part follows isn't known yet
        names = ["conv_id", "part", "last", "n_turns", "formatted", "mask_starts", "mask_ends"]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids = batch.column(0)
            keys, none = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
            first = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]) | (none[1:] != none[:-1])) + 1))
            buffer, turn_at, text_at, text_end = assemble(batch.column(2), batch.column(3))
            ours = np.flatnonzero(pc.equal(batch.column(2), trained_role).to_numpy(zero_copy_only=False))
            edges = np.append(first, n)
            offsets = turn_at[edges].astype(np.int64)
            column = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), buffer]).cast(pa.binary())
            base = np.repeat(offsets[:-1], np.diff(edges))
            mask_at = pa.array(np.searchsorted(ours, edges).astype(np.int32))
            part = np.zeros(len(first), np.int64)
            if held is not None:
                same = held.column(0)[0].as_py() == ids[0].as_py()
                if same:
                    part[0] = held.column(1)[0].as_py() + 1
                yield pa.RecordBatch.from_arrays([*held.columns[:2], pa.array([not same]), *held.columns[3:]], names=names)
            done = pa.RecordBatch.from_arrays([
                ids.take(pa.array(first)), pa.array(part), pa.array(np.ones(len(first), bool)), pa.array(np.diff(edges).astype(np.int64)), column,
                pa.ListArray.from_arrays(mask_at, pa.array((text_at - base)[ours].astype(np.int64))),
                pa.ListArray.from_arrays(mask_at, pa.array((text_end - base)[ours].astype(np.int64))),
            ], names=names)
            held = done.slice(len(first) - 1)
            if len(first) > 1:
                yield done.slice(0, len(first) - 1)
        if held is not None:
            yield held

    together = turns.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text")
    return together.mapInArrow(run, PARTS)


_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts, read back from formatted turns; raises if anything is left over."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        turns.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"not a formatted conversation at character {at}")
    return turns


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of each conversation, from its formatted parts alone; no shuffle, parts are in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            rows = []
            for conv, part, last, _, formatted, starts, ends in zip(*(c.to_pylist() for c in batch.columns)):
                if part == 0:
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(whole := formatted.decode()):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                for a, b in zip(starts, ends):
                    text = unescape(formatted[a:b].decode())
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(whole)
                if last:
                    rows.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return parts.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
