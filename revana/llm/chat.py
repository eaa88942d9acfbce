"""Chat formatting by columnar byte assembly.

A turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts
``<``, any number of backslashes and ``|`` get one more backslash, so no control
string can appear there, and taking one away restores the text. In roles
backslashes and line ends are escaped before that, for a role ends with its line.

A conversation is formatted in parts of up to ``PART_TURNS`` turn numbers; its
whole text is its parts in order. So a conversation of any length is spread over
tasks, and no Arrow buffer outgrows its limit.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from revana.llm.common import field, slices, utf8

START, END = "<|im_start|>", "<|im_end|>\n"
PART_TURNS = 64
TRAINED_ROLE = "assistant"
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)

FORMATTED = ("conv_id {kind}, part long, seq long, n_turns long, formatted string, "
             "loss array<struct<start:long,length:long>>")


def escape(text: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(text, r"<(\\*)\|", r"<\\\1|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: pa.Array) -> pa.Array:
    return escape(pc.replace_substring(pc.replace_substring(role, "\\", "\\\\"), "\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def assemble(columns: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of several byte columns written side by side into one buffer.

    ``columns`` are (bytes, offsets). Segment lengths give every segment its
    place by one cumulative sum; a scatter index per column then moves its bytes.
    """
    lengths = np.stack([np.diff(offsets) for _, offsets in columns], 1)
    ends = np.cumsum(lengths.ravel())
    places = (ends - lengths.ravel()).reshape(lengths.shape)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k, (data, offsets) in enumerate(columns):
        shift = np.repeat(places[:, k] - offsets[:-1], lengths[:, k])
        out[np.arange(len(data)) + shift] = data
    return out, np.concatenate([[0], ends[lengths.shape[1] - 1::lengths.shape[1]]])


def _constant(text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(text.encode(), np.uint8)
    return np.tile(raw, n), np.arange(n + 1) * len(raw)


def _characters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return run[offsets]


def _string_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """Rows (conv_id, part, seq, n_turns, formatted, loss): the conversations, in parts.

    Order by (part, seq). ``loss`` lists the spans of ``formatted``, in code
    points, that hold text of the trained role. Turns are ordered by turn number,
    null first, then role and text, so repeated turn numbers and repeated rows
    are all kept in a defined order. Null texts and roles are empty; a null
    conversation id is a conversation of its own; other columns are ignored.
    """
    kind = dict(turns.dtypes)[conv]
    rows = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = (rows.withColumn("part", F.floor(F.coalesce("turn", F.lit(-(1 << 62))) / PART_TURNS))
            .repartition("conv_id", "part")
            .sortWithinPartitions("conv_id", "part", F.col("turn").asc_nulls_first(), "role", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0             # rises along the sorted rows, so it orders the pieces of a part
        for batch in slices(batches):
            n = batch.num_rows
            trained = np.asarray(pc.equal(field(batch, "role"), TRAINED_ROLE).cast(pa.int8())).astype(bool)
            body, body_at = utf8(escape(field(batch, "text")))
            heads = [_constant(START, n), utf8(escape_role(field(batch, "role"))), _constant("\n", n)]
            data, at = assemble([*heads, (body, body_at), _constant(END, n)])
            conv_id = field(batch, "conv_id").to_pylist()
            part = np.asarray(field(batch, "part"))
            new = [i for i in range(n) if i == 0 or conv_id[i] != conv_id[i - 1] or part[i] != part[i - 1]]
            new.append(n)
            chars = _characters(data, at)
            length = np.diff(_characters(body, body_at))
            begin = chars[1:] - len(END) - length
            loss = []
            for a, b in zip(new, new[1:]):
                loss.append([{"start": int(begin[i] - chars[a]), "length": int(length[i])}
                             for i in range(a, b) if trained[i]])
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv_id[a] for a in new[:-1]], field(batch, "conv_id").type),
                 pa.array(part[new[:-1]], pa.int64()), pa.array(np.arange(seq, seq + len(loss)), pa.int64()),
                 pa.array(np.diff(new), pa.int64()), _string_array(data, at[new]),
                 pa.array(loss, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))],
                ["conv_id", "part", "seq", "n_turns", "formatted", "loss"])
            seq += len(loss)

    return rows.mapInArrow(run, FORMATTED.format(kind=kind))


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted part."""
    found = list(_TURN.finditer(formatted))
    if sum(m.end() - m.start() for m in found) != len(formatted):
        raise ValueError("not a formatted conversation")
    return [(unescape_role(m[1]), unescape(m[2])) for m in found]


class _Digest:
    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, formatted: str, loss: list[dict]) -> None:
        for role, text in parse(formatted):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n += 1
        for span in loss:
            text = unescape(formatted[span["start"]:span["start"] + span["length"]])
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation: what parsing its formatted parts gives, as digests.

    A hash over a whole conversation is sequential, so the parts of one
    conversation pass through one task; it keeps the running hash and one part.
    """
    kind = dict(formatted.dtypes)["conv_id"]
    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current, kind_of = None, None, None
        for batch in slices(batches, "formatted"):
            done = []
            kind_of = field(batch, "conv_id").type
            for row in batch.to_pylist():
                if state is None or row["conv_id"] != current:
                    if state is not None:
                        done.append((current, *state.row()))
                    state, current = _Digest(), row["conv_id"]
                state.add(row["formatted"], row["loss"])
            if done:
                yield _rows(done, names, kind_of)
        if state is not None:
            yield _rows([(current, *state.row())], names, kind_of)

    return rows.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
                                "loss_sha256 string, formatted_chars long")


def _rows(rows: list[tuple], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
