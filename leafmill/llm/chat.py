"""Chat formatting by columnar byte assembly, and its inverse.

Each turn becomes ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``.  Control strings in roles and texts
are escaped by one more backslash after the ``<`` of anything that looks like ``<|`` or
``<\\|``, ``<\\\\|`` and so on, so that no text can open or close a turn; a line break or
backslash in a role is written ``\\n`` or ``\\\\``.  Formatting gives the whole conversation as one
string and the byte spans of the (escaped) assistant texts as loss mask.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import column

OPEN, MIDDLE, CLOSE = b"<|im_start|>", b"\n", b"<|im_end|>\n"
SCHEMA = "conv_id long, formatted string, loss_spans array<struct<start:long,stop:long>>"


def escaped(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<(\\*)\|", r"<\\\1|")


def unescaped(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<\\(\\*)\|", r"<\1|")


def _raw(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array without nulls."""
    strings = pc.cast(strings, pa.large_string())
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All turns in one buffer; where each begins (with the end last), and each text's (start, stop) in it."""
    roles = pc.replace_substring(pc.replace_substring(escaped(pc.fill_null(roles, "")), "\\", "\\\\"), "\n", "\\n")
    (r, ro), (t, to) = _raw(roles), _raw(escaped(pc.fill_null(texts, "")))
    n = len(roles)
    fixed = [np.frombuffer(x, np.uint8) for x in (OPEN, MIDDLE, CLOSE)]
    length = np.empty((n, 5), dtype=np.int64)
    length[:, 0], length[:, 2], length[:, 4] = map(len, fixed)
    length[:, 1], length[:, 3] = np.diff(ro), np.diff(to)
    ends = np.cumsum(length.ravel()).reshape(n, 5)
    begin = ends - length
    out = np.empty(int(ends[-1, -1]) if n else 0, dtype=np.uint8)
    for k, piece in ((0, fixed[0]), (2, fixed[1]), (4, fixed[2])):
        out[(begin[:, k, None] + np.arange(len(piece))).ravel()] = np.tile(piece, n)
    for k, data, offsets in ((1, r, ro), (3, t, to)):
        out[np.arange(len(data)) + np.repeat(begin[:, k] - offsets[:-1], length[:, k])] = data
    return out, np.append(begin[:, 0], len(out)), np.stack([begin[:, 3], ends[:, 3]], 1)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: pa.Table | None = None

    def flush(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        ids = rows["conv_id"].to_numpy()
        buffer, begin, spans = assemble(rows["role"].chunk(0), rows["text"].chunk(0))
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        cuts = begin[np.append(first, len(ids))]
        loss = np.array(rows["role"].to_pylist(), dtype=object) == "assistant"
        conv = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ids))))[loss]
        relative = spans[loss] - cuts[conv][:, None]
        lists = np.searchsorted(conv, np.arange(len(first) + 1)).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids[first]),
                pc.cast(pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(cuts), pa.py_buffer(buffer)]), pa.string()),
                pa.ListArray.from_arrays(pa.array(lists), pa.StructArray.from_arrays([pa.array(relative[:, 0]), pa.array(relative[:, 1])], ["start", "stop"])),
            ],
            ["conv_id", "formatted", "loss_spans"],
        )

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        ids = held["conv_id"].to_numpy()
        done = int(np.searchsorted(ids, ids[-1])) if len(ids) else 0  # the last conversation may go on
        if done:
            yield flush(held.slice(0, done))
            held = held.slice(done)
    if held is not None and held.num_rows:
        yield flush(held)


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (byte offsets of assistant texts).

    turns needs conv_id, turn, role and text.  Turns go by turn, then role, then text, nulls
    first; repeated turns are all kept.  Null roles and texts are empty ones.  Rows without
    conv_id are left out, other columns are ignored, and an empty table gives no rows.  A
    conversation is one string, so one conversation must fit a task.
    """
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.drop("turn").mapInArrow(_format, SCHEMA)


def parse(formatted: bytes) -> tuple[list[str], list[str]]:
    """Roles and texts of a formatted conversation."""
    if not formatted:
        return [], []
    parts = formatted[len(OPEN) : -len(CLOSE)].split(CLOSE + OPEN)
    roles, texts = zip(*(p.decode().split("\n", 1) for p in parts))
    roles = ["\\".join(h.replace("\\n", "\n") for h in r.split("\\\\")) for r in roles]
    return _plain(roles), _plain(texts)


def _plain(texts) -> list[str]:
    return unescaped(pa.array(list(texts), pa.string())).to_pylist()


def read_conversations(formatted: DataFrame) -> DataFrame:
    """Digest of what formatting wrote, read back from the output alone.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, text, spans in zip(*(column(batch, c).to_pylist() for c in ("conv_id", "formatted", "loss_spans"))):
                raw = text.encode()
                roles, texts = parse(raw)
                turns = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in zip(roles, texts)).encode())
                loss = "".join(_plain([raw[s["start"] : s["stop"]].decode() for s in spans]))
                out.append((conv, len(roles), turns.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], names)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
