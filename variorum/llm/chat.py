"""Chat formatting by columnar byte assembly, and reading the result back."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, BODY, END = b"<|turn|>", b"\n", b"<|end|>\n"
#: What no text may hold as it stands: our own marks and those of common templates.
#: A backslash after its first character takes a control string's meaning away.
_CONTROL = r"(\||/?INST\]|/?s>|</?SYS>>)"
_ESCAPE = rf"([<\[])(\\*){_CONTROL}"
_UNESCAPE = re.compile(rf"([<\[])\\(\\*){_CONTROL}")
_TURN = re.compile(rb"<\|turn\|>([^\n]*)\n(.*?)<\|end\|>\n", re.S)

SCHEMA = "id long, formatted string, loss array<struct<start:long,end:long>>"


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, _ESCAPE, r"\1\\\2\3")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def _role(texts: pa.Array) -> pa.Array:
    """Roles stand on one line: line ends and backslashes in them are written \\n and \\\\."""
    return escape(pc.replace_substring(pc.replace_substring(texts, "\\", "\\\\"), "\n", "\\n"))


def _unrole(text: str) -> str:
    return re.sub(r"\\([\\n])", lambda m: "\n" if m[1] == "n" else "\\", unescape(text))


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = pa.concat_arrays([column.cast(pa.large_binary())])
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offs


def assemble(conv: np.ndarray, roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Turns in order, conv numbering their conversations from 0 without a gap.

    Gives the bytes of all conversations, where each conversation ends, and the
    start and end of each turn's text within its conversation.
    """
    n = len(conv)
    named = roles.dictionary_encode()
    heads = [TURN + x + BODY for x in _role(named.dictionary).cast(pa.binary()).to_pylist()]
    code = named.indices.to_numpy(zero_copy_only=False)
    head_data, head_at = np.frombuffer(b"".join(heads) + END, np.uint8), np.cumsum([0, *map(len, heads)])
    body, offs = _bytes(escape(texts))
    lens = np.empty((n, 3), np.int64)
    lens[:, 0], lens[:, 1], lens[:, 2] = np.diff(head_at)[code], np.diff(offs), len(END)
    ends = np.cumsum(lens.ravel()).reshape(n, 3)
    starts = ends - lens
    out = np.empty(int(ends[-1, 2]) if n else 0, np.uint8)

    def scatter(source: np.ndarray, begin: np.ndarray, column: int) -> None:
        k = lens[:, column]
        within = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
        out[np.repeat(starts[:, column], k) + within] = source[np.repeat(begin, k) + within]

    scatter(head_data, head_at[:-1][code], 0)
    scatter(body, offs[:-1], 1)
    scatter(head_data, np.full(n, head_at[-1]), 2)
    last = np.flatnonzero(np.append(conv[1:] != conv[:-1], True)) if n else np.zeros(0, int)
    conv_ends = ends[last, 2]
    base = np.concatenate([[0], conv_ends[:-1]])[conv] if n else np.zeros(0, int)
    return out, conv_ends, starts[:, 1] - base, ends[:, 1] - base


def _format(table: pa.Table, trained: str) -> pa.RecordBatch:
    ids = table.column("id").combine_chunks()
    same = pc.equal(ids[1:], ids[:-1]).fill_null(False).to_numpy(zero_copy_only=False) | (pc.is_null(ids[1:]).to_numpy(zero_copy_only=False) & pc.is_null(ids[:-1]).to_numpy(zero_copy_only=False))
    first = np.append(True, ~same)
    conv = np.cumsum(first) - 1
    roles, texts = (pa.concat_arrays(table.column(c).chunks).fill_null("") for c in ("role", "text"))
    data, ends, start, end = assemble(conv, roles, texts)
    loss = np.flatnonzero(pc.equal(roles, trained).to_numpy(zero_copy_only=False))
    per = np.bincount(conv[loss], minlength=len(ends))
    spans = pa.StructArray.from_arrays([pa.array(start[loss]), pa.array(end[loss])], ["start", "end"])
    text = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
    return pa.RecordBatch.from_arrays([ids.filter(pa.array(first)), text, pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per)).astype(np.int32)), spans)], names=["id", "formatted", "loss"])


def _formatter(trained: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the conversation that may go on in the next batch
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = batch.column(0).to_pylist()
            cut = batch.num_rows
            while cut and ids[cut - 1] == ids[-1]:
                cut -= 1
            if held and held[-1].column(0)[0].as_py() == ids[-1] and cut == 0:
                held.append(batch)
                continue
            if held and ids[0] != held[-1].column(0)[0].as_py():
                yield _format(pa.Table.from_batches(held), trained)
                held = []
            if cut or held:
                done = [*held, batch.slice(0, cut)] if cut else held
                yield _format(pa.Table.from_batches([x for x in done if x.num_rows]), trained)
            held = [batch.slice(cut)]
        if held:
            yield _format(pa.Table.from_batches(held), trained)

    return run


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: str = "assistant") -> DataFrame:
    """(id_col, formatted, loss): one row per conversation; loss has byte spans of formatted.

    The spans are the escaped texts of the turns whose role is `trained`. Turns are
    ordered by turn, nulls first; ties by role and text. Null roles and texts are
    empty. Rows with a null id make up one conversation. A conversation is one row
    of the result, so one task holds it; all else streams.
    """
    own = turns.select(F.col(id_col).cast("long").alias("id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    ordered = own.repartition("id").sortWithinPartitions("id", "turn", "role", "text")
    return ordered.select("id", "role", "text").mapInArrow(_formatter(trained), SCHEMA).withColumnRenamed("id", id_col)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of each turn of a formatted conversation."""
    return [(_unrole(r.decode()), unescape(t.decode())) for r, t in _TURN.findall(formatted.encode())]


def read_loss(formatted: str, spans: list[dict]) -> list[str]:
    data = formatted.encode()
    return [unescape(data[x["start"] : x["end"]].decode()) for x in spans]
