"""Chat formatting with offset-aligned loss masks (operator 5).

A turn is rendered as ``### role:`` + newline + fence + text + fence + ``</turn>`` + newline. The characters that control
strings need (backslash, ``#``, ``<``, ``|``) are escaped by a backslash in roles and texts, colons also in roles, so no
text can open or close a turn or hold the fence, and reading the output gives back roles and texts exactly. The fence is a
special token of the tokenizer: it cuts the text before any merge, so tokens never straddle a text's edge, and whole turns
can be encoded in segments of bounded size with the ids that the whole conversation would have in one piece.

A segment is encoded once with offsets; the loss mask marks the tokens that the sorted spans of assistant texts meet,
found by binary search.

Edge cases: null roles and texts are empty; null turns come first; equal turns are ordered by role and text, repeats kept;
rows with a null conversation form one conversation; other columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Pieces, default_tokenizer
from .common import once as _once

FENCE = "<|endoftext|>"
#: Characters of rendered text that a segment holds at least before it is closed; more only by its last turn.
SEGMENT_CHARS = 1 << 20
_escape = re.compile(r"[\\#<|]")
_escape_role = re.compile(r"[\\#<|:]")
_unescape = re.compile(r"\\(.)", re.S)
_turn = re.compile(r"### ((?:[^\\:]|\\.)*):\n" + re.escape(FENCE) + r"((?:[^\\<]|\\.)*)" + re.escape(FENCE) + r"</turn>\n", re.S)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and the span of its text in it."""
    head = f"### {_escape_role.sub(r'\\\g<0>', role)}:\n{FENCE}"
    body = _escape.sub(r"\\\g<0>", text)
    return f"{head}{body}{FENCE}</turn>\n", len(head), len(head) + len(body)


def parse(rendered: str) -> list[tuple[str, str]]:
    """Roles and texts; raises ValueError on text that no rendering gives."""
    out, at = [], 0
    for m in _turn.finditer(rendered):
        if m.start() != at:
            raise ValueError(f"no turn at character {at}")
        out.append((_unescape.sub(r"\1", m[1]), _unescape.sub(r"\1", m[2])))
        at = m.end()
    if at != len(rendered):
        raise ValueError(f"no turn at character {at}")
    return out


def mask(spans: list[tuple[int, int]], offsets: np.ndarray) -> np.ndarray:
    """Marks of the tokens (rows of start and end, sorted) that meet one of the sorted spans."""
    out = np.zeros(len(offsets), np.uint8)
    for s, e in spans:
        if e > s:
            out[np.searchsorted(offsets[:, 1], s, side="right") : np.searchsorted(offsets[:, 0], e, side="left")] = 1
    return out


class _Library:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path).encode


def _format(path: str, learned: str, segment_chars: int):
    names = ["conv_id", "segment", "n_turns", "text", "ids", "mask"]

    def close(conv, number, turns):
        text, spans, at = "".join(t[0] for t in turns), [], 0
        for rendered, s, e, role in turns:
            if role == learned:
                spans.append((at + s, at + e))
            at += len(rendered)
        got = _once(_Library, path).encode(text, add_special_tokens=False)
        marks = mask(spans, np.array(got.offsets, np.int64).reshape(-1, 2))
        return (conv, number, len(turns), text, np.array(got.ids, "<u4").tobytes(), marks.tobytes())

    def run(batches):
        conv, number, turns, size, begun = None, 0, [], 0, False
        for batch in batches:
            out = []
            for c, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True):
                if turns and (c != conv or size >= segment_chars):
                    out.append(close(conv, number, turns))
                    number, turns, size = number + 1, [], 0
                if c != conv or not begun:
                    conv, number, begun = c, 0, True
                turns.append((*render(role or "", text or ""), role or ""))
                size += len(turns[-1][0])
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], _SCHEMA)
        if turns:
            yield pa.RecordBatch.from_pylist([dict(zip(names, close(conv, number, turns), strict=True))], _SCHEMA)

    return run


_SCHEMA = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("n_turns", pa.int64()), ("text", pa.string()), ("ids", pa.binary()), ("mask", pa.binary())])


def format_conversations(turns: DataFrame, tokenizer: str | None = None, learned: str = "assistant", segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """Rows of turns (conv_id, turn, role, text) to segments: ``conv_id``, ``segment``, ``n_turns``, ``text``, ``ids`` (u32), ``mask`` (u8 for each id).

    A conversation's segments, in order, are the conversation; all but very long ones have one. They leave in the order
    of conversation and segment within each partition.
    """
    read = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    ordered = read.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_format(tokenizer or default_tokenizer(), learned, segment_chars), "conv_id long, segment long, n_turns long, text string, ids binary, mask binary")


def _digest(path: str):
    """Segments in order to one row for each conversation; holds one segment and two running digests."""

    def run(batches):
        pieces, open_, conv = _once(Pieces, path), None, None

        def row():
            n, turns, chars, loss, formatted = open_
            return {"conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": formatted}

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if open_ is None or r["segment"] == 0:
                    if open_:
                        out.append(row())
                    conv, open_ = r["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(r["text"]):
                    open_[0] += 1
                    open_[1].update(f"{role}\n{text}\n".encode())
                learned = np.frombuffer(r["ids"], "<u4")[np.frombuffer(r["mask"], np.uint8) > 0]
                loss = _unescape.sub(r"\1", pieces.join(learned)[0].decode())
                open_[2] += len(loss)
                open_[3].update(loss.encode())
                open_[4] += len(r["text"])
            if out:
                yield pa.RecordBatch.from_pylist(out, _DIGEST)
        if open_:
            yield pa.RecordBatch.from_pylist([row()], _DIGEST)

    return run


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def op5_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return format_conversations(table.unionByName(more)).mapInArrow(_digest(default_tokenizer()), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


OP5_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok', 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok', 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS loss_sha256,
  sum(40 + length(regexp_replace(role, '[\\#<|:]', 'xx', 'g')) + length(regexp_replace(text, '[\\#<|]', 'xx', 'g')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""
