r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and only its text trainable
(loss_start and loss_end, in code points of the example). Turns after the last assistant turn come as one more example
without a target, so the output holds every turn.

A turn is `<|role|>`, newline, text, `</s>`, newline. Inside texts and roles `\` becomes `\\`, and the first character of a
control string (`<|`, `</s>`, `[INST]`, `[/INST]`) becomes `\l` or `\b`; roles also lose `|` and newlines this way. So no
control string is left inside a text, and unescape() gives it back.

A conversation's rows meet in one task by a shuffle, sorted by turn, and are worked off as a stream: the worker holds the
prefix of one conversation and gives examples out in small batches. The examples' total length grows with the square of a
conversation's length, by the nature of the method.

Defined results: null text and role are empty; a null turn comes first; rows of one turn are ordered by role, then text; equal rows all count; rows
whose conv_id is null are one conversation; a conversation without assistant turns gives one example without a target; no
rows give none. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

_CONTROL = re.compile(r"\\|<(?=\||/s>)|\[(?=/?INST\])")
_ROLE = re.compile(r"[\\<\[|\n]")
_ESCAPE = {"\\": "\\\\", "<": "\\l", "[": "\\b", "|": "\\p", "\n": "\\n"}
_ESCAPED = re.compile(r"\\(.)", re.S)
_PLAIN = {v[1]: k for k, v in _ESCAPE.items()}
_TURN = re.compile(r"<\|(.*?)\|>\n(.*?)</s>\n", re.S)
EXAMPLE = "conv_id long, example int, n_turns int, text string, loss_start long, loss_end long"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"
BATCH_CHARS = 2 << 20


def escape(text: str, pattern: re.Pattern = _CONTROL) -> str:
    return pattern.sub(lambda m: _ESCAPE[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _PLAIN[m[1]], text)


def formatted(role: str | None, text: str | None) -> tuple[str, int, int]:
    """A turn, and where its text begins and ends in it."""
    head = f"<|{escape(role or '', _ROLE)}|>\n"
    body = escape(text or "")
    return f"{head}{body}</s>\n", len(head), len(head) + len(body)


def turns(text: str) -> list[tuple[str, str]]:
    """The (role, text) that an example holds."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


def _batched(rows, schema: pa.Schema, size):
    """Record batches of the rows, each of about BATCH_CHARS."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= BATCH_CHARS or len(held) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _rows(batches, *names):
    for b in batches:
        step = max(1, b.num_rows * BATCH_CHARS // max(1, b.nbytes))
        for i in range(0, b.num_rows, step):
            part = b.slice(i, step)
            yield from zip(*(part.column(n).to_pylist() for n in names), strict=True)


_EXAMPLE = pa.schema([("conv_id", pa.int64()), ("example", pa.int32()), ("n_turns", pa.int32()), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_examples", pa.int64())])


def _expand(batches):
    def examples():
        parts, length, count, made, open_turns, now = [], 0, 0, 0, False, object()
        for conv, role, text in _rows(batches, "conv_id", "role", "text"):
            if conv != now:
                if open_turns:
                    yield now, made, count, "".join(parts), None, None
                parts, length, count, made, now = [], 0, 0, 0, conv
            block, start, end = formatted(role, text)
            parts.append(block)
            count += 1
            open_turns = role != "assistant"
            if not open_turns:
                parts = ["".join(parts)]
                yield conv, made, count, parts[0], length + start, length + end
                made += 1
            length += len(block)
        if open_turns:
            yield now, made, count, "".join(parts), None, None

    yield from _batched(examples(), _EXAMPLE, lambda row: len(row[3]))


def expand(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 0), n_turns, text, loss_start, loss_end. A conversation's examples lie together, in order."""
    rows = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(_expand, EXAMPLE)


def _digest(batches):
    def conversations():
        now, last, turns_in, chars, made, loss, loss_chars = object(), None, 0, 0, 0, None, 0

        def row():
            h, n = hashlib.sha256(), 0
            for role, text in turns(last):
                h.update(f"{role}\n{text}\n".encode())
                n += 1
            if n != turns_in:
                raise ValueError(f"conversation {now}: {n} of {turns_in} turns read back")
            return now, n, h.hexdigest(), loss_chars, loss.hexdigest(), chars, made

        for conv, n, text, start, end in _rows(batches, "conv_id", "n_turns", "text", "loss_start", "loss_end"):
            if conv != now:
                if last is not None:
                    yield row()
                now, chars, made, loss, loss_chars = conv, 0, 0, hashlib.sha256(), 0
            last, turns_in = text, n
            chars += len(text)
            made += 1
            if start is not None:
                target = unescape(text[start:end])
                loss.update(target.encode())
                loss_chars += len(target)
        if last is not None:
            yield row()

    yield from _batched(conversations(), _DIGEST, lambda _: 200)


def read_back(examples: DataFrame) -> DataFrame:
    """From expand()'s output, as it lies: per conversation its turns, and the text under the loss mask, as digests."""
    return examples.mapInArrow(_digest, DIGEST)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    return read_back(expand(rows.unionByName(extra)))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (
  SELECT *, role = 'assistant' AS target,
    length(role) + 10 + length(text) + length(text) - length(replace(text, '\', ''))
      + (length(text) - length(replace(text, '<|', ''))) // 2 + (length(text) - length(replace(text, '</s>', ''))) // 4
      + (length(text) - length(replace(text, '[INST]', ''))) // 6 + (length(text) - length(replace(text, '[/INST]', ''))) // 7 AS block,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) = 1 AS final
  FROM c),
u AS (SELECT *, sum(block) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (target), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (target), '')) AS loss_sha256,
  sum(upto) FILTER (target OR final)::BIGINT AS formatted_chars,
  count(*) FILTER (target OR final) AS n_examples
FROM u GROUP BY conv_id
"""
