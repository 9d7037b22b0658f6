"""Chat formatting by event-sourced reconstruction.

A conversation is a log of events (conv_id, seq, kind, turn, role, text), dealt
by conversation and sorted by sequence inside each task. A fold applies them:

* ``message``: a whole new message, after those there are;
* ``start``: an empty message for ``turn``, to be streamed;
* ``delta``: text appended to the last message of ``turn`` (which it starts if there is none);
* ``edit``: replaces the text of the last message of ``turn``; what came after it stays;
* ``regenerate``: drops the last message of ``turn`` and all after it, and starts that turn again.

The fold reads its partition as a stream and holds one conversation at a time.
Rendering gives ``formatted`` and the code point spans under the loss mask
(assistant texts). Reading back is :func:`parse`, which needs ``formatted`` only.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``. A control string inside a
text or role gets a backslash after its first character (one more if it had some),
so no control string stays inside a text, and taking one backslash away gives
the text back. In roles, line ends are written ``<|nl|>``, itself a control string.

Defined cases: null text or role is empty; null kind is ``message``; an unknown
kind raises; null seq sorts first, ties by kind, role and text; null conv_id is
a conversation; no events, no rows; an ``edit`` or ``regenerate`` of a turn that
is not there starts it; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The control strings that texts may not hold.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|nl|>"]
START, END, NEWLINE = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
_RAW = re.compile("|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in CONTROL))
_DONE = re.compile("|".join(re.escape(c[0]) + r"\\+" + re.escape(c[1:]) for c in CONTROL))


def escape(text: str) -> str:
    return _RAW.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _DONE.sub(lambda m: m[0][0] + m[0][2:], text)


def render(messages: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the spans of it that are under the loss mask."""
    out, at, spans = [], 0, []
    for role, text in messages:
        head = f"{START}{escape(role).replace(chr(10), NEWLINE)}\n"
        body = escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The messages that ``render`` was given."""
    out, at = [], 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        end = formatted.index(END, line + 1)
        role = unescape(formatted[at + len(START) : line].replace(NEWLINE, "\n"))
        out.append((role, unescape(formatted[line + 1 : end])))
        at = end + len(END)
    return out


def fold(messages: list[list], kind: str | None, turn: int | None, role: str | None, text: str | None) -> None:
    """Apply one event to ``messages``, a list of [turn, role, pieces]."""
    role, text, kind = role or "", text or "", kind or "message"
    if kind == "message":
        messages.append([turn, role, [text]])
        return
    if kind not in ("start", "delta", "edit", "regenerate"):
        raise ValueError(f"unknown event kind {kind!r}")
    at = next((i for i in range(len(messages) - 1, -1, -1) if messages[i][0] == turn), None)
    if kind == "start" or at is None:
        messages.append([turn, role, [text]])
    elif kind == "delta":
        messages[at][2].append(text)
    elif kind == "edit":
        messages[at][2] = [text]
    else:
        del messages[at + 1 :]
        messages[at] = [turn, role or messages[at][1], [text]]


OUT = "conv_id long, n_turns long, formatted string, loss_spans array<struct<start:long,end:long>>"
_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, messages, rows, size = object(), [], [], 0

    def done():
        text, spans = render([(r, "".join(t)) for _, r, t in messages])
        rows.append({"conv_id": conv, "n_turns": len(messages), "formatted": text, "loss_spans": [{"start": a, "end": b} for a, b in spans]})
        return len(text)

    first = True
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(5)]
        for cid, kind, turn, role, text in zip(*cols, strict=True):
            if first or cid != conv:
                if not first:
                    size += done()
                conv, messages, first = cid, [], False
                if size > 4_000_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows, size = [], 0
            fold(messages, kind, turn, role, text)
    if not first:
        done()
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def format_conversations(events: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans) from an event log."""
    log = events.select("conv_id", "seq", "kind", "turn", "role", "text")
    log = log.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "kind", "role", "text")
    return log.select("conv_id", "kind", "turn", "role", "text").mapInArrow(_rebuild, OUT)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for cid, formatted, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            turns, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
            messages = parse(formatted)
            for role, text in messages:
                turns.update(f"{role}\n{text}\n".encode())
            for s in spans or []:
                text = unescape(formatted[s["start"] : s["end"]])
                loss.update(text.encode())
                chars += len(text)
            out.append({"conv_id": cid, "n_turns": len(messages), "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": len(formatted)})
        yield pa.RecordBatch.from_pylist(out, schema=_DIGEST)


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trick = "</s>[INST] ok [/INST]"
    planted = spark.sql(f"select * from values (-7L, 0L, 'user', '{trick}'), (-7L, 1L, 'assistant', '{trick}') as t(conv_id, turn, role, text)")
    events = told.unionByName(planted).select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "turn", "role", "text")
    made = format_conversations(events).select("conv_id", "formatted", "loss_spans")
    return made.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e as (
  select *, [regexp_replace(regexp_replace(x, '<(\\*(?:s>|/s>|<SYS>>|</SYS>>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|nl\|>))', '<\\\1', 'g'), '\[(\\*/?INST\])', '[\\\1', 'g') for x in [role, text]] as x
  from t
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
       sum(length('<|im_start|>') + length(replace(x[1], chr(10), '<|nl|>')) + 1 + length(x[2]) + length('<|im_end|>') + 1)::bigint as formatted_chars
from e group by conv_id
"""
