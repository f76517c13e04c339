"""Chat formatting by incremental black-box rendering.

A template is any function from turns to a string. Successive prefixes of a conversation are rendered; where an output
begins with the one before it, what was added is the new turn's span. Where it does not, the template rewrites history:
such turns are counted and get no span. An unknown template is rendered over whole conversations, whose prefixes cost the
square of their turns. A template that is declared to render each turn for itself (per_turn) streams through a task in
segments of BLOCK turns; what it gives does not depend on BLOCK, and each border is rendered once more to check the claim.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Turns that a per_turn template renders as one, which bounds memory and the cost of the prefixes.
BLOCK = 1024
Turns = list[tuple[str, str]]

# fixed values: the template's control strings and what stands for them inside texts
_CODES = {"</s>": "\\e", "<s>": "\\s", "[INST]": "\\i", "[/INST]": "\\j", "\\": "\\\\", "\n": "\\n"}
_BACK = {v: k for k, v in _CODES.items()}
_TEXT = re.compile(r"</s>|<s>|\[INST\]|\[/INST\]|\\")
_ROLE = re.compile(_TEXT.pattern + r"|\n")
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str, pattern: re.Pattern = _TEXT) -> str:
    return pattern.sub(lambda m: _CODES[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[0]], text)


def inst_template(turns: Turns) -> str:
    """Assistant turns stand bare, every other turn in an instruction mark with its role."""
    return "".join(f"{escape(text)}</s>" if role == "assistant" else f"<s>[INST] {escape(role, _ROLE)}\n{escape(text)} [/INST]" for role, text in turns)


def read_turn(span: str) -> tuple[str, str, int, int]:
    """Role, text and the place of the escaped text in a turn's span of inst_template."""
    if span.startswith("<s>[INST] "):
        role, _, rest = span[10:].partition("\n")
        return unescape(role), unescape(rest[:-8]), 11 + len(role), len(span) - 8
    return "assistant", unescape(span[:-4]), 0, len(span) - 4


def turn_spans(render: Callable[[Turns], str], turns: Turns) -> tuple[str, list[tuple[int, int]]]:
    """The whole rendering and each turn's span in it; (-1, -1) for a turn that changed what stood before."""
    out, spans = render([]), []
    for k in range(1, len(turns) + 1):
        new = render(turns[:k])
        if new.startswith(out):
            spans.append((len(out), len(new)))
        else:
            spans = [s if new[s[0] : s[1]] == out[s[0] : s[1]] else (-1, -1) for s in spans] + [(-1, -1)]
        out = new
    return out, spans


#: No conversation yet; None is the id of one.
_NOBODY = "nobody"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_SEGMENTS = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(_SPAN)), ("rewrites", pa.int64())])


def format_conversations(turns: DataFrame, render: Callable[[Turns], str] = inst_template, per_turn: bool | None = None, block: int = BLOCK) -> DataFrame:
    """(conv_id, segment, formatted, spans, rewrites) of turns (conv_id, turn, role, text), each conversation's segments in
    order in one partition. per_turn holds for inst_template and for no other template unless it is given; without it a
    conversation is one segment. A template that turns out to be no per_turn one at a border raises ValueError.

    Null roles and texts are empty; equal turn numbers go by role and text, null ones first; repeated rows are repeated
    turns; null conv_ids make one conversation; an empty table gives none, and other columns are not read.
    """

    split = render is inst_template if per_turn is None else per_turn

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, number, held, out = _NOBODY, 0, [], []

        def close() -> None:
            if held:
                text, spans = turn_spans(render, held)
                out.append({"conv_id": conv, "segment": number, "formatted": text, "spans": [{"start": a, "end": b} for a, b in spans], "rewrites": sum(a < 0 for a, _ in spans)})
                held.clear()

        for batch in batches:
            for i, role, text in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
                full = split and len(held) == block
                if full and i == conv and render([held[-1], (role, text)]) != render(held[-1:]) + render([(role, text)]):
                    raise ValueError("per_turn does not hold for this template")
                if not held or i != conv or full:
                    close()
                    conv, number = i, number + 1 if i == conv else 0
                held.append((role, text))
                if len(out) >= 500:
                    yield pa.RecordBatch.from_pylist(out, schema=_SEGMENTS)
                    out.clear()
        close()
        yield pa.RecordBatch.from_pylist(out, schema=_SEGMENTS)

    empty = F.lit("")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"), F.col("turn").cast("long").alias("turn"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, segment long, formatted string, spans array<struct<start:long,end:long>>, rewrites long")


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites long"


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of each conversation, from the formatted text and spans of inst_template alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, turns, loss = None, hashlib.sha256(), hashlib.sha256()
        names = [x.split()[0] for x in _DIGEST.split(", ")]

        def row() -> list:
            return [now[0], now[1], turns.hexdigest(), now[2], loss.hexdigest(), now[3], now[4]]

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["segment"] == 0:
                    if now:
                        out.append(row())
                    now, turns, loss = [r["conv_id"], 0, 0, 0, 0], hashlib.sha256(), hashlib.sha256()
                for s in r["spans"]:
                    role, text, _, _ = read_turn(r["formatted"][s["start"] : s["end"]])
                    turns.update(f"{role}\n{text}\n".encode())
                    now[1] += 1
                    if role == "assistant":
                        loss.update(text.encode())
                        now[2] += len(text)
                now[3] += len(r["formatted"])
                now[4] += r["rewrites"]
            yield _batch(out, names)
        yield _batch([row()] if now else [], names)

    return segments.mapInArrow(run, _DIGEST)


def _batch(rows: list[list], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)))


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, CASE WHEN role = 'assistant' THEN 4 ELSE 19 + length(role) END + length(replace(replace(replace(replace(replace(text, '\', '\\'), '</s>', '\e'), '<s>', '\s'), '[INST]', '\i'), '[/INST]', '\j')) AS f FROM c)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(f) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS rewrites
FROM e GROUP BY conv_id
"""
