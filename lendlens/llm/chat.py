"""Chat formatting: any template that turns a list of turns into text, treated as a black box."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]

#: The marks around a turn.
OPEN, MIDDLE, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
_TURN = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(MIDDLE) + "(.*?)" + re.escape(CLOSE), re.DOTALL)
_PROBE = "probe"


def escape(text: str) -> str:
    r"""Doubles backslashes and turns ``<|`` into ``<\|``, so that no mark can occur in the result."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def marked(turns: Sequence[Turn]) -> str:
    """The template of this module: marked turns one after the other, roles and texts escaped."""
    return "".join(f"{OPEN}{escape(role)}{MIDDLE}{escape(text)}{CLOSE}" for role, text in turns)


def read_turns(formatted: str) -> list[Turn]:
    """The turns that ``marked`` has written."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def _agree(a: str, b: str) -> int:
    """Length of the common prefix."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def render_spans(turns: Sequence[Turn], template: Template) -> tuple[str, list[dict]]:
    """The text of all turns, and for each turn where its rendering and its own text lie.

    The template renders every prefix of the turns. What a prefix adds to the output of the one
    before is the span of its last turn. Where an output doesn't continue the one before, the
    template has rewritten history: every turn that reaches beyond the common part is marked
    ``rewritten`` and loses its spans (-1). The text inside a span is found by rendering the prefix
    again with a probe in place of the last text.
    """
    spans: list[dict] = []
    before = template([])
    for k in range(1, len(turns) + 1):
        now = template(turns[:k])
        common = _agree(before, now)
        span = {"start": len(before), "end": len(now), "text_start": -1, "text_end": -1, "rewritten": False}
        if common < len(before):
            for old in spans:
                if old["end"] > common:
                    old |= {"start": -1, "end": -1, "text_start": -1, "text_end": -1, "rewritten": True}
            span["start"] = common
        probed = template([*turns[: k - 1], (turns[k - 1][0], _PROBE)])
        at = probed.find(_PROBE, min(span["start"], len(probed)))
        tail = len(probed) - at - len(_PROBE)
        if at >= span["start"] and len(now) - tail >= at and now[:at] == probed[:at] and now[len(now) - tail :] == probed[at + len(_PROBE) :]:
            span |= {"text_start": at, "text_end": len(now) - tail}
        spans.append(span)
        before = now
    return before, spans


SPANS = "array<struct<role:string,start:int,end:int,text_start:int,text_end:int,rewritten:boolean,loss:boolean>>"


def format_conversations(
    df: DataFrame, template: Template = marked, loss_roles: Sequence[str] = ("assistant",), conv_id: str = "conv_id",
    turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and ``spans`` of its turns.

    Offsets count code points; ``loss`` marks turns whose text (text_start to text_end) is trained on.
    Rows are shuffled by conversation and sorted by turn within the partition; a task streams
    over its rows and holds one conversation at a time, whose text is one cell of the result.
    Rendering all prefixes costs the square of the turns of one conversation.

    Null role and text count as empty; a null ``conv_id`` is a conversation of its own. Equal turn
    numbers are ordered by role and text (nulls first), repeated rows are repeated turns, an empty
    table gives an empty result, and other columns are not read.
    """
    rows = df.select(
        df[conv_id].alias("conv_id"), df[turn].alias("turn"), df[role].alias("role"), df[text].alias("text")
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind, ids = dict(rows.dtypes)["conv_id"], to_arrow_type(rows.schema["conv_id"].dataType)
    loss = frozenset(loss_roles)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")))

        def batch_of(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(done, schema=out)

        span = pa.struct([("role", pa.string()), *((c, pa.int32()) for c in ("start", "end", "text_start", "text_end")), ("rewritten", pa.bool_()), ("loss", pa.bool_())])
        out = pa.schema([("conv_id", ids), ("formatted", pa.string()), ("spans", pa.list_(span))])
        done, size = [], 0
        for key, members in groupby(stream(), key=lambda r: r[0]):
            turns = [(r or "", t or "") for _, r, t in members]
            formatted, spans = render_spans(turns, template)
            for (name, _), s in zip(turns, spans):
                s |= {"role": name, "loss": name in loss and s["text_start"] >= 0}
            done.append({"conv_id": key, "formatted": formatted, "spans": spans})
            size += len(formatted)
            if size > 4_000_000:
                yield batch_of(done)
                done, size = [], 0
        yield batch_of(done)

    return ordered.mapInArrow(render, f"conv_id {kind}, formatted string, spans {SPANS}")


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (role, text), read from the text that ``marked`` wrote, and ``loss_text``: the
    unescaped text under the loss mask, in order. No shuffle."""
    kind = dict(formatted.dtypes)["conv_id"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            texts, spans = batch.column("formatted").to_pylist(), batch.column("spans").to_pylist()
            turns = [[{"role": r, "text": t} for r, t in read_turns(x)] for x in texts]
            loss = ["".join(unescape(x[s["text_start"] : s["text_end"]]) for s in own if s["loss"]) for x, own in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("formatted"), pa.array(turns, turn), pa.array(loss, pa.string())],
                ["conv_id", "formatted", "turns", "loss_text"],
            )

    return formatted.mapInArrow(read, f"conv_id {kind}, formatted string, turns array<struct<role:string,text:string>>, loss_text string")
