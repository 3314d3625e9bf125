"""Chat formatting with a template treated as a black box.

A template is any function from a list of (role, text) to a string. Successive
turn prefixes are rendered and consecutive outputs compared: what was added is
the new turn's span. Where an output does not continue the one before, the
template rewrites history; then spans are found in the last output alone. A
turn's own text is located by rendering it twice more with two different
one-character texts: the first place where these outputs differ is where the
text begins.

One row holds one conversation, as one row holds one document: what is
unbounded is their number. Rendering prefixes costs the square of the turns of
one conversation.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Turn = tuple[str, str]
Render = Callable[[Sequence[Turn]], str]
PROBES = ("\ue000", "\ue001")  # private-use stand-in texts; a template shows them as they are


@dataclass(frozen=True)
class Span:
    """A turn in the output: the whole turn and its text, both end exclusive in code points; -1 where it is not shown."""

    start: int
    end: int
    text_start: int
    text_end: int


def _text_place(render: Render, turns: Sequence[Turn], k: int, out: str) -> tuple[int, int]:
    """Where the text of turn ``k`` stands in ``out``, the rendering of ``turns``."""
    one, two = (render([*turns[:k], (turns[k][0], p), *turns[k + 1 :]]) for p in PROBES)
    if one == two:
        return -1, -1
    low, high = 0, min(len(one), len(two))
    while low < high:  # first difference
        middle = (low + high) // 2
        if one[: middle + 1] == two[: middle + 1]:
            low = middle + 1
        else:
            high = middle
    return low, low + len(out) - len(one) + 1


def locate_turns(render: Render, turns: Sequence[Turn], texts_of: set[str] | None = None) -> tuple[str, list[Span], bool]:
    """The formatted text, a span per turn, and whether the template rewrote earlier output.

    ``texts_of``: the roles whose texts are located too (all where None).
    """
    before, spans, rewrites = render([]), [], False
    for k in range(len(turns)):
        out = render(turns[: k + 1])
        if not out.startswith(before):
            rewrites = True
            break
        place = (-1, -1)
        if texts_of is None or turns[k][0] in texts_of:
            place = _text_place(render, turns[: k + 1], k, out)
        spans.append(Span(len(before), len(out), *place))
        before = out
    if not rewrites:
        return before, spans, False
    out = render(turns)
    places = [_text_place(render, turns, k, out) for k in range(len(turns))]
    # what lies between two texts cannot be told apart, so a span is its text
    return out, [Span(*p, *p) for p in places], True


CONTROL = ("<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[TURN]", "[AS]", "[/TURN]")
_control = re.compile("|".join(["\\\\", *map(re.escape, CONTROL)]))
_escaped = re.compile(r"\\(.)", re.DOTALL)
MARKS = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", "</s>")}


def escape(text: str) -> str:
    """Break control strings by a backslash after their first character; double backslashes."""
    return _control.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text)


def render_marked(turns: Sequence[Turn]) -> str:
    """The default template: marks around every turn, texts escaped; other roles are named in the output."""
    out = ["<s>"]
    for role, text in turns:
        if role in MARKS:
            begin, end = MARKS[role]
            out += [begin, escape(text), end]
        else:
            out += ["[TURN]", escape(role), "[AS]", escape(text), "[/TURN]"]
    return "".join(out)


def read_marked(formatted: str) -> list[Turn]:
    """The turns of a text that ``render_marked`` made."""
    turns, at = [], len("<s>")

    def upto(mark: str) -> str:
        nonlocal at
        end = formatted.index(mark, at)
        part, at = formatted[at:end], end + len(mark)
        return unescape(part)

    while at < len(formatted):
        if formatted.startswith("[TURN]", at):
            at += len("[TURN]")
            role = upto("[AS]")
            turns.append((role, upto("[/TURN]")))
            continue
        role = next(r for r, (begin, _) in MARKS.items() if formatted.startswith(begin, at))
        begin, end = MARKS[role]
        at += len(begin)
        turns.append((role, upto(end)))
    return turns


SPAN = "struct<role:string,start:int,end:int,text_start:int,text_end:int,loss:boolean>"


def format_chats(
    df: DataFrame, render: Render = render_marked, loss_roles: Sequence[str] = ("assistant",)
) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, spans, rewrites_history.

    ``df`` has conv_id, turn, role, text; other columns are ignored. Rows go by
    turn, null turns first, ties by role and text; repeated rows are repeated
    turns. Null role or text counts as empty, null conv_id is a conversation.
    A span's ``loss`` marks the turns whose text carries the loss.
    """
    parts = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = df.groupBy("conv_id").agg(F.sort_array(F.collect_list(parts)).alias("turns"))
    loss = set(loss_roles)
    schema = df.select("conv_id").schema.add("n_turns", "long").add("formatted", "string")
    schema = schema.add("spans", T.DataType.fromDDL(f"array<{SPAN}>")).add("rewrites_history", "boolean")
    span_type = pa.list_(
        pa.struct(
            [("role", pa.string()), *((n, pa.int32()) for n in ("start", "end", "text_start", "text_end")), ("loss", pa.bool_())]
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                texts, spans, again, counts = [], [], [], []
                for rows in part.column("turns").to_pylist():
                    turns = [(r["role"], r["text"]) for r in rows]
                    out, found, rewrites = locate_turns(render, turns, loss)
                    texts.append(out)
                    counts.append(len(turns))
                    again.append(rewrites)
                    spans.append([{"role": t[0], **vars(s), "loss": t[0] in loss} for t, s in zip(turns, found, strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv_id"), pa.array(counts, pa.int64()), pa.array(texts, pa.string()), pa.array(spans, span_type), pa.array(again, pa.bool_())],
                    schema.names,
                )

    return chats.mapInArrow(run, schema)


def read_chats(formatted: DataFrame, read: Callable[[str], list[Turn]] = read_marked, plain: Callable[[str], str] = unescape) -> DataFrame:
    """Add ``turns`` (role, text) and ``loss_texts``, both read back from the formatted text.

    A loss text is what lies under the loss mask, with escapes undone.
    """
    names = [c for c in formatted.columns if c not in ("turns", "loss_texts")]
    schema = formatted.select(*names).schema
    schema = schema.add("turns", T.DataType.fromDDL("array<struct<role:string,text:string>>"))
    schema = schema.add("loss_texts", T.ArrayType(T.StringType()))
    turn_type = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                texts = part.column("formatted").to_pylist()
                spans = part.column("spans").to_pylist()
                turns = [[{"role": r, "text": t} for r, t in read(x)] for x in texts]
                loss = [
                    [plain(x[s["text_start"] : s["text_end"]]) for s in row if s["loss"] and s["text_start"] >= 0]
                    for x, row in zip(texts, spans, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in names), pa.array(turns, turn_type), pa.array(loss, pa.list_(pa.string()))],
                    schema.names,
                )

    return formatted.select(*names).mapInArrow(run, schema)


def digests(chats: DataFrame) -> DataFrame:
    """Per conversation: turn count, digests of the turns and of the text under the loss mask, sizes in code points."""
    back = read_chats(format_chats(chats).drop("rewrites_history"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        "n_turns",
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
