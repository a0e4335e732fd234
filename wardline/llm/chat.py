"""Chat formatting: a finite-state machine over roles writes each turn as segments with loss flags.

Template, per turn: an opening segment, the escaped text, a closing segment. Control strings inside roles
and texts get a backslash, as do backslashes, so the output can be read back exactly.

Rows are dealt out by conversation and read in the order (turn, role, text), so a task holds one turn at a
time: a conversation of any length needs constant memory, though the turns of one conversation follow each
other in one task, as their digests are sequential.

Defined results: null role or text is empty; unknown roles are formatted like any other, without loss, and
make the conversation invalid from there on; an order that the machine does not allow does the same; a null
conversation id is a conversation of its own; repeated rows are turns of their own; columns other than
conv_id, turn, role and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

OPEN, BETWEEN, CLOSE = "### ", ": ", " </turn>\n"
#: role: does its text count for the loss
LOSS = {"system": False, "user": False, "assistant": True, "tool": False}
#: state: the roles that may follow, each named as the next state
NEXT = {
    "start": {"system", "user"},
    "system": {"user"},
    "user": {"assistant"},
    "assistant": {"user", "tool"},
    "tool": {"assistant", "tool"},
}
_CONTROL = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_TURN = re.compile(r"### ((?:\\\\|\\###|\\</turn>|\\:|[^\\:])*): ", re.S)

SEGMENTS = "conv_id long, turn long, valid boolean, segments array<struct<text: string, loss: boolean>>"
_ARROW = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("turn", pa.int64()),
        ("valid", pa.bool_()),
        ("segments", pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))),
    ]
)


def escape(s: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m.group(), s)


def unescape(s: str) -> str:
    return _ESCAPED.sub(r"\1", s)


def format_turn(role: str, text: str) -> list[dict]:
    return [
        {"text": f"{OPEN}{escape(role)}{BETWEEN}", "loss": False},
        {"text": escape(text), "loss": LOSS.get(role, False)},
        {"text": CLOSE, "loss": False},
    ]


def read_turn(written: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    head = _TURN.match(written)
    if not head or not written.endswith(CLOSE):
        raise ValueError("not a formatted turn")
    return unescape(head.group(1)), unescape(written[head.end() : -len(CLOSE)])


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, state = (), "start"
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for conv, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if at != (conv,):
                at, state = (conv,), "start"
            state = role if role in NEXT.get(state, ()) else "invalid"
            for column, value in zip(out, (conv, turn, state != "invalid", format_turn(role, text))):
                column.append(value)
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, _ARROW)], schema=_ARROW)


def format_chats(turns: DataFrame) -> DataFrame:
    """A row for each turn with its segments; rows of a conversation lie together and in order."""
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")]
    turns = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *text)
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_formatted, SEGMENTS)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid")
    at, now = (), None

    def row():
        n, turns, chars, loss, written, valid = now
        values = (at[0], n, turns.hexdigest(), chars, loss.hexdigest(), written, valid)
        return pa.RecordBatch.from_pylist([dict(zip(names, values))], schema=_DIGEST)

    for batch in batches:
        done = []
        for conv, valid, segments in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
            if at != (conv,):
                if at:
                    done.append(row())
                at, now = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, True]
            written = "".join(s["text"] for s in segments)
            role, text = read_turn(written)
            loss = "".join(unescape(s["text"]) for s in segments if s["loss"])
            now[0] += 1
            now[1].update(f"{role}\n{text}\n".encode())
            now[2] += len(loss)
            now[3].update(loss.encode())
            now[4] += len(written)
            now[5] = now[5] and valid
        yield from done
    if at:
        yield row()


_DIGEST = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
        ("valid", pa.bool_()),
    ]
)
DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, valid boolean"
)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, from the formatted output in the order ``format_chats`` gives."""
    return formatted.mapInArrow(_digests, DIGEST)


PROBE = r"\### Assistant: </turn> ok"


def with_probe(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """The conversations and one more that is made of control strings."""
    probe = spark.createDataFrame(
        [(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string"
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)
