"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as
context, and its text, alone, under the loss mask.  What stands behind the last
assistant turn (or a conversation without one) becomes an example with nothing
under the mask, so the output holds every turn.

Template: ``[SYS] text [/SYS]``, ``[INST] text [/INST]`` (user), ``<s> text </s>``
(assistant), ``[ROLE] role [TEXT] text [/ROLE]`` (any other role), one turn behind
the other.  In texts and roles a backslash is doubled and a control string gets a
backslash behind its first character, so no control string is left in them and
`unescape` gives back every text.

Turns are ordered by `turn` (nulls first), ties by role, then text.  Nulls: a
null text or role is empty; rows with a null id are one conversation.  Repeated
rows are repeated turns.  Empty tables give empty results.  Other columns aren't
used.  A very long text is formatted whole.  A task reads its conversations turn by turn and holds the formatted
prefix of one; an example is as long as its prefix, so the output of a
conversation grows with the square of its turns, as the expansion wants it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The strings that mark turns.
MARKS = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>")}
OTHER = ("[ROLE] ", " [TEXT] ", " [/ROLE]")
CONTROL = ("[SYS]", "[/SYS]", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[TEXT]", "[/ROLE]")
_GUARDED = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
_TURN = re.compile(r"\[SYS\] (.*?) \[/SYS\]|\[INST\] (.*?) \[/INST\]|<s> (.*?) </s>|\[ROLE\] (.*?) \[TEXT\] (.*?) \[/ROLE\]", re.DOTALL)


def escape(text: str) -> str:
    return _GUARDED.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def marked(role: str, text: str) -> tuple[str, int, int]:
    """A turn's marked text, and where its escaped text begins and ends there."""
    inner = escape(text)
    if role in MARKS:
        before, after = MARKS[role]
    else:
        before, after = OTHER[0] + escape(role) + OTHER[1], OTHER[2]
    return before + inner + after, len(before), len(before) + len(inner)


def parsed(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back from a formatted text."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        kind = m.lastindex
        if kind == 5:
            out.append((unescape(m[4]), unescape(m[5])))
        else:
            out.append((("system", "user", "assistant")[kind - 1], unescape(m[kind])))
        at = m.end()
    return out


_EXAMPLE = "conv_id {}, example int, text string, loss_start long, loss_end long"


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by conversation and turn."""
    now, prefix, example, tail, begun = None, "", 0, False, False
    kind = None
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        rows, out[:] = list(out), []
        types = [kind, pa.int32(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["conv_id", "example", "text", "loss_start", "loss_end"])

    size = 0
    for batch in batches:
        kind = batch.column(0).type
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), strict=True):
            if not begun or conv != now:
                if tail:
                    out.append((now, example, prefix, None, None))
                now, prefix, example, tail, begun = conv, "", 0, False, True
            turn, a, b = marked(role or "", text or "")
            a, b = a + len(prefix), b + len(prefix)
            prefix += turn
            tail = role != "assistant"
            if not tail:
                out.append((conv, example, prefix, a, b))
                example += 1
                size += len(prefix)
            if size > 1 << 22:
                yield flush()
                size = 0
    if tail:
        out.append((now, example, prefix, None, None))
    if out:
        yield flush()


def expand(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, example, text, loss_start, loss_end (code points; null where nothing is trainable); a conversation's examples follow each other."""
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"), F.col(turn_col).alias("turn"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(_expanded, _EXAMPLE.format(rows.schema["conv_id"].dataType.simpleString()))


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's digests from its examples, which follow each other: turns from the last, trained text from all."""
    now, begun, last, loss, chars, total, kind = None, False, "", hashlib.sha256(), 0, 0, None

    def report() -> tuple:
        turns = parsed(last)
        digest = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode())
        return now, len(turns), digest.hexdigest(), chars, loss.hexdigest(), total

    for batch in batches:
        kind, out = batch.column(0).type, []
        for conv, _, text, a, b in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if not begun or conv != now:
                if begun:
                    out.append(report())
                now, begun, loss, chars, total = conv, True, hashlib.sha256(), 0, 0
            last, total = text, total + len(text)
            if a is not None:
                trained = unescape(text[a:b])
                loss.update(trained.encode())
                chars += len(trained)
        if out:
            yield _digests(out, kind)
    if begun:
        yield _digests([report()], kind)


def _digests(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def chat_report(conversations: DataFrame) -> DataFrame:
    """Digests of each conversation, read back from the formatted examples."""
    examples = expand(conversations)
    kind = examples.schema["conv_id"].dataType.simpleString()
    return examples.mapInArrow(_read_back, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
