"""Chat formatting: conversations as text segments with loss flags.

A declarative template says what opens and closes the text of each role and whether it is trained on. A finite-state machine
over the roles checks the order of turns. Control strings of the template that occur inside texts are escaped by a backslash
behind their first character, and backslashes are doubled, so the output can be read back.

Conversations are dealt out by their id and sorted by turn, and stream through a task turn by turn: the machine keeps one state per
conversation, so a conversation of any length takes bounded memory. Output is a row per turn, in order, with its segments.

Results for odd input: a null text is an empty one; a null role is the empty role, whose text is formatted like that of any role
unknown to the template (no loss) and makes the order invalid; rows with a null conversation id are one conversation; turns that
repeat a number are ordered by role and text, and repeated rows are turns of their own; an empty table gives no rows; other columns
are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENTS = "array<struct<text:string,loss:boolean>>"


@dataclass(frozen=True)
class Template:
    """Per role: what opens its text, what closes it, and whether it is trained on; and the order of roles.

    ``order``: the roles that may follow each role; ``None`` stands for the start as a role and for the end as a follower.
    """

    roles: dict[str, tuple[str, str, bool]]
    order: dict[str | None, set[str | None]]
    other: tuple[str, str, str] = ("<<ROLE:", ">> ", " <</ROLE>>")
    extra_controls: tuple[str, ...] = ()
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        words = {w.strip() for a, b, _ in self.roles.values() for w in (a, b)} | {w.strip() for w in self.other} | set(self.extra_controls)
        object.__setattr__(self, "controls", tuple(sorted(w for w in words if len(w) > 1)))

    def escape(self, text: str) -> str:
        pattern = "|".join([r"\\", *map(re.escape, self._longest_first())])
        return re.sub(pattern, lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)

    def unescape(self, text: str) -> str:
        return re.sub(r"(?s)\\(.)", r"\1", text)

    def _longest_first(self) -> list[str]:
        return sorted(self.controls, key=len, reverse=True)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """Opening, text and closing of a turn; only the text can be under the loss."""
        if role in self.roles:
            opened, closed, loss = self.roles[role]
        else:
            opened, closed, loss = f"{self.other[0]}{self.escape(role)}{self.other[1]}", self.other[2], False
        return [(opened, False), (self.escape(text), loss), (closed, False)]

    def parse(self, formatted: str) -> tuple[str, str]:
        """Role and text of one formatted turn."""
        for role, (opened, closed, _) in self.roles.items():
            if formatted.startswith(opened) and formatted.endswith(closed) and len(formatted) >= len(opened) + len(closed):
                return role, self.unescape(formatted[len(opened) : len(formatted) - len(closed)])
        a, b, c = self.other
        if formatted.startswith(a) and formatted.endswith(c):
            role, _, rest = formatted[len(a) : len(formatted) - len(c)].partition(b)
            return self.unescape(role), self.unescape(rest)
        raise ValueError(f"not a formatted turn: {formatted[:40]!r}")


INSTRUCT = Template(
    roles={
        "system": ("<<SYS>> ", " <</SYS>>\n", False),
        "user": ("[INST] ", " [/INST]", False),
        "assistant": ("<s> ", " </s>\n", True),
    },
    order={None: {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user", None}},
)


def _sorted(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def format_chats(df: DataFrame, template: Template = INSTRUCT, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """A row per turn: ``conv_id, seq, segments, valid, ends``.

    ``seq`` counts the turns of a conversation, ``valid`` says whether the machine has taken all turns so far, and ``ends``
    whether a conversation that ended here would be complete.
    """
    rows = df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kinds = pa.schema([
        ("conv_id", pa.int64()), ("seq", pa.int64()), ("segments", pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))),
        ("valid", pa.bool_()), ("ends", pa.bool_()),
    ])

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seq, state, valid = object(), 0, None, True
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["conv_id"] != now:
                    now, seq, state, valid = row["conv_id"], 0, None, True
                valid = valid and row["role"] in template.order.get(state, ())
                state = row["role"]
                parts = [{"text": t, "loss": x} for t, x in template.segments(row["role"], row["text"])]
                out.append({"conv_id": now, "seq": seq, "segments": parts, "valid": valid, "ends": valid and None in template.order.get(state, ())})
                seq += 1
            yield pa.RecordBatch.from_pylist(out, kinds)

    return _sorted(rows, "turn", "role", "text").mapInArrow(formatted, f"conv_id long, seq long, segments {SEGMENTS}, valid boolean, ends boolean")


def read_back(formatted: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Per conversation, from ``conv_id, seq, segments`` alone: ``conv_id, n_turns``, digests of turns and trained text, and lengths.

    Digests are fed turn by turn, so no conversation is ever held whole.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    kinds = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_ = None, None

        def closed():
            return {"conv_id": now, "n_turns": open_[0], "turns_sha256": open_[1].hexdigest(), "loss_chars": open_[2], "loss_sha256": open_[3].hexdigest(), "formatted_chars": open_[4]}

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if open_ is None or row["conv_id"] != now:
                    if open_ is not None:
                        out.append(closed())
                    now, open_ = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                whole = "".join(s["text"] for s in row["segments"])
                role, text = template.parse(whole)
                trained = template.unescape("".join(s["text"] for s in row["segments"] if s["loss"]))
                open_[0] += 1
                open_[1].update(f"{role}\n{text}\n".encode())
                open_[2] += len(trained)
                open_[3].update(trained.encode())
                open_[4] += len(whole)
            yield pa.RecordBatch.from_pylist(out, kinds)
        if open_ is not None:
            yield pa.RecordBatch.from_pylist([closed()], kinds)

    return _sorted(formatted.select("conv_id", "seq", "segments"), "seq").mapInArrow(parsed, schema)
