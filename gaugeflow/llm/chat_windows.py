"""Chat formatting in budgeted windows.

Turns are escaped, measured in tokens and brought together by conversation.  Running sums
of their tokens choose spans of whole turns; each window repeats the system turn and a
limited history, and only the assistant turns that are new in it bear loss.  A task streams
over its sorted turns and holds one window at a time, so a conversation may be of any
length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import Columns, batchwise, text_or_empty
from gaugeflow.llm.token_counts import counter

# The template's control strings.  None is a part of another, and none begins as another ends.
REPEATED, OPEN, MIDDLE, CLOSE, REPLY, END = "[PAST]", "[INST]", "[:]", "[/INST]", "<s>", "</s>"
CONTROLS = (REPEATED, OPEN, MIDDLE, CLOSE, REPLY, END)
ASSISTANT, SYSTEM = "assistant", "system"

_TO_ESCAPE = re.compile("|".join(map(re.escape, ("\\", *CONTROLS))))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(
    rf"({re.escape(REPEATED)})?(?:{re.escape(REPLY)}(.*?){re.escape(END)}"
    rf"|{re.escape(OPEN)}(.*?){re.escape(MIDDLE)}(.*?){re.escape(CLOSE)})",
    re.DOTALL,
)


def escaped(text: str) -> str:
    """Doubles backslashes and breaks up control strings by one after their first character."""
    return _TO_ESCAPE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its text lies in it."""
    start = REPLY if role == ASSISTANT else f"{OPEN}{escaped(role)}{MIDDLE}"
    body = escaped(text)
    return (
        start + body + (END if role == ASSISTANT else CLOSE),
        len(start),
        len(start) + len(body),
    )


def turns_of(window: str) -> Iterator[tuple[bool, str, str]]:
    """Reads a formatted window back: (repeated, role, text) of each turn."""
    for turn in _TURN.finditer(window):
        past, reply, role, text = turn.groups()
        if reply is not None:
            yield past is not None, ASSISTANT, unescaped(reply)
        else:
            yield past is not None, unescaped(role), unescaped(text)


@dataclass
class Turn:
    role: str
    text: str
    start: int
    end: int
    tokens: int
    # Tokens where the turn is repeated, its mark included.
    again: int


@dataclass
class Windows:
    """Cuts one conversation's turns, given in order, into windows."""

    budget: int
    history_tokens: int
    history_turns: int
    key: object = None
    number: int = 0
    seen: int = 0
    system: Turn | None = None
    past: list[Turn] = field(default_factory=list)
    new: list[Turn] = field(default_factory=list)
    # The system turn, in windows that repeat it.
    lead: list[Turn] = field(default_factory=list)
    # Running sum of the tokens of this window's turns.
    used: int = 0

    def add(self, turn: Turn) -> Iterator[tuple]:
        if self.new and self.used + turn.tokens > self.budget:
            yield self.window()
            self.follow(turn)
        if not self.seen and not self.new and turn.role == SYSTEM:
            self.system = turn
        self.new.append(turn)
        self.used += turn.tokens

    def follow(self, turn: Turn) -> None:
        """Begin the next window: the system turn, and the latest turns that the history limits allow.

        Where the system turn leaves no room for the new one, it is not repeated.
        """
        past: list[Turn] = []
        fits = self.system is not None and self.system.again + turn.tokens <= self.budget
        self.lead = [self.system] if fits else []
        base = sum(t.again for t in self.lead)
        room = min(self.history_tokens, self.budget - base - turn.tokens)
        for earlier in reversed(self.past + self.new):
            room -= earlier.again
            if room < 0 or len(past) >= self.history_turns or earlier is self.system:
                break
            past.insert(0, earlier)
        self.seen += len(self.new)
        self.past, self.new = past, []
        self.used = base + sum(t.again for t in past)

    def window(self) -> tuple:
        repeated = self.lead + self.past
        parts, loss, at = [], [], 0
        for turn in repeated:
            parts += REPEATED, turn.text
        at = sum(map(len, parts))
        for turn in self.new:
            parts.append(turn.text)
            if turn.role == ASSISTANT:
                loss.append({"start": at + turn.start, "end": at + turn.end})
            at += len(turn.text)
        self.number += 1
        return (
            self.key, self.number - 1, self.seen, len(repeated), len(self.new), self.used,
            "".join(parts), loss,
        )


WINDOWS = (
    "conv_id long, window long, first_turn long, n_repeated long, n_new long, n_tokens long,"
    " text string, loss array<struct<start:long,end:long>>"
)


def chat_windows(
    conversations: DataFrame,
    path: str,
    budget: int = 1024,
    history_tokens: int = 256,
    history_turns: int = 2,
) -> DataFrame:
    """Windows of every conversation (conv_id, turn, role, text) in order: see ``WINDOWS``.

    ``loss`` holds the stretches of ``text`` (code points) that are targets: the escaped
    texts of assistant turns that are new in the window.  Each turn is new in one window.
    A turn above the budget has a window of its own and stays whole.  A system turn that leaves
    the next turn no room is not repeated there.  ``n_tokens`` adds up what the turns have
    one by one, marks of repetition included.  NULL texts and roles
    are empty; turns are ordered by number (NULL first), then role and text; repeated rows
    are turns of their own.  Rows without conv_id form one conversation.  Other columns are
    ignored; an empty table gives no window.
    """
    sizes = "tokens int, again int, start int, stop int, body string"

    @F.pandas_udf(sizes)
    def shaped(role: pd.Series, text: pd.Series) -> pd.DataFrame:
        tokens, rows = counter(path), []
        for r, t in zip(role, text):
            body, start, stop = formatted(r, t)
            rows.append((tokens(body), tokens(REPEATED + body), start, stop, body))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in sizes.split(", ")])

    order = ["conv_id", "turn", "role", "content"]
    turns = (
        conversations.select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.col("turn").cast("long").alias("turn"),
            text_or_empty("role").alias("role"),
            text_or_empty("text").alias("content"),
        )
        .withColumn("shape", shaped("role", "content"))
        .select(*order, "shape.*")
        .repartition("conv_id")
        .sortWithinPartitions(*order)
        .drop("turn", "content")
    )

    def cut(batches: Iterator[Columns]) -> Iterator[Columns]:
        now: Windows | None = None
        rows: list[tuple] = []
        for batch in batches:
            for key, role, *shape in zip(
                *(
                    batch[c]
                    for c in ("conv_id", "role", "body", "start", "stop", "tokens", "again")
                )
            ):
                if now is None or now.key != key:
                    if now is not None:
                        rows.append(now.window())
                    now = Windows(budget, history_tokens, history_turns, key)
                rows.extend(now.add(Turn(role, *shape)))
            yield _columns(rows)
        if now is not None:
            rows.append(now.window())
            yield _columns(rows)

    return turns.transform(batchwise(cut, WINDOWS))


def _columns(rows: list[tuple]) -> Columns:
    names = [c.split()[0] for c in WINDOWS.split(", ")]
    made = {name: [row[i] for row in rows] for i, name in enumerate(names)}
    rows.clear()
    return made


DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string,"
    " formatted_chars long, n_windows long"
)


def window_digest(windows: DataFrame) -> DataFrame:
    """One row per conversation, read back from windows in the order that ``chat_windows`` gives."""

    def digest(batches: Iterator[Columns]) -> Iterator[Columns]:
        now: dict | None = None
        for batch in batches:
            done = []
            for key, text, loss in zip(batch["conv_id"], batch["text"], batch["loss"]):
                if now is None or now["conv_id"] != key:
                    if now is not None:
                        done.append(now)
                    now = {
                        "conv_id": key, "n_turns": 0, "turns": hashlib.sha256(), "loss_chars": 0,
                        "loss": hashlib.sha256(), "formatted_chars": 0, "n_windows": 0,
                    }
                for repeated, role, said in turns_of(text):
                    if not repeated:
                        now["n_turns"] += 1
                        now["turns"].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    target = unescaped(text[span["start"] : span["end"]])
                    now["loss_chars"] += len(target)
                    now["loss"].update(target.encode("utf-8", "surrogatepass"))
                now["formatted_chars"] += len(text)
                now["n_windows"] += 1
            yield _digests(done)
        if now is not None:
            yield _digests([now])

    return windows.select("conv_id", "text", "loss").transform(batchwise(digest, DIGEST))


def _digests(done: list[dict]) -> Columns:
    rows = [
        d | {"turns_sha256": d["turns"].hexdigest(), "loss_sha256": d["loss"].hexdigest()}
        for d in done
    ]
    return {c: [r[c] for r in rows] for c in (x.split()[0] for x in DIGEST.split(", "))}
