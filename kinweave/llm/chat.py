"""Chat formatting in budgeted windows.

A conversation is cut into windows of at most ``budget`` tokens.  Prefix sums
of the turns' token counts choose spans that begin and end at turns: a window
holds the latest system turn before it, whole turns of history that fit ``history`` tokens, and
as many new turns as fit the rest.  Only assistant texts among the new turns
are under the loss mask, so each is learned once however often it is repeated
as history.  A turn that is larger than the budget by itself is never cut; its
window is marked as over budget.

Turns are written ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside roles and
texts every ``<|`` gets a backslash between its characters, and one more if
there are some already, which no text can undo by accident and which is
reversed exactly.  Line breaks of a role are written ``\\n``.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.batches import bound_batches
from kinweave.llm.tokens import VOCABULARY, encoder
from kinweave.storage import shared_path

#: The template's control strings.
START, END = "<|im_start|>", "<|im_end|>\n"
BUDGET, HISTORY = 1024, 256
WINDOWS = "conv_id long, window_no long, text string, new_from long, loss array<struct<start:long,stop:long>>, n_new long, tokens long, over_budget boolean"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"

_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
_ROLE_MARK = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(written: str) -> str:
    return _ROLE_MARK.sub(lambda m: "\n" if m[1] == "n" else m[1], unescape(written))


@dataclass
class Turn:
    """One turn as written, and how many tokens it takes."""

    role: str
    written: str
    text_at: int
    text_len: int
    tokens: int


class _Conversation:
    """Cuts one conversation into windows as its turns arrive."""

    def __init__(self, conv_id: int | None, budget: int, history: int):
        self.conv_id, self._budget, self._history = conv_id, budget, history
        self._system: Turn | None = None
        self._recent: deque[Turn] = deque()
        self._recent_tokens = 0
        self._new: list[Turn] = []
        self._prefix = [0]
        self._base = 0
        self._windows = 0

    def _head(self, first: Turn) -> list[Turn]:
        """System turn and history of a window whose first new turn is given."""
        head = [self._system] if self._system else []
        room = self._budget - first.tokens - sum(t.tokens for t in head)
        back = list(self._recent)
        while back and sum(t.tokens for t in back) > max(0, min(room, self._history)):
            back.pop(0)
        return head + back

    def add(self, turn: Turn) -> Iterator[tuple]:
        """Take the next turn; yield the window that it closes, if any."""
        if self._new and self._base + self._prefix[-1] + turn.tokens > self._budget:
            yield self.close()
        if not self._new:
            self._base = sum(t.tokens for t in self._head(turn))
        self._new.append(turn)
        self._prefix.append(self._prefix[-1] + turn.tokens)

    def close(self) -> tuple:
        head = self._head(self._new[0])
        text = "".join(t.written for t in head)
        new_from, loss, parts, at = len(text), [], [text], len(text)
        for t in self._new:
            if t.role == "assistant":
                loss.append({"start": at + t.text_at, "stop": at + t.text_at + t.text_len})
            parts.append(t.written)
            at += len(t.written)
        tokens = sum(t.tokens for t in head) + self._prefix[-1]
        out = (self.conv_id, self._windows, "".join(parts), new_from, loss, len(self._new), tokens, tokens > self._budget)
        for t in self._new:
            if t.role == "system":  # the latest holds for all later windows
                self._system = t
                continue
            self._recent.append(t)
            self._recent_tokens += t.tokens
            while self._recent and self._recent_tokens > self._history:
                self._recent_tokens -= self._recent.popleft().tokens
        self._new, self._prefix = [], [0]
        self._windows += 1
        return out

    @property
    def open(self) -> bool:
        return bool(self._new)


def write_windows(conversations: DataFrame, path: str, vocabulary: str = VOCABULARY, budget: int = BUDGET, history: int = HISTORY) -> None:
    """Format all conversations (conv_id, turn, role, text) into windows at ``path``.

    Turns are ordered by (turn, role, text), null turns first; null roles and
    texts count as empty; repeated rows are turns of their own; rows without a
    conv_id form one conversation with a null id; other columns are ignored.
    Turns stream through in order, so memory holds one window, whatever the
    length of a conversation.
    """
    bound_batches(conversations.sparkSession)

    def form(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary)
        width = enc.dtype.itemsize
        now: _Conversation | None = None
        out: list[tuple] = []
        size = 0
        columns = [c.split()[0] for c in re.split(r", (?![^<]*>)", WINDOWS)]

        def flush() -> pd.DataFrame:
            return pd.DataFrame(out, columns=columns).astype({"conv_id": "Int64"})

        for rows in batches:
            for conv_id, role, text in zip(rows["conv_id"], rows["role"], rows["text"], strict=True):
                conv_id = None if pd.isna(conv_id) else int(conv_id)
                if now is None or now.conv_id != conv_id:
                    if now is not None and now.open:
                        out.append(now.close())
                    now = _Conversation(conv_id, budget, history)
                role, text = role or "", escape(text or "")
                head = f"{START}{_role_out(role)}\n"
                written = f"{head}{text}{END}"
                for window in now.add(Turn(role, written, len(head), len(text), len(enc.encode(written)) // width)):
                    out.append(window)
                    size += len(window[2])
                if size > 1 << 20:
                    yield flush()
                    out, size = [], 0
        if now is not None and now.open:
            out.append(now.close())
        if out:
            yield flush()

    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInPandas(form, WINDOWS).write.parquet(path)


@dataclass
class _Digest:
    """What the windows of one conversation add up to."""

    conv_id: int | None
    turns: int = 0
    loss_chars: int = 0
    chars: int = 0
    windows: int = 0
    turn_hash: object = field(default_factory=hashlib.sha256)
    loss_hash: object = field(default_factory=hashlib.sha256)

    def row(self) -> tuple:
        return (self.conv_id, self.turns, self.turn_hash.hexdigest(), self.loss_chars, self.loss_hash.hexdigest(), self.chars, self.windows)


def parse_window(text: str, new_from: int) -> list[tuple[str, str]]:
    """(role, text) of a window's new turns, as they were before formatting."""
    return [(_role_in(m[1]), unescape(m[2])) for m in _TURN.finditer(text, new_from)]


def read_windows(conversations_path: str, like: DataFrame) -> DataFrame:
    """Read written windows back: turns, text under the loss mask, sizes."""
    spark = like.sparkSession
    bound_batches(spark)

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: _Digest | None = None
        out: list[tuple] = []
        columns = [c.split()[0] for c in DIGESTS.split(", ")]
        for rows in batches:
            for conv_id, text, new_from, loss in zip(rows["conv_id"], rows["text"], rows["new_from"], rows["loss"], strict=True):
                conv_id = None if pd.isna(conv_id) else int(conv_id)
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        out.append(now.row())
                    now = _Digest(conv_id)
                for role, said in parse_window(text, new_from):
                    now.turns += 1
                    now.turn_hash.update(f"{role}\n{said}\n".encode())
                for span in loss:
                    said = unescape(text[span["start"] : span["stop"]])
                    now.loss_chars += len(said)
                    now.loss_hash.update(said.encode())
                now.chars += len(text)
                now.windows += 1
            if len(out) > 1000:
                yield pd.DataFrame(out, columns=columns).astype({"conv_id": "Int64"})
                out = []
        if now is not None:
            out.append(now.row())
        if out:
            yield pd.DataFrame(out, columns=columns).astype({"conv_id": "Int64"})

    windows = spark.read.schema(WINDOWS).parquet(conversations_path).select("conv_id", "window_no", "text", "new_from", "loss")
    return windows.repartition("conv_id").sortWithinPartitions("conv_id", "window_no").mapInPandas(digest, DIGESTS)


def formatted(conversations: DataFrame, vocabulary: str = VOCABULARY, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Write windows to the shared folder and return what reading them back gives."""
    path = shared_path(conversations.sparkSession, "chat-windows")
    write_windows(conversations, path, vocabulary, budget, history)
    return read_windows(path, conversations)
