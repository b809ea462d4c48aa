"""Chat formatting in budgeted windows.

Running sums of the turns' tokens (those of a tokenizer, or words) choose turn-aligned windows:
a window opens with the conversation's system turn and up to HISTORY of the turns before it,
and takes turns while the sum of the new ones stays within BUDGET. Repeated turns are masked,
so each assistant text is a target exactly once.

A window reads  <s>[INST]role[/INST]text</s>[INST]role[/INST]text</s>...  Control strings in
roles and texts get one backslash after their first character, those that have backslashes
there get one more, so the text can be read back and no text can close a turn.

Turns are sorted by conversation and number and pass through a task one after the other;
what is kept is one window, the system turn and a few turns of history, however long the
conversation.

Defined cases: a null text or role counts as empty; equal turn numbers are ordered by role
and text; repeated rows are turns of their own; a null conv_id is a conversation like any
other; a turn longer than the budget, however long, is a window of its own and is never cut;
an empty table gives no windows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .packing import token_count

#: Tokens (with one for the marks) of a window's new turns, and of its history and the most turns of that.
BUDGET, HISTORY_TOKENS, HISTORY = 512, 128, 2

_CONTROL = re.compile(r"([<\[])(\\*)(/?(?:s>|INST\]))")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?(?:s>|INST\]))")
_TURN = re.compile(r"\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


class _Writer:
    """Builds the windows of one conversation after the other from turns in order."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.window, self.system, self.history = conv_id, 0, None, []
        self.turns: list[tuple[str, str, int]] = []
        self.opened_at = self.fresh = 0

    def add(self, role: str, text: str, before: int, tokens: int) -> dict | None:
        """Takes a turn whose predecessors have `before` tokens; gives the window that it closes."""
        done = None
        if self.fresh and before + tokens - self.opened_at > BUDGET:
            done = self.close()
        if not self.fresh:
            self.opened_at = before
            kept, room = [], HISTORY_TOKENS
            for turn in reversed(self.history[-HISTORY:]):
                room -= turn[2]
                if room < 0:
                    break
                kept.insert(0, turn)
            self.turns = ([self.system] if self.system else []) + kept
            self.repeated = len(self.turns)
        self.turns.append((role, text, tokens))
        self.fresh += 1
        return done

    def close(self) -> dict:
        out, starts, lengths, at = ["<s>"], [], [], 3
        for k, (role, text, _) in enumerate(self.turns):
            head, body = f"[INST]{escape(role)}[/INST]", escape(text)
            at += len(head)
            if role == "assistant" and k >= self.repeated:
                starts.append(at)
                lengths.append(len(body))
            at += len(body) + 4
            out += [head, body, "</s>"]
        row = {"conv_id": self.conv_id, "window": self.window, "repeated": self.repeated, "turns": self.fresh, "text": "".join(out), "loss_start": starts, "loss_length": lengths}
        new = self.turns[self.repeated :]
        if self.window == 0 and self.system is None and new and new[0][0] == "system":
            self.system = new[0]
            new = new[1:]
        self.history = (self.history + new)[-HISTORY:]
        self.window += 1
        self.turns, self.fresh = [], 0
        return row


_WINDOW = "window long, repeated long, turns long, text string, loss_start array<long>, loss_length array<long>"


def _tokens(tokenizer: str | None) -> Column:
    if tokenizer is None:
        return F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    return F.pandas_udf(lambda texts: texts.map(lambda text: token_count(text, tokenizer)), "long")("text")


def windows(conversations: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """A row for each window: conv_id, window, repeated (turns that are masked), turns (new
    ones), text, loss_start, loss_length. Sorted by conversation within partitions. tokenizer
    is the path of a vocabulary; without it, a turn's tokens are its words."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = conversations.select("conv_id", F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tokens", _tokens(tokenizer) + 1)
    upto = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("before", F.sum("tokens").over(upto) - F.col("tokens"))
    rows = rows.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text", "before", "tokens")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer, columns = None, ["conv_id", "window", "repeated", "turns", "text", "loss_start", "loss_length"]
        for batch in batches:
            done = []
            for conv_id, role, text, before, tokens in zip(*(batch[c].astype(object) for c in batch), strict=True):
                conv_id = None if pd.isna(conv_id) else conv_id
                if writer is None or writer.conv_id != conv_id:
                    if writer:
                        done.append(writer.close())
                    writer = _Writer(conv_id)
                done.append(writer.add(role, text, before, tokens))
            yield pd.DataFrame([x for x in done if x], columns=columns).astype({"conv_id": object})
        if writer:
            yield pd.DataFrame([writer.close()], columns=columns).astype({"conv_id": object})

    return rows.mapInPandas(write, f"conv_id {kind}, {_WINDOW}")


def read_back(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """One row for each conversation, from the windows alone: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars, n_windows. Windows that were stored, or come from
    elsewhere, are first brought together and sorted; those that windows() just gave are
    in_order already. A conversation that lacks a window raises."""
    if not in_order:
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    kind = formatted.schema["conv_id"].dataType.simpleString()
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None
        for batch in batches:
            done = []
            for conv_id, window, repeated, text, starts, lengths in zip(*(batch[c].astype(object) for c in ("conv_id", "window", "repeated", "text", "loss_start", "loss_length")), strict=True):
                conv_id = None if pd.isna(conv_id) else conv_id
                if conv_id != now or state is None:
                    if state:
                        done.append(_result(now, state))
                    now, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                if window != state[5]:
                    raise ValueError(f"conversation {conv_id}: window {window} instead of {state[5]}")
                for role, body in _TURN.findall(text)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{unescape(role)}\n{unescape(body)}\n".encode("utf-8", "surrogatepass"))
                for start, length in zip(starts, lengths, strict=True):
                    target = unescape(text[start : start + length])
                    state[2] += len(target)
                    state[3].update(target.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
                state[5] += 1
            yield pd.DataFrame(done, columns=columns).astype({"conv_id": object})
        if state:
            yield pd.DataFrame([_result(now, state)], columns=columns).astype({"conv_id": object})

    return formatted.mapInPandas(read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


def _result(conv_id, state: list) -> tuple:
    turns, of_turns, chars, of_loss, formatted, n = state
    return conv_id, turns, of_turns.hexdigest(), chars, of_loss.hexdigest(), formatted, n
