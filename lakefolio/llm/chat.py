"""Chat formatting that is proved by a grammar round trip.

Grammar of a formatted conversation (no white space beyond what is shown):

    conversation := turn*
    turn         := "[INST] " text " [/INST]"          role user
                  | " " text "</s>"                    role assistant, in the loss
                  | "[SYS] " text " [/SYS]"            role system
                  | "[ROLE] " role "[:] " text " [/ROLE]"  any other role

A control string is one of the bracketed words or `</s>`. Texts hold none: the
escaped form has a backslash after the opening character, and the parser takes
one backslash out of every control string with one or more (`[\\INST]` reads as
`[INST]`). A turn is first rendered as it is; the parser reads it back; while
the turn read differs from the source, the conflicting strings are escaped and
the turn is rendered again. Turns delimit themselves, so a conversation is its
turns' renderings in order and each turn is rendered and checked where it is
read; only the digest of a conversation needs its turns in order, and takes them
as a sorted stream of which one turn is held at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OPEN = {"user": "[INST] ", "assistant": " ", "system": "[SYS] "}
_CLOSE = {"user": " [/INST]", "assistant": "</s>", "system": " [/SYS]"}
_CONTROL = re.compile(r"([\[<])(\\*)(/?INST\]|/?SYS\]|/?ROLE\]|:\]|/s>)")
_RAW = re.compile(r"\[/?(?:INST|SYS|ROLE)\]|\[:\]|</s>")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[1] + "\\" + m[2] + m[3], text)


def unescape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[1] + m[2][1:] + m[3], text)


def parse(formatted: str) -> list[tuple[str, str, bool]] | None:
    """(role, text, in the loss) of every turn; None if the grammar has no such
    conversation. Deterministic: the first characters name the production."""
    turns, at = [], 0
    while at < len(formatted):
        for role in ("user", "system", "assistant", ""):
            if formatted.startswith(_OPEN.get(role, "[ROLE] "), at):
                break
        else:
            return None
        at += len(_OPEN.get(role, "[ROLE] "))
        name = role
        if not role:
            end = _RAW.search(formatted, at)
            if not end or end.group() != "[:]" or not formatted.startswith(" ", end.end()):
                return None
            name, at = unescape(formatted[at : end.start()]), end.end() + 1
        close = _CLOSE.get(role, " [/ROLE]")
        end = _RAW.search(formatted, at)
        if not end or end.group() != close.strip() or not formatted.startswith(close, stop := end.end() - len(close)) or stop < at:
            return None
        turns.append((name, unescape(formatted[at:stop]), role == "assistant"))
        at = end.end()
    return turns


def _rendered(role: str, text: str) -> str:
    if role in _OPEN:
        return f"{_OPEN[role]}{text}{_CLOSE[role]}"
    return f"[ROLE] {role}[:] {text} [/ROLE]"


def render(role: str, text: str) -> str:
    """One turn, escaped only as far as the round trip asks for."""
    wanted, known = [(role, text, role == "assistant")], role in _OPEN
    for role_form, text_form in ((role, text), (role, escape(text)), (role if known else escape(role), escape(text))):
        out = _rendered(role_form, text_form)
        if parse(out) == wanted:
            return out
    raise AssertionError("an escaped turn always reads back")


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, formatted) of every row. Null roles and texts are
    empty. Other columns are ignored."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [render(r, t) for r, t in zip(frame["role"], frame["text"])]
            yield frame.assign(formatted=out)[["conv_id", "turn", "role", "formatted"]]

    rows = conversations.select(
        F.col("conv_id").cast("string"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    out = rows.mapInPandas(run, "conv_id string, turn long, role string, formatted string")
    return out.withColumn("conv_id", F.col("conv_id").cast(conversations.schema["conv_id"].dataType))


class _Digest:
    def __init__(self):
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str) -> None:
        for role, text, in_loss in parse(formatted):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if in_loss:
                self.loss_chars += len(text)
                self.loss.update(text.encode("utf-8", "surrogatepass"))
        self.formatted_chars += len(formatted)

    def row(self, conv) -> tuple:
        return conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from the output of `turns`.

    Turns are taken by number, nulls first; equal numbers by role and text.
    Repeated rows are turns of their own. Null ids are one conversation.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for frame in frames:
            done = []
            for conv, text in zip(frame["conv_id"], frame["formatted"]):
                if state is None or conv != last:
                    if state:
                        done.append(state.row(last))
                    last, state = conv, _Digest()
                state.add(text)
            yield pd.DataFrame(done, columns=names)
        if state:
            yield pd.DataFrame([state.row(last)], columns=names)

    kind = formatted.schema["conv_id"].dataType
    keyed = formatted.withColumn("conv_id", F.col("conv_id").cast("string"))
    ordered = keyed.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted").select("conv_id", "formatted")
    out = ordered.mapInPandas(run, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumn("conv_id", F.col("conv_id").cast(kind))
