"""Chat formatting in budgeted windows.

Prefix sums of the turns' tokens choose spans of whole turns: a window holds the system turn, as much history as
fits HISTORY tokens, and new turns up to BUDGET tokens in all. A turn's tokens are those of what is written for it: template,
role and escaped text. The system turn and the history of a later window repeat what an earlier one has; repeated turns are
masked, so that each assistant turn is a target once. Only a turn that is over the budget by itself or with the system turn
makes a window longer: it has one without history and is not cut. Conversations are read turn by turn in order; no
conversation is held as a whole.

Template: `<turn ROLE>`, newline, text, newline, `</turn>`, newline. In roles and texts a backslash goes before each
backslash and each control string (before `>` in roles as well), which unescape() undoes.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import col, staged, table
from quadrille.llm.tokens import encoder, public_path

VOCABULARY = "word_bpe_49k.json"
BUDGET = 2048
HISTORY = 512
WINDOW = "conv_id long, window long, text string, new_from int, n_turns int, mask array<struct<start:bigint,length:bigint>>"
_CONTROL = re.compile(r"\\|<turn |</turn>")
_ROLE = re.compile(r"\\|<turn |</turn>|>")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_MARK = re.compile(r"\\.|</turn>\n", re.DOTALL)
_OPEN = re.compile(r"<turn ((?:[^\\>]|\\.)*)>\n", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn, and where its text lies in it."""
    head, body = "<turn " + _ROLE.sub(lambda m: "\\" + m[0], role) + ">\n", escape(text)
    return f"{head}{body}\n</turn>\n", len(head), len(body)


def parse_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted window."""
    out, at = [], 0
    while at < len(text):
        m = _OPEN.match(text, at)
        if not m:
            raise ValueError("a turn does not begin here")
        end = next((x for x in _MARK.finditer(text, m.end()) if x[0][0] == "<"), None)
        if end is None or text[end.start() - 1] != "\n":
            raise ValueError("a turn does not end")
        out.append((unescape(m[1]), unescape(text[m.end() : end.start() - 1])))
        at = end.end()
    return out


class Windows:
    """Takes a conversation's turns one by one and gives its windows; holds the system turn, the history and the window."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system, self.turns, self.new_at, self.sums, self.n = None, deque(), 0, deque([0]), 0

    def add(self, role: str, text: str, cost: int):
        """Yields the window that this turn closes, if any. cost: tokens of the formatted turn; sums: their prefix sums, one more than turns."""
        if self.n == 0 and role == "system":
            self.system = (role, text, cost)
        self.n += 1
        fixed = self.system[2] if self.system else 0
        if len(self.turns) > self.new_at and fixed + self.sums[-1] - self.sums[0] + cost > self.budget:
            yield self.window()
            self.keep(min(self.history, max(0, self.budget - fixed - cost)))
        if not (self.n == 1 and role == "system"):
            self.turns.append((role, text))
            self.sums.append(self.sums[-1] + cost)

    def keep(self, room: int) -> None:
        """Leaves the longest run of last turns that fits the room."""
        first = bisect_left(self.sums, self.sums[-1] - room)
        for _ in range(first):
            self.turns.popleft()
            self.sums.popleft()
        self.new_at = len(self.turns)
        self.system_old = True

    system_old = False

    def window(self):
        """text, number of repeated turns at the front, turns, mask of the new assistant texts."""
        parts, mask, at, old = [], [], 0, 0
        if self.system:
            parts.append(self.system[:2])
        known = self.new_at + (len(parts) if self.system_old else 0)
        whole = parts + list(self.turns)
        out = []
        for i, (role, text) in enumerate(whole):
            new = i >= len(parts) + self.new_at or (i < len(parts) and not self.system_old)
            turn, start, length = format_turn(role, text)
            if new and role == "assistant":
                mask.append({"start": at + start, "length": length})
            old += not new
            out.append(turn)
            at += len(turn)
        assert old == known
        return "".join(out), old, len(whole), mask

    def end(self):
        if len(self.turns) > self.new_at or (self.system and not self.system_old):
            yield self.window()


def _by_conversation(df: DataFrame, order: list) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), *order)


def format_windows(turns: DataFrame, vocabulary: str | None = None, budget: int = BUDGET, history: int = HISTORY,
                   conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, window, text, new_from (turns repeated at the front), n_turns, mask (spans in code points).

    Turns go by number, null first; equal numbers by role, then text. Null roles and texts are empty; rows without a
    conversation form one of their own, null. Repeated rows are repeated turns. No rows in, none out. Texts of any length are
    kept whole. Other columns are not read, so their names do not matter. A conversation is one sequence: its turns
    pass through one task in order, whatever their number, a window at a time. With tokenizers that merge across a turn's
    end, a window may have fewer tokens than the sum of its turns.
    """
    vocabulary = vocabulary or public_path(VOCABULARY)
    schema = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("new_from", pa.int32()), ("n_turns", pa.int32()),
                        ("mask", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))])

    def run(batches):
        enc, state, key, k, rows = encoder(vocabulary), None, None, 0, []

        def put(windows):
            nonlocal k
            for text, old, n, mask in windows:
                rows.append({"conv_id": key, "window": k, "text": text, "new_from": old, "n_turns": n, "mask": mask})
                k += 1

        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if state is None or conv != key:
                    if state:
                        put(state.end())
                    state, key, k = Windows(budget, history), conv, 0
                put(state.add(role, text, len(enc.encode(format_turn(role, text)[0])) // 4))
                if len(rows) >= 256:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows.clear()
        if state:
            put(state.end())
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    text = lambda c: F.coalesce(col(c).cast("string"), F.lit(""))
    rows = turns.select(col(conv_col).cast("long").alias("conv_id"), col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    ordered = _by_conversation(rows, [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")])
    return ordered.select("conv_id", "role", "text").mapInArrow(run, WINDOW)


def read_back(windows: DataFrame) -> DataFrame:
    """What the windows say of each conversation: turns and their digest, text under the loss mask, characters."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches):
        key, state = None, None
        for batch in batches:
            done = []
            for conv, text, old, n, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "new_from", "n_turns", "mask"))):
                if state is None or conv != key:
                    if state:
                        done.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                found = parse_turns(text)
                if len(found) != n:
                    raise ValueError(f"conversation {conv}: a window has {len(found)} turns and not {n}")
                # New turns: behind the system turn and the history that the window repeats.
                for role, body in found[old:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode())
                for span in mask:
                    target = unescape(text[span["start"] : span["start"] + span["length"]])
                    state[2] += len(target)
                    state[3].update(target.encode())
                state[4] += len(text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)
        if state:
            row = (key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row, kinds)], names=names)

    ordered = _by_conversation(windows, [F.col("window")])
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op8_chat(spark, sf_dir) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit(r"\### Assistant: </turn> ok")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return read_back(staged(format_windows(turns.unionByName(more)), "windows"))
