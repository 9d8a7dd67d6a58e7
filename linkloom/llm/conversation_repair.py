"""Repair of conversations by cheapest edits: secondary-sorted streams that carry the state across batches.

Rows are partitioned by conversation and sorted by turn inside of partitions; one pass reads each conversation
as a stream of pandas batches. The roles must come out as nothing, or as an optional system turn and pairs of user and
assistant. That is an automaton of four states, and for each of them the pass carries the least cost of all edits
so far, and which of the states' cheapest edit strings comes first in ASCII order. Both are enough to go on: strings that
end with an edit of a row are never beginnings of each other, so their order decides every later tie.

What led to a state is kept as one byte for each row and state. A conversation that fits in SPILL_ROWS is
traced back at its end. For a longer one the bytes are spilled as rows of a table in the shared folder, and the
texts, of which four running digests (one for each state) have taken in all that they need, are let go.
A second pass reads the blocks of such conversations from last to first, carries the state across batches
again and puts the edits together. So a conversation of any length takes bounded memory but for its own result.

* Null roles and texts count as one space; null turns come first. Rows of one turn are ordered by role, then text.
* Edits: K(eep), R(erole), D(elete), I(nsert). Blank rows and repeats of an earlier role and text must go.
* Ties go to the edits that are least in ASCII order. Whole texts are read.
* A conversation without rows, or with none left, has zeros, no edits, and the digest of nothing. Rows without a
  conversation id are one conversation of that id. An empty table gives an empty result.
* Repeated rows are repeats of the conversation. Other columns are not looked at.
* One conversation is one stream in one task, as the method has it; its sort spills to disk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.llm.common import stored, table

#: Costs of the edits, and of leaving a row in that ends in the middle of a sentence.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rows and characters of a conversation that are held before they are spilled.
SPILL_ROWS = 1 << 16
SPILL_CHARS = 1 << 22

#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
WANTED = {START: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
LEGAL = {"su", "ua", "au"}
LETTERS = "DKR"
FAULTS = SOUND, BLANK, DUPLICATE, CUT = range(4)

GAP = r"\x20\x09-\x0D"


def kept_state(state: int, initial: str) -> int | None:
    """State after a row that is kept with its role."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def inserted(state: int, times: int) -> int:
    for _ in range(times):
        state = WANTED[state][0]
    return state


class Steps:
    """What a row does to the four states, remembered by the few kinds of states and rows that there are."""

    def __init__(self) -> None:
        self.known: dict[tuple, tuple] = {}

    def step(self, states: tuple, initial: str, fault: int) -> tuple[tuple, int, bytes]:
        """States after a row, what the least cost grew by, and a byte for each state: where it came from.

        ``states`` holds a pair (cost above the least, place in ASCII order) or None for each state.
        """
        key = (states, initial if initial in ("s", "u", "a") else "", fault)
        if key not in self.known:
            self.known[key] = self._step(*key)
        return self.known[key]

    @staticmethod
    def _step(states: tuple, initial: str, fault: int) -> tuple[tuple, int, bytes]:
        best: list = [None] * 4
        for base, held in enumerate(states):
            if held is None:
                continue
            for times in range(3):
                state = inserted(base, times)
                options = [("D", state, DELETE)]
                if fault not in (BLANK, DUPLICATE):
                    stays = TRUNCATED if fault == CUT else 0
                    options.append(("R", WANTED[state][0], REROLE + stays))
                    if (after := kept_state(state, initial)) is not None:
                        options.append(("K", after, stays))
                for letter, after, cost in options:
                    found = (held[0] + times * INSERT + cost, held[1], "I" * times + letter, base, times)
                    best[after] = found if best[after] is None else min(best[after], found)
        least = min(b[0] for b in best if b)
        order = sorted((b[1], b[2], s) for s, b in enumerate(best) if b)
        places = {s: i for i, (_, _, s) in enumerate(order)}
        after = tuple(None if b is None else (b[0] - least, places[s]) for s, b in enumerate(best))
        back = bytes(255 if b is None else b[3] | b[4] << 2 | LETTERS.index(b[2][-1]) << 4 for b in best)
        return after, least, back


def ending(states: tuple) -> tuple[int, int, int]:
    """What the cheapest end costs above the least, the state before it, and how many rows it inserts."""
    ends = {START: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}
    cost, _, state = min((held[0] + INSERT * ends[s], held[1], s) for s, held in enumerate(states) if held)
    return cost, state, ends[state]


def traced(back: bytes, state: int) -> tuple[int, str]:
    """State before the rows of ``back``, and their edits."""
    out = []
    for at in range(len(back) - 4, -1, -4):
        code = back[at + state]
        out.append("I" * (code >> 2 & 3) + LETTERS[code >> 4])
        state = code & 3
    return state, "".join(reversed(out))


def edited(state: int, edits: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """``edit, role, text`` for each edit, from a state on; a deleted row is given as it was."""
    for edit in edits:
        if edit == "I":
            state, role = WANTED[state]
            yield edit, role, ""
            continue
        role, text = next(rows)
        if edit == "R":
            state, role = WANTED[state]
        elif edit == "K":
            state = kept_state(state, role[:1])
        yield edit, role, text


class Digest:
    """SHA-256 of turns with line feeds between them."""

    def __init__(self, held=None, empty: bool = True):
        self.held, self.empty = held or hashlib.sha256(), empty

    def copy(self) -> Digest:
        return Digest(self.held.copy(), self.empty)

    def add(self, turns: Iterator[tuple[str, str, str]]) -> Digest:
        lines = [f"{role}:{text}" for edit, role, text in turns if edit != "D"]
        if lines:
            self.held.update(("" if self.empty else "\n").encode() + "\n".join(lines).encode())
            self.empty = False
        return self


class Conversation:
    """One conversation while its rows pass by."""

    def __init__(self, key: str | None, steps: Steps):
        self.key, self.steps = key, steps
        self.states: tuple = ((0, 0), None, None, None)
        self.cost = self.blocks = self.illegal = self.turns = self.chars = 0
        self.faults = [0, 0, 0, 0]
        self.first = self.last = None
        self.previous: str | None = None
        self.rows: list[tuple[str, str]] = []
        self.back = bytearray()
        self.digests: list[Digest | None] = [Digest(), None, None, None]

    def take(self, turn: str | None, role: str, text: str, fault: int) -> None:
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = self.first or turn, turn, self.turns + 1
        initial = role[:1]
        if self.previous is not None and self.previous + initial not in LEGAL:
            self.illegal += 1
        self.previous = initial
        self.faults[fault] += 1
        self.states, grown, back = self.steps.step(self.states, initial, fault)
        self.cost += grown
        self.back += back
        self.rows.append((role, text))
        self.chars += len(text)

    def full(self) -> bool:
        return len(self.rows) >= SPILL_ROWS or self.chars >= SPILL_CHARS

    def spill(self) -> dict:
        """The held bytes as a row; the digests take the held texts in."""
        digests: list[Digest | None] = [None] * 4
        for state, held in enumerate(self.states):
            if held is not None:
                before, edits = traced(self.back, state)
                digests[state] = self.digests[before].copy().add(edited(before, edits, iter(self.rows)))
        row = {"conv": self.key, "block": self.blocks, "back": bytes(self.back)}
        self.digests, self.blocks, self.chars = digests, self.blocks + 1, 0
        self.rows.clear()
        self.back.clear()
        return row

    def summary(self) -> dict:
        cost, state, inserts = ending(self.states)
        before, edits = traced(self.back, state)
        edits += "I" * inserts
        digest = self.digests[before].add(edited(before, edits, iter(self.rows)))
        gaps = int(self.last) - int(self.first) + 1 - self.turns if self.turns else 0
        return {
            "conv": self.key, "block": self.blocks, "state": before, "gaps": gaps, "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE],
            "truncated": self.faults[CUT], "illegal": self.illegal, "cost": self.cost + cost, "audit": edits, "repaired_sha256": digest.held.hexdigest(),
        }


FIGURES = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
PARTS = f"conv string, block int, state int, back binary, {FIGURES}"
PART_NAMES = [p.split()[0] for p in PARTS.split(", ")]


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names, dtype=object)


def prepared(conversations: DataFrame) -> DataFrame:
    """``conv, turn, role, text`` as the passes read them; ``gone`` marks rows that only name their conversation."""
    return conversations.select(
        F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        F.lit(False).alias("gone"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with the faults that the query plants by a hash of conversation and turn."""
    key = F.concat(F.coalesce("conv", F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    harm = F.crc32(key.cast("binary")) % 20
    text = F.when(harm == 1, "").when(harm == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(harm == 4, "user").otherwise(F.col("role"))
    hit = rows.select("conv", "turn", F.when(harm != 0, role).alias("role"), F.when(harm != 0, text).alias("text"), (harm == 0).alias("gone"), F.when(harm == 3, 2).otherwise(1).alias("times"))
    return hit.select("conv", "turn", "role", "text", "gone", F.explode(F.expr("array_repeat(true, times)")).alias("_copy")).drop("_copy")


def _fault(text: Column, again: Column) -> Column:
    blank = ~text.rlike(f"[^{GAP}]")
    cut = text.rlike(rf"[^.!?{GAP}][{GAP}]*\z")
    return F.when(blank, BLANK).when(again, DUPLICATE).when(cut, CUT).otherwise(SOUND)


def _streams(rows: DataFrame) -> DataFrame:
    """Rows with their faults, each conversation in one partition; sorting for the window needs no second exchange."""
    dealt = rows.repartition("conv")
    alike = Window.partitionBy("conv", "role", "text").orderBy("turn")
    return dealt.withColumn("fault", _fault(F.col("text"), F.row_number().over(alike) > 1))


#: Nulls come first by default.
ORDER = ["conv", "turn", "role", "text"]


def plans(rows: DataFrame) -> DataFrame:
    """``conv`` and the figures, edits and digest of every conversation of ``rows`` (see :func:`prepared`)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, steps = None, Steps()
        for batch in batches:
            out = []
            for conv, turn, role, text, gone, fault in zip(*(batch[c].tolist() for c in ("conv", "turn", "role", "text", "gone", "fault")), strict=True):
                if held is None or conv != held.key:
                    if held is not None:
                        out.append(held.summary())
                    held = Conversation(conv, steps)
                if gone:
                    continue
                held.take(turn, role, text, fault)
                if held.full():
                    out.append(held.spill())
            if out:
                yield _frame(out, PART_NAMES)
        if held is not None:
            yield _frame([held.summary()], PART_NAMES)

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, pieces, state = None, [], 0
        names = ["conv", *[p.split()[0] for p in FIGURES.split(", ")]]
        for batch in batches:
            out = []
            for part in batch.to_dict("records"):
                if part["audit"] is not None:
                    last, pieces, state = part, [part["audit"]], int(part["state"])
                    continue
                state, edits = traced(part["back"], state)
                pieces.append(edits)
                if part["block"] == 0:
                    out.append({**last, "audit": "".join(reversed(pieces))})
            if out:
                yield _frame(out, names)

    ordered = _streams(rows).sortWithinPartitions(*ORDER)
    # Nulls in numbers would turn them into floats, so turns travel as text.
    parts = ordered.select("conv", F.col("turn").cast("string").alias("turn"), "role", "text", "gone", "fault").mapInPandas(run, PARTS)
    parts = stored(parts, "repair-parts")
    names = ["conv", *[p.split()[0] for p in FIGURES.split(", ")]]
    long = parts.where("block > 0 or back is not null").repartition("conv").sortWithinPartitions("conv", F.col("block").desc())
    return parts.where("block = 0 and back is null").select(*names).unionByName(long.mapInPandas(joined, f"conv string, {FIGURES}"))


def repaired(rows: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """``conv, place, edit, role, text``: the turns of every conversation after repair, numbered from 0.

    The edits come before the rows of their conversation in the same sorted stream, so nothing is joined.
    """
    planned = plans(rows) if planned is None else planned
    first = planned.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))
    turns = rows.where(~F.col("gone")).select("conv", F.lit(1).alias("kind"), "turn", "role", "text")
    stream = first.unionByName(turns).repartition("conv").sortWithinPartitions("conv", "kind", *ORDER[1:])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, edits, at, state, place = None, "", 0, START, 0
        for batch in batches:
            out: list[tuple] = []

            def put(edit: str, role: str, text: str) -> None:
                nonlocal place
                out.append((conv, place, edit, role, text))  # noqa: B023
                place += 1

            def insert() -> None:
                nonlocal at, state
                while at < len(edits) and edits[at] == "I":
                    state, role = WANTED[state]
                    put("I", role, "")
                    at += 1

            for own, kind, role, text in zip(*(batch[c].tolist() for c in ("conv", "kind", "role", "text")), strict=True):
                if kind == 0:
                    conv, edits, at, state, place = own, text, 0, START, 0
                else:
                    if edits[at] == "R":
                        state, role = WANTED[state]
                    elif edits[at] == "K":
                        state = kept_state(state, role[:1])
                    if edits[at] != "D":
                        put(edits[at], role, text)
                    at += 1
                insert()
            yield pd.DataFrame(out, columns=["conv", "place", "edit", "role", "text"])

    return stream.mapInPandas(run, "conv string, place long, edit string, role string, text string")


def repaired_conversations(conversations: DataFrame, harm: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Figures of every conversation under its own id; ``harm`` plants faults first."""
    rows = prepared(conversations)
    found = plans(harm(rows) if harm else rows)
    kind = conversations.schema["conv_id"].dataType
    return found.select(F.col("conv").cast(kind).alias("conv_id"), *[p.split()[0] for p in FIGURES.split(", ")])


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """What repairs every conversation after its rows were damaged."""
    return repaired_conversations(table(spark, folder, "conversations").select("conv_id", "turn", "role", "text"), damaged)
