"""Chat formatting: the cheapest repair of a conversation's roles, by dynamic programming over legal turns."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import shuffle_parts, written

#: Places of the automaton. A legal conversation is an optional system turn, then user and assistant in turns, user first,
#: assistant last.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("system", "user", "assistant")
#: Costs: calling a turn by another role; putting it into the turn before it; an empty turn of a role put in.
RELABEL, MERGE, INSERT = 3, 1, 2
NEVER = 10**9
#: Turns of one task.
CHUNK = 20_000
#: Where each place may go on to, in one turn.
_AFTER = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}


def _moves(role: str | None) -> list[tuple[int, int, int, str, tuple[int, ...]]]:
    """All ways a turn of ``role`` goes from place to place: (from, to, cost, action, roles put in before it)."""
    out = []
    for a in range(4):
        for b in (SYSTEM, USER, ASSISTANT):
            relabel = 0 if role == ROLES[b - 1] else RELABEL
            name = "keep" if not relabel else "relabel"
            if b in _AFTER[a]:
                out.append((a, b, relabel, name, ()))
            for c in _AFTER[a]:
                if b in _AFTER[c]:
                    out.append((a, b, relabel + INSERT, name, (c,)))
                out += [(a, b, relabel + 2 * INSERT, name, (c, d)) for d in _AFTER[c] if b in _AFTER[d] and (c, d) != (USER, ASSISTANT)]
            if a == b:
                out.append((a, b, relabel + MERGE, "merge", ()))
    return sorted(out, key=lambda m: m[2])


_MOVES = {role: _moves(role) for role in (*ROLES, None)}


def _matrix(role) -> np.ndarray:
    """Cheapest cost from place to place over one turn."""
    out = np.full((4, 4), NEVER)
    for a, b, cost, _, _ in _MOVES[role]:
        out[a, b] = min(out[a, b], cost)
    return out


_MATRIX = {role: _matrix(role) for role in _MOVES}
#: What ending at each place costs: a user turn needs an (empty) answer; no turns at all are none.
_END = np.array([0, NEVER, INSERT, 0])
_END[SYSTEM] = 2 * INSERT


def _path(roles: list, start: int, goal: np.ndarray) -> list[tuple[int, str, tuple[int, ...]]]:
    """(place, action, roles put in) of each turn on the cheapest way from ``start``; ``goal``: cost at each last place."""
    best, back = [NEVER] * 4, []
    best[start] = 0
    for role in roles:
        new, by = [NEVER * 4] * 4, [None] * 4
        for m in _MOVES[role]:
            if (cost := best[m[0]] + m[2]) < new[m[1]]:
                new[m[1]], by[m[1]] = cost, m
        best = new
        back.append(by)
    at = int(np.argmin(np.array(best) + goal))
    out = []
    for by in reversed(back):
        m = by[at]
        out.append((at, m[3], m[4]))
        at = m[0]
    return out[::-1]


def _product(roles: list) -> np.ndarray:
    out = np.where(np.eye(4, dtype=bool), 0, NEVER)
    for role in roles:
        out = np.minimum((out[:, :, None] + _MATRIX[role][None]).min(axis=1), NEVER)
    return out


def escaped(text: str | None) -> str:
    """The text with a backslash in each turn mark that stands in it (one more, if it has some), so that it opens and
    closes no turn; ``unescaped`` takes it out again."""
    return re.sub(r"<(\\*+)\|(im_start|im_end)\|>", r"<\1\\|\2|>", text or "")


def unescaped(text: str) -> str:
    return re.sub(r"<(\\*)\\\|(im_start|im_end)\|>", r"<\1|\2|>", text)


def render(role: int, text: str | None, merged: bool, before: tuple[int, ...], first: bool) -> str:
    """A turn's part of the conversation's text: closes what is open, puts in empty turns, and opens or goes on."""
    if merged:
        return "\n" + escaped(text)
    out = "" if first else "<|im_end|>\n"
    for c in before:
        out += f"<|im_start|>{ROLES[c - 1]}\n<|im_end|>\n"
    return out + f"<|im_start|>{ROLES[role - 1]}\n{escaped(text)}"


def _ending(place: int) -> str:
    out = "<|im_end|>\n"
    if place == SYSTEM:
        out += "<|im_start|>user\n<|im_end|>\n"
    return out + ("<|im_start|>assistant\n<|im_end|>\n" if place in (SYSTEM, USER) else "")


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: ``conv_id, turn, pos, role, new_role, action, inserted, fragment``.

    A conversation's fragments, joined by ``pos``, are its text: turns as ``<|im_start|>role``, a line feed, the text and
    ``<|im_end|>``. Of all ways to make roles legal (system first or not at all, then user and assistant in turns, a user
    first, an assistant last), the cheapest by ``RELABEL``, ``MERGE`` and ``INSERT`` is taken: ``action`` is keep, relabel
    or merge (into the turn before), ``inserted`` counts empty turns put in before it (and, at the last turn, after it).

    Turn marks inside a text get a backslash (``escaped``): no text can open or close a turn.

    Roles count trimmed and in lower case; null and unknown ones fit no place and are relabelled. Null texts are empty.
    Null conversation ids are one conversation. Turns go by number, nulls first; ties by role and text; repeated
    rows are turns of their own. No turns, no rows. Other columns are not read.

    Turns are sorted by range over all tasks, so a conversation of any length spreads over as many as it needs, and cut
    into chunks of ``CHUNK``. Each chunk gives, for the conversations that cross its ends, the costs from place to place
    over its turns (a 4 x 4 product of the turns' costs under minimum and plus); from those, one small pass finds where the
    cheapest way enters and leaves each chunk, and every chunk then solves its own part.
    """
    clean = turns.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.lower(F.trim(F.col(role_col))).alias("kind"), F.col(role_col).alias("role"), F.col(text_col).alias("text")
    )
    keys = ["conv_id", "turn", "kind", "role", "text"]
    ranged = clean.repartitionByRange(shuffle_parts(turns.sparkSession), *keys, F.rand(17)).sortWithinPartitions(*keys)

    def number(batches):
        import pyarrow as pa

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            pos = np.arange(n, n + batch.num_rows)
            n += batch.num_rows
            yield batch.append_column("chunk", pa.array((part << 32) + pos // CHUNK, pa.int64())).append_column("pos", pa.array((part << 40) + pos, pa.int64()))

    kind = turns.schema[id_col].dataType.simpleString()
    placed = written(ranged.mapInArrow(number, f"conv_id {kind}, turn long, kind string, role string, text string, chunk long, pos long"), "chat")
    spread = placed.groupBy("conv_id").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high")).where("low < high")
    # Of each chunk, the first and the last conversation can cross: at most two rows a chunk.
    crossing = placed.select("conv_id", "chunk", "pos", "kind").join(spread.select(F.col("conv_id").alias("own")), F.col("conv_id").eqNullSafe(F.col("own")), "left_semi")

    def costs(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        m = _product([r if r in ROLES else None for r in pdf["kind"]])
        return pdf[["conv_id", "chunk"]].head(1).assign(costs=[m.ravel().tolist()])

    def enter(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        ms = [np.array(c).reshape(4, 4) for c in pdf["costs"]]
        to_go, goals = _END, []
        for m in reversed(ms):
            goals.append(to_go)
            to_go = np.minimum((m + to_go[None]).min(axis=1), NEVER)
        goals.reverse()
        at, starts, lasts = START, [], []
        for m, goal in zip(ms, goals, strict=True):
            starts.append(at)
            at = int(np.argmin(m[at] + goal))
            lasts.append(at)
        final = [i == len(ms) - 1 for i in range(len(ms))]
        return pdf[["conv_id", "chunk"]].assign(start=starts, place=lasts, final=final, first=[i == 0 for i in range(len(ms))])

    doors = crossing.groupBy("conv_id", "chunk").applyInPandas(costs, f"conv_id {kind}, chunk long, costs array<long>")
    doors = doors.groupBy("conv_id").applyInPandas(enter, f"conv_id {kind}, chunk long, start int, place int, final boolean, first boolean")

    def repair(pdf: pd.DataFrame, doors: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos").reset_index(drop=True)
        known = {("null" if pd.isna(d.conv_id) else d.conv_id): d for d in doors.itertuples()}
        out = {c: [None] * len(pdf) for c in ("new_role", "action", "inserted", "fragment")}
        kinds, texts = [r if r in ROLES else None for r in pdf["kind"]], pdf["text"].tolist()
        for key, at in pdf.groupby("conv_id", dropna=False, sort=False).indices.items():
            door = known.get("null" if pd.isna(key) else key)
            goal = _END if door is None else np.where(np.arange(4) == door.place, 0, 4 * NEVER)
            first, final = (True, True) if door is None else (door.first, door.final)
            path = _path([kinds[i] for i in at], START if door is None else door.start, goal)
            for n, (i, (place, action, before)) in enumerate(zip(at, path, strict=True)):
                text = render(place, texts[i], action == "merge", before, first and n == 0)
                more = 0
                if final and n == len(at) - 1:
                    text += _ending(place)
                    more = {SYSTEM: 2, USER: 1}.get(place, 0)
                out["new_role"][i], out["action"][i], out["inserted"][i], out["fragment"][i] = ROLES[place - 1], action, len(before) + more, text
        return pdf[["conv_id", "turn", "pos", "role"]].assign(**out)

    schema = f"conv_id {kind}, turn long, pos long, role string, new_role string, action string, inserted int, fragment string"
    return placed.groupBy("chunk").cogroup(doors.groupBy("chunk")).applyInPandas(repair, schema)


def conversations(formatted: DataFrame) -> DataFrame:
    """``conv_id, text``: each conversation's fragments joined, for conversations that fit a row."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "fragment")))
    return formatted.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["fragment"]), "").alias("text"))
