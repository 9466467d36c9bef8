"""Chat formatting: roles of a transcript's lines by a hidden Markov model, then canonical turns.

The states are the first line of a turn and a further line of it, for each role. A line is seen
through its speaker marker, whether a blank line stands before it, its length and its last mark;
these are independent given the state. Start, transition and emission counts come from transcripts
whose roles are known, one bounded table for any corpus. Viterbi finds the likeliest states of the
whole transcript; a turn begins where they say so, its marker is dropped, and turns are rendered as

    <|role|>
    text
    <|end|>

Blank lines between the lines of one turn stay as many as they are, those between turns go.

A conversation of any length is read in parts of ``PART`` turns, and still decoded as one: each part
tells the best score of its lines for each state before it and at its end, 36 numbers; these are
chained over the parts of a conversation, which fixes the states at their seams, and each part is then
decoded between its two. The pieces rendered for the parts, one after another, are the transcript's
rendering; a turn that goes on in the next part is closed there.

Defined results: a transcript that is null or has no line but blank ones has no turns and renders as
the empty text. A marker of an unknown speaker is text. Repeated rows give equal rows. Extra columns
are ignored. Rows of turns without conversation or place make no transcript, and rows whose role
is none of the three teach nothing.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import fold, map_batches
from tidewatch.session import cut_lineage

ROLES = ("system", "user", "assistant")
SPEAKERS = {
    "system": 0, "sys": 0,
    "user": 1, "human": 1, "q": 1, "question": 1, "customer": 1,
    "assistant": 2, "ai": 2, "a": 2, "answer": 2, "bot": 2,
}
#: Turns of a conversation in one part.
PART = 256
STATES, KINDS = 2 * len(ROLES), (4, 2, 5, 4)
_MARKER = re.compile(r"\s*(?:#+\s*|\[|\*\*|<\|?)?([A-Za-z]+)(?:\]|\*\*|\|?>)?\s*:\s?|\s*\[([A-Za-z]+)\]\s?").match


def speaker(line: str) -> tuple[int, int]:
    """(role + 1 or 0, where the text begins)."""
    found = _MARKER(line)
    role = SPEAKERS.get((found[1] or found[2]).lower(), -1) if found else -1
    return (role + 1, found.end()) if role >= 0 else (0, 0)


def observed(lines: list[str], blank_before: list[int]) -> np.ndarray:
    """Each line's four features."""
    out = np.zeros((len(lines), len(KINDS)), np.int64)
    for i, (line, blank) in enumerate(zip(lines, blank_before, strict=True)):
        marks = line.rstrip()
        out[i] = (
            speaker(line)[0], blank > 0, min(4, len(line).bit_length() // 2 - 1 if len(line) > 3 else 0),
            "?.:".find(marks[-1:]) + 1 if marks else 0,
        )
    return out


def full_lines(text: str | None) -> tuple[list[str], list[int]]:
    """Lines that are not blank, and how many blank ones stand before each."""
    lines, blanks, blank = [], [], 0
    for line in (text or "").split("\n"):
        if line.strip():
            lines.append(line)
            blanks.append(blank)
            blank = 0
        else:
            blank += 1
    return lines, blanks


def _count(rows: dict) -> dict:
    """Counts of one batch of turns: emissions by feature, and steps within a turn."""
    counts: dict[tuple, int] = {}
    for role, text, first in zip(rows["role"], rows["shown"], rows["first"], strict=True):
        lines, blanks = full_lines(text)
        if not lines:
            continue
        blanks[0] = int(not first)
        base = 2 * ROLES.index(role)
        seen = observed(lines, blanks)
        for i in range(len(lines)):
            state = base + (i > 0)
            for feature, value in enumerate(seen[i].tolist()):
                key = (feature, state, value)
                counts[key] = counts.get(key, 0) + 1
            if i:
                key = (len(KINDS), base + (i > 1), state)
                counts[key] = counts.get(key, 0) + 1
        # How the turn ends is joined with the next one's role from the table of turns.
        key = (len(KINDS) + 1, base + (len(lines) > 1), 0)
        counts[key] = counts.get(key, 0) + 1
    return {
        "kind": [k[0] for k in counts], "state": [k[1] for k in counts],
        "value": [k[2] for k in counts], "n": list(counts.values()),
    }


def fit_roles(turns: DataFrame) -> dict[str, np.ndarray]:
    """Log probabilities from turns (conv_id, turn, role, shown): ``shown`` is the turn as it stands
    in a transcript."""
    known = turns.where(F.col("role").isin(*ROLES) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    counted = map_batches(
        known.select("role", F.coalesce("shown", F.lit("")).alias("shown"), (F.col("turn") == 0).alias("first")),
        _count, "kind int, state int, value int, n long",
    )
    # At most a few hundred rows.
    rows = counted.groupBy("kind", "state", "value").agg(F.sum("n").alias("n")).collect()
    following = known.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next"))
    pairs = known.select("conv_id", "turn", "role").join(following, ["conv_id", "turn"])
    steps = pairs.groupBy("role", "next").agg(F.count("*").alias("n")).collect()
    starts = known.where("turn = 0").groupBy("role").agg(F.count("*").alias("n")).collect()
    emissions = [np.ones((STATES, k)) for k in KINDS]
    inside, ends = np.zeros((STATES, STATES)), np.ones(STATES)
    for row in rows:
        if row["kind"] < len(KINDS):
            emissions[row["kind"]][row["state"], row["value"]] += row["n"]
        elif row["kind"] == len(KINDS):
            inside[row["state"], row["value"]] += row["n"]
        else:
            ends[row["state"]] += row["n"]
    between = np.full((len(ROLES), len(ROLES)), 0.5)
    for row in steps:
        between[ROLES.index(row["role"]), ROLES.index(row["next"])] += row["n"]
    between /= between.sum(axis=1, keepdims=True)
    start = np.full(STATES, 1e-6)
    for row in starts:
        start[2 * ROLES.index(row["role"])] += row["n"]
    move = np.full((STATES, STATES), 1e-9)
    for state in range(STATES):
        stays = inside[state].sum() + 1
        total = stays + ends[state]
        move[state, (state | 1)] += stays / total
        for role in range(len(ROLES)):
            move[state, 2 * role] += ends[state] / total * between[state // 2, role]
    return {
        "start": np.log(start / start.sum()), "move": np.log(move / move.sum(axis=1, keepdims=True)),
        "emit": [np.log(e / e.sum(axis=1, keepdims=True)) for e in emissions],
    }


def viterbi(seen: np.ndarray, model: dict, before: int = -1, last: int = -1) -> np.ndarray:
    """The likeliest states of a transcript's lines.

    ``before`` is the state of the line before them, -1 at the transcript's beginning; ``last`` the state
    the last line has to have, -1 for any.
    """
    n = len(seen)
    scores = sum(e[:, seen[:, i]].T for i, e in enumerate(model["emit"]))
    back = np.zeros((n, STATES), np.int64)
    value = (model["start"] if before < 0 else model["move"][before]) + scores[0]
    for i in range(1, n):
        through = value[:, None] + model["move"]
        back[i] = through.argmax(axis=0)
        value = through[back[i], np.arange(STATES)] + scores[i]
    states = np.zeros(n, np.int64)
    states[-1] = value.argmax() if last < 0 else last
    for i in range(n - 1, 0, -1):
        states[i - 1] = back[i, states[i]]
    return states


def passage(seen: np.ndarray, model: dict) -> np.ndarray:
    """(state before + 1, state at the end): the best score of the lines; row 0 is for none before."""
    scores = sum(e[:, seen[:, i]].T for i, e in enumerate(model["emit"]))
    value = np.vstack((model["start"], model["move"])) + scores[0]
    for own in scores[1:]:
        value = (value[:, :, None] + model["move"]).max(axis=1) + own
    return value


def seams(passages: list[np.ndarray | None]) -> list[tuple[int, int]]:
    """For each part the state before it and at its end, of the likeliest path; -1 before any line.

    A part that is None has no lines, and hands on the state it got.
    """
    value, backs = None, []
    for own in passages:
        if own is None:
            backs.append(None)
        elif value is None:
            value, back = own[0], np.full(STATES, -1)
            backs.append(back)
        else:
            through = value[:, None] + own[1:]
            back = through.argmax(axis=0)
            value = through[back, np.arange(STATES)]
            backs.append(back)
    at = -1 if value is None else int(value.argmax())
    out = []
    for back in reversed(backs):
        before = at if back is None else int(back[at])
        out.append((before, at))
        at = before
    return out[::-1]


def pieces(
    text: str | None, model: dict, before: int = -1, last: int = -1, ends: bool = True, joined: bool = False
) -> tuple[list[str], str]:
    """(roles of the turns that begin here, rendered) of a transcript or of a part of one.

    ``joined``: if parts come before it, which a blank line joins.
    """
    lines, blanks = full_lines(text)
    roles: list[str] = []
    out: list[str] = []
    if lines:
        blanks[0] += joined
        states = viterbi(observed(lines, blanks), model, before, last).tolist()
        for i, (line, blank, state) in enumerate(zip(lines, blanks, states, strict=True)):
            inside = i > 0 or before >= 0
            if state % 2 == 0 or not inside:
                roles.append(ROLES[state // 2])
                out.append("\n<|end|>\n" if inside else "")
                out.append(f"<|{roles[-1]}|>\n{line[speaker(line)[1] :]}")
            else:
                out.append("\n" * (1 + blank) + line)
    if ends and (lines or before >= 0):
        out.append("\n<|end|>\n")
    return roles, "".join(out)


def format_chats(transcripts: DataFrame, model: dict, *columns: str) -> DataFrame:
    """Each transcript's ``columns`` with ``roles`` (array) and ``rendered``."""

    def parse(rows: dict) -> dict:
        parsed = [pieces(t, model) for t in rows.pop("__text")]
        return rows | {"__roles": [roles for roles, _ in parsed], "__rendered": [text for _, text in parsed]}

    own = transcripts.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(columns)], F.col("text").alias("__text"))
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in own.schema if f.name != "__text")
    parsed = map_batches(own, parse, f"{kinds}__roles array<string>, __rendered string")
    return parsed.select(
        *[F.col(f"__{i}").alias(c) for i, c in enumerate(columns)],
        F.col("__roles").alias("roles"), F.col("__rendered").alias("rendered"),
    )


def shown(conv_id: Column, turn: Column, role: Column, text: Column) -> Column:
    """A turn as logs show it: one of four marker habits a conversation, the last of which leaves
    every third marker out."""
    habit = F.pmod(F.xxhash64(conv_id), F.lit(4))
    names = [("System: ", "User: ", "Assistant: "), ("[system] ", "Human: ", "AI: "), ("System: ", "Q: ", "A: ")]

    def mark(own: tuple[str, str, str]) -> Column:
        return F.when(role == "system", own[0]).when(role == "user", own[1]).when(role == "assistant", own[2]).otherwise(F.lit(""))

    left_out = (habit == 3) & (F.pmod(F.xxhash64(conv_id, turn), F.lit(3)) == 0)
    marker = F.when(left_out, "").when(habit == 1, mark(names[1])).when(habit == 2, mark(names[2])).otherwise(mark(names[0]))
    return F.concat(marker, F.coalesce(text, F.lit("")))


def transcripts_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns with ``shown``, transcripts (conv_id, part, text)). Rows that are the same count once."""
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("int").alias("turn"),
        F.lower(F.col("role")).alias("role"), F.col("text").cast("string").alias("text"),
    ).where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    turns = turns.withColumn("shown", shown(F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text")))
    transcripts = (
        turns.withColumn("part", F.floor(F.col("turn") / PART).cast("int"))
        .groupBy("conv_id", "part")
        .agg(F.array_sort(F.collect_set(F.struct("turn", "shown"))).alias("said"))
        .select("conv_id", "part", F.array_join(F.col("said.shown"), "\n\n").alias("text"))
    )
    return turns, transcripts


def part_seams(transcripts: DataFrame, model: dict) -> DataFrame:
    """(conv_id, part, before, last, ends) of each part of conversations that have several."""
    several = transcripts.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select("conv_id")
    parts = transcripts.join(several, "conv_id")

    def measure(rows: dict) -> dict:
        found = []
        for part, text in zip(rows["part"], rows["text"], strict=True):
            lines, blanks = full_lines(text)
            if lines:
                blanks[0] += part > 0
            found.append(passage(observed(lines, blanks), model).ravel().tolist() if lines else [])
        return {"conv_id": rows["conv_id"], "part": rows["part"], "passage": found}

    def chain(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")
        own = [np.array(p).reshape(STATES + 1, STATES) if p else None for p in rows["passage"].to_pylist()]
        before, last = zip(*seams(own), strict=True)
        ends = [False] * (len(own) - 1) + [True]
        return pa.table({
            "conv_id": rows["conv_id"], "part": rows["part"], "before": pa.array(before, pa.int32()),
            "last": pa.array(last, pa.int32()), "ends": ends,
        })

    measured = map_batches(parts, measure, "conv_id long, part int, passage array<double>")
    # 42 numbers for each 256 turns of a conversation.
    return measured.groupBy("conv_id").applyInArrow(chain, "conv_id long, part int, before int, last int, ends boolean")


def chats(conversations: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """(conv_id, part, held_out, n_turns, roles, rendered); the model never sees the held-out fold.

    ``n_turns`` and ``roles`` are of the turns that begin in the part.
    """
    spark = conversations.sparkSession
    turns, transcripts = transcripts_of(conversations)
    model = fit_roles(turns.where(fold("conv_id", folds) != held_out))
    transcripts = cut_lineage(spark, transcripts, "transcripts")
    known = cut_lineage(spark, part_seams(transcripts, model), "part-seams")
    placed = transcripts.join(known, ["conv_id", "part"], "left").select(
        "conv_id", "part", "text", F.coalesce("before", F.lit(-1)).alias("before"),
        F.coalesce("last", F.lit(-1)).alias("last"), F.coalesce("ends", F.lit(True)).alias("ends"),
    )

    def parse(rows: dict) -> dict:
        own = zip(rows["text"], rows["before"], rows["last"], rows["ends"], rows["part"], strict=True)
        parsed = [pieces(text, model, before, last, ends, part > 0) for text, before, last, ends, part in own]
        return {"conv_id": rows["conv_id"], "part": rows["part"], "roles": [r for r, _ in parsed], "rendered": [t for _, t in parsed]}

    parsed = map_batches(placed, parse, "conv_id long, part int, roles array<string>, rendered string")
    return parsed.select(
        "conv_id", "part", (fold("conv_id", folds) == held_out).alias("held_out"),
        F.size("roles").cast("long").alias("n_turns"), "roles", "rendered",
    )
