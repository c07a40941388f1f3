"""Transcript parsing: a hidden Markov model over marker and line features, Viterbi, canonical turns."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

ROLES = ("system", "user", "assistant")
#: A state is a role and whether the line begins a turn of it.
STATES = tuple((r, begins) for r in range(len(ROLES)) for begins in (True, False))
#: Words that transcripts put before a turn, by role; matched lower-cased before a colon or in brackets.
MARKERS = {
    "system": ("system", "instruction", "instructions"),
    "user": ("user", "human", "customer", "question", "q"),
    "assistant": ("assistant", "ai", "bot", "agent", "answer", "a"),
}
#: A dash or bullet before a line: somebody speaks, but it does not say who.
ANYBODY = "anybody"
MARKS = (None, *ROLES, ANYBODY)
SMOOTH = 0.5
#: What is known of markers beforehand, worth PRIOR lines a state: the share of lines that begin a turn and carry one, and of named ones that name the right role.
PRIOR, MARKED, RIGHT = 4.0, 0.5, 0.97
#: Lines of a block, turns and conversations of which line numbers are summed.
BLOCK_LINES, CHUNK_TURNS = 512, 1024


_MARKER = re.compile(r"^\s*[\[<*#]*\s*[A-Za-z]{1,12}\s*[\]>*]*\s*[:>\]]+[\]>*: \t]*")


def marker(line: Column) -> Column:
    """The role that a line's leading marker names, ANYBODY for a dash or bullet, or null."""
    name = F.lower(F.regexp_extract(line, r"^\s*[\[<*#]*\s*([A-Za-z]{1,12})\s*[\]>*]*\s*[:>\]]", 1))
    out = F.when(line.rlike(r"^\s*[-*\u2013\u2014\u2022]\s+\S"), ANYBODY)
    for role, names in MARKERS.items():
        out = F.when(name.isin(*names), role).otherwise(out)
    return out


def features(turns: DataFrame, *more: str) -> DataFrame:
    """(*more, conv_id, turn, line_no, line, mark, look) of the lines of ``turns`` (conv_id, turn, text).

    look is a number below 36: how long the line is (four steps), what it ends with (sentence, question,
    other) and how it starts (upper case, lower case, other). Where a turn begins is not among its features.
    """
    lines = turns.select(*more, "conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    size = F.char_length("line")
    long_ = F.when(size < 40, 0).when(size < 160, 1).when(size < 480, 2).otherwise(3)
    ends = F.when(F.col("line").rlike(r"\?\s*$"), 1).when(F.col("line").rlike(r"[.!]\s*$"), 0).otherwise(2)
    place = F.when(F.col("line").rlike(r"^\s*\p{Lu}"), 0).when(F.col("line").rlike(r"^\s*\p{Ll}"), 1).otherwise(2)
    return lines.select(*more, "conv_id", "turn", "line_no", "line", marker(F.col("line")).alias("mark"), (long_ * 9 + ends * 3 + place).alias("look"))


def learn(turns: DataFrame) -> dict[str, np.ndarray]:
    """Log start, transition and emission tables from all of ``turns`` (conv_id, turn, role, text) with a known role.

    Counted by grouping: looks and marks by role, and which role follows which. Turns after the first of a
    conversation follow the turn numbered one less, where there is one; a turn that comes more than once
    counts once there, with its first role by name.
    """
    known = turns.where(F.col("role").isin(*ROLES))
    rows = features(known, "role").groupBy("role", (F.col("line_no") == 0).alias("first"), "look", "mark").count().collect()
    emit, mark = np.full((len(STATES), 36), SMOOTH), prior_marks()
    for r in rows:
        state = STATES.index((ROLES.index(r["role"]), bool(r["first"])))
        emit[state, r["look"]] += r["count"]
        mark[state, MARKS.index(r["mark"])] += r["count"]
    once = known.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    nxt = once.select(F.col("conv_id").alias("c"), (F.col("turn") - 1).alias("t"), F.col("role").alias("next"))
    follows = once.join(nxt, (once.conv_id == nxt.c) & (once.turn == nxt.t)).groupBy("role", "next").count().collect()
    starts = known.where("turn = 0").groupBy("role").count().collect()
    step, begin = np.full((len(ROLES), len(ROLES)), SMOOTH), np.full(len(ROLES), SMOOTH)
    for r in follows:
        step[ROLES.index(r["role"]), ROLES.index(r["next"])] += r["count"]
    for r in starts:
        begin[ROLES.index(r["role"])] += r["count"]
    step, begin = step / step.sum(axis=1, keepdims=True), begin / begin.sum()
    firsts = np.array([emit[STATES.index((r, True))].sum() for r in range(len(ROLES))])
    others = np.array([emit[STATES.index((r, False))].sum() for r in range(len(ROLES))])
    stop = firsts / (firsts + others)  # share of lines after which a turn ends
    move, start = np.zeros((len(STATES), len(STATES))), np.zeros(len(STATES))
    for i, (r, _) in enumerate(STATES):
        for j, (q, begins) in enumerate(STATES):
            move[i, j] = stop[r] * step[r, q] if begins else (1 - stop[r]) * (r == q)
        start[i] = begin[r] if STATES[i][1] else 0
    with np.errstate(divide="ignore"):
        return {"start": np.log(start), "move": np.log(move), "emit": np.log(emit / emit.sum(axis=1, keepdims=True)), "mark": np.log(mark / mark.sum(axis=1, keepdims=True))}


def prior_marks() -> np.ndarray:
    """Counts of (state, mark) before any line is seen: lines that begin a turn may name its role, rarely another; what training shows is added."""
    out = np.zeros((len(STATES), len(MARKS)))
    for i, (r, begins) in enumerate(STATES):
        if begins:
            out[i] = [1 - MARKED, *(MARKED / 2 * (RIGHT if r == q else (1 - RIGHT) / (len(ROLES) - 1)) for q in range(len(ROLES))), MARKED / 2]
        else:
            out[i] = [0.99] + [0.01 / (len(MARKS) - 1)] * (len(MARKS) - 1)
    return PRIOR * out


def scores(model: dict[str, np.ndarray], looks: np.ndarray, marks: np.ndarray) -> np.ndarray:
    return model["emit"][:, looks].T + model["mark"][:, marks].T


def viterbi(model: dict[str, np.ndarray], e: np.ndarray, enter: np.ndarray | None = None, leave: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(best state of each line, best score of each last state) for line scores ``e``.

    ``enter`` has the scores of the states before the first line (the start table if None); ``leave`` pins the
    last state. Ties go to the state that stands first.
    """
    v = (model["start"] if enter is None else (enter[:, None] + model["move"]).max(axis=0)) + e[0]
    back = np.zeros(e.shape, dtype=np.int64)
    if enter is not None:
        back[0] = (enter[:, None] + model["move"]).argmax(axis=0)
    for t in range(1, len(e)):
        all_ = v[:, None] + model["move"]
        back[t] = all_.argmax(axis=0)
        v = all_.max(axis=0) + e[t]
    path = np.empty(len(e), dtype=np.int64)
    path[-1] = int(v.argmax()) if leave is None else leave
    for t in range(len(e) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path, v


def block_matrix(model: dict[str, np.ndarray], e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best score, first state on that path) from each state before a block to each state at its end: blocks compose by max and plus."""
    v = model["move"] + e[0]
    n = len(v)
    first = np.tile(np.arange(n), (n, 1))
    for t in range(1, len(e)):
        all_ = v[:, :, None] + model["move"][None]
        back = all_.argmax(axis=1)
        v = all_.max(axis=1) + e[t]
        first = np.take_along_axis(first, back, axis=1)
    return v, first


def transcripts(turns: DataFrame) -> DataFrame:
    """``turns`` as raw transcripts have them, whatever their roles: a dash before the text of half of the turns, chosen by a seeded hash."""
    h = F.pmod(F.xxhash64(F.lit(5), "conv_id", "turn"), F.lit(1200))
    return turns.withColumn("text", F.when(h < 600, F.concat(F.lit("- "), F.coalesce("text", F.lit("")))).otherwise(F.col("text")))


def _numbered(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, text) plus start, the number of the conversation's lines before it.

    Turns stand by number, null ones first, equal ones by a hash of the text. Lines are summed by chunks of
    CHUNK_TURNS turns, then within a chunk, so a conversation of any length is spread over tasks.
    """
    t = turns.select("conv_id", "turn", "text", F.xxhash64("text").alias("h"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n"))
    t = t.withColumn("chunk", F.struct(F.expr(f"turn div {CHUNK_TURNS}").alias("c"), F.when(F.col("turn").isNull(), F.shiftright("h", 54)).otherwise(0).alias("d")))
    sums = t.groupBy("conv_id", "chunk").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = stored(sums.select(F.col("conv_id").alias("c_"), F.col("chunk").alias("k_"), before.alias("before")))
    t = t.join(sums, F.col("conv_id").eqNullSafe(F.col("c_")) & F.col("chunk").eqNullSafe(F.col("k_")))
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id", "chunk").orderBy("turn", "h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return t.select("conv_id", "turn", "text", (F.col("before") + inner).alias("start"))


def _rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of the lines, looks, marks) of a block."""
    order = np.argsort(table["at"].to_numpy(), kind="stable")
    marks = np.array([MARKS.index(m) for m in table["mark"].to_pylist()])
    return order, np.array(table["look"].to_pylist())[order], marks[order]


def parse(turns: DataFrame, model: dict[str, np.ndarray], block_lines: int = BLOCK_LINES) -> DataFrame:
    """(conv_id, block, piece, role, first_turn, begins, n_lines, rendered) of the transcripts in ``turns`` (conv_id, turn, text).

    A transcript is its turns' lines in order; where turns begin and who speaks is inferred from the lines
    alone, by the most probable path over all of the transcript. The path is found in blocks of
    ``block_lines`` lines: each block gives a matrix of best scores from state to state, the matrices of a
    conversation are chained (72 numbers a block), and each block then traces its part of the path with its
    first scores and last state known. So a conversation of any length is spread over tasks and the path is
    the exact one. A piece is a run of lines of one turn within a block. A canonical turn is ``<|role|>``, its text
    without the marker, ``<|end|>``; a turn that runs over a block's edge is opened by its first piece and closed by
    its last, so the pieces of a conversation by (block, piece), joined by line feeds, are the same for any
    ``block_lines``. Null texts are one empty line. Rows with a null conv_id are one
    conversation, null turns its first lines; repeated rows are lines that come again.
    """
    lines = features(_numbered(turns), "start").withColumn("at", F.col("start") + F.col("line_no"))
    lines = stored(lines.select("conv_id", F.expr(f"at div {block_lines}").alias("block"), "at", "turn", "line", "mark", "look"))
    kind = turns.schema["conv_id"].dataType.simpleString()

    def summarise(key: tuple, table: pa.Table) -> pa.Table:
        _, looks, marks = _rows(table)
        m, first = block_matrix(model, scores(model, looks, marks))
        v = viterbi(model, scores(model, looks, marks))[1]
        return pa.table({"conv_id": table["conv_id"][:1], "block": table["block"][:1], "whole": [m.tobytes()], "first": [first.tobytes()], "alone": [v.tobytes()]})

    def chain(key: tuple, table: pa.Table) -> pa.Table:
        blocks = table["block"].to_pylist()
        order = sorted(range(len(blocks)), key=blocks.__getitem__)
        n = len(STATES)
        whole = [np.frombuffer(table["whole"][i].as_py()).reshape(n, n) for i in order]
        v, enter = np.frombuffer(table["alone"][order[0]].as_py()), [None]
        for m in whole[1:]:
            enter.append(v)
            v = (v[:, None] + m).max(axis=0)
        leave, closes = [0] * len(order), [True] * len(order)
        leave[-1] = int(v.argmax())
        for k in range(len(order) - 1, 0, -1):
            leave[k - 1] = int((enter[k] + whole[k][:, leave[k]]).argmax())
            first = np.frombuffer(table["first"][order[k]].as_py(), dtype=np.int64).reshape(n, n)
            closes[k - 1] = STATES[first[leave[k - 1], leave[k]]][1]
        return pa.table(
            {
                "conv_id": table["conv_id"],
                "block": pa.array([blocks[i] for i in order], pa.int64()),
                "enter": pa.array([None if e is None else e.tobytes() for e in enter], pa.binary()),
                "leave": pa.array(leave, pa.int32()),
                "closes": pa.array(closes, pa.bool_()),
            }
        )

    def trace(key: tuple, table: pa.Table, bounds: pa.Table) -> pa.Table:
        order, looks, marks = _rows(table)
        enter, closes = bounds["enter"][0].as_py(), bounds["closes"][0].as_py()
        path, _ = viterbi(model, scores(model, looks, marks), None if enter is None else np.frombuffer(enter), bounds["leave"][0].as_py())
        line, turn = table["line"].to_pylist(), table["turn"].to_pylist()
        out: list[list] = []
        for i, state, mark in zip(order, path, marks, strict=True):
            role, begins = STATES[state]
            text = line[i]
            if begins or not out:
                if begins and mark:
                    text = _MARKER.sub("", text, count=1) if MARKS[mark] != ANYBODY else text.lstrip()[1:].lstrip()
                out.append([role, turn[i], begins, []])
            out[-1][3].append(text)
        ends = [k + 1 < len(out) or closes for k in range(len(out))]
        return pa.table(
            {
                "conv_id": pa.concat_arrays([table["conv_id"].combine_chunks()[:1]] * len(out)) if len(out) else table["conv_id"][:0],
                "block": pa.array([table["block"][0].as_py()] * len(out), pa.int64()),
                "piece": pa.array(range(len(out)), pa.int32()),
                "role": pa.array([ROLES[r] for r, _, _, _ in out]),
                "first_turn": pa.array([t for _, t, _, _ in out], pa.int64()),
                "begins": pa.array([b for _, _, b, _ in out]),
                "n_lines": pa.array([len(x) for _, _, _, x in out], pa.int32()),
                "rendered": pa.array(["\n".join([*[f"<|{ROLES[r]}|>"] * b, *x, *["<|end|>"] * end]) for (r, _, b, x), end in zip(out, ends, strict=True)]),
            }
        )

    parts = stored(lines.groupBy("conv_id", "block").applyInArrow(summarise, f"conv_id {kind}, block long, whole binary, first binary, alone binary"))
    bounds = parts.groupBy("conv_id").applyInArrow(chain, f"conv_id {kind}, block long, enter binary, leave int, closes boolean")
    schema = f"conv_id {kind}, block long, piece int, role string, first_turn long, begins boolean, n_lines int, rendered string"
    return lines.groupBy("conv_id", "block").cogroup(bounds.groupBy("conv_id", "block")).applyInArrow(trace, schema)


def parse_conversations(turns: DataFrame) -> DataFrame:
    """``parse`` of the transcripts of ``turns`` (conv_id, turn, role, text), plus true_role and right for pieces that begin a turn.

    The model is learned from the turns of conversations whose crc32(conv_id as text) mod 4 is not 2; held_out
    names the others. Roles of the conversations to parse make no part of their transcripts; they are read
    afterwards, to be compared.
    """
    held = F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    raw = transcripts(turns)
    found = parse(raw.select("conv_id", "turn", "text"), learn(raw.where(~held)))
    true = turns.groupBy(F.col("conv_id").alias("c"), F.col("turn").alias("t")).agg(F.min("role").alias("true_role"))
    found = found.join(true, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("first_turn").eqNullSafe(F.col("t")), "left").drop("c", "t")
    return found.withColumn("held_out", held).withColumn("right", F.col("role") == F.col("true_role"))
