"""Chat formatting by minimum-cost role repair.

Legal conversations: at most one system turn, first; then user and assistant in turn, user first. For every turn
a dynamic programme over the states of that automaton chooses among: *keep* (free), *relabel*, *merge* into the turn
before, and *insert* empty turns before it. Costs are in ``COSTS``. Of equally cheap ways the one wins whose states, read
from the end, are earlier in ``NAMES`` where they first differ; within a step the action listed first.

A step is a matrix of costs between states and steps combine associatively (minimum of sums). So turns are dealt
by their rank over the whole table into segments of ``segment`` rows, whatever conversation they belong to:

1. every segment gives the combined matrix of each conversation piece in it, and for each last state the order in which
   the best ways from the four first states stand by the rule for ties;
2. pieces of conversations that cross segments are chained (32 numbers a piece), which fixes the states at borders;
3. every segment is solved again between its border states and traced back; texts join the result by rank.

The order makes ties compose as costs do: ways that end in one state and start in two differ inside the piece, so their order is
a matter of the piece alone. A repair is therefore the same wherever segments are cut, whatever other conversations there are.
A conversation that holds a third of all turns is many tasks, and Python sees roles only, so very long texts need no more
memory than one row of them.

The rendered pieces of a conversation, joined in the order of ``position``, are its text; the markers in ``TAGS`` are
broken up inside texts, so they cannot be forged.

Defined results: role names are trimmed and lower-cased, ``ALIASES`` apply, null and others are unknown and cost
less to relabel; null texts are empty; turns order by number (null first), then by text checksum, text and role; repeated
turns are turns of their own; a null conversation id is a conversation of its own; an empty table gives no rows;
other columns are ignored, whatever their names; very long texts are rows like others.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import ranked
from tidebook.session import cut

START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("start", "system", "user", "assistant")
UNKNOWN = 0
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
COSTS = {"merge": 1, "relabel": 3, "relabel_unknown": 1, "insert": 2}
TAGS = ("<|turn|>", "<|end|>")
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FAR = 1 << 40


def actions(role: int) -> tuple[np.ndarray, dict]:
    """Cost matrix of a turn of this role, and the (action, inserted roles) behind each finite entry."""
    cost, how = np.full((4, 4), FAR, np.int64), {}

    def offer(s, t, price, action, inserted=()):
        if price < cost[s, t]:
            cost[s, t], how[s, t] = price, (action, inserted)

    for n in range(3):
        for inserted in product((SYSTEM, USER, ASSISTANT), repeat=n):
            for s, t in product(range(4), (SYSTEM, USER, ASSISTANT)):
                path = (s, *inserted, t)
                if all(b in NEXT[a] for a, b in zip(path, path[1:], strict=False)):
                    relabel = 0 if t == role else COSTS["relabel_unknown" if role == UNKNOWN else "relabel"]
                    offer(s, t, n * COSTS["insert"] + relabel, "keep" if t == role else "relabel", inserted)
    for s in (SYSTEM, USER, ASSISTANT):
        offer(s, s, COSTS["merge"] + (0 if role in (s, UNKNOWN) else COSTS["relabel"]), "merge")
    return cost, how


STEPS = [actions(role) for role in range(4)]


def combined(roles) -> np.ndarray:
    """Least costs between states over a run of turns."""
    return ordered(roles)[0]


def ordered(roles) -> tuple[np.ndarray, np.ndarray]:
    """Least costs between states over a run of turns, and for every last state the places of the first states by the rule for ties."""
    total, order, states = np.where(np.eye(4, dtype=bool), 0, FAR), np.repeat(np.arange(4)[:, None], 4, axis=1), np.arange(4)
    for role in roles:
        ways = total[:, :, None] + STEPS[role][0][None]
        through = ways.argmin(axis=1)
        total = np.minimum(ways.min(axis=1), FAR)
        order = (through * 4 + order[states[:, None], through]).argsort(axis=0, kind="stable").argsort(axis=0)
    return total, order


def best_end(costs: np.ndarray) -> int:
    return int(np.argmin(costs))


def solve(roles, start: int, end: int) -> list[tuple[int, int]]:
    """(state before, state after) of every turn on the cheapest way from start to end."""
    costs = [np.where(np.arange(4) == start, 0, FAR)]
    for role in roles:
        costs.append(np.minimum((costs[-1][:, None] + STEPS[role][0]).min(axis=0), FAR))
    way, state = [], end
    for i in range(len(roles) - 1, -1, -1):
        before = int(np.argmin(costs[i] + STEPS[roles[i]][0][:, state]))
        way.append((before, state))
        state = before
    return way[::-1]


def chain(matrices: list[np.ndarray], orders: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """(first state, last state) of every piece of one conversation on its cheapest way, ties by the orders of the pieces."""
    costs = [np.where(np.arange(4) == START, 0, FAR)]
    for m in matrices:
        costs.append(np.minimum((costs[-1][:, None] + m).min(axis=0), FAR))
    out, state = [], best_end(costs[-1])
    for i in range(len(matrices) - 1, -1, -1):
        ties = np.arange(4) if orders is None else orders[i][:, state]
        before = int(np.argmin((costs[i] + matrices[i][:, state]) * 4 + ties))
        out.append((before, state))
        state = before
    return out[::-1]


def runs(values: np.ndarray):
    """Ranges of equal neighbouring values."""
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    return zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(values)]]), strict=True)


def render_piece(roles: list[int], ranks: list[int], way: list[tuple[int, int]], last: bool) -> list[tuple]:
    """(rank, position, role, action, cost, head, tail) of a piece's inserted turns and turns: what stands around each text."""
    out = []
    for code, rank, (before, after) in zip(roles, ranks, way, strict=True):
        action, inserted = STEPS[code][1][before, after]
        opened = before != START
        for j, role in enumerate(inserted):
            head = (f"{TAGS[1]}\n" if opened else "") + f"{TAGS[0]}{NAMES[role]}\n"
            out.append((rank, rank * 4 + j, NAMES[role], "insert", COSTS["insert"], head, ""))
            opened = True
        if action == "merge":
            head = "\n\n"
        else:
            head = (f"{TAGS[1]}\n" if opened else "") + f"{TAGS[0]}{NAMES[after]}\n"
        price = int(STEPS[code][0][before, after]) - len(inserted) * COSTS["insert"]
        out.append((rank, rank * 4 + 3, NAMES[after], action, price, head, ""))
    if last:
        out[-1] = (*out[-1][:-1], f"{TAGS[1]}\n")
    return out


def repair(turns: DataFrame, segment: int = 2048, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn of ``turns`` and per inserted turn: conversation, source turn (null if inserted), ``position``,
    repaired role, action, cost, and the rendered piece."""
    name = F.lower(F.trim(F.col(role_col)))
    for alias, role in ALIASES.items():
        name = F.when(F.lower(F.trim(F.col(role_col))) == alias, F.lit(role)).otherwise(name)
    code = F.when(name == "system", SYSTEM).when(name == "user", USER).when(name == "assistant", ASSISTANT).otherwise(UNKNOWN)
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(text_col).cast("string").alias("text"), code.alias("role_code"))
    rows = rows.withColumn("crc", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    rows = ranked(rows, ["conv", "turn", "crc", "text", "role_code"], "rank", "chat-ranked").drop("crc").withColumn("segment", F.expr(f"rank div {segment}"))
    conv = rows.schema["conv"].dataType.simpleString()

    def pieces(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        key, roles = group["conv"].astype(object).where(group["conv"].notna(), None).map(repr).to_numpy(), group["role_code"].to_numpy()
        found = [(group["conv"].iloc[a], group["segment"].iloc[0], *(m.ravel() for m in ordered(roles[a:b]))) for a, b in runs(key)]
        return pd.DataFrame(found, columns=["conv", "segment", "matrix", "places"])

    parts = cut(rows.select("conv", "segment", "rank", "role_code").groupBy("segment").applyInPandas(pieces, f"conv {conv}, segment long, matrix array<long>, places array<long>"), "chat-pieces")
    count = parts.groupBy("conv").agg(F.count("*").alias("count"))
    parts = parts.join(count.withColumnRenamed("conv", "whole"), F.col("conv").eqNullSafe(F.col("whole"))).drop("whole")

    def borders(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("segment")
        ends = chain(*([np.array(m).reshape(4, 4) for m in group[c]] for c in ("matrix", "places")))
        return pd.DataFrame({"conv": group["conv"], "segment": group["segment"], "first": [a for a, _ in ends], "last": [b for _, b in ends], "closes": [i == len(ends) - 1 for i in range(len(ends))]})

    shape = f"conv {conv}, segment long, first long, last long, closes boolean"
    crossing = parts.filter("count > 1").groupBy("conv").applyInPandas(borders, shape)
    start = F.slice("matrix", 1, 4)
    alone = parts.filter("count = 1").select("conv", "segment", F.lit(START).cast("long").alias("first"), (F.array_position(start, F.array_min(start)) - 1).alias("last"), F.lit(True).alias("closes"))

    def solved(group: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        group, out = group.sort_values("rank"), []
        key = group["conv"].astype(object).where(group["conv"].notna(), None).map(repr).to_numpy()
        roles, ranks = group["role_code"].tolist(), group["rank"].tolist()
        known = {repr(None if pd.isna(e.conv) else e.conv): e for e in ends.itertuples()}
        for a, b in runs(key):
            end = known[key[a]]
            out += render_piece(roles[a:b], ranks[a:b], solve(roles[a:b], int(end.first), int(end.last)), bool(end.closes))
        return pd.DataFrame(out, columns=["at", "position", "role", "action", "cost", "head", "tail"])

    lean = rows.select("conv", "segment", "rank", "role_code").groupBy("segment")
    ways = lean.cogroup(crossing.unionByName(alone).groupBy("segment")).applyInPandas(solved, "at long, position long, role string, action string, cost long, head string, tail string")
    inserted, text = F.col("action") == "insert", F.coalesce("text", F.lit(""))
    for tag in TAGS:
        text = F.replace(text, F.lit(tag), F.lit(tag[0] + " " + tag[1:]))
    out = rows.select("rank", "conv", F.col("turn").alias("source"), "text").join(ways, F.col("rank") == F.col("at"))
    piece = F.concat("head", F.when(inserted, "").otherwise(text), "tail")
    return out.select(F.col("conv").alias(conv_col), F.when(~inserted, F.col("source")).alias(turn_col), "position", "role", "action", "cost", piece.alias("piece"))
