"""Repaired conversations against trying every way, and rendering against the joined pieces."""

import random
import re
from itertools import product

import pytest

from tidebook.llm import chat
from tidebook.llm.queries import op3_chat_role_repair

LEGAL = re.compile(r"s?(ua)*u?")


def cheapest(roles):
    """Least cost over all sequences of (inserted roles, role or merge), checked as a whole."""
    choices = [("", "m"), *(("".join(i), r) for n in range(3) for i in product("sua", repeat=n) for r in "sua")]
    best = 10**9
    for way in product(choices, repeat=len(roles)):
        done, cost = "", 0
        for role, (inserted, r) in zip(roles, way, strict=True):
            done += inserted
            cost += 2 * len(inserted)
            if r == "m":
                if not done:
                    cost = 10**9
                    break
                cost += 1 + (0 if role in (done[-1], "?") else 3)
            else:
                done += r
                cost += 0 if role == r else 1 if role == "?" else 3
        if cost < best and LEGAL.fullmatch(done):
            best = cost
    return best


CODE = {"s": chat.SYSTEM, "u": chat.USER, "a": chat.ASSISTANT, "?": chat.UNKNOWN}


@pytest.mark.parametrize("roles", ["u", "a", "s", "?", "aa", "us", "uu", "ss", "?a", "au", "uas", "ssu", "a?u", "uua"])
def test_least_cost(roles):
    total = chat.combined([CODE[r] for r in roles])[chat.START]
    assert total.min() == cheapest(roles)


def test_segments_agree_with_one_piece():
    rng = random.Random(3)
    for _ in range(50):
        roles = [rng.randrange(4) for _ in range(rng.randrange(2, 40))]
        whole = chat.combined(roles)
        cuts = sorted(rng.sample(range(1, len(roles)), min(3, len(roles) - 1)))
        parts = [roles[a:b] for a, b in zip([0, *cuts], [*cuts, len(roles)], strict=True)]
        ends = chat.chain([chat.combined(p) for p in parts])
        way = [w for p, (a, b) in zip(parts, ends, strict=True) for w in chat.solve(p, a, b)]
        assert sum(chat.STEPS[r][0][w] for r, w in zip(roles, way, strict=True)) == whole[chat.START].min()
        assert way[0][0] == chat.START and all(x[1] == y[0] for x, y in zip(way, way[1:], strict=False))


def test_one_repair_wherever_segments_are_cut():
    rng = random.Random(5)
    for _ in range(10_000):
        roles = [rng.randrange(4) for _ in range(rng.randrange(2, 12))]
        cuts = sorted(rng.sample(range(1, len(roles)), rng.randrange(1, min(4, len(roles)))))
        parts = [roles[a:b] for a, b in zip([0, *cuts], [*cuts, len(roles)], strict=True)]
        ends = chat.chain(*zip(*map(chat.ordered, parts), strict=True))
        way = [w for p, (a, b) in zip(parts, ends, strict=True) for w in chat.solve(p, a, b)]
        assert way == chat.solve(roles, chat.START, chat.best_end(chat.combined(roles)[chat.START]))


def test_repairs_do_not_depend_on_segments_or_other_conversations(spark):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "x", None]), f"{c}<|end|>{t}") for c in range(40) for t in range(rng.randrange(1, 9))]
    rows.append((7, 99, "user", "long " * 200_000))
    shape = "conv_id long, turn int, role string, text string"

    def texts(kept, segment):
        out = chat.repair(spark.createDataFrame(kept, shape), segment=segment).orderBy("conv_id", "position").collect()
        return {c: [(r.turn, r.role, r.action, r.cost, r.piece) for r in out if r.conv_id == c] for c in {r.conv_id for r in out}}

    whole = texts(rows, 2048)
    assert texts(rows, 3) == whole
    assert texts([r for r in rows if r[0] % 2], 5) == {c: w for c, w in whole.items() if c % 2}


def check(rows, out):
    """Every turn comes out once, in order; the joined text is legal and holds every text."""
    by = {}
    for r in out:
        by.setdefault(r.conv_id, []).append(r)
    assert sum(r.action != "insert" for r in out) == len(rows)
    for conv, own in by.items():
        own.sort(key=lambda r: r.position)
        text = "".join(r.piece for r in own)
        heads = re.findall(r"<\|turn\|>(\w+)\n", text)
        assert LEGAL.fullmatch("".join(h[0] for h in heads)) and text.count("<|end|>\n") == len(heads) and text.endswith("<|end|>\n")
        turns = sorted((t for c, t, _, _ in rows if c == conv), key=lambda t: (t is not None, t))
        assert [r.turn for r in own if r.action != "insert"] == turns


@pytest.mark.parametrize("segment", [2048, 3])
def test_repair(spark, segment):
    rng = random.Random(4)
    names = ["user", "assistant", "system", "User ", "GPT", "human", None, "tool", ""]
    rows = [(c, t, rng.choice(names), rng.choice(["hi", "", None, "<|end|> x <|turn|>user", "long " * 50])) for c in (1, 2, 3, None) for t in range(rng.randrange(1, 12))]
    rows += [(9, t, rng.choice(names), f"t{t}") for t in range(100)] + [(5, 0, "user", "same"), (5, 0, "user", "same"), (6, None, "assistant", "x")]
    frame = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, piece string, rank int").repartition(3)
    out = chat.repair(frame, segment).collect()
    check(rows, out)
    costs = {}
    for r in out:
        costs[r.conv_id] = costs.get(r.conv_id, 0) + r.cost
    known = {**chat.ALIASES, "user": "user", "assistant": "assistant", "system": "system"}
    code = lambda r: chat.NAMES.index(known.get((r or "").strip().lower(), "start"))
    for c in (1, 2, 3, 9, None):
        roles = [code(r) for x, _, r, _ in sorted((r for r in rows if r[0] == c), key=lambda r: r[1])]
        assert costs[c] == chat.combined(roles)[chat.START].min()


def test_empty(spark):
    assert chat.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_query(spark, sf):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    check(rows, op3_chat_role_repair(spark, sf).collect())
