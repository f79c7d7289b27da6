"""Conversation repair against all edit sequences, a plain dynamic program and conversations over many partitions."""

import hashlib
import itertools
import random
import re

import pytest

from glossa.llm import structure
from glossa.llm.common import stored
from glossa.llm.queries import QUERIES, damaged

LEGAL = re.compile(r"(s?(ua)+)?\Z")
BLANK = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id bigint, turn bigint, role string, text string, at int, audit string"
ROLES, TEXTS = ["system", "user", "assistant", "tool", "", None], ["Yes.", "no", "Why?", " ", "", None, "é!\n", "x ", "ok"]


def faults(rows):
    """(role, text, fault) of the rows (turn, role, text) of one conversation, in order."""
    rows = [(t, r or "", x or "") for t, r, x in rows]
    rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).digest()))
    out, seen = [], set()
    for _, role, text in rows:
        end = text.rstrip(BLANK)[-1:]
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return rows, out


def options(role, text, fault):
    yield "D", 3, None
    if fault not in ("blank", "duplicate"):
        cut = fault == "truncated"
        yield "K", int(cut), (role, text)
        yield "R", 2 + cut, ("user", text)
        yield "R", 2 + cut, ("assistant", text)


def every_edit(found):
    """Least (cost, audit) with the turns left, out of all sequences with at most two inserted turns in a row."""
    inserts = [[], *[[r] for r in ("user", "assistant")], *itertools.product(("user", "assistant"), repeat=2)]
    best = None
    for choice in itertools.product(*[list(options(*f)) for f in found]):
        for gaps in itertools.product(inserts, repeat=len(found) + 1):
            left, audit, cost = [], "", 0
            for gap, pick in zip(gaps, [*choice, None]):
                left += [(r, "") for r in gap]
                audit, cost = audit + "I" * len(gap), cost + 2 * len(gap)
                if pick:
                    audit, cost = audit + pick[0], cost + pick[1]
                    left += [pick[2]] if pick[2] else []
            if (best is None or (cost, audit) < best[:2]) and LEGAL.match("".join(r[:1] or "?" for r, _ in left)):
                best = cost, audit, left
    return best


def forward(found):
    """The same by least (cost, audit) for each last role, turn by turn."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    ways = {"": (0, "", ())}

    def inserted(ways):
        out = dict(ways)
        for _ in range(3):
            for q, (cost, audit, left) in list(out.items()):
                role = "assistant" if q == "u" else "user"
                new = (cost + 2, audit + "I", (*left, (role, "")))
                if role[0] not in out or new[:2] < out[role[0]][:2]:
                    out[role[0]] = new
        return out

    for f in found:
        nexts = {}
        for q, (cost, audit, left) in inserted(ways).items():
            for edit, price, turn in options(*f):
                if turn and (turn[0][:1] or "?") not in follow[q]:
                    continue
                to = turn[0][0] if turn else q
                new = (cost + price, audit + edit, (*left, turn) if turn else left)
                if to not in nexts or new[:2] < nexts[to][:2]:
                    nexts[to] = new
        ways = nexts
    return min((w for q, w in inserted(ways).items() if q in ("", "a")), key=lambda w: w[:2])


def expected(rows, solve=forward):
    rows, found = faults(rows)
    cost, audit, left = solve(found)
    turns = [t for t, _, _ in rows if t is not None]
    firsts = [r[:1] for r, _, _ in found]
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            **{n: sum(f == n for _, _, f in found) for n in ("blank", "duplicate", "truncated")},
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:])), "cost": cost, "audit": audit,
            "sha": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()}


def results(spark, rows):
    turns = spark.createDataFrame([(*r, 7, "clash") for r in rows], SCHEMA).repartition(5)
    plan = stored(structure.plan_repairs(turns), "plan")
    digests = {r[0]: r[1] for r in structure.repaired_digests(structure.repaired_turns(turns, plan)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {r["conv_id"]: {**{k: r[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")},
                           "sha": digests.get(r["conv_id"], empty)} for r in structure.conversation_report(plan).collect()}


def grouped(rows):
    out = {}
    for conv, *row in rows:
        out.setdefault(conv, []).append(tuple(row))
    return out


def test_the_two_plain_versions_agree():
    rng = random.Random(1)
    for _ in range(60):
        rows = [(rng.choice([None, 1, 2, 3]), rng.choice(ROLES), rng.choice(TEXTS)) for _ in range(rng.randint(0, 3))]
        found = faults(rows)[1]
        assert every_edit(found)[:2] == forward(found)[:2]


def test_conversations_equal_the_plain_version(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(150)]), rng.choice([None, *range(8)]), rng.choice(ROLES), rng.choice(TEXTS)) for _ in range(1200)]
    rows += rng.sample(rows, 200)  # repeated rows
    got = results(spark, rows)
    want = {c: expected(r) for c, r in grouped(rows).items()}
    assert got == want


@pytest.fixture
def many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_conversation_over_many_partitions(spark, many_partitions):
    rng = random.Random(3)
    rows = [(5, i, rng.choice(["user", "assistant", "user", "system"]), f"t{i % 700}{rng.choice('.x')}") for i in range(3000)]
    rows += [(5, i, "user", "same.") for i in range(3000, 3500)]                       # one long run of duplicates
    rows += [(5, 4000, "assistant", "copies.")] * 400                                  # equal rows
    rows += [(c, i, rng.choice(ROLES[:4]), rng.choice(TEXTS)) for c in (4, 6) for i in range(300)]
    turns = spark.createDataFrame([(*r, 7, "clash") for r in rows], SCHEMA)
    plan = structure.plan_repairs(turns)
    parts = {(r["conv_id"], r["part"]) for r in plan.select("conv_id", "part").collect()}
    assert sum(c == 5 for c, _ in parts) > 2
    assert results(spark, rows) == {c: expected(r) for c, r in grouped(rows).items()}


def test_null_conversations_over_many_partitions(spark, many_partitions):
    rows = [(None, i // 2, "user" if i % 3 else "assistant", f"{i}.") for i in range(2000)] + [(1, None, None, None)]
    assert results(spark, rows) == {c: expected(r) for c, r in grouped(rows).items()}


def test_runs_by_powers_of_two():
    planner, rng = structure.Planner(), random.Random(4)
    symbols = [a + b for a in "suax" for b in ("", ".")] + ["-"]
    for _ in range(200):
        runs = [(rng.choice(symbols), rng.randint(1, 40)) for _ in range(rng.randint(1, 5))]
        single = [(s, 1) for s, n in runs for _ in range(n)]
        state = rng.randrange(4)
        assert planner.plan(runs, state, structure.END) == planner.plan(single, state, structure.END)
        assert planner.matrix(runs) == planner.matrix(single)
    long = planner.plan([("u", 100_000)], 0, structure.END)[0]
    assert len(long.replace("I", "")) == 100_000 and len(planner.powers["u"]) <= 20


def test_repaired_turns_are_legal(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(ROLES), rng.choice(TEXTS)) for c in range(40) for t in range(rng.randint(1, 9))]
    turns = spark.createDataFrame([(*r, 7, "clash") for r in rows], SCHEMA)
    plan = stored(structure.plan_repairs(turns), "plan")
    left = {}
    for r in structure.repaired_turns(turns, plan).orderBy("conv_id", "at", "place").collect():
        left.setdefault(r["conv_id"], []).append(r["role"][:1] or "?")
        assert (r["turn"] is None and r["text"] == "") if r["edit"] == "I" else r["edit"] in "KR"
    assert left and all(LEGAL.match("".join(x)) for x in left.values())


def test_damage_and_query(spark, tmp_path):
    import zlib
    rng = random.Random(6)
    rows = [(c, t, rng.choice(ROLES), rng.choice(["Yes. No! Why?", "no", None])) for c in [None, *range(60)] for t in [None, *range(6)]]
    turns = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    hurt = []
    for conv, turn, role, text in rows:
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        hurt += [(conv, turn, "user" if draw == 4 else role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in damaged(turns).collect()), key=lambda r: [str(x) for x in r]) == sorted(hurt, key=lambda r: [str(x) for x in r])
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in QUERIES["op11_structure_repair"].run(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows} and key
    for conv, own in grouped(hurt).items():
        want = expected(own)
        assert {k: got[conv][k] for k in want if k != "sha"} == {k: v for k, v in want.items() if k != "sha"}
        assert got[conv]["repaired_sha256"] == want["sha"]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    plan = structure.plan_repairs(empty)
    assert plan.count() == structure.conversation_report(plan).count() == 0
    assert structure.repaired_digests(structure.repaired_turns(empty, plan)).count() == 0
