"""Conversation structure repair: cheapest edits by a run-length dynamic program, for conversations of any length."""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.llm.common import stored
from glossa.session import ensure_checkpoint_dir

_BLANKS = " \t\n\x0b\x0c\r"
# States of a conversation that is written turn by turn: nothing yet, system said, user said, assistant said.
START, SYSTEM, USER, ASSISTANT = range(4)
_KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_NEXT = (USER, USER, ASSISTANT, USER)   # where an inserted or renamed turn leads
_ROLES = "sua"                          # initials; any other is told apart no further
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
_NEVER = 1 << 60
Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]


# Min-plus algebra over the four states. A symbol is a role's initial with a mark for truncated text, or "-" for a turn that must go.

def _times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(_NEVER, *[x + b[k][j] for k, x in enumerate(row)]) for j in range(4)) for row in a)


def _apply(a: Matrix, v: Vector) -> Vector:
    return tuple(min(x + v[k] for k, x in enumerate(row)) for row in a)


_ONE: Matrix = tuple(tuple(0 if i == j else _NEVER for j in range(4)) for i in range(4))
_INSERT = _ONE
for _ in range(3):  # up to three inserted turns reach every state that they can
    _INSERT = _times(_INSERT, tuple(tuple(0 if i == j else 2 if j == _NEXT[i] else _NEVER for j in range(4)) for i in range(4)))
END: Vector = _apply(_INSERT, (0, _NEVER, _NEVER, 0))  # cost from each state behind the last turn


def _edits(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) for one turn, in the order of their letters."""
    out = [("D", 3, state)]
    if symbol != "-":
        cut = len(symbol) - 1
        kept = _KEEP.get((state, symbol[0]))
        out += [("K", cut, kept)] if kept is not None else []
        out.append(("R", 2 + cut, _NEXT[state]))
    return out


class Planner:
    """Costs and edits of runs of one symbol, by cached powers of two of its transition."""

    def __init__(self) -> None:
        self.powers: dict[str, list[Matrix]] = {}
        self.backs: dict = {}
        self.strings: dict = {}
        self.shapes: dict = {}

    def power(self, symbol: str, k: int) -> Matrix:
        """Least costs from state to state over 2**k turns, inserted turns before each of them included."""
        own = self.powers.get(symbol)
        if own is None:
            step = [[_NEVER] * 4 for _ in range(4)]
            for state in range(4):
                for _, cost, to in _edits(symbol, state):
                    step[state][to] = min(step[state][to], cost)
            own = self.powers[symbol] = [_times(_INSERT, tuple(map(tuple, step)))]
        while len(own) <= k:
            own.append(_times(own[-1], own[-1]))
        return own[k]

    def matrix(self, runs: list[tuple[str, int]]) -> Matrix:
        out = _ONE
        for symbol, length in runs:
            for k in range(length.bit_length()):
                if length >> k & 1:
                    out = _times(out, self.power(symbol, k))
        return out

    def back(self, symbol: str, k: int, after: Vector) -> Vector:
        """Costs to go before 2**k turns from those behind them, less the least of them."""
        key = symbol, k, after
        if key not in self.backs:
            before = _apply(self.power(symbol, k), after)
            low = min(before)
            self.backs[key] = tuple(x - low for x in before)
        return self.backs[key]

    def unroll(self, symbol: str, k: int, after: Vector, state: int) -> tuple[str, int]:
        """Least edits of 2**k turns, of those that cost least, and the state behind them."""
        key = symbol, k, after, state
        if key in self.strings:
            return self.strings[key]
        if k:
            left, middle = self.unroll(symbol, k - 1, self.back(symbol, k - 1, after), state)
            right, end = self.unroll(symbol, k - 1, after, middle)
            out = left + right, end
        else:
            before = _apply(self.power(symbol, 0), after)
            text, here = "", state
            while True:
                options = [(e, to) for e, cost, to in _edits(symbol, here) if cost + after[to] == before[here]]
                if options and options[0][0] == "D" or 2 + before[_NEXT[here]] != before[here]:
                    break
                text, here = text + "I", _NEXT[here]
            out = text + options[0][0], options[0][1]
        if k <= 12:
            self.strings[key] = out
        return out

    def plan(self, runs: list[tuple[str, int]], state: int, after: Vector) -> tuple[str, int]:
        """Edits of consecutive runs, with the costs to go behind them, and the state behind them."""
        pieces = [(symbol, k) for symbol, length in runs for k in range(length.bit_length()) if length >> k & 1]
        behind = []
        for symbol, k in reversed(pieces):
            behind.append(after)
            after = self.back(symbol, k, after)
        text = []
        for (symbol, k), own in zip(pieces, reversed(behind)):
            edits, state = self.unroll(symbol, k, own, state)
            text.append(edits)
        return "".join(text), state


def _tail(state: int) -> str:
    """Inserted turns behind the last one."""
    out = ""
    while END[state]:
        out, state = out + "I", _NEXT[state]
    return out


def _runs(symbols: list[str], copies: list[int]) -> list[tuple[str, int]]:
    """Equal consecutive symbols as one run. All copies of a turn but the first must go."""
    out: list[list] = []
    for symbol, n in zip(symbols, copies):
        for s, length in ((symbol, 1), ("-", n - 1)):
            if length and out and out[-1][0] == s:
                out[-1][1] += length
            elif length:
                out.append([s, length])
    return [(s, n) for s, n in out]


def _row_results(planner: Planner, symbols: list[str], copies: list[int], state: int, after: Vector, last: bool) -> list[tuple[str, str, int]]:
    """Per turn row: its edits, the turns that it leaves (u, a: inserted; K; U, A: renamed) and their cost."""
    key = None
    if len(symbols) <= 64:
        key = tuple(symbols), tuple(copies), state, after, last
        if key in planner.shapes:
            return planner.shapes[key]
    edits, end = planner.plan(_runs(symbols, copies), state, after)
    parts = iter(re.findall("I*[DKR]", edits))
    out = []
    for symbol, n in zip(symbols, copies):
        own = [next(parts) for _ in range(n)]
        made, cost = "", 0
        for edit in "".join(own):
            if edit == "D":
                cost += 3
                continue
            to = _KEEP[state, symbol[0]] if edit == "K" else _NEXT[state]
            made += "K" if edit == "K" else ("ua" if edit == "I" else "UA")[to == ASSISTANT]
            cost += (edit != "K") * 2 + (edit != "I") * (len(symbol) - 1)
            state = to
        out.append(("".join(own), made, cost))
    if last and (more := _tail(end)):
        edits, made, cost = out[-1]
        for _ in more:
            state = _NEXT[state]
            made += "ua"[state == ASSISTANT]
        out[-1] = edits + more, made, cost + 2 * len(more)
    if key:
        if len(planner.shapes) > 1 << 16:
            planner.shapes.clear()
        planner.shapes[key] = out
    return out


# Faults, and the order of the turns

def _faulty_rows(turns: DataFrame) -> DataFrame:
    """One row per different turn row: conv_id, turn, role, digest of the text, copies, and its first fault."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    end = F.right(F.rtrim(text, F.lit(_BLANKS)), F.lit(1))
    fault = F.when(end == "", "blank").when(~end.isin(".", "!", "?"), "truncated").otherwise("")
    rows = stored(turns.select("conv_id", "turn", role.alias("role"), F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("digest"),
                               fault.alias("fault"))
                  .groupBy("conv_id", "turn", "role", "digest", "fault").agg(F.count(F.lit(1)).alias("copies")), "turns")
    said = F.struct("conv_id", "role", "digest").alias("said")
    firsts = rows.groupBy(said).agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"))
    seen = ~F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn")).eqNullSafe(F.col("first"))
    return rows.withColumn("said", said).join(firsts, "said").drop("said").withColumn(
        "fault", F.when((F.col("fault") != "blank") & seen, "duplicate").otherwise(F.col("fault"))).drop("first")


def _laid_out(rows: DataFrame) -> DataFrame:
    """The rows in order, dealt by ranges and checkpointed, with their partition and a number that grows along all of them."""
    ensure_checkpoint_dir(rows.sparkSession)
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "digest")]
    initial = F.left(F.col("role"), F.lit(1))
    initial = F.when(initial.isin(*_ROLES), initial).otherwise(F.lit("x"))
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "-").when(
        F.col("fault") == "truncated", F.concat(initial, F.lit("."))).otherwise(initial)
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()
    return placed.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), "conv_id", "turn",
                         "role", "digest", "fault", "copies", initial.alias("initial"), symbol.alias("symbol"))


def _stretches(batches) -> Iterator[tuple[object, list[str], list[int], list[str], list]]:
    """Of each conversation in a sorted partition: id, symbols, copies, initials, turns."""
    conv, held = None, None
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "symbol", "copies", "initial", "turn")]
        for own, *row in zip(*columns):
            if held is None or own != conv:
                if held:
                    yield conv, *held
                conv, held = own, ([], [], [], [])
            for column, value in zip(held, row):
                column.append(value)
    if held:
        yield conv, *held


def _crossings(placed: DataFrame, planner: Planner) -> dict:
    """What partitions must know of conversations that begin before them or go on behind them.

    A partition's first and last conversation are all that can cross its borders; their min-plus
    matrices, two small rows per partition, come to the driver and are combined there.
    Returned by (partition, whether it is the partition's first): state before the stretch, costs to go behind it,
    whether the conversation ends with it, and the initial and turn before it.
    """
    def ends(batches):
        first, last, shape, part = _borders(batches)
        if first:
            plans = Planner()
            kinds = pa.schema([("part", pa.int32()), ("first", pa.bool_()), ("matrix", pa.list_(pa.int64())), ("initial", pa.string()),
                               shape.field("turn"), shape.field("conv_id")])
            yield pa.RecordBatch.from_pylist([
                {"part": part, "first": s is first, "matrix": [x for r in plans.matrix(_runs(s[1], s[2])) for x in r],
                 "initial": s[3][-1], "turn": s[4][-1], "conv_id": s[0]} for s in ([first] if first is last else [first, last])], schema=kinds)

    fields = T.StructType().add("part", "integer").add("first", "boolean").add("matrix", T.ArrayType(T.LongType())).add(
        "initial", "string").add(placed.schema["turn"]).add(placed.schema["conv_id"])
    slim = placed.select("part", "conv_id", "turn", "copies", "initial", "symbol")
    rows = sorted(slim.mapInArrow(ends, fields).collect(), key=lambda r: (r["part"], not r["first"]))
    chains, at = [], 0
    while at < len(rows):  # stretches of one conversation in partitions that follow each other
        stop = at + 1
        while stop < len(rows) and rows[stop]["conv_id"] == rows[at]["conv_id"] and rows[stop]["first"] and rows[stop]["part"] != rows[at]["part"]:
            stop += 1
        if stop - at > 1:
            chains.append(rows[at:stop])
        at = stop
    behind = {}
    for chain in chains:
        after = END
        for r in reversed(chain):
            behind[r["part"], r["first"]] = after
            m = r["matrix"]
            before = _apply(tuple(tuple(m[4 * i : 4 * i + 4]) for i in range(4)), after)
            after = tuple(x - min(before) for x in before)
    if not behind:
        return {}

    def states(batches):
        first, last, _, part = _borders(batches)
        out, plans = [], Planner()
        for s in [first, last][: 2 if first is not last else 1]:
            key = part, s is first
            if key in behind:
                out.append({"part": part, "first": s is first, "ends": [plans.plan(_runs(s[1], s[2]), q, behind[key])[1] for q in range(4)]})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_ENDS)

    ends_of = {(r["part"], r["first"]): r["ends"] for r in slim.mapInArrow(states, "part int, first boolean, ends array<int>").collect()}
    known = {}
    for chain in chains:
        state, before = START, (None, None)
        for r in chain:
            key = r["part"], r["first"]
            known[key] = (state, behind[key], r is chain[-1], r is not chain[0], *before)
            state, before = ends_of[key][state], (r["initial"], r["turn"])
    return known


_ENDS = pa.schema([("part", pa.int32()), ("first", pa.bool_()), ("ends", pa.list_(pa.int32()))])


def _borders(batches) -> tuple:
    """First and last conversation of a partition, the batches' schema and the partition's number."""
    found: list = [None, None]

    def watched():
        for batch in batches:
            if batch.num_rows:
                found[:] = batch.schema, batch.column(0)[0].as_py()
                yield batch

    first = last = None
    for stretch in _stretches(watched()):
        first, last = first or stretch, stretch
    return first, last, *found


def plan_repairs(turns: DataFrame) -> DataFrame:
    """The cheapest edits that give each conversation the roles of an optional system turn and user-assistant pairs, or none.

    ``turns`` has conv_id, turn, role and text. A conversation's turns come in order of (turn, role, SHA-256 of the text),
    null turns first; a null conv_id is a conversation; null roles and texts count as empty. A turn is blank without any
    other sign than white space, else a duplicate if its role and text came earlier, else truncated if its last sign
    is none of ``.!?``. Edits: keep (K, 0), rename to user or assistant (R, 2), delete (D, 3; blank turns and duplicates
    must go), insert an empty user or assistant turn (I, 2); a truncated turn that stays costs 1. Of equally cheap
    edits the least string of letters is taken. Extra columns are left out; an empty table gives no rows.

    Returned per different turn row, in order of ``at``: part, at, conv_id, turn, role, digest, fault, copies (equal rows), audit
    (its edits, inserted turns before it first, the conversation's last row also with those behind it), made (the turns that
    it leaves: u, a inserted, U, A renamed, K kept), cost, illegal (pairs of neighbours whose roles may not follow each other)
    and fresh (1 for the first row of a known turn number).

    Runs of equal symbols (role and fault) are advanced by cached powers of two of their min-plus transitions. A
    conversation may lie in many partitions: each then works on its stretch, between the state and the costs that
    the products of the others' transitions give. Texts are not shuffled, only their digests.
    """
    rows = _laid_out(_faulty_rows(turns))
    known = rows.sparkSession.sparkContext.broadcast(_crossings(rows, Planner()))  # at most two entries per partition

    def run(batches):
        planner, waiting, results, sent, part = Planner(), deque(), [], 0, None
        number = 0

        def solve(stretch, last_of_part: bool) -> None:
            nonlocal number
            _, symbols, copies, initials, numbers = stretch
            own = (part, number == 0)
            fact = known.value.get(own) if number == 0 or last_of_part else None
            state, after, ends, goes_on, initial, turn = fact or (START, END, True, False, None, None)
            number += 1
            for i, (audit, made, cost) in enumerate(_row_results(planner, symbols, copies, state, after, ends)):
                pair = (initial, initials[i])
                illegal = copies[i] - 1 + ((i > 0 or goes_on) and pair not in _LEGAL)
                fresh = numbers[i] is not None and (numbers[i] != turn or (i == 0 and not goes_on))
                results.append((audit, made, cost, illegal, int(fresh)))
                initial, turn = initials[i], numbers[i]

        def ready():
            nonlocal sent
            while waiting and len(results) - sent >= waiting[0].num_rows:
                batch = waiting.popleft()
                own = results[sent : sent + batch.num_rows]
                sent += batch.num_rows
                columns = [pa.array(c, f.type) for c, f in zip(zip(*own), _RESULTS)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], names=[*kept, *_RESULTS.names])
            if sent == len(results):
                results.clear()
                sent = 0

        def watched():
            nonlocal part
            for batch in batches:
                if batch.num_rows:
                    part = batch.column(0)[0].as_py()
                    waiting.append(batch)
                    yield batch

        held = None
        for stretch in _stretches(watched()):
            if held:
                solve(held, False)
                yield from ready()
            held = stretch
        if held:
            solve(held, True)
            yield from ready()

    kept = ["part", "at", "conv_id", "turn", "role", "digest", "fault", "copies"]
    schema = rows.select(*kept).schema
    for name, kind in (("audit", "string"), ("made", "string"), ("cost", "long"), ("illegal", "long"), ("fresh", "long")):
        schema = schema.add(name, kind)
    return rows.mapInArrow(run, schema)


_RESULTS = pa.schema([("audit", pa.string()), ("made", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64()), ("fresh", pa.int64())])


def conversation_report(plan: DataFrame) -> DataFrame:
    """Per conversation of a plan: gaps, blank, duplicate, truncated, illegal, cost and the whole audit.

    ``gaps`` counts the missing numbers between the least and the largest turn. Audits are joined by
    partition first, so what meets in one row is one string per partition that the conversation lies in.
    """
    def faults(name: str) -> Column:
        """A duplicate's first copy is not counted again; later copies of any turn but a blank one are duplicates."""
        own = F.when(F.col("fault") == name, F.col("copies") if name != "truncated" else F.lit(1)).otherwise(0)
        if name == "duplicate":
            own = F.when(F.col("fault").isin("", "truncated"), F.col("copies") - 1).otherwise(own)
        return F.sum(own).alias(name)

    def joined(order: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "audit"))), lambda s: s["audit"]), "").alias("audit")

    sums = ["blank", "duplicate", "truncated", "illegal", "cost", "fresh"]
    pieces = plan.groupBy("conv_id", "part").agg(
        *[faults(n) for n in sums[:3]], *[F.sum(n).alias(n) for n in sums[3:]], F.min("turn").alias("low"),
        F.max("turn").alias("high"), joined("at"))
    whole = pieces.groupBy("conv_id").agg(*[F.sum(n).alias(n) for n in sums], F.min("low").alias("low"), F.max("high").alias("high"),
                                          joined("part"))
    return whole.select("conv_id", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("fresh"), F.lit(0)).cast("bigint").alias("gaps"),
                        *sums[:5], "audit")


def repaired_turns(turns: DataFrame, plan: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, at and place (their order), edit (K, R or I), turn, role and text.

    Inserted turns have no turn number and an empty text; renamed ones have the new role. Texts are shuffled
    once, to meet the rows of the plan that leave a turn.
    """
    text = F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("digest")
    key = F.struct("conv_id", "turn", "role", "digest").alias("key")
    texts = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), digest, text.alias("text")).groupBy(key).agg(
        F.min("text").alias("text"))
    made = plan.where("made != ''").select(key, "conv_id", "at", "turn", "role", F.posexplode(F.split("made", "")).alias("place", "how")).where(
        "how != ''")
    kept = F.col("how").isin("K", "U", "A")
    named = F.when(F.col("how") == "K", F.col("role")).when(F.lower("how") == "u", "user").otherwise("assistant")
    edit = F.when(F.col("how") == "K", "K").when(kept, "R").otherwise("I")
    return made.join(texts, "key", "left").select(
        "conv_id", "at", "place", edit.alias("edit"), F.when(kept, F.col("turn")).alias("turn"), named.alias("role"),
        F.when(kept, F.col("text")).otherwise("").alias("text"))


def repaired_digests(repaired: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256, the digest of a conversation's ``role:text`` lines, joined by line breaks.

    A digest is one chain over all of a conversation, so its lines pass one task, in order and a
    batch at a time.
    """
    line = F.concat("role", F.lit(":"), "text").alias("line")
    ordered = repaired.select("conv_id", line, "at", "place").repartition("conv_id").sortWithinPartitions("conv_id", "at", "place")

    def run(batches):
        conv, digest = None, None
        for batch in batches:
            done = []
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if digest is None or own != conv:
                    if digest:
                        done.append((conv, digest.hexdigest()))
                    conv, digest = own, hashlib.sha256(text.encode())
                else:
                    digest.update(b"\n" + text.encode())
            kind = batch.schema.field(0).type
            if done:
                yield _pairs(done, kind)
        if digest:
            yield _pairs([(conv, digest.hexdigest())], kind)

    return ordered.mapInArrow(run, repaired.select("conv_id").schema.add("repaired_sha256", "string"))


def _pairs(rows: list, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.string())],
                                      names=["conv_id", "repaired_sha256"])
