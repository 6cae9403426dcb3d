"""Repair of conversations: the cheapest edits after which roles alternate, found by dynamic programming over runs.

A conversation's turns must read `system`? then pairs of `user` and `assistant`. Turns can be kept, given another role,
deleted, and turns without text can be put in. What a turn costs depends on a symbol alone, the initial of its role
and its fault. So:

1. Faults are columns; whether role and text were seen earlier is known from the least turn with that pair.
2. Symbols go through in order without texts, and consecutive equal ones collapse into runs. One symbol is a min-plus matrix over
   the states of the role pattern; its binary powers are cached, and a run takes as many products as its length has bits.
3. The audit, the edits' initials, is unrolled from the vectors between runs by halving; equal halves are remembered.
4. Turns meet their audit once more in order, and come out edited.

Turns stream through in order; of a conversation a task holds its runs and its audit, never its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import stored

SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
ROLES = {2: "user", 3: "assistant"}  # the role that leads to a state
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
NEXT = (AFTER_USER, AFTER_USER, AFTER_ASSISTANT, AFTER_USER)  # by a put-in or changed turn
PUT_IN, CHANGE, DELETE, CUT_OFF = 3, 3, 4, 3  # what edits cost; the last is for a turn cut off that stays
INITIALS = "sua"
GONE = 8  # the symbol of turns that must go; others are the initial's number, plus 4 for those cut off
NEVER = 1 << 60
MOST_HALVINGS = 12  # longer stretches of one run are unrolled in parts of 2 ** this


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of the turns left when crc32(`conv_id:turn`) % 20 says what happens to each; nulls are a space."""
    text_or = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(text_or("conv_id"), F.lit(":"), text_or("turn"))) % 20
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.when(lot == 4, "user").otherwise(text_or("role")).alias("role"),
        F.when(lot == 1, "").when(lot == 2, F.translate(text_or("text"), ENDS, "")).otherwise(text_or("text")).alias("text"),
        F.when(lot == 3, 2).otherwise(1).alias("copies"), lot.alias("lot"),
    ).where("lot <> 0").drop("lot")


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of the turns as they are; null roles and texts are a space."""
    space = F.lit(" ")
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"),
                                F.coalesce(F.col("text").cast("string"), space).alias("text"), F.lit(1).alias("copies"))


def _same() -> Column:
    return F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))


def symbols(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, same, first, blank, cut, who, copies) of turns: without texts, but all that edits depend on.

    first: no earlier turn has this role and text. Turns of one number come in the order of a hash of role and text,
    so equal ones are neighbours, and among them the first is the first.
    """
    core = F.rtrim(F.col("text"), F.lit(SPACE))
    who = F.when(F.length("role") == 0, 3).otherwise(F.pmod(F.instr(F.lit(INITIALS), F.substring("role", 1, 1)) + 3, F.lit(4)))
    slim = rows.select("conv_id", "turn", _same().alias("same"), (core == "").alias("blank"),
                       (~F.substring(core, -1, 1).isin(*ENDS)).alias("cut"), who.cast("int").alias("who"), "copies")
    place = F.struct(F.col("turn").isNotNull().alias("named"), "turn")
    least = slim.groupBy(F.col("conv_id").alias("of"), F.col("same").alias("like")).agg(F.min(place).alias("least"))
    met = slim.join(least, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("same") == F.col("like")))
    return met.select("conv_id", "turn", "same", F.col("turn").eqNullSafe(F.col("least.turn")).alias("first"), "blank", "cut", "who", "copies")


def _times(a: tuple, b: tuple) -> tuple:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


def _costs(symbol: int) -> tuple[int | None, int | None]:
    """What keeping (but for its role) and changing a turn cost."""
    if symbol == GONE:
        return None, None
    extra = CUT_OFF if symbol >= 4 else 0
    return extra, CHANGE + extra


def _kept(symbol: int, state: int) -> int | None:
    """The state after a kept turn, if it may be kept in this state."""
    if symbol == GONE:
        return None
    to = {0: AFTER_SYSTEM, 1: AFTER_USER, 2: AFTER_ASSISTANT}.get(symbol % 4)
    fits = state == START if to == AFTER_SYSTEM else to == NEXT[state]
    return to if fits else None


def _put_in() -> tuple:
    out = [[0 if i == j else NEVER for j in range(4)] for i in range(4)]
    for i in range(4):
        state, cost = i, 0
        for _ in range(3):
            state, cost = NEXT[state], cost + PUT_IN
            out[i][state] = min(out[i][state], cost)
    return tuple(map(tuple, out))


@lru_cache(maxsize=None)
def power(symbol: int, k: int) -> tuple:
    """Min-plus matrix, from state to state, of 2 ** k turns of a symbol with any turns put in before each."""
    if k:
        half = power(symbol, k - 1)
        return _times(half, half)
    step = [[DELETE if i == j else NEVER for j in range(4)] for i in range(4)]
    keep, change = _costs(symbol)
    for i in range(4):
        if keep is not None:
            step[i][NEXT[i]] = min(step[i][NEXT[i]], change)
            if (to := _kept(symbol, i)) is not None:
                step[i][to] = min(step[i][to], keep)
    return _times(_put_in(), tuple(map(tuple, step)))


@lru_cache(maxsize=1 << 16)
def before(symbol: int, k: int, after: tuple) -> tuple[tuple, int]:
    """What remains to be paid before 2 ** k turns, given what remains after them, as (vector less its least, its least)."""
    cost = [min(a + b for a, b in zip(row, after)) for row in power(symbol, k)]
    least = min(cost)
    return tuple(c - least for c in cost), least


def ending() -> tuple:
    put_in = _put_in()
    return tuple(min(put_in[i][START], put_in[i][AFTER_ASSISTANT]) for i in range(4))


@lru_cache(maxsize=1 << 14)
def unrolled(symbol: int, k: int, state: int, after: tuple) -> tuple[str, int]:
    """The ASCII-least cheapest edits of 2 ** k turns of a symbol from a state, and the state they lead to."""
    if k:
        middle, _ = before(symbol, k - 1, after)
        one, state = unrolled(symbol, k - 1, state, middle)
        two, state = unrolled(symbol, k - 1, state, after)
        return one + two, state
    now, least = before(symbol, 0, after)
    keep, change = _costs(symbol)
    audit = ""
    while True:
        open_cost = now[state] + least
        if DELETE + after[state] == open_cost:
            return audit + "D", state
        if PUT_IN + now[NEXT[state]] + least == open_cost:
            audit, state = audit + "I", NEXT[state]
            continue
        to = _kept(symbol, state)
        if to is not None and keep + after[to] == open_cost:
            return audit + "K", to
        return audit + "R", NEXT[state]


def cheapest(runs: list[tuple[int, int]]) -> tuple[int, str]:
    """(cost, audit) of a conversation given as runs (symbol, length)."""
    blocks = []
    for symbol, length in runs:
        whole, rest = divmod(length, 1 << MOST_HALVINGS)
        blocks += [(symbol, MOST_HALVINGS)] * whole + [(symbol, k) for k in range(MOST_HALVINGS) if rest >> k & 1]
    vector, cost, after = ending(), 0, []
    for symbol, k in reversed(blocks):
        after.append(vector)
        vector, least = before(symbol, k, vector)
        cost += least
    cost += vector[START]
    state, audit = START, []
    for (symbol, k), vector in zip(blocks, reversed(after)):
        part, state = unrolled(symbol, k, state, vector)
        audit.append(part)
    while state not in (START, AFTER_ASSISTANT):
        audit.append("I")
        state = NEXT[state]
    return cost, "".join(audit)


class _Seen:
    """What is known of one conversation while its turns go by in order."""

    def __init__(self):
        self.runs: list[list[int]] = []
        self.count = [0, 0, 0, 0]  # blank, duplicate, truncated, illegal
        self.who = self.last = None
        self.least = self.most = None
        self.numbers = 0

    def add(self, turn, same, first, blank, cut, who, copies) -> None:
        for _ in range(copies):
            again = not first or self.last == (turn, same)
            if turn is not None and (self.most is None or turn != self.most):
                self.numbers += 1
                self.least, self.most = turn if self.least is None else self.least, turn
            fault = 0 if blank else 1 if again else 2 if cut else None
            if fault is not None:
                self.count[fault] += 1
            if self.who is not None and (self.who, who) not in ((0, 1), (1, 2), (2, 1)):
                self.count[3] += 1
            self.who, self.last = who, (turn, same)
            symbol = GONE if fault in (0, 1) else who + 4 * (fault == 2)
            if self.runs and self.runs[-1][0] == symbol:
                self.runs[-1][1] += 1
            else:
                self.runs.append([symbol, 1])

    def result(self) -> tuple:
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.numbers
        return (gaps, *self.count, *cheapest(self.runs))


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation with a turn."""
    marked = symbols(rows)
    kind = marked.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, done, arrow = None, None, [], None

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], arrow), *[pa.array(c, pa.int64()) for c in columns[1:7]], pa.array(columns[7], pa.string())], names=["conv_id", *NAMES])

        for batch in batches:
            arrow = batch.schema.field(0).type
            for conv, *turn in zip(*(c.to_pylist() for c in batch.columns)):
                if seen is None or conv != now:
                    if seen is not None:
                        done.append((now, *seen.result()))
                    now, seen = conv, _Seen()
                seen.add(*turn)
            if sum(len(d[-1]) for d in done) > 1 << 20 or len(done) > 1 << 16:
                yield flush()
                done = []
        if seen is not None:
            done.append((now, *seen.result()))
        if done:
            yield flush()

    ordered = marked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "same")
    return ordered.mapInArrow(run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def edited(rows: DataFrame, told: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text) of the turns after the edits that `told` holds in `audit`, deleted ones left out; conversations come whole and in order."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    notes = told.select("conv_id", F.lit(0).alias("side"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("same"), F.lit("").alias("role"),
                        F.col("audit").alias("text"), F.lit(1).alias("copies"))
    both = notes.unionByName(rows.select("conv_id", F.lit(1).alias("side"), "turn", _same().alias("same"), "role", "text", "copies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, place, now, arrow = "", 0, START, 0, None, None
        out: list[tuple] = []

        def put_in() -> None:
            nonlocal at, state, place
            while at < len(audit) and audit[at] == "I":
                at, state = at + 1, NEXT[state]
                out.append((now, place, "I", ROLES[state], ""))
                place += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], arrow), pa.array(columns[1], pa.int64()), *[pa.array(c, pa.string()) for c in columns[2:]]],
                                              names=["conv_id", "place", "edit", "role", "text"])

        for batch in batches:
            arrow = batch.schema.field(0).type
            for conv, side, _, _, role, text, copies in zip(*(c.to_pylist() for c in batch.columns)):
                if side == 0:
                    put_in()  # what ends the one before
                    audit, at, state, place, now = text, 0, START, 0, conv
                    continue
                for _ in range(copies):
                    put_in()
                    edit, at = audit[at], at + 1
                    if edit == "D":
                        continue
                    if edit == "R":
                        state = NEXT[state]
                        role = ROLES[state]
                    else:
                        state = AFTER_SYSTEM if role[:1] == "s" else NEXT[state]
                    out.append((now, place, edit, role, text))
                    place += 1
            if out:
                yield flush()
                out = []
        put_in()
        if out:
            yield flush()

    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "side", "turn", "same")
    return ordered.mapInArrow(run, f"conv_id {kind}, place long, edit string, role string, text string")


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of turns as `edited` returns them: of `role:text`, joined by newlines."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, arrow = None, None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now], arrow), pa.array([sha.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])
        for batch in batches:
            arrow = batch.schema.field(0).type
            for conv, place, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
                if place == 0:
                    if sha is not None:
                        yield row()
                    now, sha = conv, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
        if sha is not None:
            yield row()

    return turns.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repair(conversations: DataFrame, damage: bool = False) -> tuple[DataFrame, DataFrame]:
    """What is told of every conversation, and the turns after the edits.

    The first has conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit, the second conv_id, place, edit, role and text.
    damage: first spoil the turns as `damaged` does.

    Defined cases: null roles and texts are one space; null turns come first and make no gap; the null conv_id is a
    conversation like others; turns of one number come in the order of a hash of role and text, so a repeated row follows its like and is a
    duplicate; a conversation without turns left has zeros and an empty audit; empty tables give empty tables; texts of any length are
    judged whole; other columns are not looked at.
    """
    rows = damaged(conversations) if damage else turns(conversations)
    told = stored(audits(rows), "audits")
    every = conversations.select(F.col("conv_id").alias("of")).distinct()
    full = every.join(told, F.col("of").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("of").alias("conv_id"), *[F.coalesce(n, F.lit("" if n == "audit" else 0)).alias(n) for n in NAMES])
    return full, edited(rows, told)


def repair_digest(conversations: DataFrame, damage: bool = True) -> DataFrame:
    """What is told of every conversation, with the SHA-256 of its turns after the edits."""
    told, turns = repair(conversations, damage)
    sums = digests(turns).withColumnRenamed("conv_id", "of")
    nothing = F.lit(hashlib.sha256().hexdigest())
    return told.join(sums, F.col("conv_id").eqNullSafe(F.col("of")), "left").select("conv_id", *NAMES, F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
