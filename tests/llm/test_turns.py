"""Conversation repair against a search over all edits, one turn after the other."""

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pytest

from patronage.llm import turns

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, audit string, cost string, same string, of string, side string, place string"


def spoil(rows):
    out = []
    for conv, turn, role, text in rows:
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if lot == 0:
            continue
        text = "" if lot == 1 else text.translate({ord(c): None for c in ".!?"}) if lot == 2 else text
        out += [(conv, turn, "user" if lot == 4 else role, text)] * (2 if lot == 3 else 1)
    return out


def brute(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired) of one conversation's rows in order."""
    faults, seen = [], set()
    for _, _, role, text in rows:
        core = text.strip(SPACE)
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None)
        seen.add((role, text))
    numbers = {r[1] for r in rows if r[1] is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    first = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))

    def wanted(have):  # initials that may follow
        return {"": "su", "s": "u", "u": "a", "a": "u"}[have]

    @lru_cache(None)
    def best(i, have, put):
        options = []
        if i == len(rows) and have in ("", "a"):
            options.append((0, "", ()))
        if put < 3:
            for c in wanted(have).replace("s", ""):
                cost, audit, rest = best(i, c, put + 1)
                options.append((3 + cost, "I" + audit, ({"u": "user", "a": "assistant"}[c] + ":", *rest)))
        if i < len(rows):
            _, _, role, text = rows[i]
            cost, audit, rest = best(i + 1, have, 0)
            options.append((4 + cost, "D" + audit, rest))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 if faults[i] else 0
                if role[:1] and role[:1] in wanted(have):
                    cost, audit, rest = best(i + 1, role[:1], 0)
                    options.append((extra + cost, "K" + audit, (f"{role}:{text}", *rest)))
                for c in wanted(have).replace("s", ""):
                    cost, audit, rest = best(i + 1, c, 0)
                    options.append((3 + extra + cost, "R" + audit, ({"u": "user", "a": "assistant"}[c] + ":" + text, *rest)))
        return min(options) if options else (10 ** 9, "", ())

    cost, audit, repaired = best(0, "", 0)
    count = faults.count
    return gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, "\n".join(repaired)


def expected(given, damage=True):
    rows = spoil(given) if damage else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in given]
    out = {}
    for conv in {r[0] for r in given}:
        own = [r for r in rows if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()))
        *told, text = brute(own)
        out[conv] = (*told, hashlib.sha256(text.encode()).hexdigest())
    return out


def result(df):
    rows = df.collect()
    out = {r["conv_id"]: tuple(r[n] for n in (*turns.NAMES, "repaired_sha256")) for r in rows}
    assert len(out) == len(rows)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 6) for r in rows], SCHEMA)


@pytest.mark.parametrize("damage", [True, False])
def test_against_all_edits(spark, damage):
    rng = np.random.default_rng(3)
    rows = []
    for conv in range(150):
        for turn in range(int(rng.integers(1, 14))):
            role = rng.choice(["system", "user", "assistant", "tool", "", "User"], p=[.15, .35, .35, .05, .05, .05])
            text = rng.choice(["Yes.", "No", "Why? ", "", " \t\n", "A!\x0b", "Und so", f"Text {conv} {turn}."], p=[.1, .1, .1, .05, .05, .05, .05, .5])
            at = int(turn + rng.integers(0, 2) * 3) if rng.random() < .9 else None
            rows.append((None if conv == 0 else conv, at, None if rng.random() < .03 else str(role), None if rng.random() < .03 else str(text)))
    rows += rows[40:60]
    assert result(turns.repair_digest(frame(spark, rows), damage)) == expected(rows, damage)


def test_long_runs_equal_single_steps():
    rng = np.random.default_rng(1)
    for _ in range(200):
        symbols = [int(s) for s in rng.choice([0, 1, 2, 3, 4, 5, 6, 7, turns.GONE], size=int(rng.integers(1, 6)))]
        runs = [(s, int(rng.integers(1, 40))) for s in symbols]
        assert turns.cheapest(runs) == turns.cheapest([(s, 1) for s, n in runs for _ in range(n)])
    cost, audit = turns.cheapest([(1, 100_000)])
    assert (cost, len(audit), set(audit)) == (150_000, 100_000, {"K", "R"})


def test_turns_come_out_edited(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hello?"), (1, 2, "user", "Who?"), (1, 3, "assistant", "Me."), (1, 4, "assistant", " "), (2, 0, "assistant", "A.")]
    told, out = turns.repair(frame(spark, rows))
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in told.collect()} == {conv: brute([r for r in rows if r[0] == conv])[5:7] for conv in (1, 2)}
    got = [(r["conv_id"], r["place"], r["edit"], r["role"], r["text"]) for r in out.orderBy("conv_id", "place").collect()]
    audit = {r["conv_id"]: r["audit"] for r in told.collect()}
    for conv in (1, 2):
        assert "".join(g[2] for g in got if g[0] == conv) == audit[conv].replace("D", "")
    assert got[-2:] == [(2, 0, "I", "user", ""), (2, 1, "K", "assistant", "A.")]


def test_edge_cases(spark):
    long = "word " * 200_000 + "."
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "All gone."), (2000, None, "user", "x."), (2000, None, "user", "x."), (2001, 5, None, None), (2002, 1, "user", long), (2002, 2, "assistant", "é."), (2003, -5, "", ""), (None, None, None, None)]
    got = result(turns.repair_digest(frame(spark, rows)))
    assert got == expected(rows)
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert turns.repair_digest(frame(spark, [])).collect() == []
