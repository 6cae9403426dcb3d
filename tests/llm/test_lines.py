import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from patronage.llm import lines
from patronage.llm.common import read
from tests.llm.conftest import EDGE


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row, before = [i], row
        for j, d in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (c != d)))
    return row[-1]


def edited(rng, line, n, letters="abcd é"):
    out = list(line)
    for _ in range(n):
        at, kind = rng.randrange(len(out) + 1), rng.random()
        if kind < 0.34:
            out.insert(at, rng.choice(letters))
        elif out and kind < 0.67:
            out.pop(min(at, len(out) - 1))
        elif out:
            out[min(at, len(out) - 1)] = rng.choice(letters)
    return "".join(out)


@settings(max_examples=1500, deadline=None)
@given(st.text("ab", max_size=14), st.integers(0, 4), st.integers(0, 6), st.randoms(use_true_random=False))
def test_banded_distance(a, k, n, rng):
    b = edited(rng, a, n, "abc")
    assert lines.within(a, b, k) == (distance(a, b) <= k)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_close_lines_share_a_key(edits):
    rng = random.Random(edits)
    for _ in range(4000):
        a = "".join(rng.choices("ab", k=rng.randint(20, 34)))
        b = edited(rng, a, rng.randint(1, edits), "ab")
        posted = [({(p, i, x[at:at + size]) for p, i, at, size, role in lines.places(len(x), edits) if role >= least})
                  for x in (a, b) for least in (lines.PROBE, lines.INDEX)]
        assert posted[0] & posted[3] or posted[1] & posted[2]
        s = lines.sketches([a, b])
        assert lines.bridged(s[:1], s[1:], edits)[0]


def brute(rows, shortest=lines.MIN_CHARS):
    """doc_id -> places taken out, over all pairs of lines; ids are distinct and not null.

    Equal lines count from `shortest` characters on, blank ones excepted, near-equal ones from `MIN_CHARS` on.
    """
    occurs = {}
    for doc, text in rows:
        for place, line in enumerate((text or "").split("\n")):
            if text is not None and len(line) >= shortest and line.strip():
                occurs.setdefault(line, []).append((doc, place))
    distinct = sorted(occurs, key=len)
    up = {x: x for x in distinct}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if len(b) - len(a) > lines.EDITS:
                break
            if len(a) >= lines.MIN_CHARS and distance(a, b) <= lines.allowed(len(a)):
                up[root(a)] = root(b)
    classes = {}
    for line, at in occurs.items():
        classes.setdefault(root(line), []).extend(at)
    out = {doc: [] for doc, _ in rows}
    for at in classes.values():
        for doc, place in sorted(at)[1:]:
            out[doc].append(place)
    return {d: sorted(p) for d, p in out.items()}


def corpus(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcd é", k=rng.randint(15, 60))) for _ in range(12)]
    base += [base[0][:20] + "".join(rng.choices("abcd", k=25)) for _ in range(15)]  # one beginning, different lines
    rows = []
    for doc in range(60):
        own = [edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 5))]
        rows.append((doc, "\n".join(own)))
    return rows


@pytest.mark.parametrize("chunk, at_once", [(512, 4096), (3, 4)])
def test_against_all_pairs(spark, docs_frame, monkeypatch, chunk, at_once):
    monkeypatch.setattr(lines, "AT_ONCE", at_once)
    monkeypatch.setattr(lines.line_links, "__defaults__", (lines.EDITS, chunk))
    rows = corpus(chunk)
    want = brute(rows)
    assert any(want.values())
    got = {r["doc_id"]: r for r in lines.deduplicate_lines(docs_frame(rows), removed="taken").collect()}
    assert {d: list(r["taken"]) for d, r in got.items()} == want
    for doc, text in rows:
        assert got[doc]["text"] == "\n".join(x for i, x in enumerate(text.split("\n")) if i not in want[doc])


def test_edge_documents(edge, empty):
    rows = [(r["doc_id"], r["text"]) for r in lines.deduplicate_lines(edge).collect()]
    assert lines.deduplicate_lines(edge).columns == edge.columns
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(rows, key=order) == sorted(EDGE, key=order)  # no line of 20 characters twice
    assert lines.deduplicate_lines(empty).count() == 0


def test_ties_repeats_and_null_ids(docs_frame):
    line = "a line of more than twenty characters"
    rows = [(None, line), (3, f"{line}\n{line}"), (2, f"short\n{line}."), (2, f"short\n{line}."), (9, f"{line}\nother text that nobody else has")]
    got = sorted(((r["doc_id"], r["text"]) for r in lines.deduplicate_lines(docs_frame(rows)).collect()), key=str)
    assert got == sorted([(None, ""), (3, ""), (2, f"short\n{line}."), (2, f"short\n{line}."), (9, "other text that nobody else has")], key=str)


def test_whole_table_against_all_pairs(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    cheap = {}

    def quick(a, b):  # edits change at most two counts each
        from collections import Counter
        ca, cb = (cheap.setdefault(x, Counter(x)) for x in (a, b))
        return 3 if (ca - cb).total() > 2 or (cb - ca).total() > 2 else _slow(a, b)

    global distance
    _slow, distance = distance, quick
    try:
        want = brute(rows)
    finally:
        distance = _slow
    assert {r["doc_id"]: list(r["taken"]) for r in lines.deduplicate_lines(docs, removed="taken").collect()} == want
