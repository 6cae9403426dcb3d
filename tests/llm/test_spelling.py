"""Spelling variants against a count by hand and all pairs of words."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from patronage.llm import spelling

LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, damage=None, shortest=7, least=2, ratio=10):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if damage and h % damage == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            count[word] += 1
    count = {w: n for w, n in count.items() if len(w) >= shortest and n >= least}
    near = {w: [v for v in count if abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in count}
    best = {w: min(vs, key=lambda v: (-count[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if count[v] >= ratio * count[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n, len(near[w]), count.get(form.get(w))) for w, n in count.items()}


def result(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("damage", [None, 3])
def test_against_all_pairs(docs_frame, damage):
    rng = np.random.default_rng(5)
    stems = ["".join(rng.choice(list("abcdeé"), size=n)) for n in rng.integers(6, 10, 40)]
    stems += ["".join(rng.permutation(list("abcdefgh"))) for _ in range(60)]  # the same letters throughout
    rows = []
    for i in range(60):
        words = []
        for w in rng.choice(stems, 60):
            at = int(rng.integers(len(w)))
            kind = rng.integers(12)
            words.append({0: w[:at] + w[at + 1:], 1: w[:at] + "ü" + w[at:], 2: w[:at] + "a" + w[at + 1:], 3: w.capitalize()}.get(kind, w))
        rows.append((i if i % 7 else None, " ".join(words) + " Ébcdefgh, ébcdefgh; Zzzzzzz9zzzzzzz"))
    want = brute(rows, damage)
    assert any(v[0] for v in want.values()) or damage
    assert result(spelling.variants(docs_frame(rows), damage=damage)) == want


def test_chain_of_forms_and_ties(docs_frame):
    text = " ".join(["abcdefg"] * 2 + ["abcdefgh"] * 20 + ["abcdefghi"] * 200 + ["abcdefghij"] * 2000 + ["bbcdefgh"] * 20 + ["xbcdefg"] * 20)
    got = result(spelling.variants(docs_frame([(1, text)])))
    assert got == brute([(1, text)])
    assert got["abcdefg"][:2] == ("abcdefgh", "abcdefghij")  # a tie with xbcdefg, and three steps


def test_cells_chunks_and_long_words(docs_frame, monkeypatch):
    for name, value in (("CELL", 20), ("LEAST_SAMPLED", 2), ("CHUNK", 7), ("LEAF", 2), ("HELD", 10), ("AT_ONCE", 500), ("SAMPLE_LENGTH", 9)):
        monkeypatch.setattr(spelling, name, value)
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abc"), size=n)) for n in rng.integers(7, 11, 300)] + ["ab" * 400, "ab" * 400 + "c", "ab" * 399 + "bb"]
    rows = [(i, " ".join([w, w, *words[:i % 40]])) for i, w in enumerate(words)]
    assert result(spelling.variants(docs_frame(rows))) == brute(rows)


def test_edge_cases(edge, empty):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    assert result(spelling.variants(edge, shortest=3, damage=31)) == brute(rows, 31, shortest=3)
    assert spelling.variants(empty).collect() == []
    with pytest.raises(ValueError):
        spelling.variants(empty, ratio=1)
