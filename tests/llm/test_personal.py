"""Personal data: patterns against the expressions they stand for, and the field against a search over all labellings."""

import hashlib
import itertools
import re

import numpy as np
import pytest

from patronage.llm import personal
from patronage.llm.personal import CARD, EMAIL, IP, KINDS, OUT, PHONE, Span

SAID = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def check_digit(s):
    table = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    return sum(table[int(c)] if i % 2 else int(c) for i, c in enumerate(s[::-1])) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in SAID.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else None,
                    "card": 13 <= len(digits) <= 19 and check_digit(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def card(rng, length=16):
    body = "4" + "".join(map(str, rng.integers(0, 10, length - 2)))
    return next(body + d for d in "0123456789" if check_digit(body + d))


def email(rng):
    return "".join(rng.choice(list("abcdefg"), 5)) + f".{rng.integers(10, 99)}@mail{rng.integers(9)}.example.com"


def phone(rng):
    return f"+1 ({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)}"


def ip(rng):
    return ".".join(str(n) for n in rng.integers(1, 255, 4))


def prose(rng, n):
    return " ".join("".join(rng.choice(list("aeioutnrs"), int(rng.integers(2, 9)))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(2)
    make = (email, ip, card, phone)
    plain = [f"{prose(rng, 4)} version {rng.integers(1, 9)}.{rng.integers(0, 9)} {prose(rng, 5)} {rng.integers(0, 10 ** 9)} {prose(rng, 5)}" for _ in range(60)]
    return [f"{prose(rng, 6)} {make[i % 4](rng)} {prose(rng, 6)}" for i in range(320)] + plain


@pytest.fixture(scope="module")
def model(corpus):
    return personal.fit(corpus)


def test_patterns_against_their_expressions():
    rng = np.random.default_rng(4)
    for _ in range(3000):
        text = "".join(rng.choice(["@", ".", "a", "b.c", "1", "25", "256", "0", "4111111111111111", " ", "-", "+", "(", ")", "+1 ", "é", "\n", "_%", "4111 1111 1111 1111", "1.2.3.4", "x@y.z"], int(rng.integers(1, 16))))
        assert sorted((KINDS[s.kind], s.start, s.end) for s in personal.base_spans(text)) == sorted(brute(text)), text


def test_best_labelling_against_all(model):
    rng = np.random.default_rng(6)
    for _ in range(40):
        text = " ".join([str(rng.choice(["call", "12", "555-0199", "+1", "(212)", "10.0.0.1", "a [at] b [dot] org", "99"])) for _ in range(4)])
        graph = personal.lattice(text, 0, len(text))
        if not graph.edges:
            continue
        noisy = personal.Model({f: float(rng.normal()) for e in graph.edges for f in e[3]}, rng.normal(size=(5, 5)).tolist())

        def ways(at):
            if at == len(graph.places) - 1:
                yield ()
            for e in graph.edges:
                if e[0] == at:
                    for rest in ways(e[1]):
                        yield (e, *rest)

        def score(way):
            return sum(sum(noisy.weights[f] for f in e[3]) + noisy.after[p][e[2]] for p, e in zip([OUT, *[e[2] for e in way]], way))

        every = list(itertools.islice(ways(0), 200_000))
        best = [Span(e[2], graph.places[e[0]], graph.places[e[1]]) for e in max(every, key=score) if e[2] != OUT]
        assert personal.best_spans(noisy, graph) == best


def added(model, text):
    return [(KINDS[s.kind], text[s.start:s.end]) for s in personal.added_spans(text, personal.base_spans(text), model)]


def test_spans_run_together_are_taken_apart(model):
    rng = np.random.default_rng(8)
    for _ in range(50):
        p, c, i = phone(rng), card(rng), ip(rng)
        assert added(model, f"oras nti {p} {c} onto") == [("phone", p), ("card", c)]
        if not any(k == "card" for k, _, _ in brute(f"{c} {i}")):  # by chance the check digit fits with the next number
            assert added(model, f"oras nti {c} {i} onto") == [("card", c)]
        assert added(model, f"oras nti {p} {i} onto") == [("phone", p)]


def test_spans_written_otherwise_are_mostly_found(model):
    rng = np.random.default_rng(10)
    found = []
    for _ in range(100):
        e, i = email(rng), ip(rng)
        other = e.replace("@", " [at] ").replace(".com", " [dot] com").replace(".example", " [dot] example")
        found += [added(model, f"{prose(rng, 5)} {other} {prose(rng, 5)}") == [("email", other)]]
        other = i.replace(".", "[.]")
        found += [added(model, f"{prose(rng, 5)} {other} {prose(rng, 5)}") == [("ip", other)]]
    assert np.mean(found) > 0.9


def test_clean_text_stays_clean(model):
    rng = np.random.default_rng(12)
    clean = ["Released 2024-03-11 at 10:22:31.", "Version 1.2.3 or 10.4", "It cost 1,234,567.89 in 1999-2004.", "He stayed at home. dot", "password=dd605f4e45f5f1b466", "AKIAMD4HKU6VBLCCCCE 12", "Room 12-14, page 300"]
    got = [added(model, f"{prose(rng, 5)} {c} {prose(rng, 5)}") for c in clean]
    assert got == [[]] * len(clean)


def test_query_against_brute_force(spark, docs_frame, corpus, model):
    rows = [(i, t) for i, t in enumerate(corpus[:40])] + [(100, f"{corpus[0]} {corpus[3]} {corpus[2]}")]
    for r in personal.digest(docs_frame(rows), model).collect():
        text = dict(rows)[r["doc_id"]]
        base = sorted(brute(text), key=lambda s: (KINDS.index(s[0]), s[1]))
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[0] == k for s in base) for k in KINDS]
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        assert {(k, int(a), int(b)) for k, a, b in spans} >= set(base)
        assert spans == sorted(spans, key=lambda s: (KINDS.index(s[0]), int(s[1])))


def test_edge_cases(edge, empty, docs_frame, model):
    full = personal.find(edge, model)
    assert full.columns == [*edge.columns, "spans"] and full.count() == edge.count()
    assert personal.find(full, model).columns == full.columns
    assert personal.find(empty, model).collect() == [] and personal.train(empty) == personal.Model({}, [[0.0] * 5] * 5)
    nothing = hashlib.sha256(b"").hexdigest()
    rows = [(1, None), (1, None), (None, ""), (2, "9" * 200_000), (3, "a" * 200_000 + "@b"), (4, "1." * 100_000), (5, "+1" * 50_000), (6, "a.b@" * 50_000), (7, "x at " * 40_000 + "y dot z")]
    got = personal.digest(docs_frame(rows), model).collect()
    assert len(got) == len(rows)
    assert all(r["spans"] == "" and r["base_sha256"] == nothing for r in got if r["doc_id"] in (None, 1, 2, 3, 5))
    bare = personal.digest(docs_frame([(1, "a@b.cc 1.2.3.4 555-0199")]), personal.Model({}, [])).first()
    assert bare["spans"] == "email:0:6,ip:7:14"


def test_training_learns_from_the_table(spark, docs_frame, corpus):
    learned = personal.train(docs_frame(list(enumerate(corpus))))
    assert {EMAIL, IP, CARD, PHONE} <= {KINDS.index(f) for f in learned.weights if f in KINDS}
    rng = np.random.default_rng(14)
    p, c = phone(rng), card(rng)
    assert added(learned, f"xa {p} {c} yo") == [("phone", p), ("card", c)]
