"""Personal data in texts: fixed patterns, and a semi-Markov conditional random field for what they miss.

The patterns are strict about boundaries: a phone number that runs into a card number fails as a whole, and an address
written `name [at] host [dot] org` is none. The field scores whole candidate spans by what they consist of and what
surrounds them, and dynamic programming over spans of bounded length picks boundaries and kinds of a stretch of text together.

The field learns from the corpus alone: passages with spans that the patterns find, the same spans run together or written
otherwise, and passages and numbers without any. Passages where a pattern failed teach nothing. What the patterns find stays as it is;
the field adds spans between them.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.llm.common import fresh, per_batch, shared, stored, texts_of

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
OUT = 4  # the label of text that is no personal data

# Fixed patterns; each has an equivalent form here that takes linear time.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
FOUR = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

HINT = re.compile(r"[0-9@]|[\[({] ?(?:at|dot) ?[\])}]| dot ", re.I)
ATOM = re.compile(r"[0-9]+|[A-Za-z]+|\s+|.", re.S)
OTHERWISE = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@| @ | ?[\[({] ?at ?[\])}] ?| at )(?:[A-Za-z0-9-]++(?:\.| \. | ?[\[({] ?(?:dot|\.) ?[\])}] ?| dot ))+[A-Za-z0-9-]++", re.I)
SEPARATORS = {" ", "-", ".", "/", "(", ")", "[", "]", "dot", " dot ", ",", "\t", " "}
DOTS = {".", " . ", "[.]", "(.)", " dot ", "[dot]", "(dot)", " [dot] ", " (dot) "}

NEAR = 24  # characters between hints of one passage
MARGIN = 40
MOST_ATOMS = 24  # of a span
PASSAGE = 400  # characters of a passage to learn from, at most
SAMPLE, SAMPLE_WITHOUT = 700, 300  # passages to learn from, with and without a span
EPOCHS, RATE, PRIOR = 8, 0.3, 1e-3
SUPPORT = 8  # passages that a word before a span must occur in to count
BATCH = 200


class Span(NamedTuple):
    kind: int
    start: int
    end: int


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _is_octet(s: str) -> bool:
    s = s.lstrip("0")
    return len(s) <= 3 and int(s or "0") <= 255


def matches(text: str) -> Iterator[tuple[Span, bool]]:
    """Every match of the fixed patterns, by kind and start, and whether it is personal data."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.fullmatch(text[start - 1]):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield Span(EMAIL, start, end), True
        at = text.find("@", max(at + 1, end))
    for m in FOUR.finditer(text):
        yield Span(IP, *m.span()), all(map(_is_octet, m.group().split(".")))
    for m in DIGITS.finditer(text):
        digits = _only_digits(m.group())
        yield Span(CARD, *m.span()), 13 <= len(digits) <= 19 and luhn(digits)
    for m in PLUS.finditer(text):
        yield Span(PHONE, *m.span()), 9 <= len(_only_digits(m.group())) <= 15


def base_spans(text: str) -> list[Span]:
    return [span for span, valid in matches(text) if valid]


def passages(text: str) -> list[tuple[int, int]]:
    """(start, end) of the stretches around what may be personal data, cut at white space where there is some."""
    out: list[list[int]] = []
    for m in HINT.finditer(text):
        if out and m.start() - out[-1][1] <= NEAR:
            out[-1][1] = m.end()
        else:
            out.append([m.start(), m.end()])
    cut, floor = [], 0
    for i, (a, b) in enumerate(out):
        low, high = max(floor, a - MARGIN), min(len(text), b + MARGIN, out[i + 1][0] if i + 1 < len(out) else len(text))
        while low > floor and low < a and not text[low - 1].isspace():
            low += 1
        while high > b and high < len(text) and not text[high].isspace():
            high -= 1
        cut.append((low, high))
        floor = high
    return cut


def _side(text: str, at: int, step: int) -> str:
    """What is next to a span, seen from its edge: a letter, a digit, a sign, or what is behind the space."""
    if not 0 <= at < len(text):
        return "edge"
    c = text[at]
    if c.isspace():
        there = text[at + step] if 0 <= at + step < len(text) else ""
        return "gap" + ("digit" if "0" <= there <= "9" else "(+" if there in ("(", "+") and there else "")
    if c.isalnum():
        return "digit" if "0" <= c <= "9" else "letter"
    beyond = text[at + step] if 0 <= at + step < len(text) else ""
    return ("stuck" if beyond.isalnum() else "") + (c if c in ".,:;=\"'/@_-+()[]<>#%&$" else "sign")


WORD_BEFORE = re.compile(r"([^\W\d_]+)\W{0,3}\Z")


def features(kind: int, text: str, start: int, end: int, groups: list[str], gaps: list[str]) -> list[str]:
    """Features of a whole span: its groups and what lies between and around them."""
    name = KINDS[kind]
    out = [name, f"{name}<{_side(text, start - 1, -1)}", f"{name}>{_side(text, end, 1)}"]
    if kind == EMAIL:
        out += [f"{name}|{g}" for g in gaps] + [f"{name}#{min(len(groups), 5)}", f"{name}$alpha" if groups[-1].isalpha() else f"{name}$digit"]
    else:
        digits = sum(map(len, groups))
        kinds = "".join(sorted(set("".join(gaps))))
        out += [f"{name}#{digits}", f"{name}|{kinds}", f"{name}:" + "-".join(str(len(g)) for g in groups)[:24], f"{name}^{text[start] if not text[start].isdigit() else '0' if text[start] == '0' else '9'}",
                f"{name}groups{min(len(groups), 6)}"]
    word = WORD_BEFORE.search(text, max(0, start - 24), start)
    if word:
        out.append(f"{name}@{word.group(1).lower()}")
    return out


def _numbers(text: str, atoms: list[tuple[int, int]], i: int) -> Iterator[tuple[int, int, list[str], list[str]]]:
    """(kind, end atom, groups, gaps) of the spans of digits that start at an atom."""
    groups: list[str] = []
    gaps: list[str] = []
    gap, opened, total = "", 0, 0
    for j in range(i, min(len(atoms), i + MOST_ATOMS)):
        s = text[atoms[j][0]:atoms[j][1]]
        if "0" <= s[0] <= "9":
            gaps.append(gap)
            groups.append(s)
            gap, total = "", total + len(s)
            if total > 19:
                return
            if opened:
                continue
            inner = gaps[1:]
            if len(groups) == 4 and not gaps[0] and len(set(inner)) == 1 and inner[0].lower() in DOTS and all(map(_is_octet, groups)):
                yield IP, j, groups[:], gaps[:]
            if 13 <= total and not gaps[0] and len(groups) <= 6 and all(len(g) == 1 for g in inner) and luhn("".join(groups)):
                yield CARD, j, groups[:], gaps[:]
            if 9 <= total <= 15 and len(groups) <= 7 and all(len(g) <= 3 and not g[:1].isalpha() for g in gaps):
                yield PHONE, j, groups[:], gaps[:]
        elif s == "+" and j == i or s in SEPARATORS or s.lower() == "dot":
            opened += {"(": 1, ")": -1, "[": 1, "]": -1}.get(s, 0)
            gap += s
            if opened < 0 or opened > 1 or len(gap) > 7:
                return
        else:
            return


class Lattice(NamedTuple):
    """Positions of a stretch where spans may begin or end, and edges (from, to, label, features) between them."""

    places: list[int]
    edges: list[tuple[int, int, int, list[str]]]


def lattice(text: str, start: int, end: int) -> Lattice:
    """All labellings of text[start:end] as a graph; what surrounds the stretch counts as context."""
    atoms = [m.span() for m in ATOM.finditer(text, start, end)]
    spans = []
    for i, (a, b) in enumerate(atoms):
        if "0" <= text[a] <= "9" or text[a] in "+(":
            for kind, j, groups, gaps in _numbers(text, atoms, i):
                spans.append((a, atoms[j][1], kind, features(kind, text, a, atoms[j][1], groups, gaps)))
    at = start
    while m := OTHERWISE.search(text, at, end):
        a, stop = m.span()
        parts = re.split(r"(@| @ | ?[\[({] ?(?:at|dot|\.) ?[\])}] ?| at | dot | \. )", m.group(), flags=re.I)
        groups, gaps = parts[::2], [g.lower() for g in parts[1::2]]
        spans.append((a, stop, EMAIL, features(EMAIL, text, a, stop, groups, gaps)))
        at = stop
    if not spans:
        return Lattice([], [])
    places = sorted({start, end, *(s[0] for s in spans), *(s[1] for s in spans)})
    number = {p: i for i, p in enumerate(places)}
    edges = [(number[a], number[b], kind, f) for a, b, kind, f in spans]
    for i, (a, b) in enumerate(zip(places, places[1:])):
        plain = []
        for m in ATOM.finditer(text, a, b):
            c = m.group()
            if "0" <= c[0] <= "9":
                plain.append(f"plain{min(len(c), 20)}")
            elif c == "@":
                plain.append("plain@")
        edges.append((i, i + 1, OUT, plain))
    edges.sort(key=lambda e: (e[1], e[0], e[2]))
    return Lattice(places, edges)


class Model(NamedTuple):
    """Weights of features and of one label after another; without weights nothing is added."""

    weights: dict[str, float]
    after: list[list[float]]


def best_spans(model: Model, graph: Lattice) -> list[Span]:
    """The spans of the likeliest labelling."""
    if not graph.edges:
        return []
    labels = len(KINDS) + 1
    score = [[-math.inf] * labels for _ in graph.places]
    came: list[list[tuple[int, int] | None]] = [[None] * labels for _ in graph.places]
    score[0][OUT] = 0.0
    weight = model.weights.get
    for a, b, label, names in graph.edges:
        own = sum(weight(f, 0.0) for f in names)
        before = max(range(labels), key=lambda y: score[a][y] + model.after[y][label])
        total = score[a][before] + model.after[before][label] + own
        if total > score[b][label]:
            score[b][label], came[b][label] = total, (a, before)
    at, label, out = len(graph.places) - 1, max(range(labels), key=lambda y: score[-1][y]), []
    while at > 0:
        a, before = came[at][label]
        if label != OUT:
            out.append(Span(label, graph.places[a], graph.places[at]))
        at, label = a, before
    return out[::-1]


def added_spans(text: str, base: list[Span], model: Model) -> list[Span]:
    """What the field finds between the spans of the patterns."""
    if not model.weights:
        return []
    taken: list[list[int]] = []
    for _, a, b in sorted(base, key=lambda s: s.start):
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    out, i = [], 0
    for low, high in passages(text):
        while i < len(taken) and taken[i][1] <= low:
            i += 1
        at, j = low, i
        while j < len(taken) and taken[j][0] < high:
            if at < taken[j][0]:
                out += best_spans(model, lattice(text, at, taken[j][0]))
            at, j = max(at, taken[j][1]), j + 1
        if at < high:
            out += best_spans(model, lattice(text, at, high))
    return out


# Learning.


def _rewritten(kind: int, s: str, rng: np.random.Generator) -> str:
    """The same personal data written otherwise."""
    pick = lambda *options: options[int(rng.integers(len(options)))]
    if kind == EMAIL:
        local, _, host = s.partition("@")
        at, dot = pick(("[at]", "[dot]"), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" (at) ", " (dot) "), (" at ", " dot "), (" @ ", "."), ("[at]", "."), ("@", "[.]"), ("@", " . "), ("{at}", "{dot}"))
        return local + at + host.replace(".", dot)
    if kind == IP:
        return s.replace(".", pick("[.]", "(.)", " . ", "[dot]", " dot "))
    digits = _only_digits(s)
    if kind == CARD:
        gap = pick(".", "/", " ", "-")
        return gap.join(digits[i:i + 4] for i in range(0, len(digits), 4))
    parts = re.findall("[0-9]+", s)
    gap = pick(" ", "-", ".", "/")
    if rng.random() < 0.4 or len(parts) < 3:
        return "+" + gap.join(parts) if len(parts) > 1 else "+" + gap.join((digits[:2], digits[2:5], digits[5:]))
    return pick(f"00{gap.join(parts)}", f"({parts[1]}) {gap.join(parts[2:])}" if len(digits) - len(parts[0]) >= 9 else s, f"+{parts[0]} ({parts[1]}) {gap.join(parts[2:])}")


def _no_data(rng: np.random.Generator) -> str:
    """A number that is nobody's: a date, a time, a version, an amount, a count or a serial number."""
    n = lambda low, high: int(rng.integers(low, high))
    return [
        f"{n(1900, 2100)}-{n(1, 13):02}-{n(1, 29):02}", f"{n(1, 29):02}.{n(1, 13):02}.{n(1900, 2100)} {n(0, 24):02}:{n(0, 60):02}:{n(0, 60):02}", f"{n(1, 9)}.{n(0, 30)}.{n(0, 30)}",
        f"{n(1, 999)},{n(100, 999)},{n(100, 999)}.{n(0, 99):02}", f"{n(1900, 2000)}-{n(2000, 2100)}", str(n(0, 10 ** n(1, 10))), str(n(10 ** 9, 10 ** n(10, 16))),
        f"{n(0, 99999)}/{n(0, 9999)}/{n(0, 999999)}", f"978-{n(0, 9)}-{n(10, 99)}-{n(100000, 999999)}-{n(0, 9)}", f"{n(10, 99)} {n(100, 999)} {n(10, 99)} {n(100, 999)} {n(1000, 9999)}",
        f"{n(1, 9)}.{n(256, 999)}.{n(0, 30)}.{n(0, 30)}", f"{n(100, 999)} at {n(10, 99)}", f"id={n(10 ** 9, 10 ** 15)}x", f"\"{n(10 ** 5, 10 ** 12)}a{n(10 ** 3, 10 ** 6)}\"",
    ][n(0, 14)]


def _lesson(text: str, spans: list[Span]) -> tuple[Lattice, list[int]] | None:
    """A graph and the edges of its right path; None where a span is not among the candidates."""
    graph = lattice(text, 0, len(text))
    if not graph.edges:
        return None
    index = {(graph.places[a], graph.places[b], label): i for i, (a, b, label, _) in enumerate(graph.edges)}
    path, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: s.start):
        if a < at or (a, b, kind) not in index:
            return None
        path += [index[(p, q, OUT)] for p, q in zip(graph.places, graph.places[1:]) if at <= p and q <= a]
        path.append(index[(a, b, kind)])
        at = b
    path += [index[(p, q, OUT)] for p, q in zip(graph.places, graph.places[1:]) if at <= p]
    return graph, path


def lessons(texts: list[str], seed: int = 0) -> list[tuple[Lattice, list[int]]]:
    """Graphs to learn from: passages as they are, with spans run together or written otherwise, and with numbers that are nobody's."""
    rng = np.random.default_rng(seed)
    clear = []
    for text in texts:
        found = list(matches(text))
        if any(not valid and (s.kind == PHONE or s.kind == CARD and len(_only_digits(text[s.start:s.end])) >= 13) for s, valid in found):
            continue
        spans = sorted((s for s, valid in found if valid), key=lambda s: s.start)
        if all(a.end <= b.start for a, b in zip(spans, spans[1:])):
            clear.append((text, spans))
    known = [(s.kind, t[s.start:s.end]) for t, spans in clear for s in spans]
    out = []

    def learn(text: str, spans: list[Span]) -> None:
        lesson = _lesson(text, spans)
        if lesson:
            out.append(lesson)

    for text, spans in clear:
        learn(text, spans)
        if not spans:
            at = int(rng.integers(len(text) + 1))
            learn(f"{text[:at]} {_no_data(rng)} {text[at:]}", [])
            continue
        head, tail = text[:spans[0].start], text[spans[0].end:spans[1].start if len(spans) > 1 else len(text)]
        for _ in range(2):  # run together with others, or written otherwise
            body, inside = head, []
            for k in range(int(rng.integers(1, 4))):
                kind, s = known[int(rng.integers(len(known)))] if k else (spans[0].kind, text[spans[0].start:spans[0].end])
                if rng.random() < 0.5:
                    s = _rewritten(kind, s, rng)
                inside.append(Span(kind, len(body), len(body) + len(s)))
                body += s + [" ", " ", ", ", "; ", "\n"][int(rng.integers(5))]
                if rng.random() < 0.25:
                    body += _no_data(rng) + " "
            learn(body.rstrip(" ,;\n") + (tail if k % 2 else ""), inside)
    return out


def _sum_exp(values: np.ndarray) -> float:
    most = values.max()
    return most if most == -math.inf else most + math.log(np.exp(values - most).sum())


def fit(texts: list[str]) -> Model:
    """Weights by stochastic ascent of the likelihood of the right labellings, with a Gaussian prior."""
    taught = lessons(texts)
    labels = len(KINDS) + 1
    seen: dict[str, int] = defaultdict(int)
    for graph, _ in taught:
        for f in {f for e in graph.edges for f in e[3]}:
            seen[f] += 1
    names = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= (SUPPORT if "@" in f[1:] else 1)))}
    if not names:
        return Model({}, [[0.0] * labels for _ in range(labels)])
    weights, square = np.zeros(len(names)), np.full(len(names), 1e-6)
    after, after_square = np.zeros((labels, labels)), np.full((labels, labels), 1e-6)
    indexed = [(graph, path, [np.array([names[f] for f in e[3] if f in names], dtype=np.int64) for e in graph.edges]) for graph, path in taught]
    rng = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for nth in rng.permutation(len(indexed)).tolist():
            graph, path, ids = indexed[nth]
            own = [weights[i].sum() for i in ids]
            size = len(graph.places)
            ahead, back = np.full((size, labels), -math.inf), np.full((size, labels), -math.inf)
            ahead[0, OUT], back[-1] = 0.0, 0.0
            for e, (a, b, label, _) in enumerate(graph.edges):
                ahead[b, label] = np.logaddexp(ahead[b, label], _sum_exp(ahead[a] + after[:, label]) + own[e])
            by_start = sorted(range(len(graph.edges)), key=lambda e: -graph.edges[e][0])
            for e in by_start:
                a, b, label, _ = graph.edges[e]
                back[a] = np.logaddexp(back[a], after[:, label] + own[e] + back[b, label])
            total = _sum_exp(ahead[-1])
            slope, after_slope = defaultdict(float), np.zeros((labels, labels))
            right = set(path)
            for e, (a, b, label, _) in enumerate(graph.edges):
                share = np.exp(ahead[a] + after[:, label] + own[e] + back[b, label] - total)
                after_slope[:, label] -= share
                gain = (e in right) - share.sum()
                if abs(gain) > 1e-9:
                    for i in ids[e].tolist():
                        slope[i] += gain
            before = OUT
            for e in path:
                label = graph.edges[e][2]
                after_slope[before, label] += 1
                before = label
            if slope:
                at = np.fromiter(slope, dtype=np.int64)
                g = np.fromiter(slope.values(), dtype=float) - PRIOR * weights[at]
                square[at] += g * g
                weights[at] += RATE * g / np.sqrt(square[at])
            after_slope -= PRIOR * after
            after_square += after_slope ** 2
            after += RATE * after_slope / np.sqrt(after_square)
    return Model({f: float(weights[i]) for f, i in names.items()}, after.tolist())


def train(docs: DataFrame) -> Model:
    """A field fitted on at most `SAMPLE` distinct passages with personal data and `SAMPLE_WITHOUT` others of `docs`, in the order of a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in per_batch(BATCH, batches):
            out = []
            for text in texts_of(batch):
                for a, b in passages(text):
                    if b - a <= PASSAGE:
                        out.append((text[a:b], bool(base_spans(text[a:b]))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([d for _, d in out])], names=["passage", "data"])

    told = docs.select(F.col("text").cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    found = stored(told.mapInArrow(run, "passage string, data boolean").distinct(), "passages")
    first = lambda data, n: found.where(F.col("data") == data).orderBy(F.xxhash64("passage"), "passage").limit(n)
    sample = stored(first(True, SAMPLE).unionByName(first(False, SAMPLE_WITHOUT)), "passage-sample")
    return fit([r["passage"] for r in sample.orderBy(F.xxhash64("passage"), "passage").collect()])


def find(docs: DataFrame, model: Model, name: str = "spans") -> DataFrame:
    """`docs` with the array `name` of (kind, start, end, base): spans by kind and start in code points, end exclusive.

    base: found by the fixed patterns; the others are the field's. Defined cases: null and empty texts hold nothing; null ids, repeated
    rows and further columns, also one called `name`, come back as they are (`name` is replaced); texts of any length are
    searched whole, in time that grows with their length; spans of different kinds by the patterns may overlap, the field's overlap none.
    """
    known = shared(docs.sparkSession, model)
    rest = [c for c in docs.columns if c.lower() != name.lower()]
    given = docs.select(*rest)
    own = fresh(given, "searched_text")
    given = given.withColumn(own, F.coalesce(F.col("text").cast("string"), F.lit("")))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = known.value
        for batch in per_batch(BATCH, batches):
            at = batch.schema.get_field_index(own)
            found = []
            for text in batch.column(at).to_pylist():
                spans = []
                if HINT.search(text):
                    base = base_spans(text)
                    spans = sorted([(*s, True) for s in base] + [(*s, False) for s in added_spans(text, base, model)])
                found.append([{"kind": KINDS[k], "start": a, "end": b, "base": given} for k, a, b, given in spans])
            columns = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, kind)], names=[*rest, name])

    schema = given.select(*rest).schema.add(name, T.DataType.fromDDL("array<struct<kind:string,start:int,end:int,base:boolean>>"))
    return given.mapInArrow(run, schema)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) per row: counts and hash of what the patterns find, and all spans."""
    found = find(docs.select("doc_id", "text"), model)
    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda k: F.filter(base, lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
