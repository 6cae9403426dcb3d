"""Spelling variants of a corpus' words, found through k-d trees over letter counts.

One inserted or deleted letter changes one letter's count by one, one replaced letter
lowers one count and raises another. So words of one length (or of neighbouring lengths)
that are one edit apart lie at L1 distance two (or one), and a search visits only the boxes
of a k-d tree that lie within that budget:

1. Words are counted in the tasks that read the texts, and summed.
2. Per length a k-d tree is grown over a bounded sample of words; its leaves are cells that deal the work out.
   Every word goes to its own cell, and visits the cells where words of its length, with one letter replaced by a
   lesser one, or words one letter longer may be. (The direction is fixed, so each pair meets once.)
3. A cell's words, in chunks of bounded size, get a k-d tree of their own. Visitors go down it batch-wise, and
   what they reach is verified by the order of the letters.
4. A word's variants are added up per word; pointers to the commonest variant are followed to the end.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import per_batch, shared, stored

SHORTEST = 7
LEAST = 2
RATIO = 10
RUN = "[A-Za-zÀ-ÿ]"
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
LETTERS = 26 + 64  # a-z and U+00C0 to U+00FF
NONE = -1
#: Words that cells are fitted on (a share of the words by hash, so many are expected), and the longest among them; longer words have one cell per length.
SAMPLE, SAMPLE_LENGTH = 65_536, 64
CELL = 2048  # words that a cell is to have, by the sample
LEAST_SAMPLED = 16  # sampled words that a cell has at least
CHUNK = 8192  # words of a cell that one task holds, about
LEAF = 12
HELD = 400_000  # distinct words that a task holds before it passes them on
AT_ONCE = 1 << 22  # letters compared at once
BATCH = 200


def word_counts(docs: DataFrame, shortest: int = SHORTEST, damage: int | None = None) -> DataFrame:
    """(word, n): letter runs of whole texts with A-Z lower-cased, of at least `shortest` letters, and how often each occurs.

    damage: take one letter out of the runs of a document whose crc32 it divides (a test of what finds variants).
    """
    find = re.compile(f"{RUN}{{{shortest},}}").findall

    def flush(count: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.string()), pa.array(count.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[str, int] = {}
        for batch in per_batch(BATCH, batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own: dict[str, int] = Counter()
                for word, n in Counter(find(text)).items():
                    own[word.lower() if word.isascii() else word.translate(LOWER)] += n
                start = zlib.crc32(f"{doc_id}:".encode())
                for word, n in own.items():
                    if damage:
                        h = zlib.crc32(word.encode(), start)
                        if h % damage == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                            if len(word) < shortest:
                                continue
                    count[word] = count.get(word, 0) + n
                if len(count) > HELD:
                    yield flush(count)
                    count = {}
        yield flush(count)

    own = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"),
                      F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return own.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letters(codes: np.ndarray) -> np.ndarray:
    """Letter counts of words of one length, given as rows of Latin-1 codes."""
    rows, length = codes.shape
    index = np.where(codes < 0xC0, codes - np.uint8(97), codes - np.uint8(0xC0 - 26)).astype(np.int64)
    index += np.arange(rows)[:, None] * LETTERS
    kind = np.int16 if length < 1 << 15 else np.int32
    return np.bincount(index.ravel(), minlength=rows * LETTERS).reshape(rows, LETTERS).astype(kind)


def grow(counts: np.ndarray, leaf: int, rows: np.ndarray | None = None):
    """A k-d tree: (letter, least count on the right, left, right), or the rows of a leaf."""
    rows = np.arange(len(counts)) if rows is None else rows
    if len(rows) <= leaf:
        return rows
    own = counts[rows]
    middle = np.partition(own, len(rows) // 2, axis=0)[len(rows) // 2]
    best = None
    for at in (middle, middle + 1):
        above = (own >= at).sum(axis=0)
        above = np.where((above == 0) | (above == len(rows)), 4 * len(rows), above)
        letter = int(np.abs(2 * above - len(rows)).argmin())
        gap = abs(2 * int(above[letter]) - len(rows))
        if gap < len(rows) and (best is None or gap < best[0]):
            best = gap, letter, int(at[letter])
    if best is None:  # all words have the same letters
        return rows
    _, letter, at = best
    right = own[:, letter] >= at
    return letter, at, grow(counts, leaf, rows[~right]), grow(counts, leaf, rows[right])


def numbered(tree, names: list[int]):
    """The tree with numbers, counted up in `names`, in place of the leaves' rows."""
    if isinstance(tree, tuple):
        return tree[0], tree[1], numbered(tree[2], names), numbered(tree[3], names)
    names.append(len(names))
    return names[-1]


def home(tree, counts: np.ndarray) -> Iterator[tuple[object, np.ndarray]]:
    """(leaf, rows) of the leaves that the vectors lie in."""
    stack = [(tree, np.arange(len(counts)))]
    while stack:
        node, who = stack.pop()
        if not isinstance(node, tuple):
            yield node, who
            continue
        right = counts[who, node[0]] >= node[1]
        stack += [(child, part) for child, part in ((node[2], who[~right]), (node[3], who[right])) if len(part)]


def reach(tree, counts: np.ndarray, longer: bool) -> Iterator[tuple[object, np.ndarray]]:
    """(leaf, rows) of the leaves whose boxes hold vectors with one count raised and, unless `longer`, one of a later letter lowered."""
    none = np.full(len(counts), NONE, np.int16)
    stack = [(tree, np.arange(len(counts)), none, none)]
    while stack:
        node, who, up, down = stack.pop()
        if not isinstance(node, tuple):
            yield node, who
            continue
        letter, at, left, right = node
        value = counts[who, letter] + (up == letter) - (down == letter)
        high = value >= at
        rises = (value == at - 1) & (up == NONE) & ((down == NONE) | (letter < down))
        goes = high | rises
        if goes.any():
            stack.append((right, who[goes], np.where(rises, np.int16(letter), up)[goes], down[goes]))
        falls = high & (value == at) & (down == NONE) & (up < letter) & (not longer)
        goes = ~high | falls
        if goes.any():
            stack.append((left, who[goes], up[goes], np.where(falls, np.int16(letter), down)[goes]))


def one_apart(visitors: np.ndarray, homes: np.ndarray, longer: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs, by the order of letters: a home is a visitor with one letter put in, or else with one replaced by a lesser one."""
    length = visitors.shape[1]
    step = max(1, AT_ONCE // max(1, len(homes) * length))
    found = []
    for at in range(0, len(visitors), step):
        own = visitors[at:at + step, None, :]
        if longer:
            start, end = own == homes[None, :, :-1], own == homes[None, :, 1:]
            first = np.where(start.all(axis=2), length, start.argmin(axis=2))
            last = np.where(end.all(axis=2), length, end[:, :, ::-1].argmin(axis=2))
            near = first + last >= length
        else:
            near = ((own != homes[None]).sum(axis=2) == 1) & (own > homes[None]).any(axis=2)
        v, h = np.nonzero(near)
        found.append((v + at, h))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def codes_of(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(words), dtype=np.uint8).reshape(len(words), -1)


def _cells(words: DataFrame) -> dict[int, object]:
    """Per length the tree whose leaves are cells, grown over the sample."""
    total = words.count()
    share = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < (1 << 30) * min(1.0, SAMPLE / max(1, total))
    rows = words.where(share & (F.length("word") <= SAMPLE_LENGTH)).select("word").collect()
    by_length: dict[int, list[bytes]] = {}
    for r in rows:
        by_length.setdefault(len(r["word"]), []).append(r["word"].encode("latin-1"))
    leaf = max(LEAST_SAMPLED, CELL * len(rows) // max(1, total))
    return {n: numbered(grow(letters(codes_of(own)), leaf), []) for n, own in by_length.items()}


def _routes(words: DataFrame, trees: dict[int, object]) -> DataFrame:
    """(meeting, side, codes, n): every word in its own cell (side 0), and in those it visits (1: same length, 2: one longer)."""
    known = shared(words.sparkSession, trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = known.value
        for batch in batches:
            words = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            count = batch.column(1).to_numpy()
            by_length: dict[int, list[int]] = {}
            for i, w in enumerate(words):
                by_length.setdefault(len(w), []).append(i)
            for length, members in by_length.items():
                who = np.array(members)
                for block in np.array_split(who, min(len(who), -(-len(who) * length // AT_ONCE))):
                    own = letters(codes_of([words[i] for i in block.tolist()]))
                    same, above = trees.get(length, 0), trees.get(length + 1, 0)
                    parts = [*(((length << 24) + cell, 0, rows) for cell, rows in home(same, own)),
                             *(((length << 24) + cell, 1, rows) for cell, rows in reach(same, own, False)),
                             *(((length + 1 << 24) + cell, 2, rows) for cell, rows in reach(above, own, True))]
                    at = block[np.concatenate([rows for _, _, rows in parts])]
                    size = [len(rows) for _, _, rows in parts]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat([m for m, _, _ in parts], size)), pa.array(np.repeat([s for _, s, _ in parts], size).astype(np.int32)),
                         pa.array([words[i] for i in at.tolist()], pa.binary()), pa.array(count[at])], names=["meeting", "side", "codes", "n"])

    return words.select("word", "n").mapInArrow(run, "meeting long, side int, codes binary, n long")


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by meeting, chunk and side: a chunk's words build a tree, its visitors go down it as they come."""
    now, held, trees = None, [], None
    for batch in batches:
        meeting, chunk, side = (batch.column(c).to_numpy() for c in range(3))
        cuts = np.flatnonzero((np.diff(meeting) != 0) | (np.diff(chunk) != 0) | (np.diff(side) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if a == b:
                continue
            if now != (meeting[a], chunk[a]):
                now, held, trees = (meeting[a], chunk[a]), [], None
            part = batch.slice(a, b - a)
            if side[a] == 0:
                held.append(part)
                continue
            if trees is None:
                rows = pa.Table.from_batches(held) if held else None
                words = rows.column("codes").to_pylist() if held else []
                codes = codes_of(words) if held else None
                trees = (words, codes, rows.column("n").to_numpy(), grow(letters(codes), LEAF)) if held else ()
            if trees:
                yield from _visit(part.column(3).to_pylist(), part.column(4).to_numpy(), trees, side[a] == 2)


def _visit(words: list[bytes], n: np.ndarray, homes: tuple, longer: bool) -> Iterator[pa.RecordBatch]:
    """(codes, n_near, most, form) of the visitors and the words at home that are near each other."""
    home_words, home_codes, home_n, tree = homes
    codes = codes_of(words)
    pairs = []
    for rows, who in reach(tree, letters(codes), longer):
        v, h = one_apart(codes[who], home_codes[rows], longer)
        if len(v):
            pairs.append((who[v], rows[h]))
    if not pairs:
        return
    v, h = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    for one, other, one_words, other_words, other_n in ((v, h, words, home_words, home_n), (h, v, home_words, words, n)):
        names, rank = np.unique(other, return_inverse=True)
        order = sorted(range(len(names)), key=lambda i: other_words[names[i]])
        place = np.empty(len(names), np.int64)
        place[order] = np.arange(len(names))
        by = np.lexsort((place[rank], -other_n[other], one))
        first = np.flatnonzero(np.r_[True, np.diff(one[by]) != 0])
        best = other[by][first]
        yield pa.RecordBatch.from_arrays(
            [pa.array([one_words[i] for i in one[by][first].tolist()], pa.binary()), pa.array(np.diff(np.r_[first, len(by)])),
             pa.array(other_n[best]), pa.array([other_words[i] for i in best.tolist()], pa.binary())],
            names=["codes", "n_near", "most", "form"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n) of the words with a near one: how many, and the commonest (ties: the least in code-point order).

    words: (word, n) of distinct words of lower-case Latin-1 letters, in a written table.
    """
    routes = stored(_routes(words, _cells(words)), "word-routes")
    cells = (routes.where("side = 0").groupBy("meeting").agg(F.count(F.lit(1)).alias("m"))
             .select("meeting", F.ceil(F.col("m") / CHUNK).cast("int").alias("chunks")))
    own = F.when(F.col("side") == 0, F.array(F.pmod(F.xxhash64("codes"), F.col("chunks")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    dealt = routes.join(cells, "meeting").select("meeting", F.explode(own).alias("chunk"), "side", "codes", "n")
    found = (dealt.repartition("meeting", "chunk").sortWithinPartitions("meeting", "chunk", "side")
             .mapInArrow(_search, "codes binary, n_near long, most long, form binary"))
    best = F.min(F.struct((-F.col("most")).alias("less"), "form")).alias("best")
    text = lambda c: F.decode(c, "ISO-8859-1")
    return (found.groupBy("codes").agg(F.sum("n_near").alias("n_near"), best)
            .select(text("codes").alias("word"), "n_near", text("best.form").alias("form"), (-F.col("best.less")).alias("form_n")))


def roots(forms: DataFrame, rounds: int) -> DataFrame:
    """(word, root) of the words with a form: the last word on the way along forms, which `rounds` doublings reach."""
    to = stored(forms.select("word", F.col("form").alias("root")), "forms")
    for _ in range(rounds):
        then = to.select(F.col("word").alias("root"), F.col("root").alias("then"))
        to = stored(to.join(then, "root", "left").select("word", F.coalesce("then", "root").alias("root")), "forms")
    return to


def variants(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, ratio: int = RATIO, damage: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of at least `shortest` letters that occurs `least` times or more.

    form: the commonest word one edit away (ties: the least in code-point order), if it is `ratio` times as common, else null;
    root: the end of the way from form to form. Defined cases: null and empty texts hold no word; a null doc_id
    counts as an empty one where runs are damaged; repeated rows count each; words of any length are compared whole; no words: no rows.
    Other columns of `docs` are not looked at.
    """
    if ratio < 2:
        raise ValueError("a form must be at least twice as common")
    words = stored(word_counts(docs, shortest, damage).where(F.col("n") >= least), "words")
    most = words.agg(F.max("n")).first()[0] or 0
    rounds = 0
    while least * ratio ** (1 << rounds) <= most:  # a way has log(most / least) steps at most
        rounds += 1
    near = near_words(words).withColumnRenamed("n_near", "near")
    joined = words.join(near, "word", "left").withColumn("common", F.col("form_n") >= ratio * F.col("n"))
    told = stored(joined.select(
        "word", F.when(F.col("common"), F.col("form")).alias("form"), "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("common"), F.col("form_n")).alias("form_n")), "word-forms")
    ends = roots(told.where("form IS NOT NULL"), rounds)
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
