"""Line deduplication by a segment-partition edit join.

Lines are duplicates when they are equal or, from `MIN_CHARS` characters on, at most `allowed` edits apart
(one edit per `CHARS_PER_EDIT` characters, `EDITS` at most), and a line belongs to the class of all it reaches
over such pairs. Of every class the first occurrence stays, by doc_id and place in the document.

A line is split into EDITS + 1 segments. Two lines within EDITS edits share a segment of
the one as a substring of the other, near its own place. So:

1. Every distinct line posts its segments and, for each length a partner may have, the few substrings that can
   match a segment of a partner of that length. The key is a hash of length, segment number and
   substring; with it go the line's hash and a sketch of its character counts.
2. Postings meet by key. A line stays alive under a key if a line there has a sketch that EDITS edits
   can bridge; nothing is paired yet, so a key gives no more rows than it has.
3. The few lines left get their text and meet again by key; large keys are dealt to pairs of
   chunks. Pairs not yet connected are verified by banded bit-parallel edit distance, and a task
   reports the links that connect something.
4. Links give classes, classes their first occurrence, and documents lose the other lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patronage.llm.common import fresh, per_batch, stored, texts_of
from patronage.llm.graph import components
from patronage.llm.simhash import Forest

EDITS = 2
CHARS_PER_EDIT = 20
MIN_CHARS = 20
SEED = 42
BINS = 15  # of the character counts, four bits each; the last four bits of a sketch hold the role
PROBE, INDEX = 0, 1
AT_ONCE = 4096  # rows of one key whose sketches are compared; with more, all stay alive
CHUNK = 512
BATCH = 300
REMEMBER = 500_000
BROADCAST_ROWS = 500_000


def allowed(n: int, edits: int = EDITS) -> int:
    """Edits that two lines may differ by, the shorter of which has n characters."""
    return min(edits, n // CHARS_PER_EDIT)


def segments(n: int, edits: int) -> list[tuple[int, int]]:
    """(start, length) of the edits + 1 segments of a line of n characters; the last ones are the longer."""
    parts = edits + 1
    short, longer = n // parts, n % parts
    out, at = [], 0
    for i in range(parts):
        size = short + (i >= parts - longer)
        out.append((at, size))
        at += size
    return out


def places(n: int, edits: int) -> list[tuple[int, int, int, int, int]]:
    """(length of the partner, segment, start, size, role) of all that a line of n characters posts.

    Where a substring can start for a partner `gap` characters shorter: before segment i lie at most i edits, after
    it at most edits - i, and the line's surplus must be made up on either side.
    """
    out = []
    for gap in range(edits + 1):
        partner = n - gap
        for i, (start, size) in enumerate(segments(partner, edits) if partner > edits else []):
            low = max(start - i, start + gap - (edits - i), 0)
            high = min(start + i, start + gap + (edits - i), n - size)
            for at in range(low, high + 1):
                out.append((partner, i, at, size, INDEX if gap == 0 and at == start else PROBE))
    return out


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance is at most k: banded, bit-parallel, over what differs."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > k or k <= 0:
        return False
    if len(a) > len(b):
        a, b = b, a
    low, high = 0, len(a)  # common beginning, by halving
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    a, b = a[low:], b[low:]
    low, high = 0, len(a)
    while low < high:
        mid = (low + high + 1) // 2
        if a[len(a) - mid:] == b[len(b) - mid:]:
            low = mid
        else:
            high = mid - 1
    a, b = a[:len(a) - low], b[:len(b) - low]
    if not a:
        return len(b) <= k
    m, n = len(a), len(b)
    if m <= k:
        return _table(a, b) <= k
    # Column j sees rows j - k .. j + k, bit 0 the uppermost. The windows slide down one row per column.
    size = 2 * k + 1
    full = (1 << size) - 1
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << (i + k)
    up, down = full & ~((1 << k) - 1), 0
    score, last = k, size - 1  # distance in the window's last row, and that row's bit
    for j in range(1, n + 1):
        match = (at.get(b[j - 1], 0) >> (j - 1)) & full
        diagonal = ((((match & up) + up) ^ up) | match | down) & full
        right_up = (down | ~(diagonal | up)) & full
        right_down = diagonal & up
        if j + k <= m:
            score += not diagonal >> last & 1
        else:  # the last row is the pattern's end now and moves up in the window
            last -= 1
            score += (right_up >> last & 1) - (right_down >> last & 1)
        # from the last row at most the columns left can still take away
        if score - max(0, n - j if j + k >= m else n - j + k) > k:
            return False
        up = (right_down | ~(diagonal >> 1 | right_up)) & full
        down = (diagonal >> 1) & right_up
    return score <= k


def _table(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            before, row[j] = row[j], min(before + (c != d), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def sketches(lines: list[str]) -> np.ndarray:
    """Per line the characters' counts in `BINS` bins, four bits of each, above four free bits."""
    joined = np.frombuffer("".join(lines).encode("utf-32-le"), dtype="<u4") % BINS
    row = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    counts = np.bincount(row * BINS + joined, minlength=len(lines) * BINS).reshape(-1, BINS).astype(np.uint64) & np.uint64(15)
    return (counts << (np.arange(1, BINS + 1, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64)


def bridged(a: np.ndarray, b: np.ndarray, edits: int) -> np.ndarray:
    """Whether the sketches are no further apart than so many edits can move them."""
    moved = np.zeros(len(a), np.int16)
    for i in range(1, BINS + 1):
        gap = ((a >> np.uint64(4 * i)) - (b >> np.uint64(4 * i))) & np.uint64(15)
        moved += np.minimum(gap, np.uint64(16) - gap).astype(np.int16)
    return moved <= 2 * edits


def postings(docs: DataFrame, edits: int) -> DataFrame:
    """(key, line, sketch): what the lines of all documents post; repeats within a task mostly once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh64_intdigest
        seen: set[int] = set()
        plans: dict[int, list] = {}
        for batch in per_batch(BATCH, batches):
            lines, ids = [], []
            for text in texts_of(batch):
                for line in text.split("\n"):
                    if len(line) >= MIN_CHARS:
                        own = digest(line.encode(), SEED)
                        if own not in seen:
                            seen.add(own)
                            lines.append(line)
                            ids.append(own)
            if len(seen) > REMEMBER:
                seen.clear()
            if not lines:
                continue
            sketch = sketches(lines)
            keys: list[int] = []
            roles: list[int] = []
            sizes: list[int] = []
            for line in lines:
                n = len(line)
                plan = plans.get(n)
                if plan is None:
                    plan = plans[n] = [((partner << 4) | i, at, at + size, role) for partner, i, at, size, role in places(n, edits)]
                    if len(plans) > 100_000:
                        plans.clear()
                raw = line.encode()
                if len(raw) == n:
                    keys += [digest(raw[a:b], s) for s, a, b, _ in plan]
                else:
                    keys += [digest(line[a:b].encode(), s) for s, a, b, _ in plan]
                roles += [r for _, _, _, r in plan]
                sizes.append(len(plan))
            marked = np.repeat(sketch, sizes) | np.array(roles, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(keys, dtype=np.uint64).view(np.int64)), pa.array(np.repeat(np.array(ids, dtype=np.uint64), sizes).view(np.int64)),
                 pa.array(marked.view(np.int64))], names=["key", "line", "sketch"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "key long, line long, sketch long")


def _by_key(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[tuple[pa.Table, bool]]:
    """Rows sorted by key, in tables that hold whole keys; a key beyond `most` rows comes in parts, marked true."""
    held: list[pa.RecordBatch] = []
    large = None
    for batch in batches:
        if large is not None:
            key = batch.column(0).to_numpy()
            end = int(np.searchsorted(key, large, "right"))
            if end:
                yield pa.Table.from_batches([batch.slice(0, end)]), True
            if end == batch.num_rows:
                continue
            batch, large = batch.slice(end), None
        held.append(batch)
        rows = pa.Table.from_batches(held)
        key = rows.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield rows.slice(0, cut), False
        if most is not None and len(key) - cut > most:
            yield rows.slice(cut), True
            held, large = [], key[-1]
        else:
            held = rows.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held), False


def alive(posted: DataFrame, edits: int) -> DataFrame:
    """(key, line, role) of the postings that another line of their key may be linked to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, large in _by_key(batches, AT_ONCE):
            key, line, sketch = (rows.column(c).to_numpy() for c in ("key", "line", "sketch"))
            keep = np.full(len(key), large)
            if not large:
                bits = sketch.view(np.uint64)
                starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                end = np.repeat(np.r_[starts[1:], len(key)], np.diff(np.r_[starts, len(key)]))
                left, step = np.arange(len(key)), 1
                while len(left := left[left + step < end[left]]):
                    a, b = left, left + step
                    meet = (line[a] != line[b]) & (((bits[a] | bits[b]) & np.uint64(INDEX)) == INDEX)
                    a, b = a[meet], b[meet]
                    meet = bridged(bits[a], bits[b], edits)
                    keep[a[meet]] = keep[b[meet]] = True
                    step += 1
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(line[keep]), pa.array((sketch[keep] & INDEX).astype(np.int32))],
                                             names=["key", "line", "role"])

    return posted.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, line long, role int")


def line_links(docs: DataFrame, edits: int = EDITS, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between hashes of different lines that span the classes of lines within the allowed edits."""
    living = stored(alive(postings(docs, edits), edits).groupBy("key", "line").agg(F.max("role").alias("role")), "living-lines")
    wanted = stored(living.select(F.col("line").alias("wanted")).distinct(), "wanted-lines")
    if wanted.count() <= BROADCAST_ROWS:  # eight bytes each; beyond that Spark chooses
        wanted = F.broadcast(wanted)
    all_lines = docs.select(F.explode(F.split(F.col("text").cast("string"), "\n", -1)).alias("body")).where(F.length("body") >= MIN_CHARS)
    bodies = stored(
        all_lines.withColumn("line", F.xxhash64("body")).join(wanted, F.col("line") == F.col("wanted"), "left_semi")
        .groupBy("line").agg(F.min("body").alias("body")), "line-bodies")
    sizes = stored(living.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                   .select("key", F.ceil(F.col("n") / chunk).cast("int").alias("chunks")), "key-sizes")
    own = F.pmod(F.xxhash64("line"), F.col("chunks")).cast("int")
    dealt = (
        living.join(sizes, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("line", "role", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("meeting"),
                F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side"))
    )
    met = dealt.join(bodies, "line").select("meeting", "line", "role", "side", "body")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _ in _by_key(batches):
            key, line, role, side = (rows.column(c).to_numpy() for c in ("meeting", "line", "role", "side"))
            body = rows.column("body").to_pylist()
            sketch = sketches(body)
            forest, out = Forest(), []
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]).tolist() + [len(key)]
            for first, end in zip(starts, starts[1:]):
                for i in range(first, end - 1):
                    js = np.arange(i + 1, end)
                    js = js[(line[js] != line[i]) & ((role[js] | role[i]) == INDEX) & ((side[js] == 2) | (side[js] != side[i]))]
                    if not len(js):
                        continue
                    js = js[bridged(np.full(len(js), sketch[i]), sketch[js], edits)]
                    for j in js.tolist():
                        a, b = int(line[i]), int(line[j])
                        if forest.root(a) != forest.root(b) and within(body[i], body[j], allowed(min(len(body[i]), len(body[j])), edits)):
                            forest.join(a, b)
                            out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

    return met.repartition("meeting").sortWithinPartitions("meeting").mapInArrow(verify, "a long, b long")


def _marked(docs: DataFrame, shortest: int = MIN_CHARS) -> DataFrame:
    """doc_id, doc (hash of id and text), place, line and check hash of every line that counts: not blank, `shortest` characters or more."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.withColumn("doc", F.xxhash64("doc_id", "text"))
    lines = own.select("doc_id", "doc", F.posexplode(F.split("text", "\n", -1)).alias("place", "body"))
    lines = lines.where((F.length("body") >= shortest) & F.col("body").rlike("\\S"))
    return lines.select("doc_id", "doc", "place", F.xxhash64("body").alias("line"), F.xxhash64("body", F.lit(1)).alias("check"))


def surplus_lines(docs: DataFrame, edits: int = EDITS, shortest: int = MIN_CHARS) -> DataFrame:
    """(doc, place, line) of every line that is not the first of its class."""
    occurrences = _marked(docs, shortest)
    at = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "doc", "place")
    exact = stored(occurrences.groupBy("line", "check").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")), "exact-lines")
    roots = components(line_links(docs, edits)).withColumnRenamed("node", "line")
    # lines that occur once and are linked to nothing keep their place and drop out here
    classed = exact.join(roots, "line", "left").where("n > 1 or root is not null")
    # a class is named by its root, or by the line itself
    classed = stored(classed.select("line", "check", "first", F.coalesce("root", "line").alias("name"),
                                    F.when(F.col("root").isNull(), F.col("check")).otherwise(0).alias("name_check")), "linked-lines")
    first = stored(classed.groupBy("name", "name_check").agg(F.min("first").alias("kept")), "first-lines")
    judged = stored(classed.join(first, ["name", "name_check"]).select("line", "check", "kept"), "line-classes")
    return occurrences.join(judged, ["line", "check"]).where(at != F.col("kept")).select("doc", "place", "line")


def deduplicate_lines(docs: DataFrame, edits: int = EDITS, removed: str | None = None, shortest: int = MIN_CHARS) -> DataFrame:
    """`docs` with the surplus lines taken out of `text`; all other columns, and all rows, stay.

    removed: name of a further column with the places (from 0) of the lines taken out, ascending.
    shortest: length from which equal lines count as repeated; near-equal ones count from `MIN_CHARS` on.

    Defined cases: null text stays null, empty text empty; lines under `shortest` characters and blank lines always stay;
    a document may end up empty; equal lines at one doc_id go by their place, documents
    with a null id come last; rows with the same id and text are one document and
    come back alike; an empty table stays empty; texts and lines of any length are compared whole.
    """
    doc, places_, at = fresh(docs, "doc_key"), fresh(docs, "surplus"), removed or fresh(docs, "removed_places")
    per_doc = surplus_lines(docs, edits, shortest).groupBy(F.col("doc").alias(doc)).agg(F.collect_set("place").alias(places_))
    own = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    names = list(docs.columns)
    joined = docs.withColumn("text", F.col("text").cast("string")).join(per_doc, own == F.col(doc), "left").select(*names, places_)
    schema = docs.withColumn("text", F.lit(None).cast("string")).withColumn(at, F.array(F.lit(0))).select(*names, at).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            surplus = batch.column(len(names)).to_pylist()
            texts = batch.column(names.index("text")).to_pylist()
            for i, gone in enumerate(surplus):
                if gone:
                    out = set(gone)
                    texts[i] = "\n".join(line for n, line in enumerate(texts[i].split("\n")) if n not in out)
            columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(i) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([sorted(g or ()) for g in surplus], pa.list_(pa.int32()))], names=[*names, at])

    done = joined.mapInArrow(cut, schema)
    return done if removed else done.drop(at)
