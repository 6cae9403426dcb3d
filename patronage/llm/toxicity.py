"""Toxicity by compression distance: two zstandard dictionaries, one comparison per window.

A window of text is compressed twice, once with a dictionary trained on ordinary
text and once with the same dictionary extended by one trained on toxic text. What
they share cancels, so the bytes saved by the second measure how toxic the window reads. Both
dictionaries end in the same filler, which opens every window; so even a window of two words is
stored compressed and its length means something.

Training (on the driver, over bounded samples of labelled documents, `Bounds`):

1. Toxic documents are mostly ordinary text. The samples of the toxic dictionary are the words
   whose first letters come in significantly more different contexts in toxic
   documents than in ordinary ones; counting contexts rather than occurrences
   keeps copies of one document from looking like a pattern.
2. A logistic curve over the strongest windows of further labelled documents
   turns saved bytes into the probability of a toxic document, at the labels' own
   class ratio.

Scoring (tasks, whole texts): windows of `SCREEN_WORDS` words are compared at a fast level; in those
where anything is saved, windows of `CLOSE_WORDS` words are compared at a thorough one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import fresh, per_batch, shared, texts_of

FILLER = bytes(range(200, 232))
SCREEN_WORDS, SCREEN_LEVEL = 4, 3
CLOSE_WORDS, CLOSE_LEVEL = 2, 19
LONGEST_WORD = 64
PREFIXES = (4, 5, 6, 7, 8)
SIGNIFICANT = 25.0  # least log-likelihood ratio of a toxic beginning
RICHER = 10.0  # least ratio of its rates
BATCH = 200
THRESHOLD = 0.7
FEATURES = "best long, top3 long, hits long, windows long"


@dataclass(frozen=True)
class Bounds:
    """How many labelled documents each sample holds at most, and how long they may be."""

    toxic: int = 1000
    ordinary: int = 2000
    calibrate_toxic: int = 500
    calibrate_ordinary: int = 1500
    chars: int = 20_000
    ordinary_bytes: int = 16_384
    toxic_bytes: int = 4_096


@dataclass(frozen=True)
class Model:
    ordinary: bytes  # dictionary
    toxic: bytes  # dictionary; b"" when no toxic pattern is known
    weights: tuple[float, ...]
    base: float  # probability when there is nothing to learn from


def words_of(text: str) -> list[bytes]:
    """Lower-cased words as bytes; very long ones in pieces, so that no window is long."""
    out = []
    for w in text.lower().encode().split():
        if len(w) <= LONGEST_WORD:
            out.append(w)
        else:
            out += [w[i:i + LONGEST_WORD] for i in range(0, len(w), LONGEST_WORD)]
    return out


def beginnings(word: bytes) -> set[bytes]:
    return {word[:k] for k in PREFIXES if len(word) >= k} | ({word} if len(word) >= PREFIXES[0] else set())


def _contexts(texts: list[str], only: set[bytes] | None = None) -> dict[bytes, int]:
    """In how many contexts (preceding words) each beginning occurs."""
    ids: dict[bytes, int] = {}
    pairs: list[np.ndarray] = []
    for text in texts:
        own, before = [], b""
        for w in words_of(text):
            for x in beginnings(w):
                if only is None or x in only:
                    own.append((ids.setdefault(x, len(ids)) << 32) | (hash(before) & 0xFFFFFFFF))
            before = w
        pairs.append(np.unique(np.array(own, dtype=np.int64)))
    distinct = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    counts = np.bincount(distinct >> 32, minlength=len(ids))
    return {x: int(counts[i]) for x, i in ids.items()}


def toxic_beginnings(toxic: list[str], ordinary: list[str]) -> set[bytes]:
    """Beginnings of words whose contexts are significantly and much more frequent in toxic text."""
    n1, n0 = sum(map(len, toxic)) + 1, sum(map(len, ordinary)) + 1
    share = n1 / (n1 + n0)
    in_toxic = {x: k for x, k in _contexts(toxic).items() if 2 * k * -math.log(share) >= SIGNIFICANT}
    in_ordinary = _contexts(ordinary, set(in_toxic))
    out = set()
    for x, k1 in in_toxic.items():
        k0 = in_ordinary.get(x, 0)
        n = k1 + k0
        ratio = 2 * (k1 * math.log(k1 / (n * share)) + (k0 * math.log(k0 / (n * (1 - share))) if k0 else 0.0))
        if ratio >= SIGNIFICANT and k1 / n1 >= RICHER * k0 / n0:
            out.add(x)
    return out


def _dictionary(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary, or the plain end of the samples where they are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def dictionaries(toxic: list[str], ordinary: list[str], bounds: Bounds) -> tuple[bytes, bytes]:
    marked = toxic_beginnings(toxic, ordinary)
    words = [w for t in toxic for w in words_of(t) if beginnings(w) & marked]
    plain = [w for t in ordinary for w in words_of(t)]
    lines = lambda ws: [b" " + b" ".join(ws[i:i + 8]) + b" " for i in range(0, len(ws), 8)]
    base = _dictionary(bounds.ordinary_bytes, lines(plain)[:: max(1, len(plain) // (8 * 6000))])
    if not words:
        return base, b""
    return base, base + _dictionary(bounds.toxic_bytes, lines(words))


class Comparer:
    """Features of whole texts under two dictionaries."""

    def __init__(self, model: Model):
        self.known = bool(model.toxic)
        if self.known:
            self.screen, self.close = ([self._compress(d, level) for d in (model.ordinary, model.toxic)] for level in (SCREEN_LEVEL, CLOSE_LEVEL))

    @staticmethod
    def _compress(content: bytes, level: int):
        import zstandard

        made = zstandard.ZstdCompressionDict(content + FILLER)
        made.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=made, write_checksum=False, write_content_size=False, write_dict_id=False).compress

    def features(self, text: str) -> tuple[int, int, int, int]:
        """Most bytes saved by a close window, by the three best, windows that saved any, windows looked at."""
        words = words_of(text)
        if not self.known or not words:
            return 0, 0, 0, 0
        ordinary, toxic = self.screen
        n, first, saved = len(words), FILLER + b" ", []
        for i in range(0, n, SCREEN_WORDS):
            window = first + b" ".join(words[i:i + SCREEN_WORDS]) + b" "
            if len(ordinary(window)) > len(toxic(window)):
                for j in range(max(0, i - 1), min(i + SCREEN_WORDS, n), CLOSE_WORDS):
                    near = first + b" ".join(words[j:j + CLOSE_WORDS]) + b" "
                    saved.append(len(self.close[0](near)) - len(self.close[1](near)))
        top = sorted(saved)[-3:]
        return max([0, *top]), sum(x for x in top if x > 0), len(saved), -(-n // SCREEN_WORDS)


def _inputs(features: np.ndarray) -> np.ndarray:
    best, top3, hits, windows = features.T.astype(float)
    return np.stack([np.ones(len(best)), np.minimum(best, 12), np.minimum(top3, 36) / 3, np.log1p(hits), np.log1p(windows)], axis=1)


def probability(weights: np.ndarray, features: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_inputs(features) @ weights, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Penalised Newton steps until they vanish; the objective is strictly concave."""
    w, weight = np.zeros(x.shape[1]), weight * len(y) / weight.sum()
    total = lambda w: float(np.sum(weight * (y * (x @ w) - np.logaddexp(0, x @ w))) - ridge * w @ w / 2)
    while True:
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        scale, now = 1.0, total(w)
        while scale > 1e-6 and total(w + scale * step) < now:
            scale /= 2
        w = w + scale * step
        if np.abs(scale * step).max() < 1e-6:
            return w


def train(docs: DataFrame, labels: DataFrame, bounds: Bounds = Bounds()) -> Model:
    """Fit on `labels` (doc_id, toxic), joined to `docs` by doc_id.

    Rows with a null id or label count for nothing; a document labelled twice is toxic if
    one label says so. Samples are drawn by a hash of the id. With no toxic or no ordinary
    document the model gives every text the share of toxic labels (0 without labels).
    """
    spark = docs.sparkSession
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    own = own.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    ids = []
    for toxic, learn, calibrate in ((1, bounds.toxic, bounds.calibrate_toxic), (0, bounds.ordinary, bounds.calibrate_ordinary)):
        drawn = own.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(learn + calibrate).collect()
        # two parts to the first, one to the second, as far as there are enough
        cut = min(learn, max(1, round(len(drawn) * learn / (learn + calibrate))))
        ids += [(r["doc_id"], toxic, nth < cut) for nth, r in enumerate(drawn)]
    empty = Model(b"", b"", (), n1 / max(1, n1 + n0))
    if not n1 or not n0:
        return empty
    sample = F.broadcast(spark.createDataFrame(ids, "sampled long, toxic int, learn boolean"))
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .where(F.length("text") <= bounds.chars).join(sample, F.col("doc_id") == F.col("sampled"))
        .groupBy("doc_id").agg(F.min(F.struct("text", "toxic", "learn")).alias("row")).select("row.*").collect()
    )
    rows.sort(key=lambda r: (r["text"]))
    texts = lambda toxic, learn: [r["text"] for r in rows if r["toxic"] == toxic and r["learn"] == learn]
    if not texts(1, True) or not texts(0, True):
        return empty
    model = Model(*dictionaries(texts(1, True), texts(0, True), bounds), (), empty.base)
    held = [(r["text"], r["toxic"]) for r in rows if not r["learn"]]
    y = np.array([t for _, t in held], dtype=float)
    if not y.any() or y.all():
        return empty
    sent = shared(spark, model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compare = Comparer(sent.value)
        for batch in batches:
            rows = [(*compare.features(t), y) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["best", "top3", "hits", "windows", "toxic"])

    found = (
        spark.createDataFrame(held, "text string, toxic long").repartition(spark.sparkContext.defaultParallelism)
        .mapInArrow(measure, FEATURES + ", toxic long").collect()
    )
    table = np.array([tuple(r) for r in found], dtype=float)
    y = table[:, 4]
    weight = np.where(y > 0, n1 / y.sum(), n0 / (len(y) - y.sum()))
    fitted = _logistic(_inputs(table[:, :4]), y, weight)
    return Model(model.ordinary, model.toxic, tuple(fitted), empty.base)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """`docs` with a column more: the probability that the text is toxic.

    Null and empty texts have no window and get the curve's value for that. Every
    other column, whatever its name, is passed on; one called like the new column is replaced.
    An empty table stays empty.
    """
    sent = shared(docs.sparkSession, model)
    text, kept = fresh(docs, "scored_text"), [c for c in docs.columns if c.lower() != name.lower()]
    out = docs.select(*[F.col(f"`{c}`") for c in kept], F.col("text").cast("string").alias(text))
    schema = out.drop(text).withColumn(name, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compare = Comparer(sent.value)
        weights = np.array(sent.value.weights)
        for batch in per_batch(BATCH, batches):
            if len(weights):
                p = probability(weights, np.array([compare.features(t) for t in texts_of(batch, text)], dtype=float).reshape(-1, 4))
            else:
                p = np.full(batch.num_rows, sent.value.base)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], pa.array(p)], names=[*kept, name])

    return out.mapInArrow(run, schema)
