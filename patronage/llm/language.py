"""Language identification in two steps: the family first, then the languages within it.

A text becomes hashed counts of its letters' one-, two- and three-byte sequences. Linear
support vector machines, one per family against the rest, choose the family; within it
one machine per pair of languages votes. The machines are fitted on the driver from a bounded
sample per language; tasks compute the features of whole texts and the margins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import forget, fresh, give_back, per_batch, shared, texts_of

UNKNOWN = "und"
DIM = 4096
PER_LANGUAGE = 300  # documents of one language that a fit sees at most
SAMPLE_CHARS = 20_000  # longest document of the sample
BATCH = 200
SLOPE = 2.0  # of the curve from margins to scores
FOLDS = 3  # of the sample, to measure margins of rows a fit has not seen
KEEP = 0.995  # share of right held-out rows of a language whose margin is enough
FAMILIES = {
    **dict.fromkeys("af da de en fo fy is lb nl nn no sv yi".split(), "germanic"),
    **dict.fromkeys("an ast ca co es fr gl it la oc pt ro sc".split(), "romance"),
    **dict.fromkeys("be bg bs cs hr mk pl ru sk sl sr uk".split(), "slavic"),
    **dict.fromkeys("bn fa gu hi ku mr ne pa ps sd si ur".split(), "indo-iranian"),
    **dict.fromkeys("br cy ga gd kw".split(), "celtic"),
    **dict.fromkeys("et fi hu se".split(), "uralic"),
    **dict.fromkeys("az kk ky tr tt ug uz".split(), "turkic"),
    **dict.fromkeys("ar he mt am".split(), "semitic"),
    **dict.fromkeys("lt lv".split(), "baltic"),
    **dict.fromkeys("id jv ms su tl".split(), "austronesian"),
    **dict.fromkeys("my th lo km vi".split(), "south-east asian"),
    **dict.fromkeys("ja ko zh".split(), "east asian"),
    **dict.fromkeys("kn ml ta te".split(), "dravidian"),
}
OTHER = "other"


@dataclass(frozen=True)
class Model:
    """Families with their languages, and weight vectors (bias last) per family and per pair of languages."""

    families: tuple[tuple[str, tuple[str, ...]], ...]
    of_family: np.ndarray
    of_pair: dict[tuple[str, str], np.ndarray]
    of_language: dict[str, np.ndarray] = field(default_factory=dict)  # against all other languages
    least: dict[str, float] = field(default_factory=dict)  # margin of a language below which a text is in none


# Bytes that are no letters become a space; bytes over 127 belong to letters almost always.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256)], dtype=np.uint32)


def features(text: str) -> np.ndarray:
    """Hashed sequence counts under a square root, of length one, with a constant at the end."""
    raw = b" " + text.lower().encode() + b" "
    total = np.zeros(DIM)
    step = 1 << 20
    for at in range(0, len(raw), step):
        b = _FOLD[np.frombuffer(raw[at:at + step + 2], dtype=np.uint8)]
        for n, key in ((1, b), (2, b[:-1] * np.uint32(257) + b[1:]), (3, (b[:-2] * np.uint32(257) + b[1:-1]) * np.uint32(263) + b[2:])):
            if at + step < len(raw):  # the overlap counts in the next stretch
                key = key[:step]
            total += np.bincount(((key + np.uint32(n)) * np.uint32(2654435761) >> np.uint32(20)).astype(np.int64), minlength=DIM)
    total = np.sqrt(total)
    return np.append(total / (np.linalg.norm(total) or 1.0), 1.0)


def svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, epochs: int = 60, tolerance: float = 1e-3) -> np.ndarray:
    """Linear support vector machine with squared hinge loss by dual coordinate descent; y is +1 or -1."""
    rng = np.random.default_rng(0)
    alpha, w, square = np.zeros(len(y)), np.zeros(x.shape[1]), np.einsum("ij,ij->i", x, x) + 1 / (2 * cost)
    for _ in range(epochs):
        largest = 0.0
        for i in rng.permutation(len(y)):
            gradient = y[i] * (x[i] @ w) - 1 + alpha[i] / (2 * cost)
            if alpha[i] == 0 and gradient >= 0:
                continue
            largest = max(largest, abs(gradient))
            new = max(alpha[i] - gradient / square[i], 0.0)
            w += (new - alpha[i]) * y[i] * x[i]
            alpha[i] = new
        if largest < tolerance:
            break
    return w


def fit(x: np.ndarray, languages: list[str], families: dict[str, str] = FAMILIES) -> Model:
    own = np.array([families.get(v.split("-")[0].lower(), OTHER) for v in languages])
    spoken = np.array(languages)
    known = tuple((f, tuple(sorted(set(spoken[own == f])))) for f in sorted(set(own)))
    of_family = np.stack([svm(x, np.where(own == f, 1.0, -1.0)) if len(known) > 1 else np.zeros(x.shape[1]) for f, _ in known]) if known else np.zeros((0, DIM + 1))
    pairs = {}
    for _, members in known:
        for a, b in combinations(members, 2):
            either = (spoken == a) | (spoken == b)
            pairs[a, b] = svm(x[either], np.where(spoken[either] == a, 1.0, -1.0))
    return Model(known, of_family, pairs)


def predict(model: Model, x: np.ndarray) -> tuple[str, float]:
    """The language and how sure: the family's lead times the least lead over a language of the family."""
    sure = lambda lead: float(1 / (1 + np.exp(-SLOPE * lead)))
    margins = model.of_family @ x
    order = np.argsort(-margins, kind="stable")
    members = model.families[order[0]][1]
    score = sure(margins[order[0]] - margins[order[1]]) if len(order) > 1 else 1.0
    votes = dict.fromkeys(members, 0)
    lead: dict[str, list[float]] = {m: [] for m in members}
    for a, b in combinations(members, 2):
        margin = float(model.of_pair[a, b] @ x)
        votes[a if margin >= 0 else b] += 1
        lead[a].append(margin)
        lead[b].append(-margin)
    best = max(members, key=lambda m: (votes[m], sum(lead[m])))
    return best, score * min([1.0, *map(sure, lead[best])])


def evidence(model: Model, x: np.ndarray, language: str) -> float:
    """The smaller of the margins that the language's family and the language itself have against all the rest."""
    family = next(i for i, (_, members) in enumerate(model.families) if language in members)
    own = [float(model.of_language[language] @ x)]
    return min(own + [float(model.of_family[family] @ x)] * (len(model.families) > 1))


def with_evidence(x: np.ndarray, languages: list[str], families: dict[str, str] = FAMILIES) -> Model:
    """A model that also knows the least evidence for each language, from rows held out of `FOLDS` fits.

    With a single language there is no rest to tell it from, and no least evidence.
    """

    def whole(x: np.ndarray, spoken: list[str]) -> Model:
        known = sorted(set(spoken))
        machines = {v: svm(x, np.where(np.array(spoken) == v, 1.0, -1.0)) for v in known} if len(known) > 1 else {}
        return replace(fit(x, spoken, families), of_language=machines)

    model, margins = whole(x, languages), {v: [] for v in languages}
    if not model.of_language:
        return model
    place = np.zeros(len(languages), dtype=int)  # every language is dealt to all folds
    for v in margins:
        own = np.flatnonzero(np.array(languages) == v)
        place[own] = np.arange(len(own)) % FOLDS
    for fold in range(FOLDS):
        seen = np.flatnonzero(place != fold)
        part = whole(x[seen], [languages[i] for i in seen])
        for i in np.flatnonzero(place == fold):
            if part.of_language and predict(part, x[i])[0] == languages[i]:
                margins[languages[i]].append(evidence(part, x[i], languages[i]))
    return replace(model, least={v: float(np.quantile(m, 1 - KEEP, method="lower")) for v, m in margins.items() if m})


def predict_known(model: Model, x: np.ndarray) -> tuple[str, float]:
    """As `predict`, but `und` with score 0 for a text with less evidence than nearly all texts of the language have."""
    language, score = predict(model, x)
    if model.of_language and evidence(model, x, language) < model.least.get(language, -np.inf):
        return UNKNOWN, 0.0
    return language, score


def _vectors(docs: DataFrame, columns: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in per_batch(BATCH, batches):
            made = [features(t).astype("<f4").tobytes() for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], names=[*columns, "x"])
        give_back()

    return docs.select(*columns, "text").mapInArrow(run, f"{columns[0]} string, {columns[1]} long, x binary")


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, families: dict[str, str] = FAMILIES, reject: bool = False) -> Model:
    """Fit on `docs` (doc_id, text, lang); with `reject`, `identify` gives `und` to texts without evidence for a language.

    Rows with a null text or lang, without a letter, or longer than `SAMPLE_CHARS` are not
    drawn. The draw is by a hash of text and id, about `per_language` for each language and never more. With no row the
    model knows no language.
    """
    own = docs.select(F.xxhash64("doc_id", "text").alias("draw"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    own = own.where("lang is not null and text is not null and text rlike '\\\\p{L}'").where(F.length("text") <= SAMPLE_CHARS)
    counts = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return fit(np.zeros((0, DIM + 1)), [])
    top = 2**63 - 1
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(top, int(2.0 * top * min(1.0, 1.2 * per_language / n) - top)))])
    drawn = _vectors(own.where(F.col("draw") <= share[F.col("lang")]).select("lang", "draw", "text"), ["lang", "draw"]).collect()
    kept: list[tuple[str, bytes]] = []
    left = dict.fromkeys(counts, per_language)
    for r in sorted(drawn, key=lambda r: (r["lang"], r["draw"], r["x"])):
        if left[r["lang"]]:
            left[r["lang"]] -= 1
            kept.append((r["lang"], r["x"]))
    if not kept:
        return fit(np.zeros((0, DIM + 1)), [])
    x = np.stack([np.frombuffer(v, dtype="<f4").astype(float) for _, v in kept])
    return (with_evidence if reject else fit)(x, [lang for lang, _ in kept], families)


def identify(docs: DataFrame, model: Model, lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """`docs` with the predicted language of its whole `text` and a score from 0 to 1.

    A null text, a text without a letter, or a model without languages gives `und` with
    score 0, as does a text with too little evidence where the model can tell. All other columns are passed on, and one called like a new column is replaced;
    repeated rows come back each; an empty table stays empty.
    """
    sent = shared(docs.sparkSession, model)
    taken = {lang_name.lower(), score_name.lower()}
    text, kept = fresh(docs, "identified_text"), [c for c in docs.columns if c.lower() not in taken]
    out = docs.select(*[F.col(f"`{c}`") for c in kept], F.col("text").cast("string").alias(text))
    schema = out.drop(text).withColumn(lang_name, F.lit("")).withColumn(score_name, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        model = sent.value
        for batch in per_batch(BATCH, batches):
            found = [predict_known(model, features(t)) if model.families and any(map(str.isalpha, t)) else (UNKNOWN, 0.0) for t in texts_of(batch, text)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(kept)], pa.array([f for f, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                names=[*kept, lang_name, score_name])
        give_back()

    return out.mapInArrow(run, schema)
