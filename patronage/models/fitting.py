"""Maximum likelihood per tenant, all tenants side by side, on Spark.

Observations never leave the executors. In every pass the tenants still open send
one trial parameter vector to their own rows and get back the sums of the log-likelihood and of its first and
second derivatives, one evaluation a row; a damped Newton step per tenant, on log parameters, follows from those
as one row per tenant. Tenants that are done send nothing, so their rows drop out.

Sums are exact: every term is rounded to a fixed point and added up as integers, so a fit is the same to
the last bit however the rows are dealt out.

A pass either lowers a tenant's loss or raises its damping, whose growth ends in a stalled
tenant; so the loop needs no bound on passes.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.models.numeric import Slopes, by_logs
from patronage.session import settle

# Box of the log parameters, penalty on the squared parameters.
LOG_LOW, LOG_HIGH = -10.0, 25.0
PENALTY = 1e-4  # blocks the ridge towards infinity
STEP = 1e-3
LONGEST_STEP = 2.0
DAMPING_END = 1e7
PROMISE = 1e-12  # fall in loss still promised at which a fit has converged
ROUNDING = 1e-11  # the same relative to the loss, once a step has failed to lower it: a loss is a sum over many rows
DIGITS = 6  # of a fitted parameter; those below say nothing

SCALE = 40  # binary digits of a term behind the point
LIMBS = (22 + SCALE, 31, 0)  # binary digits below the parts that a term is added up in
LIMIT = 2.0 ** 80  # no term of a likelihood worth following is larger

LogLik = Callable[[DataFrame], DataFrame]  # (tenant_id, point array<double>) -> (tenant_id, limbs array<long>, bad long)
STATE = (
    "tenant_id long, point array<double>, best array<double>, loss double, "
    "slopes array<double>, damping double, passes int, status string"
)


def limbs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Doubles in parts that add up exactly as longs, over 2 ** 31 rows.

    Parts are cut towards zero: a small negative term beside a borrowed 2 ** 22 would keep 30 binary digits behind the point only.
    """
    high = np.trunc(values * 2.0 ** -22)
    rest = np.rint((values - high * 2.0 ** 22) * 2.0 ** SCALE).astype(np.int64)
    return high.astype(np.int64), rest >> 31, rest & ((1 << 31) - 1)


def exact(parts: list[int]) -> float:
    """The double next to a sum that came as limbs."""
    return sum(int(p) << shift for p, shift in zip(parts, LIMBS)) / (1 << SCALE)


def exact_sum(value: Column) -> Column:
    """The sum of a column, the same in every order of the rows, as a double; null terms do not count."""
    whole = F.when(value < 0, F.ceil(value * 2.0 ** -22)).otherwise(F.floor(value * 2.0 ** -22))
    rest = F.rint((value - whole.cast("double") * 2.0 ** 22) * 2.0 ** SCALE).cast("long")
    high, middle, low = F.sum(whole), F.sum(F.shiftright(rest, 31)), F.sum(rest.bitwiseAND(F.lit((1 << 31) - 1)))
    wide = lambda c: c.cast("decimal(38,0)")
    carried = wide(middle) * F.lit(1 << 31).cast("decimal(20,0)") + wide(low)
    return high.cast("double") * 2.0 ** 22 + carried.cast("double") * 2.0 ** -SCALE


def summed(rows: DataFrame, points: DataFrame, loglik: Callable[..., Column], names: list[str]) -> DataFrame:
    """Total log-likelihood per tenant and trial of `rows` (tenant_id, n, ...); n counts equal rows.

    `loglik` gets a column per parameter name, in the order of the trial vectors.
    """
    trials = rows.join(points, "tenant_id").select(*rows.columns, F.posexplode("points").alias("trial", "point"))
    given = trials.select("*", *[F.exp(F.col("point")[i]).alias(f"param_{n}") for i, n in enumerate(names)])
    part = loglik(*[F.col(f"param_{n}") for n in names])
    return given.groupBy("tenant_id", "trial").agg(F.sum(part * F.col("n")).alias("ll"))


def total(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("tenant_id", "trial").agg(F.sum("ll").alias("ll"))


def summed_slopes(rows: DataFrame, points: DataFrame, inputs: list[str], slopes: Callable[..., Slopes], names: list[str]) -> DataFrame:
    """Exact sums of a log-likelihood's value and slopes per tenant of `rows` (tenant_id, n, inputs) at `points` (tenant_id, point).

    `slopes` gets an array per input and per parameter. Columns of the sums: tenant_id, bad (rows with a term that is no number) and limbs,
    those of value, gradient and curvature in rows one after the other. Tasks add up their batches; there is one evaluation a row.
    """
    k = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tenant, n, *given = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            with np.errstate(all="ignore"):
                at = [np.exp(p) for p in given[len(inputs):]]
                terms = np.stack(by_logs(slopes(*given[:len(inputs)], *at), at)) * n
            fine = np.abs(terms) < LIMIT
            high, middle, low = limbs(np.where(fine, terms, 0.0))
            whose, nth = np.unique(tenant, return_inverse=True)
            sums = np.zeros((len(whose), 3 * len(terms)), np.int64)
            np.add.at(sums, nth, np.stack([high, middle, low], axis=1).reshape(3 * len(terms), -1).T)
            bad = np.bincount(nth, weights=~fine.all(axis=0), minlength=len(whose)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(whose), pa.array(bad), pa.array(list(sums), pa.list_(pa.int64()))], names=["tenant_id", "bad", "limbs"])

    wide = rows.join(points, "tenant_id").select(
        "tenant_id", F.col("n").cast("double").alias("n"), *inputs, *[F.col("point")[i].alias(f"param_{i}") for i in range(k)])
    return wide.mapInArrow(run, "tenant_id long, bad long, limbs array<long>")


def total_slopes(names: list[str], *parts: DataFrame) -> DataFrame:
    """Sums per tenant over the tasks and the parts of a likelihood."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    k = len(names)
    size = 3 * (1 + k + k * (k + 1) // 2)
    sums = out.groupBy("tenant_id").agg(F.sum("bad").alias("bad"), *[F.sum(F.col("limbs")[i]).alias(f"limb_{i}") for i in range(size)])
    return sums.select("tenant_id", "bad", F.array(*[f"limb_{i}" for i in range(size)]).alias("limbs"))


def stencil(at: np.ndarray) -> np.ndarray:
    """The point and the neighbours that give its gradient and curvature."""
    k = len(at)
    shifts = [np.zeros(k)]
    eye = np.eye(k) * STEP
    for i in range(k):
        shifts += [eye[i], -eye[i]]
    for i in range(k):
        for j in range(i):
            shifts += [eye[i] + eye[j], -eye[i] - eye[j]]
    return np.clip(at + np.array(shifts), LOG_LOW, LOG_HIGH)


def newton(at: np.ndarray, gradient: np.ndarray, curve: np.ndarray, damping: float) -> tuple[np.ndarray, float]:
    """Downhill step inside the box with the curvature made positive, and the fall in loss that an undamped one promises.

    A parameter at a wall that it would cross stays there and takes no part.
    """
    free = ~(((at <= LOG_LOW) & (gradient > 0)) | ((at >= LOG_HIGH) & (gradient < 0)))
    step = np.zeros(len(at))
    if not free.any():
        return step, 0.0
    size, axes = np.linalg.eigh(curve[np.ix_(free, free)])
    size = np.maximum(np.abs(size), 1e-8 * max(1.0, float(np.abs(size).max())))
    along = axes.T @ gradient[free]
    step[free] = -axes @ (along / (size * (1.0 + damping)))
    length = float(np.linalg.norm(step))
    return step if length <= LONGEST_STEP else step * (LONGEST_STEP / length), float(np.sum(along**2 / size)) / 2


def advance(row: dict, k: int) -> dict:
    """A tenant's state after the sums at its trial point have come in."""
    point = np.array(row["point"])
    parts = [exact(row["limbs"][i:i + 3]) for i in range(0, len(row["limbs"]), 3)]
    squares = PENALTY * np.exp(2 * point)
    loss = np.inf if row["bad"] else -parts[0] + float(squares.sum())
    best, lowest, packed, damping = row["best"], row["loss"], row["slopes"], row["damping"]
    better = best is None or loss < lowest
    if better:
        gradient, curve, at = -np.array(parts[1:k + 1]) + 2 * squares, np.diag(4 * squares), k + 1
        for i in range(k):
            for j in range(i + 1):
                curve[i, j] -= parts[at]
                curve[j, i] = curve[i, j]
                at += 1
        best, lowest, packed = point.tolist(), float(loss), [float(v) for v in (*gradient, *curve.ravel())]
        damping /= 4.0 if damping > 1e-3 else 1e9
    else:
        damping = max(1.0, damping * 4.0)
    at, gradient, curve = np.array(best), np.array(packed[:k]), np.array(packed[k:]).reshape(k, k)
    step, promise = newton(at, gradient, curve, damping)
    status = "open"
    if promise <= (PROMISE if better else ROUNDING * abs(lowest)):
        status = "converged"
    elif damping > DAMPING_END:
        status = "stalled"
    out = {"tenant_id": row["tenant_id"], "point": None, "best": best, "loss": lowest, "slopes": list(packed), "damping": damping,
           "passes": row["passes"] + 1, "status": status}
    if status == "open":
        out["point"] = np.clip(at + step, LOG_LOW, LOG_HIGH).tolist()
    return out


def fit(tenants: DataFrame, start: np.ndarray, loglik: LogLik, names: list[str]) -> DataFrame:
    """Penalised maximum-likelihood parameters of each row of `tenants` (tenant_id).

    Columns: tenant_id, the parameters by name, log_likelihood, passes, converged. `loglik` gives the sums at a point
    and is evaluated once per pass, so let it read settled tables.
    """
    k = len(start)
    nothing = F.lit(None)
    state = settle(tenants.select(
        F.col("tenant_id").cast("long"), F.array(*[F.lit(float(v)) for v in start]).alias("point"),
        nothing.cast("array<double>").alias("best"), nothing.cast("double").alias("loss"), nothing.cast("array<double>").alias("slopes"),
        F.lit(0.0).alias("damping"), F.lit(0).alias("passes"), F.lit("open").alias("status")))
    done: DataFrame | None = None

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [advance(r, k) for r in batch.to_dict("records")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in STATE.split(", ")])

    while not state.isEmpty():
        sums = loglik(state.select("tenant_id", "point"))
        after = settle(state.join(sums, "tenant_id").mapInPandas(step, STATE))
        over = after.where("status <> 'open'")
        done = over if done is None else done.unionByName(over)
        state = after.where("status = 'open'")
    if done is None:
        done = state
    value = lambda i: F.exp(F.col("best")[i])

    def digits(c: Column) -> Column:
        unit = F.pow(F.lit(10.0), F.floor(F.log10(c)) - F.lit(DIGITS - 1))
        return F.round(c / unit) * unit

    return done.select(
        "tenant_id", *[digits(value(i)).alias(n) for i, n in enumerate(names)],
        (-F.col("loss")).alias("log_likelihood"), "passes", (F.col("status") == "converged").alias("converged"),
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
