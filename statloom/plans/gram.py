"""Sufficient statistics: every estimator's distributed work is a call in here.

``sums`` is one ``df.agg`` (partial and final hash aggregate inside whole-stage codegen);
``cross`` builds weighted cross-product matrices with it. Wide designs (from ``WIDE``
columns on) switch to one numpy product a batch, summed per partition, since a thousand
sum expressions neither compile nor run well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.plans.formula import InvalidInput, SingularMatrix

WIDE = 14


def sums(df: DataFrame, columns: list[Column]) -> np.ndarray:
    """Totals of the columns over all rows (0 of an empty frame)."""
    row = df.agg(*[F.sum(c.cast("double")).alias(f"s{k}") for k, c in enumerate(columns)]).first()
    return np.array([0.0 if v is None else float(v) for v in row])


def cross(df: DataFrame, left: list[Column], right: list[Column] | None = None, weight: Column | None = None, extra: list[Column] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(left' W right, totals of extra). Without ``right`` the matrix is symmetric."""
    extra = list(extra or [])
    if len(left) + len(right or []) > WIDE:
        return _cross_wide(df, left, right, weight, extra)
    w = (lambda c: c) if weight is None else (lambda c: weight * c)
    if right is None:
        index = [(i, j) for i in range(len(left)) for j in range(i, len(left))]
        got = sums(df, [w(left[i] * left[j]) for i, j in index] + extra)
        out = np.zeros((len(left), len(left)))
        for (i, j), v in zip(index, got, strict=False):
            out[i, j] = out[j, i] = v
        return out, got[len(index) :]
    index = [(i, j) for i in range(len(left)) for j in range(len(right))]
    got = sums(df, [w(left[i] * right[j]) for i, j in index] + extra)
    return got[: len(index)].reshape(len(left), len(right)), got[len(index) :]


def _cross_wide(df: DataFrame, left: list[Column], right: list[Column] | None, weight: Column | None, extra: list[Column]) -> tuple[np.ndarray, np.ndarray]:
    a, b, e = len(left), len(right or []), len(extra)
    columns = [c.cast("double").alias(f"c{k}") for k, c in enumerate([*left, *(right or []), *extra, *([weight] if weight is not None else [])])]
    weighted, own = weight is not None, right is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(a * (a if own else b) + e)
        for batch in batches:
            m = np.stack([np.asarray(batch.column(k), dtype=float) for k in range(batch.num_columns)])
            w = m[-1] if weighted else 1.0
            x, y = m[:a], m[:a] if own else m[a : a + b]
            total += np.concatenate([((x * w) @ y.T).ravel(), m[a + b : a + b + e].sum(1)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

    rows = df.select(*columns).mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(a * (a if own else b) + e)
    for r in rows:
        out[r["i"]] = r["v"]
    return out[: len(out) - e].reshape(a, -1), out[len(out) - e :]


def solve_spd(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(solution, inverse) of a symmetric positive definite system."""
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    try:
        root = np.linalg.cholesky(a / np.outer(scale, scale))
    except np.linalg.LinAlgError as e:
        raise SingularMatrix("the design's columns are linearly dependent") from e
    # a dependent column leaves the rounding of its sums, some 1e-14, as its squared pivot
    if (np.diag(root) ** 2).min() < len(a) * 1e-13:
        raise SingularMatrix("the design's columns are linearly dependent")
    half = np.linalg.inv(root)
    inverse = half.T @ half / np.outer(scale, scale)
    return inverse @ b, inverse


def percentiles(df: DataFrame, value: Column, q: list[float], near: tuple[float, float] | None = None) -> list[float]:
    """Exact percentiles, as ``percentile`` interpolates them. That function counts every
    distinct value in one hash table; here a sketch (or ``near``, a guess for a single q)
    brackets each one, ranks are counted, and only the brackets' values are gathered: some
    0.0004 of the rows. A bracket that misses its ranks is widened."""
    rows = df.select(value.cast("double").alias("v")).filter("v is not null")
    margin, accuracy = 2e-4, 10_000
    while True:
        if near is None:
            at = [p for x in q for p in (max(x - margin, 0.0), min(x + margin, 1.0))]
            edges = rows.agg(F.percentile_approx("v", at, accuracy)).first()[0]
            if edges is None:
                raise InvalidInput("no rows to take percentiles of")
            pairs = [(-float("inf") if a == 0.0 else lo, float("inf") if b == 1.0 else hi) for a, b, lo, hi in zip(at[::2], at[1::2], edges[::2], edges[1::2], strict=True)]
        else:
            pairs = [near]
        inside = F.lit(False)
        for lo, hi in pairs:
            inside = inside | F.col("v").between(lo, hi)
        got = rows.agg(F.count(F.lit(1)), *[F.count_if(F.col("v") < lo) for lo, _ in pairs], F.count_if(inside)).first()
        n, out = got[0], []
        if near is None or got[-1] <= 1_000_000:
            held = rows.filter(inside).groupBy("v").count().toPandas().sort_values("v")
            for x, (lo, hi), below in zip(q, pairs, got[1:-1], strict=True):
                own = held[(held["v"] >= lo) & (held["v"] <= hi)]
                values, ends = own["v"].to_numpy(), below + np.cumsum(own["count"].to_numpy())
                place = (n - 1) * x
                first, last = int(np.floor(place)), int(np.ceil(place))
                if len(ends) and first >= below and last < ends[-1]:
                    a, b = (values[np.searchsorted(ends, r, "right")] for r in (first, last))
                    out.append(float(a if first == last or a == b else (last - place) * a + (place - first) * b))
        if len(out) == len(q):
            return out
        margin, near = margin if near is not None else 4 * margin, None


def quadratic(matrix: np.ndarray, x: list[Column]) -> Column:
    """x' M x of a row as a column expression (M symmetric)."""
    total = F.lit(0.0)
    for i in range(len(x)):
        for j in range(i, len(x)):
            total = total + F.lit(float(matrix[i, j] * (1 if i == j else 2))) * x[i] * x[j]
    return total


def require_finite(df: DataFrame, columns: list[str]) -> int:
    """Row count; raises where a column holds a null, NaN or infinity."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    row = df.agg(F.count(F.lit(1)), F.count_if(bad)).first()
    if row[1]:
        raise InvalidInput(f"{row[1]} rows hold nulls, NaNs or infinities")
    return row[0]
