"""Survival analysis: tables by distinct time, cumulated range by range."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions import dist
from statloom.operators.base import Model
from statloom.operators.linear import _design
from statloom.plans.formula import InvalidInput
from statloom.plans.gram import sums
from statloom.plans.order import range_of, running, with_lags


def _later(table: DataFrame, columns: list[str], order: str = "time", part: str | None = None) -> DataFrame:
    """``table`` with ``c_r``: totals of c over this and all later times."""
    return running(table, {f"{c}_r": ("sum", F.col(c).cast("double")) for c in columns}, order, reverse=True, part=part)


def _so_far(table: DataFrame, columns: list[str], order: str = "time") -> DataFrame:
    """``table`` with ``c_s``: totals of c over this and all earlier times."""
    return running(table, {f"{c}_s": ("sum", F.col(c).cast("double")) for c in columns}, order)


def life_table(df: DataFrame, time: str, event: str) -> DataFrame:
    """By distinct time: events d, all rows n, and those at risk."""
    by = df.groupBy(F.col(time).cast("double").alias("time")).agg(F.count_if(F.col(event) == 1).cast("double").alias("d"), F.count(F.lit(1)).cast("double").alias("n"))
    return _later(by, ["n"]).withColumnRenamed("n_r", "at_risk")


def kaplan_meier(df: DataFrame, time: str, event: str, alpha: float = 0.05) -> DataFrame:
    """Steps at event times: time, at_risk, events, survival, lower, upper. The interval is
    symmetric in ln S; at S = 0 or 1 it is (0, 1)."""
    table = life_table(df, time, event).filter("d > 0")
    table = table.withColumns({"__l": F.when(F.col("d") < F.col("at_risk"), F.log1p(-F.col("d") / F.col("at_risk"))).otherwise(0.0), "__z": (F.col("d") == F.col("at_risk")).cast("double"), "__g": F.when(F.col("d") < F.col("at_risk"), F.col("d") / (F.col("at_risk") * (F.col("at_risk") - F.col("d")))).otherwise(0.0)})
    table = _so_far(table, ["__l", "__z", "__g"])
    q = dist.norm_ppf(1 - alpha / 2)
    s = F.when(F.col("__z_s") > 0, 0.0).otherwise(F.exp("__l_s"))
    table = table.withColumn("survival", s)
    log = F.log("survival")
    se = F.sqrt("__g_s") / F.abs(log)
    inside = (F.col("survival") > 0) & (F.col("survival") < 1)
    clip = lambda c: F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))
    return table.select("time", "at_risk", F.col("d").alias("events"), "survival", F.when(inside, clip(F.exp(log * (1 + q * se)))).otherwise(0.0).alias("lower"), F.when(inside, clip(F.exp(log * (1 - q * se)))).otherwise(1.0).alias("upper"))


def km_summary(curve: DataFrame) -> dict[str, float]:
    """Median survival (first time with S <= 1/2) and restricted mean to the last event."""
    median = curve.filter("survival <= 0.5").agg(F.min("time")).first()[0]
    steps = with_lags(curve.select("time", "survival"), ["time", "survival"], [1], "time")
    area = (F.col("time") - F.coalesce("time_1", F.lit(0.0))) * F.coalesce("survival_1", F.lit(1.0))
    return {"median": median if median is not None else math.nan, "rmst": float(sums(steps, [area])[0])}


def survival_at(curve: DataFrame, t: float) -> float:
    """The right-continuous step function at t."""
    row = curve.filter(F.col("time") <= t).agg(F.max_by("survival", "time")).first()[0]
    return 1.0 if row is None else row


def survival_lookup(curve: DataFrame, df: DataFrame, at: str, name: str = "survival") -> DataFrame:
    """As-of lookup for many times: both sides are cut by the ranges of the curve, the last
    step before each range is carried in, and the union is filled forward by range."""
    piece = range_of(curve, "time")
    carry, last = {}, 1.0
    ends = {r[0]: r[1] for r in curve.groupBy(piece.alias("p")).agg(F.max_by("survival", "time")).collect()}
    for p in range(max(ends, default=0) + 1):
        carry[p] = last
        last = ends.get(p, last)
    left = df.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in df.columns])).select("__row", F.col(at).cast("double").alias("time"), F.lit(None).cast("double").alias("__s"), F.lit(1).alias("__o"))
    right = curve.select(F.lit(None).cast(left.schema["__row"].dataType).alias("__row"), "time", F.col("survival").alias("__s"), F.lit(0).alias("__o"))
    both = left.unionByName(right).withColumn("__p", piece)
    w = Window.partitionBy("__p").orderBy("time", "__o").rowsBetween(Window.unboundedPreceding, 0)
    start = F.element_at(F.create_map(*[F.lit(v) for kv in carry.items() for v in kv]), F.col("__p"))
    both = both.withColumn(name, F.coalesce(F.last("__s", ignorenulls=True).over(w), start))
    return both.filter("__o = 1").select("__row.*", name)


@dataclass
class LogRank:
    statistic: float
    p_value: float
    observed: float
    expected: float


def log_rank(df: DataFrame, time: str, event: str, group: str) -> LogRank:
    """Two groups, hypergeometric variance; figures are the first group's."""
    names = [r[0] for r in df.select(group).distinct().orderBy(group).limit(3).collect()]
    if len(names) != 2:
        raise InvalidInput("log_rank compares two groups")
    one, dead = F.col(group) == F.lit(names[0]), F.col(event) == 1
    by = df.groupBy(F.col(time).cast("double").alias("time")).agg(F.count_if(dead).cast("double").alias("d"), F.count_if(dead & one).cast("double").alias("d1"), F.count(F.lit(1)).cast("double").alias("n"), F.count_if(one).cast("double").alias("n1"))
    t = _later(by, ["n", "n1"]).filter("d > 0")
    d, n, n1 = F.col("d"), F.col("n_r"), F.col("n1_r")
    seen, want, var = sums(t, [F.col("d1"), d * n1 / n, F.when(n > 1, d * n1 / n * (1 - n1 / n) * (n - d) / (n - 1))])
    stat = (seen - want) ** 2 / var
    return LogRank(stat, dist.chi2_sf(stat, 1), seen, want)


def cox(df: DataFrame, formula, event: str, max_iter: int = 200, tol: float = 1e-8) -> Model:
    """Cox regression (``time ~ x1 + x2``), Breslow ties, by Newton steps. A step sums the
    risk sets' moments by distinct time, cumulates them from the end range by range, and
    adds up score and information."""
    d = _design(df, formula, event=event)
    k = len(d.names)
    x = [F.col(f"x{j}") for j in range(k)]
    means = sums(d.df, [F.lit(1), *x])
    n, center = means[0], means[1:] / max(means[0], 1)
    rows = d.df.select(F.col("y").alias("time"), (F.col("event") == 1).cast("double").alias("e"), *[(c - float(m)).alias(f"x{j}") for j, (c, m) in enumerate(zip(x, center, strict=True))])
    rows = rows.withColumn("part", range_of(rows, "time")).persist()
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    beta, done, used, llf, null = np.zeros(k), False, 0, 0.0, None
    try:
        for used in range(1, max_iter + 1):
            eta = F.lit(0.0)
            for b, c in zip(beta, x, strict=True):
                eta = eta + float(b) * c
            w = F.exp(eta)
            by = rows.groupBy("part", "time").agg(F.sum("e").alias("d"), F.sum(F.col("e") * eta).alias("l"), *[F.sum(F.col("e") * c).alias(f"s{j}") for j, c in enumerate(x)], F.sum(w).alias("a"), *[F.sum(w * c).alias(f"b{j}") for j, c in enumerate(x)], *[F.sum(w * x[i] * x[j]).alias(f"c{i}_{j}") for i, j in cells])
            names = ["a", *[f"b{j}" for j in range(k)], *[f"c{i}_{j}" for i, j in cells]]
            t = _later(by, names, part="part").filter("d > 0")
            a, m = F.col("a_r"), [F.col(f"b{j}_r") / F.col("a_r") for j in range(k)]
            got = sums(t, [F.col("l") - F.col("d") * F.log(a), *[F.col(f"s{j}") - F.col("d") * m[j] for j in range(k)], *[F.col("d") * (F.col(f"c{i}_{j}_r") / a - m[i] * m[j]) for i, j in cells]])
            llf, grad = got[0], got[1 : 1 + k]
            null = llf if null is None else null
            info = np.zeros((k, k))
            for v, (i, j) in zip(got[1 + k :], cells, strict=True):
                info[i, j] = info[j, i] = v
            try:
                step = np.linalg.solve(info, grad)
            except np.linalg.LinAlgError:
                step = np.linalg.solve(info + 1e-8 * np.eye(k), grad)
            if np.abs(step).max() < tol:
                done = True
                break
            beta = beta + step
        cov = np.linalg.pinv(info)
    finally:
        rows.unpersist()
    out = Model(list(d.names), beta, cov, math.inf, design=d, stats={"n": int(n), "llf": llf, "llnull": null}, converged=done, iterations=used, link="log")
    out.hazard_ratios = {c: (math.exp(b), math.exp(b - 1.959963984540054 * s), math.exp(b + 1.959963984540054 * s)) for c, b, s in zip(d.names, beta, out.se, strict=True)}
    return out
