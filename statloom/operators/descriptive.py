"""Descriptive statistics, correlation, contingency tables, evaluation and diagnostics.

Everything is one or two aggregates; ranks are made from the counts of distinct values,
so ties cost nothing and no window runs over all rows of one value.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions import dist
from statloom.operators.linear import fit_ols
from statloom.plans.formula import Design, InvalidInput
from statloom.plans.gram import cross, sums
from statloom.plans.order import numbered, rank_table


def describe(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Count, mean, sample std and variance, extremes, quartiles (linear interpolation),
    population skewness and excess kurtosis; of all rows or by group."""
    x = F.col(column).cast("double")
    q = F.percentile(x, [0.25, 0.5, 0.75])
    exprs = [F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.var_samp(x).alias("variance"), F.min(x).alias("min"), F.max(x).alias("max"), q.alias("q"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis")]
    out = (df.groupBy(*by) if by else df).agg(*exprs)
    return out.select(*(by or []), "n", "mean", "std", "variance", "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "max", "skewness", "kurtosis")


def percentile(df: DataFrame, column: str, p: float) -> float:
    return float(df.agg(F.percentile(column, p)).first()[0])


def midranks(df: DataFrame, column: str, name: str = "rank") -> DataFrame:
    """``df`` with average ranks of a column: the table of distinct values, joined back."""
    rows = df.select(F.col(column).alias("__v"))
    table = rank_table(rows.filter("__v is not null"), "__v").select("__v", F.col("rank").alias(name))
    return df.join(table, F.col(column) == F.col("__v")).drop("__v")


def pearson(df: DataFrame, x: str, y: str) -> float:
    r = df.agg(F.corr(F.col(x).cast("double"), F.col(y).cast("double"))).first()[0]
    if r is None or math.isnan(r):
        raise InvalidInput("a column without variance")
    return r


def spearman(df: DataFrame, x: str, y: str) -> float:
    rows = df.select(F.col(x).cast("double").alias("a"), F.col(y).cast("double").alias("b")).filter("a is not null and b is not null")
    out = rows
    for c in "ab":  # both tables come from the plain columns; the joins back split hot values
        table = rank_table(rows.select(c), c).select(F.col(c).alias(f"v{c}"), F.col("rank").alias(f"r{c}"))
        out = out.join(table, F.col(c) == F.col(f"v{c}")).drop(f"v{c}")
    return pearson(out, "ra", "rb")


def correlation_test(r: float, n: int) -> float:
    """Two-sided p-value of a correlation."""
    return 0.0 if abs(r) >= 1 else dist.two_sided_t(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def correlation_matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    x = [F.col(c).cast("double") for c in columns]
    got = sums(df, [F.lit(1), *x])
    g, _ = cross(df, [c - float(m) for c, m in zip(x, got[1:] / got[0], strict=True)])
    s = np.sqrt(np.diag(g))
    return g / np.outer(s, s)


def correlation_frame(df: DataFrame, columns: list[str]) -> DataFrame:
    m = correlation_matrix(df, columns)
    return df.sparkSession.createDataFrame([(a, b, float(m[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns)], "a string, b string, r double")


def format_correlation(matrix: np.ndarray, names: list[str]) -> str:
    head = " " * 12 + "".join(f"{n:>12}" for n in names)
    return "\n".join([head, *[f"{n:<12}" + "".join(f"{v:>12.4f}" for v in row) for n, row in zip(names, matrix, strict=True)]])


# ---------------------------------------------------------------- contingency


@dataclass
class Table2x2:
    odds_ratio: float
    risk_ratio: float
    risk_difference: float
    cells: tuple[float, float, float, float]


def counts_2x2(df: DataFrame, row: Column, column: Column) -> list[list[float]]:
    """Counts of two conditions: rows true/false, columns true/false."""
    a, b, c, d = sums(df, [(row & column).cast("int"), (row & ~column).cast("int"), (~row & column).cast("int"), (~row & ~column).cast("int")])
    return [[a, b], [c, d]]


def table2x2(t) -> Table2x2:
    """Odds ratio, risk ratio and risk difference; an empty cell counts as one half."""
    a, b, c, d = (v if v > 0 else 0.5 for r in t for v in r)
    return Table2x2(a * d / (b * c), a / (a + b) / (c / (c + d)), a / (a + b) - c / (c + d), (a, b, c, d))


def odds_ratio_interval(t, alpha: float = 0.05) -> tuple[float, float]:
    one = table2x2(t)
    se = math.sqrt(sum(1 / v for v in one.cells))
    q, log = dist.norm_ppf(1 - alpha / 2), math.log(one.odds_ratio)
    return math.exp(log - q * se), math.exp(log + q * se)


def mcnemar(t, correction: bool = True) -> tuple[float, float]:
    b, c = t[0][1], t[1][0]
    if b + c == 0:
        return 0.0, 1.0
    gap = max(abs(b - c), 1) - 1 if correction else abs(b - c)
    stat = gap**2 / (b + c)
    return stat, dist.chi2_sf(stat, 1)


def mantel_haenszel(df: DataFrame, stratum: str, row: Column, column: Column) -> tuple[float, float, float]:
    """(chi-squared, p, common odds ratio) over strata, none of which is gathered."""
    by = df.groupBy(stratum).agg(F.count_if(row & column).alias("a"), F.count_if(row & ~column).alias("b"), F.count_if(~row & column).alias("c"), F.count_if(~row & ~column).alias("d"))
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n = a + b + c + d
    ok = n > 1
    got = sums(by, [F.when(ok, v) for v in (a, (a + b) * (a + c) / n, (a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1)), a * d / n, b * c / n)])
    stat = (got[0] - got[1]) ** 2 / got[2]
    return stat, dist.chi2_sf(stat, 1), got[3] / got[4]


# ---------------------------------------------------------------- evaluation


def regression_metrics(df: DataFrame, truth: str, guess: str) -> dict[str, float]:
    y, p = F.col(truth).cast("double"), F.col(guess).cast("double")
    e = y - p
    row = df.agg(F.avg(F.abs(e)), F.avg(e * e), F.avg(F.when(y != 0, F.abs(e / y))), F.var_pop(y)).first()
    return {"mae": row[0], "mse": row[1], "rmse": math.sqrt(row[1]), "mape": row[2], "r2": 1 - row[1] / row[3] if row[3] else math.nan}


def confusion(df: DataFrame, truth: str, probability: str, threshold: float = 0.5) -> dict[str, int]:
    hit, yes = F.col(probability) >= threshold, F.col(truth) == 1
    row = df.agg(F.count_if(hit & yes), F.count_if(hit & ~yes), F.count_if(~hit & ~yes), F.count_if(~hit & yes)).first()
    return dict(zip(("tp", "fp", "tn", "fn"), row, strict=True))


def classification_metrics(df: DataFrame, truth: str, probability: str, threshold: float = 0.5) -> dict[str, float]:
    c = confusion(df, truth, probability, threshold)
    y, p = F.col(truth).cast("double"), F.greatest(F.least(F.col(probability), F.lit(1 - 1e-15)), F.lit(1e-15))
    loss, brier = df.agg(F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))), F.avg((y - F.col(probability)) ** 2)).first()
    precision = c["tp"] / (c["tp"] + c["fp"]) if c["tp"] + c["fp"] else 0.0
    recall = c["tp"] / (c["tp"] + c["fn"]) if c["tp"] + c["fn"] else 0.0
    return {"accuracy": (c["tp"] + c["tn"]) / max(sum(c.values()), 1), "precision": precision, "recall": recall, "f1": 2 * precision * recall / (precision + recall) if precision + recall else 0.0, "log_loss": loss, "brier": brier}


def bootstrap_mean(df: DataFrame, column: str, resamples: int = 1000, alpha: float = 0.05, seed: int = 7) -> tuple[float, float, float]:
    """(mean, lower, upper): Poisson bootstrap. Every row draws its own weight in every
    resample, so resamples are columns of sums and the data are read once per hundred."""
    x, means = F.col(column).cast("double"), []
    for at in range(0, resamples, 100):
        draws = []
        for k in range(at, min(at + 100, resamples)):
            u = F.rand(seed + k)
            w, p, total = F.lit(0.0), math.exp(-1), 0.0
            for j in range(8):  # inverse of the Poisson(1) distribution
                total += p
                w = w + (u > total).cast("double")
                p /= j + 1
            draws.append(w)
        named = df.select(x.alias("x"), *[w.alias(f"w{k}") for k, w in enumerate(draws)])
        row = named.agg(*[(F.sum(F.col(f"w{k}") * F.col("x")) / F.sum(f"w{k}")) for k in range(len(draws))]).first()
        means += [float(v) for v in row]
    means.sort()
    pick = lambda q: means[min(len(means) - 1, max(0, round(q * (len(means) - 1))))]
    return float(df.agg(F.avg(x)).first()[0]), pick(alpha / 2), pick(1 - alpha / 2)


# ---------------------------------------------------------------- diagnostics


def variance_inflation(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """The diagonal of the inverse correlation matrix."""
    return dict(zip(columns, np.diag(np.linalg.inv(correlation_matrix(df, columns))).tolist(), strict=True))


def _auxiliary(d: Design, target: Column, x: list[Column]) -> tuple[float, int, int]:
    """(R², n, regressors) of a target on x and a constant."""
    m = fit_ols(Design(d.df.select(target.alias("y"), *[c.alias(f"x{k}") for k, c in enumerate(x)]), [f"x{k}" for k in range(len(x))]))
    return m.r2, m.n, len(x)


def breusch_pagan(m) -> tuple[float, float]:
    e = F.col("y") - m.design.linear(m.coef)
    r2, n, k = _auxiliary(m.design, e * e, [F.col(f"x{j}") for j in range(len(m.design.names))])
    return n * r2, dist.chi2_sf(n * r2, k)


def white_test(m) -> tuple[float, float]:
    x = [F.col(f"x{j}") for j in range(len(m.design.names))]
    e = F.col("y") - m.design.linear(m.coef)
    terms = x + [x[i] * x[j] for i in range(len(x)) for j in range(i, len(x))]
    r2, n, k = _auxiliary(m.design, e * e, terms)
    return n * r2, dist.chi2_sf(n * r2, k)


def reset_test(m, powers: tuple[int, ...] = (2, 3)) -> tuple[float, float]:
    """F test of powers of the fitted values, scaled so that they stay solvable."""
    d, fit = m.design, m.design.linear(m.coef)
    mean, sd = d.df.agg(F.avg(fit), F.stddev_pop(fit)).first()
    z = (fit - mean) / sd
    wide = Design(d.df.select("y", *[F.col(f"x{k}") for k in range(len(d.names))], *[F.pow(z, F.lit(float(p))).alias(f"x{len(d.names) + k}") for k, p in enumerate(powers)]), [*d.names, *[f"fit^{p}" for p in powers]], d.intercept)
    full = fit_ols(wide)
    q = len(powers)
    f = (m.ssr - full.ssr) / q / (full.ssr / full.dof)
    return f, dist.f_sf(f, q, full.dof)


def ordered_values(df: DataFrame, column: str) -> DataFrame:
    """Values with their 1-based position in rising order."""
    return numbered(df.select(F.col(column).cast("double").alias("v")), "v", "i")
