"""Hypothesis tests over DataFrames: group sums, ranks from value counts, and p-values on
the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions import dist
from statloom.operators.base import norm_cdf_column
from statloom.plans.formula import InsufficientData, InvalidInput
from statloom.plans.gram import sums
from statloom.plans.order import cumulative, range_of, rank_table, running


@dataclass
class Test:
    statistic: float
    p_value: float
    df: float = math.nan
    interval: tuple[float, float] | None = None
    estimate: float = math.nan


def _stats(df: DataFrame, x: Column) -> tuple[float, float, float]:
    n, m, v = df.agg(F.count(x), F.avg(x), F.var_samp(x)).first()
    return n, m, v


def _num(column: str) -> Column:
    return F.col(column).cast("double")


# ---------------------------------------------------------------- means


def _t_test(mean: float, se: float, df: float, alpha: float = 0.05) -> Test:
    t = mean / se if se > 0 else math.copysign(math.inf, mean) if mean else 0.0
    q = dist.t_ppf(1 - alpha / 2, df)
    return Test(t, dist.two_sided_t(t, df) if math.isfinite(t) else 0.0, df, (mean - q * se, mean + q * se), mean)


def ttest_one(df: DataFrame, column: str, mu: float = 0.0) -> Test:
    n, m, v = _stats(df, _num(column))
    if n < 2:
        raise InsufficientData(2, n)
    return _t_test(m - mu, math.sqrt(v / n), n - 1)


def ttest_paired(df: DataFrame, before: str, after: str) -> Test:
    return ttest_one(df.select((_num(before) - _num(after)).alias("d")), "d")


def group_stats(df: DataFrame, column: str, group: str) -> list[tuple]:
    """(group, n, mean, sample variance) by rising group; as many rows as groups."""
    rows = df.groupBy(group).agg(F.count(_num(column)), F.avg(_num(column)), F.var_samp(_num(column))).orderBy(group).collect()
    return [tuple(r) for r in rows]


def ttest_two(df: DataFrame, column: str, group: str) -> Test:
    """Welch's test of the first group against the second."""
    g = group_stats(df, column, group)
    if len(g) != 2:
        raise InvalidInput("a two-sample test needs two groups")
    (_, n1, m1, v1), (_, n2, m2, v2) = g
    a, b = v1 / n1, v2 / n2
    return _t_test(m1 - m2, math.sqrt(a + b), (a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1)))


@dataclass
class Anova:
    f: float
    p_value: float
    df_between: int
    df_within: int
    ss_between: float
    ss_within: float


def anova(df: DataFrame, column: str, group: str) -> Anova:
    g = group_stats(df, column, group)
    if len(g) < 2 or min(r[1] for r in g) < 2:
        raise InvalidInput("anova needs two groups of two values")
    n = sum(r[1] for r in g)
    mean = sum(r[1] * r[2] for r in g) / n
    between, within = sum(r[1] * (r[2] - mean) ** 2 for r in g), sum((r[1] - 1) * r[3] for r in g)
    d1, d2 = len(g) - 1, n - len(g)
    f = between / d1 / (within / d2)
    return Anova(f, dist.f_sf(f, d1, d2), d1, d2, between, within)


def anova_two_way(df: DataFrame, y: str, a: str, b: str, kind: int = 1) -> dict[str, tuple[float, int, float, float]]:
    """(sum of squares, df, F, p) of a, b, a:b and residual, from the table of cells; sums
    of type 1 or 2 with interaction."""
    rows = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(_num(y)).alias("n"), F.sum(_num(y)).alias("s"), F.sum(_num(y) ** 2).alias("q")).collect()
    la, lb = sorted({r["a"] for r in rows}), sorted({r["b"] for r in rows})
    n, s, q = (np.array([float(r[c]) for r in rows]) for c in "nsq")
    total = q.sum()

    def rss(use_a: bool, use_b: bool, cross_: bool) -> float:
        columns = [np.ones(len(rows))]
        if use_a:
            columns += [np.array([float(r["a"] == v) for r in rows]) for v in la[1:]]
        if use_b:
            columns += [np.array([float(r["b"] == v) for r in rows]) for v in lb[1:]]
        if cross_:
            columns += [np.array([float(r["a"] == u and r["b"] == v) for r in rows]) for u in la[1:] for v in lb[1:]]
        x = np.stack(columns, 1)
        g = x.T @ (n[:, None] * x)
        beta = np.linalg.lstsq(g, x.T @ s, rcond=None)[0]
        return float(total - beta @ (x.T @ s))

    r0, ra, rb, rab, full = rss(False, False, False), rss(True, False, False), rss(False, True, False), rss(True, True, False), rss(True, True, True)
    dof = int(n.sum()) - len(rows)
    parts = {a: ((r0 - ra) if kind == 1 else (rb - rab), len(la) - 1), b: (ra - rab, len(lb) - 1), f"{a}:{b}": (rab - full, (len(la) - 1) * (len(lb) - 1))}
    error = full / dof
    out = {k: (ss, d, ss / d / error, dist.f_sf(ss / d / error, d, dof)) for k, (ss, d) in parts.items()}
    return out | {"residual": (full, dof, math.nan, math.nan)}


def tukey_hsd(df: DataFrame, column: str, group: str, alpha: float = 0.05) -> list[tuple]:
    """(a, b, difference a - b, se, q, p, lower, upper, reject) for each pair of groups."""
    g = group_stats(df, column, group)
    k, n = len(g), sum(r[1] for r in g)
    error = sum((r[1] - 1) * r[3] for r in g) / (n - k)
    crit = dist.studentized_range_critical_value(alpha, k, n - k)
    out = []
    for i in range(k):
        for j in range(i + 1, k):
            gap = g[i][2] - g[j][2]
            se = math.sqrt(error / 2 * (1 / g[i][1] + 1 / g[j][1]))
            q = abs(gap) / se
            p = dist.studentized_range_p_value(q, k, n - k)
            out.append((g[i][0], g[j][0], gap, se, q, p, gap - crit * se, gap + crit * se, p < alpha))
    return out


# ---------------------------------------------------------------- several p-values


def adjust_p(df: DataFrame, column: str, method: str = "holm", alpha: float = 0.05) -> DataFrame:
    """``df`` with p_adjusted and reject (strictly below alpha). Distinct p-values are
    ranked by counts; running extremes go over that table, range by range."""
    if method not in ("bonferroni", "holm", "bh", "by"):
        raise InvalidInput(f"unknown method {method!r}")
    p = _num(column)
    n = int(sums(df, [F.lit(1)])[0])
    if method == "bonferroni":
        new = F.least(p * n, F.lit(1.0))
        return df.withColumns({"p_adjusted": new, "reject": new < alpha})
    counts = df.groupBy(p.alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.withColumn("__p", range_of(counts, "__v"))
    counts = running(counts, {"__before": ("sum", F.col("__n"))}, "__v", own=False, part="__p")
    if method == "holm":
        made = running(counts, {"__a": ("max", F.col("__v") * (n - F.col("__before")))}, "__v", part="__p")
    else:
        factor = sum(1 / i for i in range(1, n + 1)) if method == "by" else 1.0
        made = running(counts, {"__a": ("min", F.col("__v") * n * factor / (F.col("__before") + F.col("__n")))}, "__v", reverse=True, part="__p")
    table = made.select("__v", F.least("__a", F.lit(1.0)).alias("p_adjusted"))
    return df.join(table, p == F.col("__v")).drop("__v").withColumn("reject", F.col("p_adjusted") < alpha)


# ---------------------------------------------------------------- counts


def chi2_goodness(df: DataFrame, category: str, expected: dict | None = None, count: str | None = None) -> Test:
    """Observed counts (of rows, or the sums of ``count``) against expected ones."""
    rows = df.groupBy(category).agg((F.sum(count) if count else F.count(F.lit(1))).cast("double")).collect()
    seen = {r[0]: r[1] for r in rows}
    n = sum(seen.values())
    want = expected or {k: n / len(seen) for k in seen}
    stat = sum((seen.get(k, 0.0) - e) ** 2 / e for k, e in want.items())
    return Test(stat, dist.chi2_sf(stat, len(want) - 1), len(want) - 1)


def chi2_independence(df: DataFrame, a: str, b: str, count: str | None = None) -> Test:
    """Pearson's test without a continuity correction. Empty cells need no row: with
    margins r and c, chi² = n (sum of o²/(r c) - 1)."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg((F.sum(count) if count else F.count(F.lit(1))).cast("double").alias("o"))
    r = cells.groupBy("a").agg(F.sum("o").alias("r"))
    c = cells.groupBy("b").agg(F.sum("o").alias("c"))
    n, share = sums(cells.join(r, "a").join(c, "b"), [F.col("o"), F.col("o") ** 2 / (F.col("r") * F.col("c"))])
    rows, columns = r.count(), c.count()
    stat, dof = n * (share - 1), (rows - 1) * (columns - 1)
    return Test(stat, dist.chi2_sf(stat, dof), dof)


# ---------------------------------------------------------------- ranks


def _rank_sums(rows: DataFrame, value: str, group: str) -> tuple[list[tuple], float]:
    """((group, rows, rank sum) by rising group, sum of t³ - t over the ties) of the rows
    with a value; as many figures as groups."""
    by = rank_table(rows.filter(F.col(value).isNotNull()), value, (group,)).groupBy(group)
    found = by.agg(F.sum("n"), F.sum(F.col("n") * F.col("rank")), F.sum(F.col("n") * (F.col("ties") * F.col("ties") - 1))).collect()
    return sorted(((r[0], r[1], r[2]) for r in found), key=lambda r: (r[0] is not None, r[0])), sum(r[3] for r in found)


def mann_whitney(df: DataFrame, column: str, group: str) -> Test:
    """U of the first group; tie-corrected normal approximation with continuity."""
    g, ties = _rank_sums(df.select(F.col(group).alias("g"), _num(column).alias("v")), "v", "g")
    if len(g) != 2:
        raise InvalidInput("two groups are needed")
    n1, n2 = g[0][1], g[1][1]
    n = n1 + n2
    u = g[0][2] - n1 * (n1 + 1) / 2
    sd = math.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
    z = max(abs(u - n1 * n2 / 2) - 0.5, 0.0) / sd if sd > 0 else 0.0
    return Test(u, min(1.0, dist.two_sided_normal(z)))


def kruskal_wallis(df: DataFrame, column: str, group: str) -> Test:
    g, ties = _rank_sums(df.select(F.col(group).alias("g"), _num(column).alias("v")), "v", "g")
    n = sum(r[1] for r in g)
    h = 12 / (n * (n + 1)) * sum(r[2] ** 2 / r[1] for r in g) - 3 * (n + 1)
    h /= 1 - ties / (n**3 - n)
    return Test(h, dist.chi2_sf(h, len(g) - 1), len(g) - 1)


def wilcoxon(df: DataFrame, a: str, b: str) -> Test:
    """Signed ranks: zeros fall away, ties share ranks, continuity of one half."""
    rows = df.select((_num(a) - _num(b)).alias("d")).filter("d <> 0").select(F.abs("d").alias("m"), (F.col("d") > 0).alias("up"))
    g, ties = _rank_sums(rows, "m", "up")
    if not g:
        raise InsufficientData(1, 0)
    total = {up: s for up, _, s in g}
    n, w = sum(r[1] for r in g), min(total.get(True, 0.0), total.get(False, 0.0))
    mean, sd = n * (n + 1) / 4, math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    z = max(abs(w - mean) - 0.5, 0) / sd
    return Test(w, min(1.0, dist.two_sided_normal(z)))


def sign_test(df: DataFrame, a: str, b: str) -> tuple[int, int, int, float]:
    """(positives, negatives, zeros, exact two-sided p)."""
    d = _num(a) - _num(b)
    up, down, none = (int(v) for v in sums(df, [(d > 0).cast("int"), (d < 0).cast("int"), (d == 0).cast("int")]))
    n, k = up + down, min(up, down)
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
    return up, down, none, min(1.0, 2 * sum(map(math.exp, logs)))


# ---------------------------------------------------------------- distributions


def _kolmogorov(x: float) -> float:
    if x < 1e-3:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * x * x) for j in range(1, 101))))


def _ks_statistic(df: DataFrame, column: str, mean: float, sd: float) -> float:
    counts = cumulative(df.select(_num(column).alias("__v")).groupBy("__v").agg(F.count(F.lit(1)).alias("__n")))
    n = float(sums(counts, [F.col("__n")])[0])
    f = norm_cdf_column((F.col("__v") - mean) / sd)
    return float(counts.agg(F.max(F.greatest((F.col("__before") + F.col("__n")) / n - f, f - F.col("__before") / n))).first()[0])


def ks_one(df: DataFrame, column: str, mean: float | None = None, sd: float | None = None) -> Test:
    """Against a normal distribution; mean and deviation are estimated where not given."""
    n, m, v = _stats(df, _num(column))
    d = _ks_statistic(df, column, m if mean is None else mean, math.sqrt(v) if sd is None else sd)
    root = math.sqrt(n)
    return Test(d, _kolmogorov((root + 0.12 + 0.11 / root) * d))


def ks_two(df: DataFrame, column: str, group: str, compat: bool = False) -> Test:
    """Two samples. ``compat`` takes n, not n/2, as the effective size of equal samples."""
    rows = df.select(_num(column).alias("__v"), F.col(group).alias("g"))
    names = [r["g"] for r in rows.select("g").distinct().orderBy("g").limit(3).collect()]
    if len(names) != 2:
        raise InvalidInput("two groups are needed")
    by = rows.groupBy("__v").agg(F.count_if(F.col("g") == names[0]).alias("a"), F.count_if(F.col("g") == names[1]).alias("b"))
    n1, n2 = sums(by, [F.col("a"), F.col("b")])
    # sum of signed steps: F_a - F_b after each value
    steps = cumulative(by.withColumn("__n", F.col("a") / n1 - F.col("b") / n2))
    d = float(steps.agg(F.max(F.abs(F.col("__before") + F.col("__n")))).first()[0])
    n = n1 if compat and n1 == n2 else n1 * n2 / (n1 + n2)
    root = math.sqrt(n)
    return Test(d, _kolmogorov((root + 0.12 + 0.11 / root) * d))


def lilliefors(df: DataFrame, column: str) -> Test:
    """KS distance with estimated parameters; p by Dallal and Wilkinson, for p to 0.2."""
    n, m, v = _stats(df, _num(column))
    d = _ks_statistic(df, column, m, math.sqrt(v))
    e, k = (d * (n / 100) ** 0.49, 100) if n > 100 else (d, n)
    p = math.exp(-7.01256 * e * e * (k + 2.78019) + 2.99587 * e * math.sqrt(k + 2.78019) - 0.122119 + 0.974598 / math.sqrt(k) + 1.67997 / k)
    return Test(d, min(max(p, 0.0), 0.2))


def anderson_darling(df: DataFrame, column: str) -> Test:
    """Normality; the statistic is corrected for estimated parameters (Stephens)."""
    n, m, v = _stats(df, _num(column))
    if n < 8:
        raise InsufficientData(8, n)
    counts = cumulative(df.select(_num(column).alias("__v")).filter("__v is not null").groupBy("__v").agg(F.count(F.lit(1)).cast("double").alias("__n")))
    z = (F.col("__v") - m) / math.sqrt(v)
    low, high = F.log(F.greatest(norm_cdf_column(z), F.lit(1e-300))), F.log(F.greatest(norm_cdf_column(-z), F.lit(1e-300)))
    # sum (2i-1) [ln F(x_i) + ln(1 - F(x_{n+1-i}))], the second sum taken by its own index;
    # equal values take their places together: sums of 2i-1 are differences of squares
    least, most = F.col("__before"), F.col("__before") + F.col("__n")
    (total,) = sums(counts, [(most * most - least * least) * low + ((n - least) * (n - least) - (n - most) * (n - most)) * high])
    a = -n - total / n
    s = a * (1 + 0.75 / n + 2.25 / n**2)
    if s >= 13:
        p = 0.0
    elif s >= 0.6:
        p = math.exp(1.2937 - 5.709 * s + 0.0186 * s * s)
    elif s >= 0.34:
        p = math.exp(0.9177 - 4.279 * s - 1.38 * s * s)
    elif s >= 0.2:
        p = 1 - math.exp(-8.318 + 42.796 * s - 59.938 * s * s)
    else:
        p = 1 - math.exp(-13.436 + 101.14 * s - 223.73 * s * s)
    return Test(a, min(max(p, 0.0), 1.0), estimate=s)


def shapiro_wilk(df: DataFrame, column: str) -> Test:
    """W for 3 to 5000 values (the test's own range, so the values fit the driver); weights
    from Blom's scores with Royston's corrections for the two largest."""
    x = np.array([r[0] for r in df.select(_num(column).alias("v")).filter("v is not null").orderBy("v").limit(5001).collect()])
    return _shapiro(x)


def shapiro_wilk_dealt(df: DataFrame, column: str, key: str, size: int = 2500) -> DataFrame:
    """W of each of the groups (part, n, statistic, p_value) that all rows with a value are
    dealt to by a hash of ``key``: as many as give about ``size`` values each, within the
    test's range. A sample as wide as the table has no W of its own."""
    rows = df.select(F.col(key).alias("key"), _num(column).alias("v")).filter("v is not null")
    parts = max(1, round(rows.count() / size))

    def each(part, values):
        import pandas as pd

        t = _shapiro(np.sort(values["v"].to_numpy()))
        return pd.DataFrame({"part": [part[0]], "n": [len(values)], "statistic": [t.statistic], "p_value": [t.p_value]})

    dealt = rows.select(F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part"), "v")
    return dealt.groupBy("part").applyInPandas(each, "part long, n long, statistic double, p_value double")


def _shapiro(x: np.ndarray) -> Test:
    """W of sorted values."""
    n = len(x)
    if not 3 <= n <= 5000:
        raise InvalidInput("the test takes 3 to 5000 values")
    m = np.array([dist.norm_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    total = float(m @ m)
    u, a = 1 / math.sqrt(n), m / math.sqrt(total)
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    elif n > 5:
        last = np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, a[-1]], u)
        before = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, a[-2]], u)
        phi = (total - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * before**2)
        a = m / math.sqrt(phi)
        a[-1], a[-2], a[0], a[1] = last, before, -last, -before
    w = min(1.0, float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum()))
    if n == 3:
        p = max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    elif n <= 11:
        g = -2.273 + 0.459 * n
        y = -math.log(max(g - math.log1p(-w), 1e-12))
        mean, sd = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
        p = dist.norm_sf((y - mean) / sd)
    else:
        k = math.log(n)
        mean, sd = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], k), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], k))
        p = dist.norm_sf((math.log1p(-w) - mean) / sd)
    return Test(w, float(p))
