"""Estimators against numpy on small seeded data, and distributions against known values."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statloom.functions import dist
from statloom.operators import descriptive, glm, hypothesis, linear, panel, power, smoothing, statespace, survival, timeseries
from statloom.operators.base import hac, norm_cdf_column
from statloom.operators.plot import Plot
from statloom.plans import formula, order


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(5)
    n = 240
    x1, x2 = r.normal(size=n), r.normal(size=n)
    y = 1 + 2 * x1 - x2 + r.normal(size=n)
    p = 1 / (1 + np.exp(-(0.3 + 0.8 * x1)))
    return pd.DataFrame({"t": np.arange(n), "x1": x1, "x2": x2, "y": y, "b": (r.random(n) < p).astype(float), "c": r.poisson(np.exp(0.4 + 0.5 * x1)).astype(float), "pos": r.gamma(2, np.exp(0.5 + 0.3 * x1)), "g": r.choice(list("abc"), n), "e": np.arange(n) % 12, "w": r.random(n) + 0.5, "event": (r.random(n) < 0.7).astype(int), "time": np.ceil(r.exponential(10, n))})


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data).repartition(4).cache()


def design(data, *names):
    return np.column_stack([np.ones(len(data)), *[data[c] for c in names]])


def test_distributions():
    assert dist.norm_cdf(1.96) == pytest.approx(0.9750021048517795)
    assert dist.two_sided_t(2.0, 10) == pytest.approx(0.07338803477074)
    assert dist.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05)
    assert dist.f_sf(4.0, 2, 10) == pytest.approx(0.0529221494014)
    assert dist.t_ppf(0.975, 10) == pytest.approx(2.2281388519649385)
    assert dist.beta_cdf(0.3, 2, 3) == pytest.approx(0.3483)
    assert dist.digamma(1.0) == pytest.approx(-0.5772156649015329)
    assert dist.studentized_range_critical_value(0.05, 3, 20) == pytest.approx(3.5779, abs=1e-3)
    assert dist.noncentral_t_cdf(1.0, 10, 0.0) == pytest.approx(dist.t_cdf(1.0, 10), abs=1e-8)
    assert dist.noncentral_f_cdf(2.0, 2, 10, 0.0) == pytest.approx(dist.f_cdf(2.0, 2, 10), abs=1e-10)


def test_normal_cdf_column(spark):
    x = [-38.0, -9.0, -5.0, -2.5, -0.6, 0.0, 0.1, 0.66, 1.0, 4.0, 6.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(norm_cdf_column(F.col("x"))).collect()]
    assert got == pytest.approx([dist.norm_cdf(v) for v in x], rel=1e-13)


def test_formula():
    f = formula.Formula.parse("y ~ x1 + C(g) + x1*x2 + log(w) - 1")
    assert not f.intercept and f.predictor_names() == ["x1", "C(g)", "x2", "x1:x2", "log(w)"]
    for bad in ("y", "y ~", "y ~ -x", "y ~ f(x)", "1 ~ x"):
        with pytest.raises(formula.InvalidInput):
            formula.Formula.parse(bad)


@pytest.mark.parametrize("kind", ["nonrobust", "hc0", "hc1", "hc2", "hc3"])
def test_ols(df, data, kind):
    m = linear.ols(df, "y ~ x1 + x2", cov=kind)
    x, y = design(data, "x1", "x2"), data["y"].to_numpy()
    inv = np.linalg.inv(x.T @ x)
    b = inv @ x.T @ y
    e, n, k = y - x @ b, len(y), 3
    h = np.einsum("ij,jk,ik->i", x, inv, x)
    scale = {"hc0": 1, "hc1": n / (n - k), "hc2": 1 / (1 - h), "hc3": 1 / (1 - h) ** 2}
    cov = inv * (e @ e) / (n - k) if kind == "nonrobust" else inv @ (x.T * (e**2 * scale[kind])) @ x @ inv
    assert m.coef == pytest.approx(b) and m.se == pytest.approx(np.sqrt(np.diag(cov)))
    assert m.r2 == pytest.approx(1 - e @ e / ((y - y.mean()) ** 2).sum())


def test_ols_hac_and_cluster(df, data):
    x, y = design(data, "x1"), data["y"].to_numpy()
    inv = np.linalg.inv(x.T @ x)
    s = x * (y - x @ (inv @ x.T @ y))[:, None]
    meat = s.T @ s
    for lag in (1, 2, 3):
        part = s[lag:].T @ s[:-lag]
        meat = meat + (1 - lag / 4) * (part + part.T)
    assert linear.ols(df, "y ~ x1", cov=hac(3), order="t").se == pytest.approx(np.sqrt(np.diag(inv @ meat @ inv)))
    g = pd.DataFrame(s).groupby(data["e"]).sum().to_numpy()
    meat = g.T @ g * 12 / 11 * 239 / 238
    assert linear.ols(df, "y ~ x1", cov="cluster", group="e").se == pytest.approx(np.sqrt(np.diag(inv @ meat @ inv)))


def test_wls_categorical_predict(df, data):
    m = linear.ols(df, "y ~ x1 + C(g)", weight="w")
    x = np.column_stack([np.ones(len(data)), data["x1"], data["g"] == "b", data["g"] == "c"]).astype(float)
    w = data["w"].to_numpy()
    b = np.linalg.solve(x.T @ (w[:, None] * x), x.T @ (w * data["y"]))
    assert m.coef == pytest.approx(b) and m.names == ["const", "x1", "g[T.b]", "g[T.c]"]
    got = m.predict(df).orderBy("t").toPandas()
    assert got["prediction"].to_numpy() == pytest.approx(x @ b)
    assert set(df.columns) < set(got.columns)


def test_wide_gram_equals_narrow(spark, monkeypatch, df):
    from statloom.plans import gram

    one = linear.ols(df, "y ~ x1 + x2 + w")
    monkeypatch.setattr(gram, "WIDE", 1)
    assert linear.ols(df, "y ~ x1 + x2 + w").coef == pytest.approx(one.coef)


@pytest.mark.parametrize("parts", range(1, 11))
def test_singular(df, parts):
    rows = df.withColumns({"z": 2 * F.col("x1"), "v": F.col("x1") + 3 * F.col("x2") - 1}).repartition(parts)
    for design_ in ("y ~ x1 + z", "y ~ x1 + x2 + v"):
        with pytest.raises(formula.SingularMatrix):
            linear.ols(rows, design_)


def test_logit_and_poisson(df, data):
    for name, fit in (("b", glm.logistic), ("c", glm.poisson)):
        m = fit(df, f"{name} ~ x1")
        x, y = design(data, "x1"), data[name].to_numpy()
        mu = 1 / (1 + np.exp(-x @ m.coef)) if name == "b" else np.exp(x @ m.coef)
        assert x.T @ (y - mu) == pytest.approx([0, 0], abs=1e-5)
        w = mu * (1 - mu) if name == "b" else mu
        assert m.se == pytest.approx(np.sqrt(np.diag(np.linalg.inv(x.T @ (w[:, None] * x)))), rel=1e-5)


def test_gamma_and_gaussian_family(df, data):
    m = glm.gamma(df, "pos ~ x1", link="log")
    x, y = design(data, "x1"), data["pos"].to_numpy()
    mu = np.exp(x @ m.coef)
    assert x.T @ ((y - mu) / mu) == pytest.approx([0, 0], abs=1e-5)
    assert glm.glm(df, "y ~ x1", "gaussian").coef == pytest.approx(linear.ols(df, "y ~ x1").coef)


def test_probit_score(df, data):
    m = glm.probit(df, "b ~ x1")
    x, y = design(data, "x1"), data["b"].to_numpy()
    eta = x @ m.coef
    p = np.array([dist.norm_cdf(v) for v in eta])
    phi = np.exp(-(eta**2) / 2) / math.sqrt(2 * math.pi)
    assert m.converged and x.T @ ((y - p) * phi / (p * (1 - p))) == pytest.approx([0, 0], abs=1e-5)


def test_penalised(df, data):
    x, y = data[["x1", "x2"]].to_numpy(), data["y"].to_numpy()
    xc, yc, n = x - x.mean(0), y - y.mean(), len(y)
    b = np.linalg.solve(xc.T @ xc + 0.3 * n * np.eye(2), xc.T @ yc)
    assert linear.ridge(df, "y ~ x1 + x2", 0.3).coef[1:] == pytest.approx(b)
    m = linear.lasso(df, "y ~ x1 + x2", 0.2)
    grad = xc.T @ (yc - xc @ m.coef[1:]) / n
    assert np.abs(grad) == pytest.approx([0.2, 0.2], abs=1e-8)


def test_panel(df, data):
    m = panel.fixed_effects(df, "y ~ x1", entity="e")
    d = data[["y", "x1"]] - data.groupby("e")[["y", "x1"]].transform("mean")
    assert m.coef[0] == pytest.approx((d["x1"] @ d["y"]) / (d["x1"] @ d["x1"]))
    assert len(panel.random_effects(df, "y ~ x1", "e").coef) == 2
    two = panel.fixed_effects(df, "y ~ x1", entity="e", time="g")
    x = np.column_stack([data["x1"], pd.get_dummies(data["e"]).to_numpy(float), pd.get_dummies(data["g"]).to_numpy(float)[:, 1:]])
    assert two.coef[0] == pytest.approx(np.linalg.lstsq(x, data["y"], rcond=None)[0][0], rel=1e-6)


def test_hypothesis(df, data):
    a, b = data.loc[data["b"] == 0, "y"], data.loc[data["b"] == 1, "y"]
    t = hypothesis.ttest_two(df, "y", "b")
    assert t.statistic == pytest.approx((a.mean() - b.mean()) / math.sqrt(a.var() / len(a) + b.var() / len(b)))
    u = sum((a.to_numpy()[:, None] > b.to_numpy()[None]).sum(1))
    assert hypothesis.mann_whitney(df, "y", "b").statistic == pytest.approx(u)
    grid = np.sort(data["y"])
    d = max(abs(np.searchsorted(np.sort(a), grid, "right") / len(a) - np.searchsorted(np.sort(b), grid, "right") / len(b)))
    assert hypothesis.ks_two(df, "y", "b").statistic == pytest.approx(d)
    assert 0.9 < hypothesis.shapiro_wilk(df, "y").statistic <= 1


def test_adjust(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.03]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p double")
    holm = [r[0] for r in hypothesis.adjust_p(rows, "p", "holm").orderBy("i").select("p_adjusted").collect()]
    assert holm == pytest.approx([0.04, 0.09, 0.09, 0.025, 0.09])
    bh = [r[0] for r in hypothesis.adjust_p(rows, "p", "bh").orderBy("i").select("p_adjusted").collect()]
    assert bh == pytest.approx([0.025, 0.04, 0.0375, 0.025, 0.0375])


def test_descriptive(df, data):
    r = descriptive.describe(df, "y").first()
    assert r["median"] == pytest.approx(data["y"].median()) and r["std"] == pytest.approx(data["y"].std())
    assert descriptive.spearman(df, "x1", "y") == pytest.approx(data["x1"].rank().corr(data["y"].rank()))


def test_survival(df, data):
    curve = survival.kaplan_meier(df, "time", "event").orderBy("time").toPandas()
    s, expect = 1.0, []
    for t in sorted(data.loc[data["event"] == 1, "time"].unique()):
        n, d = (data["time"] >= t).sum(), ((data["time"] == t) & (data["event"] == 1)).sum()
        s *= 1 - d / n
        expect.append(s)
    assert curve["survival"].to_numpy() == pytest.approx(expect)
    m = survival.cox(df, "time ~ x1", "event")
    assert m.converged
    look = survival.survival_lookup(survival.kaplan_meier(df, "time", "event"), df.select("t", "time"), "time").collect()
    steps = dict(zip(curve["time"], curve["survival"], strict=True))
    for r in look:
        assert r["survival"] == pytest.approx(min([v for k, v in steps.items() if k <= r["time"]], default=1.0))


def test_lags_and_acf(df, data):
    y = data["y"].to_numpy()
    got = order.with_lags(df.select(F.col("t").alias("ord"), "y"), ["y"], [1, 3]).orderBy("ord").toPandas()
    assert got["y_3"].to_numpy()[3:] == pytest.approx(y[:-3]) and got["y_1"].isna().sum() == 1
    c = y - y.mean()
    assert timeseries.acf(df, "y", "t", 2)[2] == pytest.approx(c[2:] @ c[:-2] / (c @ c))


def test_arima_and_kalman():
    r = np.random.default_rng(3)
    e, y = r.normal(size=600), np.zeros(600)
    for t in range(1, 600):
        y[t] = 0.6 * y[t - 1] + e[t]
    css = timeseries.arima_fit(y, timeseries.ArimaSpec(1, 0, 0))
    exact = timeseries.arima_fit(y, timeseries.ArimaSpec(1, 0, 0, method="exact"))
    assert css.ar[0] == pytest.approx(0.6, abs=0.1) and exact.ar[0] == pytest.approx(css.ar[0], abs=0.01)
    f = statespace.arma_model(0.0, [0.6], [], 1.0).filter(y)
    assert f.llf == pytest.approx(-0.5 * (600 * math.log(2 * math.pi) - math.log(1 - 0.36) + y[0] ** 2 * (1 - 0.36) + ((y[1:] - 0.6 * y[:-1]) ** 2).sum()))
    assert timeseries.forecast_standard_errors([0.5], [], 0, [], [], 0, 1, 1.0, 2) == pytest.approx([1.0, math.sqrt(1.25)])


def test_smoothing():
    y = np.array([3.0, 5, 4, 6, 7])
    f = smoothing.simple_smoothing(y, 0.5)
    assert f.fitted == pytest.approx([3, 3, 4, 4, 5])
    t = np.arange(96)
    y = 0.1 * t + np.tile(np.arange(12) - 5.5, 8)
    trend, season, resid, _ = smoothing.stl(y, 12)
    assert np.abs(resid[12:-12]).max() < 0.2 and season.std() > 3 and trend[-13] > trend[12]


def test_power_and_proportions():
    assert power.ttest_ind_power(0.5, 64) == pytest.approx(0.8015, abs=1e-3)
    assert power.solve_ttest_ind_n(0.5, 0.8) == pytest.approx(63.7656, abs=1e-2)
    assert power.proportion_interval(8, 20, method="wilson") == pytest.approx((0.2188, 0.6134), abs=1e-4)
    assert power.proportion_interval(0, 20, method="clopper_pearson")[0] == 0


def test_imputation_pca_manova(spark, df, data):
    rows = df.withColumn("x1", F.when(F.col("t") % 7 != 0, F.col("x1")))
    done = panel.mice_impute(rows.select("t", "x1", "x2", "y"), ["x1", "x2", "y"], 2)
    assert done.filter("x1 is null").count() == 0
    p = panel.pca(df, ["x1", "x2"])
    assert p.variance == pytest.approx(np.linalg.eigvalsh(np.cov(data[["x1", "x2"]].T))[::-1])
    assert 0 < panel.manova(df, ["x1", "y"], "g").wilks <= 1


def test_plot():
    p = Plot("a < b").line([0, 1, 2], [1, 3, 2]).hline(2)
    assert "a &lt; b" in p.to_svg() and p.to_ascii().count("\n") > 10
