"""Iterative estimators against numpy and against their own estimating equations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statloom.operators import glm, linear, panel, timeseries
from statloom.plans import gram


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(12)
    n = 300
    x, z = r.normal(size=n), r.normal(size=n)
    y = 1 + 2 * x - z + r.standard_t(3, size=n)
    s, u = np.zeros(n), r.normal(size=n)
    for t in range(1, n):
        s[t] = 0.6 * s[t - 1] + 0.4 * u[t - 1] + r.normal()
    level = np.digitize(0.8 * x + r.logistic(size=n), [-1, 0.5]).astype(float)
    return pd.DataFrame({"t": np.arange(n), "x": x, "z": z, "y": y, "s": s, "u": u, "level": level, "c": r.poisson(np.exp(0.5 + 0.4 * x)), "g": np.arange(n) % 20, "k": r.choice(list("ab"), n)})


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data).repartition(3).cache()


def matrix(data, *names):
    return np.column_stack([np.ones(len(data)), *[data[c] for c in names]])


def lag(v, k):
    return np.concatenate([np.full(k, np.nan), v[:-k]])


def fitted(x, y):
    keep = ~np.isnan(x).any(1) & ~np.isnan(y)
    x, y = x[keep], y[keep]
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    e = y - x @ b
    return b, e, np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * (e @ e) / (len(y) - x.shape[1]))


@pytest.mark.parametrize("q", [0.25, 0.5])
def test_quantile(df, data, q):
    m = linear.quantile(df, "y ~ x + z", q)
    x, e = matrix(data, "x", "z"), data["y"].to_numpy() - matrix(data, "x", "z") @ m.coef
    # the check loss cannot fall in any direction: its subgradient holds zero
    loss = lambda b: float(np.sum((d := data["y"].to_numpy() - x @ b) * (q - (d < 0))))
    for step in np.vstack([np.eye(3), -np.eye(3), np.ones((1, 3))]) * 1e-3:
        assert loss(m.coef + step) >= loss(m.coef) - 1e-4
    assert m.converged and abs(np.mean(e < 0) - q) < 0.02


def test_huber(df, data):
    m = linear.robust(df, "y ~ x + z")
    x = matrix(data, "x", "z")
    e = data["y"].to_numpy() - x @ m.coef
    scale = np.median(np.abs(e)) / 0.6745
    assert m.scale == pytest.approx(scale, rel=1e-5)
    assert x.T @ np.clip(e / scale, -1.345, 1.345) == pytest.approx(np.zeros(3), abs=1e-3)


@pytest.mark.parametrize("near", [None, (0.4, 0.6), (5.0, 6.0)])
def test_percentiles(spark, near):
    """Exact with ties, gaps and a guess that misses; no hash table of all values."""
    v = np.round(np.random.default_rng(3).exponential(size=20_000), 3)
    rows = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    q = [0.5] if near else [0.0, 0.001, 0.37, 0.5, 0.999, 1.0]
    assert gram.percentiles(rows, F.col("v"), q, near) == pytest.approx(list(np.quantile(v, q)), abs=1e-12)


def test_quantile_by_bands(spark, monkeypatch):
    """A band of few rows gives what all rows give, in few passes over them."""
    rng = np.random.default_rng(4)
    x = rng.integers(1, 50, 3000).astype(float)
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, 3 + 0.1 * x + rng.standard_t(3, 3000), strict=True)], "x double, y double").cache()
    whole = linear.quantile(rows, "y ~ x", 0.3)
    calls = []
    monkeypatch.setattr(linear, "NEAR", 900)
    monkeypatch.setattr(linear, "cross", lambda *a, **k: calls.append(1) or gram.cross(*a, **k))
    m = linear.quantile(rows, "y ~ x", 0.3)
    assert m.converged and whole.converged and len(calls) < 20
    assert m.coef == pytest.approx(whole.coef, abs=1e-5)


def test_recursive(df, data):
    got = linear.recursive_ols(df, "y", ["x"], "t").orderBy("ord").toPandas()
    x, y = matrix(data, "x"), data["y"].to_numpy()
    for t in (5, 50, 299):
        b = np.linalg.lstsq(x[: t + 1], y[: t + 1], rcond=None)[0]
        assert got.loc[t, ["const", "x"]].to_numpy(float) == pytest.approx(b, abs=1e-8)
        before = np.linalg.lstsq(x[:t], y[:t], rcond=None)[0]
        f = 1 + x[t] @ np.linalg.inv(x[:t].T @ x[:t]) @ x[t]
        assert got.loc[t, "recursive_resid"] == pytest.approx((y[t] - x[t] @ before) / np.sqrt(f), abs=1e-7)


def test_granger_and_adf(df, data):
    s, u = data["s"].to_numpy(), data["u"].to_numpy()
    one = np.column_stack([np.ones(len(s)), lag(s, 1), lag(s, 2)])
    _, e1, _ = fitted(np.column_stack([one, lag(u, 2)])[:, :3], s)
    _, e2, _ = fitted(np.column_stack([one, lag(u, 1), lag(u, 2)]), s)
    f, p = timeseries.granger(df, "s", "u", "t", 2)
    assert f == pytest.approx((e1 @ e1 - e2 @ e2) / 2 / (e2 @ e2 / (len(e2) - 5))) and p < 1e-6
    d = np.concatenate([[np.nan], np.diff(s)])
    b, _, se = fitted(np.column_stack([np.ones(len(s)), lag(s, 1), lag(d, 1)])[2:], d[2:])
    got = timeseries.adf(df, "s", "t", 1).statistic
    assert got == pytest.approx(b[1] / se[1], rel=0.02) and got < -5


def test_var(df, data):
    m = timeseries.var(df, ["s", "u"], "t", 1)
    x = np.column_stack([np.ones(len(data)), lag(data["s"].to_numpy(), 1), lag(data["u"].to_numpy(), 1)])
    want = np.stack([fitted(x, data[c].to_numpy(float))[0] for c in ("s", "u")])
    assert m.coef == pytest.approx(want, abs=1e-9)
    last = np.array([1.0, data["s"].iloc[-1], data["u"].iloc[-1]])
    assert m.forecast(1)[0] == pytest.approx(want @ last)


def test_gam_scores_new_rows(spark, df, data):
    m = linear.gam(df, "y", [linear.Spline("x", (-0.5, 0.5), 2)], ("z",), penalty=1.0)
    new = spark.createDataFrame([(0.7, 1.0, "p"), (-2.0, 0.0, "q")], "x double, z double, name string")
    got = {r["name"]: r["prediction"] for r in m.predict(new).collect()}
    for x, z, name in ((0.7, 1.0, "p"), (-2.0, 0.0, "q")):
        assert got[name] == pytest.approx(m.coef @ [1, x, x * x, max(x + 0.5, 0) ** 2, max(x - 0.5, 0) ** 2, z])


def test_class_models_score_new_rows(spark, df, data):
    new = spark.createDataFrame([(1, 0.3, "a"), (2, -1.0, "b")], "id long, x double, k string")
    m = glm.ordered_logit(df, "level ~ x")
    rows = {r["id"]: r for r in m.predict_proba(new).collect()}
    below = 1 / (1 + np.exp(-(m.cuts - m.coef[0] * 0.3)))
    assert rows[1]["probabilities"] == pytest.approx(np.diff([0, *below, 1])) and set(new.columns) < set(rows[1].asDict())
    assert rows[1]["predicted_class"] == int(np.argmax(rows[1]["probabilities"]))
    m = glm.multinomial(df, "level ~ x + C(k)")
    rows = {r["id"]: r for r in m.predict_proba(new).collect()}
    eta = np.concatenate([[0], m.coef @ [1, -1.0, 1.0]])
    assert rows[2]["probabilities"] == pytest.approx(np.exp(eta) / np.exp(eta).sum())
    assert m.predict_proba().count() == len(data)


def test_gee_independence_equals_glm(df, data):
    one, many = glm.poisson(df, "c ~ x"), glm.gee(df, "c ~ x", "g", "poisson", "independence")
    assert many.coef == pytest.approx(one.coef, abs=1e-6)


def test_two_way_panel(df, data):
    rows = df.withColumns({"e": F.col("t") % 15, "w": F.floor(F.col("t") / 15)})
    x = data[["x", "y"]].to_numpy()
    e, w = data["t"].to_numpy() % 15, data["t"].to_numpy() // 15
    centred = x - pd.DataFrame(x).groupby(e).transform("mean").to_numpy() - pd.DataFrame(x).groupby(w).transform("mean").to_numpy() + x.mean(0)
    m = panel.fixed_effects(rows, "y ~ x", entity="e", time="w")
    assert m.coef[0] == pytest.approx(centred[:, 0] @ centred[:, 1] / (centred[:, 0] @ centred[:, 0]), abs=1e-7)
