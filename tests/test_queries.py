"""Registered queries return every row of their tables: numpy on a small lineitem and events."""

import numpy as np
import pandas as pd
import pytest

from statloom import queries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = np.random.default_rng(9)
    n = 900
    qty, folder = r.integers(1, 51, n).astype(float), str(tmp_path_factory.mktemp("tables"))
    lines = pd.DataFrame({"l_orderkey": np.arange(n) // 3 * 5 + 1, "l_linenumber": np.arange(n) % 3 + 1, "l_suppkey": r.integers(1, 12, n), "l_quantity": qty, "l_extendedprice": 900 * qty * (1 + r.random(n)), "l_discount": r.integers(0, 11, n) / 100, "l_tax": r.integers(0, 9, n) / 100, "l_returnflag": r.choice(list("ANR"), n), "l_linestatus": r.choice(list("FO"), n)})
    spark.createDataFrame(lines).write.parquet(f"{folder}/lineitem.parquet")
    m = 7000
    events = pd.DataFrame({"event_id": np.arange(m), "value": np.concatenate([r.normal(50, 9, 1000), r.exponential(50, m - 1000)]), "user_id": r.integers(1, 90, m), "event_type": r.choice(list("abc"), m)})
    spark.createDataFrame(events).write.parquet(f"{folder}/events.parquet")
    lines["pos"], lines["price"] = lines["l_orderkey"] * 8 + lines["l_linenumber"], lines["l_extendedprice"] / 1000
    return folder, lines.sort_values("pos").reset_index(drop=True), events


def fitted(lines):
    x = np.column_stack([np.ones(len(lines)), lines["l_quantity"]])
    return x, x @ np.linalg.lstsq(x, lines["price"], rcond=None)[0]


def test_influence_of_every_row(spark, tables):
    folder, lines, _ = tables
    got = queries.queries()["ols_influence"](spark, folder).toPandas().sort_values("pos")
    assert got["pos"].tolist() == lines["pos"].tolist()
    x, fit = fitted(lines)
    h, e = np.einsum("ij,jk,ik->i", x, np.linalg.inv(x.T @ x), x), lines["price"] - fit
    assert got["leverage"].to_numpy() == pytest.approx(h, abs=1e-8)
    assert got["studentized"].to_numpy() == pytest.approx((e / np.sqrt(e @ e / (len(e) - 2) * (1 - h))).to_numpy(), abs=1e-5)


def test_prediction_of_every_row(spark, tables):
    folder, lines, _ = tables
    got = queries.queries()["predict"](spark, folder).toPandas().sort_values("pos")
    assert got["pos"].tolist() == lines["pos"].tolist()
    assert got["prediction"].to_numpy() == pytest.approx(fitted(lines)[1], abs=1e-5)


def test_imputation_of_every_row(spark, tables):
    folder, lines, _ = tables
    got = queries.queries()["impute_mean"](spark, folder).toPandas().sort_values("pos")
    price = lines["price"].where(lines["l_linenumber"] != 2)
    assert got["pos"].tolist() == lines["pos"].tolist() and price.isna().sum() == 300
    assert got["price"].to_numpy() == pytest.approx(price.fillna(price.mean()).to_numpy(), abs=1e-5)


def test_normality_of_every_row(spark, tables):
    folder, _, events = tables
    got = queries.queries()["normality_tests"](spark, folder).first()
    assert got["shapiro_n"] == len(events) and got["shapiro_groups"] == 3
    # the first 1000 ids are normal, the whole column is not
    assert got["shapiro_least"] <= got["shapiro"] < 0.93


def test_iterative_queries_run_with_defaults(spark, tables, monkeypatch):
    folder, calls = tables[0], {}
    for module, name in ((queries.li, "quantile"), (queries.gl, "negative_binomial"), (queries.gl, "zip_poisson"), (queries.pa, "fixed_effects"), (queries.pa, "mixed"), (queries.pa, "mice_impute"), (queries.ds, "bootstrap_mean")):

        def kept(*args, _name=name, **options):
            calls[_name] = (len(args), options)
            raise InterruptedError

        monkeypatch.setattr(module, name, kept)
    for query in ("quantile_regression", "negative_binomial", "zero_inflated_poisson", "panel_two_way", "mixed_model", "impute_chained", "bootstrap_mean"):
        with pytest.raises(InterruptedError):
            queries.queries()[query](spark, folder)
    assert len(calls) == 7 and not any({"max_iter", "tol"} & set(options) for _, options in calls.values())
    assert calls["mice_impute"][0] == 2 and calls["bootstrap_mean"][0] == 2


def test_fits_tell_whether_they_settled(spark, tables):
    lines = queries.lines(spark, tables[0])
    for fit in (lambda **o: queries.pa.fixed_effects(lines, "price ~ qty", entity="supp", time="line", **o), lambda **o: queries.pa.mixed(lines, "price ~ qty", "supp", **o)):
        assert not fit(max_iter=1).converged and fit().converged
    assert {r["converged"] for r in queries.queries()["panel_two_way"](spark, tables[0]).collect()} == {True}
