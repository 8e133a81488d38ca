"""Orders over whole tables: exact against numpy, twice, over many ranges."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statloom.operators import descriptive, hypothesis, survival, timeseries
from statloom.plans import formula, order

N = 600_000


@pytest.fixture(scope="module")
def rows(spark):
    """N distinct order values in no order, ties in ``v``."""
    d = spark.range(N).select(F.xxhash64("id").alias("o"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(250_000)).cast("double").alias("v"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1000)).cast("double").alias("u"))
    return d.cache()


@pytest.fixture(scope="module")
def local(rows):
    return rows.toPandas().sort_values("o").reset_index(drop=True)


@pytest.mark.parametrize("time", [1, 2])
def test_positions(rows, local, time):
    got = order.numbered(rows, "o", "i").agg(F.count_distinct("i"), F.min("i"), F.max("i"), F.sum(F.col("i") * F.col("u"))).first()
    assert tuple(got) == (N, 1, N, float((np.arange(1, N + 1) * local["u"]).sum()))


@pytest.mark.parametrize("time", [1, 2])
def test_midranks_and_spearman(rows, local, time):
    want = local["v"].rank()
    got = descriptive.midranks(rows, "v").agg(F.sum("rank"), F.max("rank"), F.sum(F.col("rank") * F.col("u"))).first()
    assert tuple(got) == pytest.approx((want.sum(), want.max(), (want * local["u"]).sum()), rel=1e-14)
    assert descriptive.spearman(rows, "v", "u") == pytest.approx(np.corrcoef(want, local["u"].rank())[0, 1], abs=1e-10)


@pytest.mark.parametrize("time", [1, 2])
def test_acf(rows, local, time):
    e = local["v"].to_numpy() - local["v"].mean()
    assert timeseries.acf(rows, "v", "o", 3) == pytest.approx([(e[k:] * e[: N - k]).sum() / (e * e).sum() for k in range(4)], abs=1e-10)


def test_running_both_ways(rows, local):
    many = rows.select("o", "u")
    for reverse in (False, True):
        for own in (False, True):
            x = local["u"][::-1] if reverse else local["u"]
            sums, most = x.cumsum() - (0 if own else x), (x.cummax() if own else x.cummax().shift())
            got = order.running(many, {"s": ("sum", F.col("u")), "m": ("max", F.col("u"))}, "o", reverse, own).agg(F.sum(F.col("s") * F.col("u")), F.sum(F.col("m") * F.col("u"))).first()
            assert tuple(got) == pytest.approx(((sums * x).sum(), (most * x).sum()), rel=1e-12)


def test_many_bounds_are_searched(spark, monkeypatch):
    """The search in an array literal gives what the compiled choice gives."""
    monkeypatch.setattr(order, "RANGE_ROWS", 20)
    d = spark.range(20_000).select(F.when(F.col("id") % 50 != 0, F.xxhash64("id")).alias("o"))
    got = order.numbered(d, "o", "i").filter("o is not null").orderBy("o").select("i").toPandas()["i"]
    assert got.tolist() == list(range(401, 20_001))
    text = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("s"))
    ids = formula.group_ids(text, "s").orderBy("s").select("group_id").toPandas()["group_id"]
    assert ids.tolist() == list(range(20_000))


def test_ends(spark):
    empty = spark.createDataFrame([], "o long, v double")
    assert order.numbered(empty, "o").count() == 0 and order.running(empty, {"s": ("sum", F.col("v"))}, "o").count() == 0
    nulls = spark.createDataFrame([(None, 1.0), (2, float("nan")), (1, None)], "o long, v double")
    assert [r["rn"] for r in order.numbered(nulls, "o").orderBy("rn").collect()] == [1, 2, 3]


def test_life_table_of_many_times(rows, local):
    got = survival.life_table(rows.withColumn("e", F.lit(1)), "o", "e").agg(F.max("at_risk"), F.sum("at_risk"), F.sum("d")).first()
    assert tuple(got) == (N, N * (N + 1) / 2, N)


def test_survival_steps(spark, rows):
    some = rows.limit(1).union(rows.filter("u < 3")).withColumns({"t": F.pmod("o", F.lit(5000)).cast("double"), "e": (F.col("u") < 2).cast("int")}).cache()
    curve, p = survival.kaplan_meier(some, "t", "e"), some.toPandas()
    at, alive, s = np.unique(p["t"]), 1.0, {}
    for t in at:
        alive *= 1 - ((p["t"] == t) & (p["e"] == 1)).sum() / (p["t"] >= t).sum()
        s[t] = alive
    got = survival.survival_lookup(curve, some.select("t"), "t").toPandas()
    assert got["survival"].to_numpy() == pytest.approx([s[t] for t in got["t"]])
    steps = curve.orderBy("time").toPandas()
    before = np.concatenate([[1.0], steps["survival"][:-1]])
    assert survival.km_summary(curve)["rmst"] == pytest.approx(float((np.diff(np.concatenate([[0.0], steps["time"]])) * before).sum()))


def test_rank_tests(rows, local):
    some = rows.withColumn("g", (F.col("u") < 400).cast("int"))
    r, first = local["v"].rank(), local["u"] >= 400
    u = r[first].sum() - first.sum() * (first.sum() + 1) / 2
    assert hypothesis.mann_whitney(some, "v", "g").statistic == pytest.approx(u)
    d = local["v"] - 250 * local["u"]
    w = d[d != 0].abs().rank()
    assert hypothesis.wilcoxon(rows.withColumn("w", 250 * F.col("u")), "v", "w").statistic == pytest.approx(min(w[d[d != 0] > 0].sum(), w[d[d != 0] < 0].sum()))
    ps = spark_p(rows)
    holm = hypothesis.adjust_p(ps, "p", "holm").agg(F.sum("p_adjusted")).first()[0]
    p = np.sort(local["v"].to_numpy() / 1e12)
    assert holm == pytest.approx(np.minimum(1, np.maximum.accumulate(p * (N - pd.Series(p).rank(method="min").to_numpy() + 1))).sum())


def spark_p(rows):
    return rows.select((F.col("v") / 1e12).alias("p"))
