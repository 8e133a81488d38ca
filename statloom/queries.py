"""One query for each operator family over the test tables, with SQL where SQL can say it.

Figures are rounded on both sides; iterative fits without a closed form have no SQL, and
tests hold them against numpy or their own estimating equations instead.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.operators import descriptive as ds
from statloom.operators import glm as gl
from statloom.operators import hypothesis as hy
from statloom.operators import linear as li
from statloom.operators import panel as pa
from statloom.operators import power as pw
from statloom.operators import smoothing as sm
from statloom.operators import statespace as st
from statloom.operators import survival as su
from statloom.operators import timeseries as ts
from statloom.plans import formula as fm
from statloom.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def row(spark: SparkSession, **values) -> DataFrame:
    """One row of figures, rounded."""
    kinds = ", ".join(f"{k} {'long' if isinstance(v, int | np.integer) else 'string' if isinstance(v, str) else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(int(v) if isinstance(v, int | np.integer) else v if isinstance(v, str) else round(float(v), 6) for v in values.values())], kinds)


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem with short numeric names."""
    t = read_table(spark, sf, "lineitem")
    return t.select(
        (F.col("l_extendedprice") / 1000).alias("price"), F.col("l_quantity").alias("qty"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("rf"), F.col("l_linestatus").alias("ls"),
        (F.col("l_returnflag") == "R").cast("double").alias("returned"), (F.col("l_quantity") > 25).cast("double").alias("many"), F.col("l_orderkey").alias("okey"), F.col("l_linenumber").cast("double").alias("line"), F.col("l_suppkey").alias("supp"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"),
    )


#: The same projection in SQL.
L = "(SELECT l_extendedprice / 1000 AS price, l_quantity AS qty, l_discount AS disc, l_tax AS tax, l_returnflag AS rf, l_linestatus AS ls, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS returned, CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END AS many, l_orderkey AS okey, CAST(l_linenumber AS DOUBLE) AS line, l_suppkey AS supp, l_orderkey * 8 + l_linenumber AS pos FROM lineitem)"
E = "(SELECT event_id AS i, value AS v, user_id AS u, event_type AS k FROM events)"


def _swept(table: str, columns: list[str], centred: bool = True) -> str:
    """SQL tables s0, s1, ...: each takes its first column's part out of y and of the
    columns after it, so a later column stands free of all earlier ones."""
    first = [f"{c} - avg({c}) OVER () AS {c}" if centred else c for c in ["y", *columns]]
    steps = [f"s0 AS (SELECT {', '.join(first)} FROM {table})"]
    for k, x in enumerate(columns):
        rest = [f"{c} - {x} * (sum({x} * {c}) OVER () / sum({x} * {x}) OVER ()) AS {c}" for c in ["y", *columns[k + 1 :]]]
        steps.append(f"s{k + 1} AS (SELECT {', '.join(rest)} FROM s{k})")
    return ", ".join(steps)


def settled(table: DataFrame, converged: bool) -> DataFrame:
    """Figures of an iterative fit, with whether it settled."""
    return table.withColumn("converged", F.lit(bool(converged)))


def events(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events").select(F.col("event_id").alias("i"), F.col("value").alias("v"), F.col("user_id").alias("u"), F.col("event_type").alias("k"))


# ---------------------------------------------------------------- linear models


@query(f"SELECT round(regr_intercept(price, qty), 6) AS const, round(regr_slope(price, qty), 6) AS qty, round(regr_r2(price, qty), 6) AS r2, count(*) AS n FROM {L}")
def ols_simple(spark, sf):
    m = li.ols(lines(spark, sf), "price ~ qty")
    return row(spark, const=m.coef[0], qty=m.coef[1], r2=m.r2, n=m.n)


@query(f"""WITH c AS (SELECT covar_pop(qty, qty) a, covar_pop(qty, disc) b, covar_pop(disc, disc) d, covar_pop(qty, price) p, covar_pop(disc, price) q, avg(price) my, avg(qty) mx, avg(disc) mz, count(*) n, var_pop(price) vy FROM {L}),
s AS (SELECT *, (d * p - b * q) / (a * d - b * b) AS b1, (a * q - b * p) / (a * d - b * b) AS b2 FROM c)
SELECT round(my - b1 * mx - b2 * mz, 6) AS const, round(b1, 6) AS qty, round(b2, 6) AS disc, round(n * (vy - b1 * p - b2 * q) / (n - 3), 6) AS s2 FROM s""")
def ols_two_regressors(spark, sf):
    m = li.ols(lines(spark, sf), "price ~ qty + disc")
    return row(spark, const=m.coef[0], qty=m.coef[1], disc=m.coef[2], s2=m.s2)


@query(f"""WITH g AS (SELECT rf, avg(price) m FROM {L} GROUP BY rf), b AS (SELECT m FROM g WHERE rf = 'A')
SELECT CASE WHEN rf = 'A' THEN 'const' ELSE 'rf[T.' || rf || ']' END AS term, round(CASE WHEN rf = 'A' THEN g.m ELSE g.m - b.m END, 6) AS coef FROM g, b""")
def ols_categorical(spark, sf):
    m = li.ols(lines(spark, sf), "price ~ C(rf)")
    return spark.createDataFrame([(n, round(float(b), 6)) for n, b in zip(m.names, m.coef, strict=True)], "term string, coef double")


@query(f"""WITH m AS (SELECT *, sum(line * qty) OVER () / sum(line) OVER () mx, sum(line * price) OVER () / sum(line) OVER () my FROM {L})
SELECT round(sum(line * (qty - mx) * (price - my)) / sum(line * (qty - mx) * (qty - mx)), 6) AS qty, round(max(my) - max(mx) * sum(line * (qty - mx) * (price - my)) / sum(line * (qty - mx) * (qty - mx)), 6) AS const FROM m""")
def wls(spark, sf):
    m = li.ols(lines(spark, sf), "price ~ qty", weight="line")
    return row(spark, qty=m.coef[1], const=m.coef[0])


_RESID = f"WITH f AS (SELECT regr_slope(price, qty) b, regr_intercept(price, qty) a, avg(qty) mx, regr_sxx(price, qty) sxx, count(*) n FROM {L}), r AS (SELECT t.*, price - a - b * qty AS e, qty - mx AS xc, sxx, n, 1.0 / n + (qty - mx) * (qty - mx) / sxx AS h FROM {L} t, f)"


@query(f"""{_RESID} SELECT round(sqrt(sum(e * e) / (max(n) - 2) / max(sxx)), 6) AS nonrobust, round(sqrt(sum(xc * xc * e * e)) / max(sxx), 6) AS hc0, round(sqrt(sum(xc * xc * e * e) * max(n) / (max(n) - 2)) / max(sxx), 6) AS hc1,
round(sqrt(sum(xc * xc * e * e / (1 - h))) / max(sxx), 6) AS hc2, round(sqrt(sum(xc * xc * e * e / ((1 - h) * (1 - h)))) / max(sxx), 6) AS hc3 FROM r""")
def ols_robust_errors(spark, sf):
    d = lines(spark, sf)
    return row(spark, **{c: li.ols(d, "price ~ qty", cov=c).se[1] for c in ("nonrobust", "hc0", "hc1", "hc2", "hc3")})


@query(f"""{_RESID}, g AS (SELECT supp, sum(xc * e) s, max(n) n, max(sxx) sxx FROM r GROUP BY supp)
SELECT round(sqrt(sum(s * s) * count(*) / (count(*) - 1.0) * (max(n) - 1.0) / (max(n) - 2.0)) / max(sxx), 6) AS se FROM g""")
def ols_cluster_errors(spark, sf):
    return row(spark, se=li.ols(lines(spark, sf), "price ~ qty", cov="cluster", group="supp").se[1])


@query(f"""WITH f AS (SELECT regr_slope(v, u) b, regr_intercept(v, u) a, avg(u) mx, regr_sxx(v, u) sxx FROM {E}), r AS (SELECT i, (u - mx) * (v - a - b * u) AS s, sxx FROM {E}, f),
o AS (SELECT s, lag(s, 1) OVER (ORDER BY i) AS s1, lag(s, 2) OVER (ORDER BY i) AS s2, sxx FROM r)
SELECT round(sqrt(sum(s * s) + 2 * (2.0 / 3) * sum(s * s1) + 2 * (1.0 / 3) * sum(s * s2)) / max(sxx), 6) AS se FROM o""")
def ols_hac_errors(spark, sf):
    from statloom.operators.base import hac

    return row(spark, se=li.ols(events(spark, sf), "v ~ u", cov=hac(2), order="i").se[1])


@query(f"{_RESID} SELECT pos, round(h, 9) AS leverage, round(e / sqrt((1 - h) * s2), 6) AS studentized FROM r, (SELECT sum(e * e) / (max(n) - 2) AS s2 FROM r)")
def ols_influence(spark, sf):
    m = li.ols(lines(spark, sf), "price ~ qty", order="pos")
    return li.influence(m).select(F.col("ord").alias("pos"), F.round("leverage", 9).alias("leverage"), F.round("studentized", 6).alias("studentized"))


@query(f"""WITH f AS (SELECT regr_slope(v, i) b, regr_intercept(v, i) a FROM {E}), r AS (SELECT v - a - b * i AS e, lag(v - a - b * i) OVER (ORDER BY i) AS p FROM {E}, f)
SELECT round(sum((e - p) * (e - p)) / sum(e * e), 6) AS durbin_watson, round(count(*) / 6.0 * (power(avg(e * e * e) / power(avg(e * e), 1.5), 2) + power(avg(e * e * e * e) / power(avg(e * e), 2) - 3, 2) / 4), 3) AS jarque_bera FROM r""")
def ols_diagnostics(spark, sf):
    out = li.residual_diagnostics(li.ols(events(spark, sf), "v ~ i", order="i"))
    return row(spark, durbin_watson=out["durbin_watson"], jarque_bera=round(out["jarque_bera"], 3))


@query(f"SELECT round(regr_sxy(price, qty) / (regr_sxx(price, qty) + 0.5 * count(*)), 6) AS qty FROM {L}")
def ridge(spark, sf):
    return row(spark, qty=li.ridge(lines(spark, sf), "price ~ qty", 0.5).coef[1])


@query(f"SELECT round(sign(regr_sxy(price, qty)) * greatest(abs(regr_sxy(price, qty) / count(*)) - 0.5, 0) / (regr_sxx(price, qty) / count(*)), 6) AS qty FROM {L}")
def lasso(spark, sf):
    return row(spark, qty=li.lasso(lines(spark, sf), "price ~ qty", 0.5).coef[1])


@query(f"SELECT round(sign(regr_sxy(price, qty)) * greatest(abs(regr_sxy(price, qty) / count(*)) - 0.25, 0) / (regr_sxx(price, qty) / count(*) + 0.25), 6) AS qty FROM {L}")
def elastic_net(spark, sf):
    return row(spark, qty=li.elastic_net(lines(spark, sf), "price ~ qty", 0.5, 0.5).coef[1])


@query(f"SELECT round(covar_pop(line, price) / covar_pop(line, qty), 4) AS qty FROM {L}")
def iv_2sls(spark, sf):
    return row(spark, qty=round(li.iv2sls(lines(spark, sf), "price", ["qty"], ["line"]).coef[1], 4))


@query(f"""WITH w AS (SELECT i, regr_slope(v, u) OVER o AS slope, regr_intercept(v, u) OVER o AS const, count(*) OVER o AS c FROM {E} WINDOW o AS (ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
SELECT i, round(const, 5) AS const, round(slope, 5) AS slope FROM w WHERE c = 50""")
def rolling_ols(spark, sf):
    r = li.rolling_ols(events(spark, sf), "v ~ u", "i", 50)
    return r.select(F.col("ord").alias("i"), F.round("const", 5).alias("const"), F.round("u", 5).alias("slope"))


@query(f"""WITH w AS (SELECT k, i, v, u, regr_slope(v, u) OVER n AS slope, regr_intercept(v, u) OVER n AS const, count(*) OVER p AS c, regr_slope(v, u) OVER p AS b, regr_intercept(v, u) OVER p AS a, avg(u) OVER p AS m, regr_sxx(v, u) OVER p AS s, count(*) OVER (PARTITION BY k) AS total FROM {E}
WINDOW n AS (PARTITION BY k ORDER BY i), p AS (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, (v - a - b * u) / sqrt(1 + 1.0 / c + (u - m) * (u - m) / s) AS e FROM w WHERE c >= 2)
SELECT k AS key, i AS ord, round(const, 3) + 0.0 AS const, round(slope, 3) + 0.0 AS u, round(e, 3) + 0.0 AS recursive_resid, round(sum(e) OVER (PARTITION BY k ORDER BY i) / stddev_samp(e) OVER (PARTITION BY k), 3) + 0.0 AS cusum, round(0.948 * sqrt(total - 2), 3) AS bound FROM r""")
def recursive_ols(spark, sf):
    t = li.recursive_ols(events(spark, sf), "v", ["u"], "i", key="k").filter("recursive_resid is not null and not isnan(recursive_resid)")
    return t.select("key", "ord", *[(F.round(c, 3) + 0.0).alias(c) for c in ("const", "u", "recursive_resid", "cusum", "bound")])


@query()
def quantile_regression(spark, sf):
    m = li.quantile(lines(spark, sf), "price ~ qty", 0.5)
    return settled(m.coef_table(spark), m.converged)


@query()
def robust_regression(spark, sf):
    return li.robust(lines(spark, sf), "price ~ qty", tol=1e-6).coef_table(spark)


@query()
def fgls_ar1(spark, sf):
    return li.fgls(events(spark, sf), "v ~ u", "i").coef_table(spark)


@query()
def gam_gcv(spark, sf):
    m = li.gam(lines(spark, sf), "price", [li.Spline("qty", (10.0, 25.0, 40.0), 2)], penalty="gcv")
    return row(spark, edf=m.edf, gcv=m.gcv)


# ---------------------------------------------------------------- GLMs (closed forms with one binary regressor)

_BY = f"SELECT many, avg(returned) p, avg(price) m, avg(line) c, count(*) n FROM {L} GROUP BY many"
_PAIR = f"WITH g AS ({_BY}), a AS (SELECT * FROM g WHERE many = 0), b AS (SELECT * FROM g WHERE many = 1)"


@query(f"{_PAIR} SELECT round(ln(a.p / (1 - a.p)), 6) AS const, round(ln(b.p / (1 - b.p)) - ln(a.p / (1 - a.p)), 6) AS many, round(sqrt(1 / (a.n * a.p * (1 - a.p)) + 1 / (b.n * b.p * (1 - b.p))), 6) AS se FROM a, b")
def logistic(spark, sf):
    m = gl.logistic(lines(spark, sf), "returned ~ many")
    return row(spark, const=m.coef[0], many=m.coef[1], se=m.se[1])


@query(f"{_PAIR} SELECT round(ln(a.c), 6) AS const, round(ln(b.c / a.c), 6) AS many, round(sqrt(1 / (a.n * a.c) + 1 / (b.n * b.c)), 6) AS se FROM a, b")
def poisson(spark, sf):
    m = gl.poisson(lines(spark, sf), "line ~ many")
    return row(spark, const=m.coef[0], many=m.coef[1], se=m.se[1])


@query(f"{_PAIR} SELECT round(1 / a.m, 9) AS const, round(1 / b.m - 1 / a.m, 9) AS many FROM a, b")
def gamma_inverse(spark, sf):
    m = gl.gamma(lines(spark, sf), "price ~ many")
    return spark.createDataFrame([(round(float(m.coef[0]), 9), round(float(m.coef[1]), 9))], "const double, many double")


@query(f"{_PAIR} SELECT round(ln(a.m), 6) AS const, round(ln(b.m / a.m), 6) AS many FROM a, b")
def inverse_gaussian(spark, sf):
    m = gl.inverse_gaussian(lines(spark, sf), "price ~ many")
    return row(spark, const=m.coef[0], many=m.coef[1])


@query(f"{_PAIR} SELECT round(ln(a.m), 6) AS const, round(ln(b.m / a.m), 6) AS many FROM a, b")
def gamma_log(spark, sf):
    m = gl.glm(lines(spark, sf), "price ~ many", "gamma", "log")
    return row(spark, const=m.coef[0], many=m.coef[1])


@query(f"WITH g AS ({_BY}) SELECT many, round(p, 6) AS p FROM g")
def probit_fit(spark, sf):
    d = lines(spark, sf)
    m = gl.probit(d, "returned ~ many")
    return m.predict(d.select("many").distinct().withColumn("returned", F.lit(0.0)), "p").select("many", F.round("p", 6).alias("p"))


@query(f"WITH g AS (SELECT many, rf, count(*) c, sum(count(*)) OVER (PARTITION BY many) n FROM {L} GROUP BY many, rf) SELECT many, rf, round(c / n, 5) AS p FROM g")
def multinomial_logit(spark, sf):
    d = lines(spark, sf).withColumn("code", F.when(F.col("rf") == "A", 0).when(F.col("rf") == "N", 1).otherwise(2))
    m = gl.multinomial(d, "code ~ many")
    fit = m.predict_proba().select(F.col("x0").alias("many"), F.col("probabilities").alias("q")).groupBy("many").agg(F.first("q").alias("q"))
    return fit.select("many", F.posexplode("q").alias("k", "p")).select("many", F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), F.col("k") + 1).alias("rf"), F.round("p", 5).alias("p"))


@query()
def ordered_logit(spark, sf):
    d = lines(spark, sf).withColumn("code", F.when(F.col("qty") < 15, 0).when(F.col("qty") < 35, 1).otherwise(2))
    m = gl.ordered_logit(d, "code ~ disc")
    return spark.createDataFrame([(n, float(b)) for n, b in [*zip(m.names, m.coef, strict=True), *((f"cut{k}", c) for k, c in enumerate(m.cuts))]], "term string, coef double")


@query()
def negative_binomial(spark, sf):
    m = gl.negative_binomial(events(spark, sf).withColumn("c", F.floor(F.col("v") / 20)), "c ~ u")
    return settled(m.coef_table(spark), m.converged)


@query()
def zero_inflated_poisson(spark, sf):
    m = gl.zip_poisson(events(spark, sf).withColumn("c", F.floor(F.col("v") / 30)).withColumn("w", F.col("u") / 100), "c ~ w")
    return settled(m.count.coef_table(spark).unionByName(m.inflation.coef_table(spark)), m.converged)


@query()
def gee_exchangeable(spark, sf):
    return gl.gee(lines(spark, sf), "returned ~ qty", "supp", "binomial", "exchangeable").coef_table(spark)


@query(f"WITH g AS ({_BY}) SELECT round(sum(n * abs(p * (1 - p))) / sum(n) * (SELECT ln(b.p / (1 - b.p)) - ln(a.p / (1 - a.p)) FROM g a, g b WHERE a.many = 0 AND b.many = 1), 6) AS effect FROM g")
def marginal_effects(spark, sf):
    return row(spark, effect=gl.average_marginal_effects(gl.logistic(lines(spark, sf), "returned ~ many"))[0][1])


# ---------------------------------------------------------------- panel, treatment, imputation, multivariate


@query(f"WITH m AS (SELECT price - avg(price) OVER (PARTITION BY supp) y, qty - avg(qty) OVER (PARTITION BY supp) x FROM {L}) SELECT round(sum(x * y) / sum(x * x), 6) AS qty FROM m")
def panel_fixed_effects(spark, sf):
    return row(spark, qty=pa.fixed_effects(lines(spark, sf), "price ~ qty", entity="supp").coef[0])


@query()
def panel_two_way(spark, sf):
    m = pa.fixed_effects(lines(spark, sf), "price ~ qty", entity="supp", time="line")
    return settled(m.coef_table(spark), m.converged)


#: Swamy-Arora by closed forms; ``plain`` is the within variance with the absorbed means uncounted.
_RE = f"""WITH l AS (SELECT supp, price, qty, avg(price) OVER w AS pm, avg(qty) OVER w AS qm, count(*) OVER w AS m FROM {L} WINDOW w AS (PARTITION BY supp)),
h AS (SELECT regr_sxy(price - pm, qty - qm) / regr_sxx(price - pm, qty - qm) AS fe, regr_sxx(price - pm, qty - qm) AS sxx, regr_syy(price - pm, qty - qm) AS syy, count(*) AS n, count(DISTINCT supp) AS g FROM l),
b AS (SELECT regr_syy(p, q) - power(regr_sxy(p, q), 2) / regr_sxx(p, q) AS ssr, avg(1.0 / m) AS inverse FROM (SELECT avg(price) AS p, avg(qty) AS q, count(*) AS m FROM {L} GROUP BY supp)),
v AS (SELECT fe, sxx, n, (syy - fe * fe * sxx) / (n - 1 - g) AS se, (syy - fe * fe * sxx) / (n - 1) AS plain, greatest(ssr / (g - 2) - (syy - fe * fe * sxx) / (n - 1 - g) * inverse, 0) AS su FROM h, b),
t AS (SELECT *, 1 - sqrt(se / (m * su + se)) AS theta FROM l, v), r AS (SELECT *, 1 - theta AS c, qty - theta * qm AS q, price - theta * pm AS p FROM t),
s AS (SELECT sum(c * c) AS cc, sum(c * q) AS cq, sum(q * q) AS qq, sum(c * p) AS cp, sum(q * p) AS qp, sum(p * p) AS pp, any_value(fe) AS fe, any_value(sxx) AS sxx, any_value(se) AS se, any_value(plain) AS plain, any_value(su) AS su, count(*) AS n FROM r),
o AS (SELECT *, (cp * qq - qp * cq) / (cc * qq - cq * cq) AS a, (qp * cc - cp * cq) / (cc * qq - cq * cq) AS b FROM s)
"""
_RE_VARIANCE = "(pp - a * cp - b * qp) / (n - 2) * cc / (cc * qq - cq * cq)"


@query(f"{_RE} SELECT round(a, 6) AS const, round(b, 6) AS qty, round(se, 6) AS sigma2_e, round(su, 6) AS sigma2_u, round(greatest(power(fe - b, 2) / (plain / sxx - {_RE_VARIANCE} + 1e-14), 0), 6) AS hausman FROM o")
def panel_random_effects(spark, sf):
    d = lines(spark, sf)
    re, fe = pa.random_effects(d, "price ~ qty", "supp"), pa.fixed_effects(d, "price ~ qty", entity="supp")
    h = pa.hausman(fe, re)
    return row(spark, const=re.coef[0], qty=re.coef[1], sigma2_e=re.sigma2_e, sigma2_u=re.sigma2_u, hausman=h.statistic)


@query(f"{_RE} SELECT round(greatest(power(fe - b, 2) / (se / sxx - {_RE_VARIANCE} + 1e-14), 0), 6) AS statistic, CAST(1 AS BIGINT) AS df FROM o")
def hausman_within_df(spark, sf):
    d = lines(spark, sf)
    h = pa.hausman(pa.fixed_effects(d, "price ~ qty", entity="supp", within_df=True), pa.random_effects(d, "price ~ qty", "supp"))
    return row(spark, statistic=h.statistic, df=h.df)


@query()
def mixed_model(spark, sf):
    m = pa.mixed(lines(spark, sf), "price ~ qty", "supp")
    return settled(m.coef_table(spark), m.converged)


@query(f"""WITH g AS (SELECT many, avg(price) m, var_samp(price) v FROM {L} GROUP BY many), a AS (SELECT * FROM g WHERE many = 1), b AS (SELECT * FROM g WHERE many = 0)
SELECT 'price' AS variable, round(a.m, 6) AS treated, round(b.m, 6) AS control, round((a.m - b.m) / sqrt((a.v + b.v) / 2), 6) AS smd FROM a, b""")
def treatment_balance(spark, sf):
    return pa.balance(lines(spark, sf), "many", ["price"]).select("variable", *[F.round(c, 6).alias(c) for c in ("treated", "control", "smd")])


@query(f"""WITH c AS (SELECT returned, many, avg(price) y, count(*) n FROM {L} GROUP BY ALL), s AS (SELECT returned, sum(n) t FROM c GROUP BY returned),
p AS (SELECT c.*, t, (SELECT sum(n) FROM c) AS total FROM c JOIN s USING (returned))
SELECT round(sum(CASE WHEN many = 1 THEN y * t END) / max(total) - sum(CASE WHEN many = 0 THEN y * t END) / max(total), 6) AS ate FROM p""")
def treatment_ipw(spark, sf):
    return row(spark, ate=pa.ipw(lines(spark, sf), "many", "price", ["returned"]).ate)


@query(f"SELECT pos, round(coalesce(CASE WHEN line = 2 THEN NULL ELSE price END, (SELECT avg(price) FROM {L} WHERE line <> 2)), 6) AS price FROM {L}")
def impute_mean(spark, sf):
    d = lines(spark, sf).select("pos", F.when(F.col("line") != 2, F.col("price")).alias("price"))
    return pa.mean_impute(d, ["price"]).select("pos", F.round("price", 6).alias("price"))


@query()
def impute_chained(spark, sf):
    d = lines(spark, sf).select("pos", F.when(F.col("line") != 2, F.col("price")).alias("price"), "qty", F.when(F.col("line") != 3, F.col("disc")).alias("disc"))
    return pa.mice_impute(d, ["price", "qty", "disc"])


@query(f"WITH c AS (SELECT var_samp(qty) a, covar_samp(qty, price) b, var_samp(price) d FROM {L}), e AS (SELECT (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b) l1, (a + d) / 2 - sqrt((a - d) * (a - d) / 4 + b * b) l2 FROM c) SELECT round(l1, 5) AS first, round(l2, 5) AS second FROM e")
def pca(spark, sf):
    v = pa.pca(lines(spark, sf), ["qty", "price"]).variance
    return row(spark, first=round(v[0], 5), second=round(v[1], 5))


@query()
def manova(spark, sf):
    m = pa.manova(lines(spark, sf), ["price", "qty"], "rf")
    return row(spark, wilks=m.wilks, f=m.f, p=m.p_value)


# ---------------------------------------------------------------- descriptive, correlation, contingency


@query(f"""WITH m AS (SELECT rf, price, avg(price) OVER (PARTITION BY rf) a FROM {L})
SELECT rf, count(*) AS n, round(avg(price), 6) AS mean, round(stddev_samp(price), 6) AS std, round(quantile_cont(price, 0.25), 6) AS q1, round(median(price), 6) AS median, round(quantile_cont(price, 0.75), 6) AS q3,
round(avg(power(price - a, 3)) / power(avg(power(price - a, 2)), 1.5), 6) AS skewness, round(avg(power(price - a, 4)) / power(avg(power(price - a, 2)), 2) - 3, 6) AS kurtosis FROM m GROUP BY rf""")
def describe(spark, sf):
    t = ds.describe(lines(spark, sf), "price", ["rf"])
    return t.select("rf", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "q1", "median", "q3", "skewness", "kurtosis")])


@query(f"""WITH r AS (SELECT rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0 AS a, rank() OVER (ORDER BY qty) + (count(*) OVER (PARTITION BY qty) - 1) / 2.0 AS b FROM {L})
SELECT round((SELECT corr(price, qty) FROM {L}), 6) AS pearson, round(corr(a, b), 6) AS spearman FROM r""")
def correlation(spark, sf):
    d = lines(spark, sf)
    return row(spark, pearson=ds.pearson(d, "price", "qty"), spearman=ds.spearman(d, "price", "qty"))


@query(f"SELECT 'price' AS a, 'qty' AS b, round(corr(price, qty), 6) AS r FROM {L} UNION ALL SELECT 'price', 'disc', round(corr(price, disc), 6) FROM {L} UNION ALL SELECT 'qty', 'disc', round(corr(qty, disc), 6) FROM {L}")
def correlation_matrix(spark, sf):
    m = ds.correlation_frame(lines(spark, sf), ["price", "qty", "disc"])
    return m.filter("(a = 'price' and b <> 'price') or (a = 'qty' and b = 'disc')").select("a", "b", F.round("r", 6).alias("r"))


_CELLS = f"WITH c AS (SELECT CAST(count(*) FILTER (many = 1 AND returned = 1) AS DOUBLE) a, CAST(count(*) FILTER (many = 1 AND returned = 0) AS DOUBLE) b, CAST(count(*) FILTER (many = 0 AND returned = 1) AS DOUBLE) c, CAST(count(*) FILTER (many = 0 AND returned = 0) AS DOUBLE) d FROM {L})"


@query(f"{_CELLS} SELECT round(a * d / (b * c), 6) AS odds_ratio, round(a / (a + b) / (c / (c + d)), 6) AS risk_ratio, round(a / (a + b) - c / (c + d), 6) AS risk_difference, round(power(greatest(abs(b - c), 1) - 1, 2) / (b + c), 5) AS mcnemar FROM c")
def contingency_2x2(spark, sf):
    t = ds.counts_2x2(lines(spark, sf), F.col("many") == 1, F.col("returned") == 1)
    x = ds.table2x2(t)
    return row(spark, odds_ratio=x.odds_ratio, risk_ratio=x.risk_ratio, risk_difference=x.risk_difference, mcnemar=round(ds.mcnemar(t)[0], 5))


@query(f"""WITH s AS (SELECT supp, CAST(count(*) FILTER (many = 1 AND returned = 1) AS DOUBLE) a, CAST(count(*) FILTER (many = 1 AND returned = 0) AS DOUBLE) b, CAST(count(*) FILTER (many = 0 AND returned = 1) AS DOUBLE) c, CAST(count(*) FILTER (many = 0 AND returned = 0) AS DOUBLE) d, CAST(count(*) AS DOUBLE) n FROM {L} GROUP BY supp HAVING count(*) > 1)
SELECT round(power(sum(a) - sum((a + b) * (a + c) / n), 2) / sum((a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))), 6) AS statistic, round(sum(a * d / n) / sum(b * c / n), 6) AS odds_ratio FROM s""")
def mantel_haenszel(spark, sf):
    s, _, o = ds.mantel_haenszel(lines(spark, sf), "supp", F.col("many") == 1, F.col("returned") == 1)
    return row(spark, statistic=s, odds_ratio=o)


@query(f"WITH p AS (SELECT price AS y, 2 * qty AS p FROM {L}) SELECT round(avg(abs(y - p)), 6) AS mae, round(avg((y - p) * (y - p)), 5) AS mse, round(avg(abs((y - p) / y)) FILTER (y <> 0), 6) AS mape FROM p")
def regression_metrics(spark, sf):
    m = ds.regression_metrics(lines(spark, sf).withColumn("guess", 2 * F.col("qty")), "price", "guess")
    return row(spark, mae=m["mae"], mse=round(m["mse"], 5), mape=m["mape"])


@query(f"SELECT count(*) FILTER (qty / 50 >= 0.5 AND returned = 1) AS tp, count(*) FILTER (qty / 50 >= 0.5 AND returned = 0) AS fp, count(*) FILTER (qty / 50 < 0.5 AND returned = 0) AS tn, count(*) FILTER (qty / 50 < 0.5 AND returned = 1) AS fn FROM {L}")
def confusion_matrix(spark, sf):
    return row(spark, **ds.confusion(lines(spark, sf).withColumn("p", F.col("qty") / 50), "returned", "p"))


@query(f"SELECT round(1 / (1 - corr(price, qty) * corr(price, qty)), 6) AS price, round(1 / (1 - corr(price, qty) * corr(price, qty)), 6) AS qty FROM {L}")
def variance_inflation(spark, sf):
    return row(spark, **ds.variance_inflation(lines(spark, sf), ["price", "qty"]))


@query(f"{_RESID} SELECT round(count(*) * regr_r2(e * e, qty), 5) AS statistic FROM r")
def breusch_pagan(spark, sf):
    return row(spark, statistic=round(ds.breusch_pagan(li.ols(lines(spark, sf), "price ~ qty"))[0], 5))


@query(f"""WITH l AS (SELECT price AS y, qty, disc FROM {L}), {_swept("l", ["qty", "disc"])},
d AS (SELECT price, qty - avg(qty) OVER () AS q, disc - avg(disc) OVER () AS x FROM {L}), c AS (SELECT (sum(q * price) * sum(x * x) - sum(x * price) * sum(q * x)) / (sum(q * q) * sum(x * x) - sum(q * x) * sum(q * x)) AS b, (sum(x * price) * sum(q * q) - sum(q * price) * sum(q * x)) / (sum(q * q) * sum(x * x) - sum(q * x) * sum(q * x)) AS g, avg(price) AS m FROM d),
f AS (SELECT price, q, x, m + b * q + g * x AS fit FROM d, c), z AS (SELECT price AS y, q, x, (fit - avg(fit) OVER ()) / stddev_pop(fit) OVER () AS z FROM f), z3 AS (SELECT y, q, x, z * z AS p2, z * z * z AS p3 FROM z),
wide AS (WITH {_swept("z3", ["q", "x", "p2", "p3"])} SELECT sum(y * y) AS ssr, count(*) AS n FROM s4),
e AS (SELECT power(price - fit, 2) AS y, q, x, q * q AS qq, q * x AS qx, x * x AS xx FROM f), white AS (WITH {_swept("e", ["q", "x", "qq", "qx", "xx"])} SELECT sum(y * y) AS ssr FROM s5)
SELECT round((SELECT count(*) * (1 - any_value(white.ssr) / (var_pop(y) * count(*))) FROM e, white), 6) AS white, round((SELECT (sum(y * y) / any_value(wide.ssr) - 1) * (any_value(wide.n) - 5) / 2 FROM s2, wide), 6) AS reset""")
def specification_tests(spark, sf):
    m = li.ols(lines(spark, sf), "price ~ qty + disc")
    return row(spark, white=ds.white_test(m)[0], reset=ds.reset_test(m)[0])


@query()
def bootstrap_mean(spark, sf):
    m, lo, hi = ds.bootstrap_mean(events(spark, sf), "v")
    return row(spark, mean=m, lower=lo, upper=hi)


# ---------------------------------------------------------------- hypothesis tests

_G = f"SELECT many AS g, count(*) n, avg(price) m, var_samp(price) v FROM {L} GROUP BY many"


@query(f"WITH g AS ({_G}), a AS (SELECT * FROM g WHERE g = 0), b AS (SELECT * FROM g WHERE g = 1) SELECT round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 5) AS t, round(power(a.v / a.n + b.v / b.n, 2) / (power(a.v / a.n, 2) / (a.n - 1) + power(b.v / b.n, 2) / (b.n - 1)), 4) AS df FROM a, b")
def ttest_welch(spark, sf):
    t = hy.ttest_two(lines(spark, sf), "price", "many")
    return row(spark, t=round(t.statistic, 5), df=round(t.df, 4))


@query(f"SELECT round((avg(price) - 50) / sqrt(var_samp(price) / count(*)), 5) AS one, round((SELECT avg(price - qty) / sqrt(var_samp(price - qty) / count(*)) FROM {L}), 4) AS paired FROM {L}")
def ttest_one_paired(spark, sf):
    d = lines(spark, sf)
    return row(spark, one=round(hy.ttest_one(d, "price", 50.0).statistic, 5), paired=round(hy.ttest_paired(d, "price", "qty").statistic, 4))


@query(f"WITH m AS (SELECT rf, price, avg(price) OVER () a, avg(price) OVER (PARTITION BY rf) b FROM {L}) SELECT round(sum((b - a) * (b - a)) / (count(DISTINCT rf) - 1) / (sum((price - b) * (price - b)) / (count(*) - count(DISTINCT rf))), 6) AS f FROM m")
def anova_one_way(spark, sf):
    return row(spark, f=hy.anova(lines(spark, sf), "price", "rf").f)


@query(f"""WITH d AS (SELECT price y, rf, ls, CASE WHEN ls = 'O' THEN 1.0 ELSE 0.0 END AS o FROM {L}),
m AS (SELECT y - avg(y) OVER (PARTITION BY rf) AS ya, o - avg(o) OVER (PARTITION BY rf) AS oa, y - avg(y) OVER (PARTITION BY ls) AS yb, y - avg(y) OVER (PARTITION BY rf, ls) AS yc FROM d),
s AS (SELECT sum(ya * ya) AS ra, sum(yb * yb) AS rb, sum(ya * ya) - sum(ya * oa) * sum(ya * oa) / sum(oa * oa) AS rab, sum(yc * yc) AS cells, count(*) AS n FROM m),
c AS (SELECT count(*) AS k, count(DISTINCT rf) AS a, count(DISTINCT ls) AS b FROM (SELECT DISTINCT rf, ls FROM d))
SELECT 'rf' AS term, round(rb - rab, 3) AS ss, CAST(a - 1 AS INTEGER) AS df FROM s, c UNION ALL SELECT 'ls', round(ra - rab, 3), CAST(b - 1 AS INTEGER) FROM s, c
UNION ALL SELECT 'rf:ls', round(rab - cells, 3), CAST((a - 1) * (b - 1) AS INTEGER) FROM s, c UNION ALL SELECT 'residual', round(cells, 3), CAST(n - k AS INTEGER) FROM s, c""")
def anova_two_way(spark, sf):
    t = hy.anova_two_way(lines(spark, sf), "price", "rf", "ls", 2)
    return spark.createDataFrame([(k, round(float(v[0]), 3), int(v[1])) for k, v in t.items()], "term string, ss double, df int")


@query()
def tukey_hsd(spark, sf):
    return spark.createDataFrame([(a, b, float(d), float(p)) for a, b, d, _, _, p, *_ in hy.tukey_hsd(lines(spark, sf), "price", "rf")], "a string, b string, difference double, p double")


_P = f"SELECT supp, (supp % 97 + 0.5) / 100.0 * 0.2 AS p FROM {L} GROUP BY supp"


def _p_values(spark, sf):
    return lines(spark, sf).select("supp").distinct().withColumn("p", (F.col("supp") % 97 + 0.5) / 100.0 * 0.2)


@query(f"WITH p AS ({_P}), r AS (SELECT *, count(*) OVER () n, row_number() OVER (ORDER BY p, supp) i FROM p) SELECT supp, round(least(max(p * (n - i + 1)) OVER (ORDER BY p, supp), 1), 6) AS adjusted FROM (SELECT supp, p, n, min(i) OVER (PARTITION BY p) i FROM r)")
def adjust_holm(spark, sf):
    return hy.adjust_p(_p_values(spark, sf), "p", "holm").select("supp", F.round("p_adjusted", 6).alias("adjusted"))


@query(f"WITH p AS ({_P}), r AS (SELECT *, count(*) OVER () n, count(*) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) i FROM p) SELECT supp, round(least(min(p * n / i) OVER (ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 6) AS adjusted FROM r")
def adjust_fdr(spark, sf):
    return hy.adjust_p(_p_values(spark, sf), "p", "bh").select("supp", F.round("p_adjusted", 6).alias("adjusted"))


@query(f"WITH p AS ({_P}), r AS (SELECT *, count(*) OVER () n, count(*) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) i FROM p), h AS (SELECT sum(1.0 / k) AS h FROM (SELECT unnest(range(1, (SELECT max(n) + 1 FROM r))) AS k)) SELECT supp, round(least(min(p * n * h / i) OVER (ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 6) AS adjusted FROM r, h")
def adjust_by(spark, sf):
    return hy.adjust_p(_p_values(spark, sf), "p", "by").select("supp", F.round("p_adjusted", 6).alias("adjusted"))


@query(f"SELECT supp, round(least(p * count(*) OVER (), 1), 6) AS adjusted FROM ({_P})")
def adjust_bonferroni(spark, sf):
    return hy.adjust_p(_p_values(spark, sf), "p", "bonferroni").select("supp", F.round("p_adjusted", 6).alias("adjusted"))


@query(f"WITH o AS (SELECT rf, count(*) o FROM {L} GROUP BY rf) SELECT round(sum(power(o - t / k, 2) / (t / k)), 6) AS statistic FROM o, (SELECT sum(o) t, count(*) k FROM o)")
def chi2_goodness(spark, sf):
    return row(spark, statistic=hy.chi2_goodness(lines(spark, sf), "rf").statistic)


@query(f"WITH c AS (SELECT rf, ls, count(*) o FROM {L} GROUP BY ALL), m AS (SELECT o, sum(o) OVER (PARTITION BY rf) r, sum(o) OVER (PARTITION BY ls) c, sum(o) OVER () n FROM c) SELECT round(sum(power(o - r * c / n, 2) / (r * c / n)), 5) AS statistic FROM m")
def chi2_independence(spark, sf):
    return row(spark, statistic=round(hy.chi2_independence(lines(spark, sf), "rf", "ls").statistic, 5))


_R = f"SELECT many, rf, price, rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0 AS r FROM {L}"


@query(f"WITH r AS ({_R}) SELECT round(sum(r) - count(*) * (count(*) + 1) / 2.0, 1) AS u FROM r WHERE many = 0")
def mann_whitney(spark, sf):
    return row(spark, u=round(hy.mann_whitney(lines(spark, sf), "price", "many").statistic, 1))


@query(f"WITH r AS ({_R}), g AS (SELECT rf, sum(r) s, count(*) m FROM r GROUP BY rf), t AS (SELECT sum(c * c * c - c) t FROM (SELECT CAST(count(*) AS DOUBLE) c FROM r GROUP BY price)), n AS (SELECT CAST(count(*) AS DOUBLE) n FROM r) SELECT round((12 / (n * (n + 1)) * sum(s * s / m) - 3 * (n + 1)) / (1 - max(t) / (n * n * n - n)), 5) AS h FROM g, t, n GROUP BY n")
def kruskal_wallis(spark, sf):
    return row(spark, h=round(hy.kruskal_wallis(lines(spark, sf), "price", "rf").statistic, 5))


@query(f"WITH d AS (SELECT price - 2 * qty AS d FROM {L} WHERE price <> 2 * qty), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM d) SELECT round(least(sum(r) FILTER (d > 0), sum(r) FILTER (d < 0)), 1) AS w, count(*) FILTER (d > 0) AS up, count(*) FILTER (d < 0) AS down FROM r")
def wilcoxon_sign(spark, sf):
    d = lines(spark, sf).withColumn("twice", 2 * F.col("qty"))
    up, down, _, _ = hy.sign_test(d, "price", "twice")
    return row(spark, w=round(hy.wilcoxon(d, "price", "twice").statistic, 1), up=up, down=down)


@query(f"WITH v AS (SELECT price, count(*) FILTER (many = 0) a, count(*) FILTER (many = 1) b FROM {L} GROUP BY price), c AS (SELECT sum(a) OVER (ORDER BY price) / (SELECT sum(a) FROM v) - sum(b) OVER (ORDER BY price) / (SELECT sum(b) FROM v) d FROM v) SELECT round(max(abs(d)), 6) AS d FROM c")
def ks_two_sample(spark, sf):
    return row(spark, d=hy.ks_two(lines(spark, sf), "price", "many").statistic)


@query()
def normality_tests(spark, sf):
    e = events(spark, sf)
    a, k, lf = hy.anderson_darling(e, "v"), hy.ks_one(e, "v"), hy.lilliefors(e, "v")
    # Shapiro-Wilk takes 5000 values at most: all rows, dealt to groups within that range
    w = hy.shapiro_wilk_dealt(e, "v", "i").agg(F.avg("statistic").alias("mean"), F.min("statistic").alias("least"), F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n")).first()
    return row(spark, anderson=a.statistic, ks=k.statistic, lilliefors=lf.statistic, shapiro=w["mean"], shapiro_least=w["least"], shapiro_groups=w["groups"], shapiro_n=w["n"])


@query(f"SELECT many, count(*) FILTER (returned = 1) AS c, count(*) AS n, round((avg(returned) + 1.959963984540054 * 1.959963984540054 / (2 * count(*)) - 1.959963984540054 * sqrt(avg(returned) * (1 - avg(returned)) / count(*) + 1.959963984540054 * 1.959963984540054 / (4.0 * count(*) * count(*)))) / (1 + 1.959963984540054 * 1.959963984540054 / count(*)), 6) AS lower FROM {L} GROUP BY many")
def proportion_wilson(spark, sf):
    t = lines(spark, sf).groupBy("many").agg(F.count_if(F.col("returned") == 1).alias("c"), F.count(F.lit(1)).alias("n"))
    return t.withColumn("lower", F.round(pw.wilson_columns(F.col("c"), F.col("n"))[0], 6))


@query(f"WITH g AS (SELECT avg(returned) FILTER (many = 0) a, avg(returned) FILTER (many = 1) b, avg(returned) p, count(*) FILTER (many = 0) n, count(*) FILTER (many = 1) m FROM {L}) SELECT round((a - b) / sqrt(p * (1 - p) * (1.0 / n + 1.0 / m)), 6) AS z FROM g")
def proportions_ztest(spark, sf):
    return row(spark, z=pw.proportions_ztest_frame(lines(spark, sf), F.col("returned") == 1, "many")[0])


@query()
def power_analysis(spark, sf):
    return row(spark, one=pw.ttest_power(0.5, 30), two=pw.ttest_ind_power(0.5, 40), normal=pw.normal_ind_power(0.3, 100), anova=pw.anova_power(0.25, 120, groups=3), n=pw.solve_ttest_ind_n(0.5, 0.8))


# ---------------------------------------------------------------- survival

_T = f"SELECT qty AS t, count(*) FILTER (returned = 1) d, count(*) FILTER (returned = 1 AND many = 0) d1, count(*) c FROM {L} GROUP BY qty"


@query(f"WITH t AS ({_T}), r AS (SELECT *, sum(c) OVER (ORDER BY t DESC) n FROM t) SELECT t AS time, CAST(n AS DOUBLE) AS at_risk, CAST(d AS DOUBLE) AS events, round(exp(sum(ln(1 - d / n)) OVER (ORDER BY t)), 6) AS survival FROM r WHERE d > 0 AND d < n")
def kaplan_meier(spark, sf):
    k = su.kaplan_meier(lines(spark, sf), "qty", "returned").filter("events < at_risk")
    return k.select("time", "at_risk", "events", F.round("survival", 6).alias("survival"))


@query(f"""WITH t AS (SELECT qty AS t, CAST(count(*) FILTER (returned = 1) AS DOUBLE) d, CAST(count(*) FILTER (returned = 1 AND ls = 'F') AS DOUBLE) d1, count(*) c, count(*) FILTER (ls = 'F') c1 FROM {L} GROUP BY qty), r AS (SELECT *, sum(c) OVER (ORDER BY t DESC) n, sum(c1) OVER (ORDER BY t DESC) n1 FROM t)
SELECT round(power(sum(d1 - d * n1 / n), 2) / sum(CASE WHEN n > 1 THEN d * n1 / n * (1 - n1 / n) * (n - d) / (n - 1) END), 5) AS statistic FROM r WHERE d > 0""")
def log_rank(spark, sf):
    return row(spark, statistic=round(su.log_rank(lines(spark, sf), "qty", "returned", "ls").statistic, 5))


@query()
def cox_ph(spark, sf):
    return su.cox(lines(spark, sf), "qty ~ disc + tax", "returned").coef_table(spark)


# ---------------------------------------------------------------- time series

_C = f"SELECT i, v - avg(v) OVER () AS c FROM {E}"


@query(f"WITH c AS ({_C}), g AS (SELECT c, lag(c, 1) OVER (ORDER BY i) l1, lag(c, 2) OVER (ORDER BY i) l2, lag(c, 3) OVER (ORDER BY i) l3 FROM c) SELECT round(sum(c * l1) / sum(c * c), 6) AS r1, round(sum(c * l2) / sum(c * c), 6) AS r2, round(sum(c * l3) / sum(c * c), 6) AS r3 FROM g")
def acf(spark, sf):
    r = ts.acf(events(spark, sf), "v", "i", 3)
    return row(spark, r1=r[1], r2=r[2], r3=r[3])


@query(f"WITH c AS ({_C}), g AS (SELECT c, lag(c, 1) OVER (ORDER BY i) l1, lag(c, 2) OVER (ORDER BY i) l2 FROM c), r AS (SELECT sum(c * l1) / sum(c * c) r1, sum(c * l2) / sum(c * c) r2, count(*) n FROM g) SELECT round((r2 - r1 * r1) / (1 - r1 * r1), 6) AS pacf2, round(n * (n + 2.0) * (r1 * r1 / (n - 1) + r2 * r2 / (n - 2)), 5) AS q2 FROM r")
def pacf_ljung_box(spark, sf):
    e = events(spark, sf)
    return row(spark, pacf2=ts.pacf(e, "v", "i", 2)[2], q2=round(ts.ljung_box(e, "v", "i", 2)[1][1], 5))


@query(f"WITH g AS (SELECT v, lag(v) OVER (ORDER BY i) l FROM {E}) SELECT round(regr_intercept(v, l), 6) AS const, round(regr_slope(v, l), 6) AS ar1 FROM g")
def autoregression(spark, sf):
    m = ts.autoregression(events(spark, sf), "v", "i", 1)
    return row(spark, const=m.coef[0], ar1=m.coef[1])


def _root_sql(table: str, lags: int, centred: bool) -> str:
    """The t value of the level of ``v`` in a unit-root regression with ``lags`` differences."""
    lagged = [f"d{k}" for k in range(1, lags + 1)]
    shifted = ", ".join(f"lag(d, {k}) OVER (ORDER BY i) AS d{k}" for k in range(1, lags + 1))
    return f"""SELECT sum(level * y) / sqrt(sum(level * level) * (sum(y * y) - sum(level * y) * sum(level * y) / sum(level * level)) / (count(*) - {lags + 1 + centred})) FROM (
WITH d AS (SELECT i, v - lag(v) OVER (ORDER BY i) AS d, lag(v) OVER (ORDER BY i) AS level, row_number() OVER (ORDER BY i) AS r FROM {table}), w AS (SELECT r, d AS y, level, {shifted} FROM d),
u AS (SELECT * FROM w WHERE r > {lags + 2}), {_swept("u", [*lagged, "level"], centred)} SELECT y, level FROM s{lags})"""


_LONG_RUN = " + ".join(f"{2 * (1 - k / 5)} * sum(e * l{k})" for k in range(1, 5))
_KPSS = f"""SELECT sum(s * s) / count(*) / (sum(e * e) + {_LONG_RUN}) FROM (SELECT *, sum(e) OVER (ORDER BY i) AS s, {", ".join(f"lag(e, {k}) OVER (ORDER BY i) AS l{k}" for k in range(1, 5))} FROM (SELECT i, v - avg(v) OVER () AS e FROM {E}))"""
_COINT = f"(SELECT i, v - a - b * u AS v FROM {E}, (SELECT regr_slope(v, u) AS b, regr_intercept(v, u) AS a FROM {E}))"


@query(f"SELECT round(({_root_sql(E, 2, True)}), 6) AS adf, round(({_KPSS}), 6) AS kpss, round(({_root_sql(_COINT, 1, False)}), 6) AS engle_granger")
def unit_roots(spark, sf):
    e = events(spark, sf)
    return row(spark, adf=ts.adf(e, "v", "i", 2).statistic, kpss=ts.kpss(e, "v", "i", 4).statistic, engle_granger=ts.engle_granger(e, "v", "u", "i").statistic)


@query(f"""WITH w AS (SELECT i, v AS y, lag(v, 1) OVER o AS a1, lag(v, 2) OVER o AS a2, lag(u, 1) OVER o AS b1, lag(u, 2) OVER o AS b2 FROM {E} WINDOW o AS (ORDER BY i)),
u AS (SELECT * FROM w WHERE b2 IS NOT NULL AND a2 IS NOT NULL), {_swept("u", ["a1", "a2", "b1", "b2"])},
f AS (SELECT ((SELECT sum(y * y) FROM s2) / (SELECT sum(y * y) FROM s4) - 1) * (n - 5) / 2 AS f, n - 5 AS dof FROM (SELECT count(*) AS n FROM u))
SELECT round(f, 6) AS f, round(power(1 + 2 * f / dof, -dof / 2.0), 6) AS p FROM f""")
def granger(spark, sf):
    f, p = ts.granger(events(spark, sf), "v", "u", "i", 2)
    return row(spark, f=f, p=p)


@query()
def vector_autoregression(spark, sf):
    m = ts.var(events(spark, sf), ["v", "u"], "i", 2)
    f = m.forecast(3)
    return spark.createDataFrame([(h, *map(float, r)) for h, r in enumerate(f, 1)], "step int, v double, u double")


@query()
def vecm(spark, sf):
    m = ts.vecm(events(spark, sf), ["v", "u"], "i", 1)
    return row(spark, first=m.eigenvalues[0], second=m.eigenvalues[1], trace=m.trace[0])


def _daily(spark, sf):
    t = read_table(spark, sf, "orders")
    return t.groupBy("o_orderpriority", F.date_trunc("month", "o_orderdate").alias("m")).agg((F.sum("o_totalprice") / 1e6).alias("v"))


@query()
def arima_by_key(spark, sf):
    return ts.arima(_daily(spark, sf), "o_orderpriority", "m", "v", ts.ArimaSpec(1, 0, 1), steps=3).select("key", "n", "aic", "forecast")


@query()
def smoothing_by_key(spark, sf):
    return sm.smoothing_by_key(_daily(spark, sf), "o_orderpriority", "m", "v", sm.Smoothing("add", "add", 12), 3)


@query()
def stl_by_key(spark, sf):
    return sm.stl_by_key(_daily(spark, sf), "o_orderpriority", "m", "v", 12)


@query("""WITH d AS (SELECT o_orderpriority AS key, date_trunc('month', o_orderdate) m, sum(o_totalprice) / 1e6 v FROM orders GROUP BY ALL),
t AS (SELECT key, m, v, (row_number() OVER w - 1) % 12 AS p, CASE WHEN count(*) OVER (w ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) = 13 THEN (sum(v) OVER (w ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) - 0.5 * (lag(v, 6) OVER w + lead(v, 6) OVER w)) / 12 END AS trend FROM d WINDOW w AS (PARTITION BY key ORDER BY m)),
s AS (SELECT key, p, avg(v - trend) s FROM t GROUP BY key, p), a AS (SELECT key, avg(s) a FROM s GROUP BY key)
SELECT t.key, CAST(t.m AS VARCHAR)[:7] AS month, round(trend, 6) AS trend, round(s - a, 6) AS seasonal FROM t JOIN s ON s.key = t.key AND s.p = t.p JOIN a ON a.key = t.key""")
def seasonal_decompose(spark, sf):
    t = sm.seasonal_decompose(_daily(spark, sf), "v", "m", 12, key="o_orderpriority")
    return t.select("key", F.date_format("ord", "yyyy-MM").alias("month"), F.round("trend", 6).alias("trend"), F.round("seasonal", 6).alias("seasonal"))


@query()
def kalman_local_level(spark, sf):
    return st.kalman_by_key(_daily(spark, sf), "o_orderpriority", "m", "v", st.local_level(1.0, 0.1), smooth=True)


# ---------------------------------------------------------------- after the fit

_LINE = f"WITH f AS (SELECT *, (syy - sxy * sxy / sxx) / (n - 2) AS s2 FROM (SELECT regr_slope(price, qty) b, regr_intercept(price, qty) a, avg(qty) mx, regr_sxx(price, qty) sxx, regr_sxy(price, qty) sxy, regr_syy(price, qty) syy, count(*) n FROM {L}))"
_Z = 1.959963984540054


@query(f"{_LINE} SELECT pos, round(a + b * qty, 5) AS prediction, round(a + b * qty - {_Z} * sqrt(s2 * (1.0 / n + (qty - mx) * (qty - mx) / sxx)), 5) AS lower, round(a + b * qty + {_Z} * sqrt(s2 * (1.0 / n + (qty - mx) * (qty - mx) / sxx)), 5) AS upper FROM {L}, f")
def prediction_interval(spark, sf):
    d = lines(spark, sf)
    t = li.ols(d, "price ~ qty").predict_interval(d)
    return t.select("pos", *[F.round(c, 5).alias(c) for c in ("prediction", "lower", "upper")])


@query(f"{_LINE} SELECT round(b * b * sxx / s2, 2) AS statistic, round((b - 1.5) * (b - 1.5) * sxx / s2, 2) AS against_value FROM f")
def wald_test(spark, sf):
    m = li.ols(lines(spark, sf), "price ~ qty")
    return row(spark, statistic=round(m.wald_test([[0, 1]]).statistic, 2), against_value=round(m.wald_test([[0, 1]], [1.5]).statistic, 2))


@query(f"{_PAIR}, s AS (SELECT ln(b.p / (1 - b.p)) - ln(a.p / (1 - a.p)) AS c, sqrt(1 / (a.n * a.p * (1 - a.p)) + 1 / (b.n * b.p * (1 - b.p))) AS se FROM a, b) SELECT round(exp(c), 6) AS ratio, round(exp(c - {_Z} * se), 6) AS lower, round(exp(c + {_Z} * se), 6) AS upper FROM s")
def odds_ratios(spark, sf):
    m = gl.logistic(lines(spark, sf), "returned ~ many")
    low, high = m.confidence_intervals()[1]
    return row(spark, ratio=gl.ratios(m)["many"], lower=np.exp(low), upper=np.exp(high))


@query(f"{_PAIR}, t AS (SELECT sum(n * p) / sum(n) AS p, sum(n) AS n FROM g) SELECT round(2 * (sum(g.n * (g.p * ln(g.p) + (1 - g.p) * ln(1 - g.p))) - max(t.n * (t.p * ln(t.p) + (1 - t.p) * ln(1 - t.p)))), 4) AS statistic FROM g, t")
def likelihood_ratio(spark, sf):
    return row(spark, statistic=round(gl.likelihood_ratio(gl.logistic(lines(spark, sf), "returned ~ many"))[0], 4))


@query(f"""WITH m AS (SELECT many, line AS y, avg(line) OVER (PARTITION BY many) AS mu FROM {L})
SELECT many, round(max(mu), 6) AS fitted, round(sum((y - mu) * (y - mu) / mu), 3) AS pearson, round(sum(2 * (y * ln(y / mu) - (y - mu))), 3) AS deviance FROM m GROUP BY many""")
def glm_residuals(spark, sf):
    t = gl.glm_rows(gl.poisson(lines(spark, sf), "line ~ many")).groupBy(F.col("x0").alias("many"))
    return t.agg(F.round(F.max("fitted"), 6).alias("fitted"), F.round(F.sum(F.col("resid_pearson") ** 2), 3).alias("pearson"), F.round(F.sum(F.col("resid_deviance") ** 2), 3).alias("deviance"))


@query(f"""WITH p AS (SELECT returned AS y, qty / 51 AS p, CASE WHEN qty / 51 >= 0.5 THEN 1 ELSE 0 END AS h FROM {L}), c AS (SELECT sum(h * y) tp, sum(h * (1 - y)) fp, sum((1 - h) * (1 - y)) tn, sum((1 - h) * y) fn, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS l, avg((y - p) * (y - p)) AS b FROM p)
SELECT round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(l, 6) AS log_loss, round(b, 6) AS brier FROM c""")
def classification_metrics(spark, sf):
    return row(spark, **ds.classification_metrics(lines(spark, sf).withColumn("p", F.col("qty") / 51), "returned", "p"))


@query(f"""WITH t AS (SELECT qty, sum(returned) d, count(*) n FROM {L} GROUP BY qty), r AS (SELECT qty, d, sum(n) OVER (ORDER BY qty DESC) AS n FROM t), s AS (SELECT qty, exp(sum(ln(1 - d / n)) OVER (ORDER BY qty)) AS s FROM r WHERE d < n)
SELECT l.line, round(max_by(s.s, s.qty), 6) AS survival FROM (SELECT DISTINCT line FROM {L}) l JOIN s ON s.qty <= l.line GROUP BY l.line""")
def survival_lookup(spark, sf):
    d = lines(spark, sf)
    return su.survival_lookup(su.kaplan_meier(d, "qty", "returned"), d.select("line").distinct(), "line").select("line", F.round("survival", 6).alias("survival"))


@query(f"WITH g AS (SELECT many, rf, count(*) c, sum(count(*)) OVER (PARTITION BY many) n FROM {L} GROUP BY many, rf), b AS (SELECT many, arg_max(rf, c) AS best FROM g GROUP BY many) SELECT pos, best FROM {L} JOIN b USING (many)")
def multinomial_predict(spark, sf):
    d = lines(spark, sf)
    coded = d.withColumn("code", F.when(F.col("rf") == "A", 0).when(F.col("rf") == "N", 1).otherwise(2))
    t = gl.multinomial(coded, "code ~ many").predict_proba(d)
    return t.select("pos", F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), F.col("predicted_class").cast("int") + 1).alias("best"))


@query(f"""WITH c AS (SELECT i, v - avg(v) OVER () AS e FROM {E}), s AS (SELECT e, sum(e) OVER (ORDER BY i) AS t, lag(e, 1) OVER (ORDER BY i) AS e1, lag(e, 2) OVER (ORDER BY i) AS e2, lag(e, 3) OVER (ORDER BY i) AS e3, lag(e, 4) OVER (ORDER BY i) AS e4 FROM c)
SELECT round(sum(t * t) / count(*) / (sum(e * e) + 2 * (0.8 * sum(e * e1) + 0.6 * sum(e * e2) + 0.4 * sum(e * e3) + 0.2 * sum(e * e4))), 6) AS statistic FROM s""")
def kpss_level(spark, sf):
    return row(spark, statistic=ts.kpss(events(spark, sf), "v", "i", 4).statistic)


@query(f"""WITH d AS (SELECT price - avg(price) OVER () AS a, qty - avg(qty) OVER () AS b, price - avg(price) OVER (PARTITION BY rf) AS wa, qty - avg(qty) OVER (PARTITION BY rf) AS wb FROM {L}),
s AS (SELECT (sum(wa * wa) * sum(wb * wb) - sum(wa * wb) * sum(wa * wb)) / (sum(a * a) * sum(b * b) - sum(a * b) * sum(a * b)) AS w, count(*) AS n FROM d)
SELECT round(w, 9) AS wilks, round((1 - sqrt(w)) / sqrt(w) * (2 * (n - 1 - 2.5) - 1) / 4, 4) AS f FROM s""")
def manova_wilks(spark, sf):
    m = pa.manova(lines(spark, sf), ["price", "qty"], "rf")
    return spark.createDataFrame([(round(float(m.wilks), 9), round(float(m.f), 4))], "wilks double, f double")


# ---------------------------------------------------------------- design


@query(f"SELECT count(*) AS n, round(sum(ln(price)), 4) AS log_price, round(sum(qty * disc), 4) AS cross, count(*) FILTER (rf = 'N') AS level_n FROM {L}")
def formula_design(spark, sf):
    d = fm.design(lines(spark, sf), "price ~ log(price) + qty:disc + C(rf)")
    r = d.df.agg(F.count(F.lit(1)), F.sum("x0"), F.sum("x1"), F.sum("x2")).first()
    return row(spark, n=r[0], log_price=round(r[1], 4), cross=round(r[2], 4), level_n=int(r[3]))


@query(f"SELECT pos, round(a + b * qty, 6) AS prediction FROM {L}, (SELECT regr_slope(price, qty) b, regr_intercept(price, qty) a FROM {L})")
def predict(spark, sf):
    d = lines(spark, sf)
    return li.ols(d, "price ~ qty").predict(d).select("pos", F.round("prediction", 6).alias("prediction"))


@query(f"SELECT supp, CAST(dense_rank() OVER (ORDER BY supp) - 1 AS INTEGER) AS group_id FROM (SELECT DISTINCT supp FROM {L})")
def group_ids(spark, sf):
    return fm.group_ids(lines(spark, sf).select("supp").distinct(), "supp").select("supp", "group_id")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """A regression with categories and robust errors, as a coefficient table."""
    m = li.ols(lines(spark, sf), "price ~ qty + disc + C(rf)", cov="hc1")
    return m.coef_table(spark)

