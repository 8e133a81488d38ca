"""Mixing sources to target weights by soft membership; DataFrame functions only.

A naive-Bayes classifier over binned text features learns domains from a labelled table
and gives every document posteriors over the domains. One feature counts word beginnings
that are learnt from about ``sample_rows`` labelled rows of each domain: those that come
back within toxic texts and stand in toxic texts more than in others. Document rates r in [0, most] are the nearest to 1,

    min 1/2 sum_i t_i (r_i - 1)^2   where   sum_i r_i t_i p_id = T_d for each domain d

(t tokens, p posteriors, T_d targets). The multipliers of the domains are found by lazily
projected gradient steps, each scaled by the domains' curvature, until every domain's
expected total is within ``tol`` of its target (relative); ``Mixture`` holds wanted and
achieved totals and whether they met, and a warning tells when they did not. A step needs
the documents only through a few sums over the table of distinct features. A rate is a
function of a document's posteriors and is computed in its own row: no shuffle of texts
(the sample of labelled ids, a documented bound, is sent to the tasks instead).

Targets: the weights times a total at which the domain with the largest weight is wanted
``headroom`` more than there is. With ``most`` (``thin``: 1, no repeats) the total is free
and the shares are the targets. Where the posteriors cannot meet the targets, or only by
dropping half of the main domain, the gaps to totals that keep the main domain cost their
square instead, less until half of it stays, and the warning is given.

Defined results: a null or empty text has no tokens; without labelled rows there is one
domain, "all", and every rate is 1. Labels that are null are passed over; repeated
labels and rows each count; ties between domains go to the first by name. A label of no
document teaches nothing. An empty table gives no row. Very long texts are read whole.
``mix`` replaces columns named like new ones; ``thin`` leaves all columns, whatever their
names, as they are.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import materialize

#: Weights of the domains in the mixed corpus (production parameters of the query).
WEIGHTS = {"clean": 0.93, "low": 0.06, "toxic": 0.01}
BINS = 24
FEATURES = ("length", "non_ascii", "shouting", "lines", "signs", "repeats", "marks")
#: Letters of a word beginning, how many beginnings are learnt at most, and the labelled
#: rows of a domain that they are learnt from, about.
BEGIN, MARKS, SAMPLE_ROWS = 5, 64, 3000


def _bin(x: Column) -> Column:
    return F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(BINS - 1)).cast("int")


def token_count(text: Column) -> Column:
    """Blank-separated tokens: blanks plus one, none in an empty text."""
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("long")


def _words(text: Column) -> Column:
    return F.split(F.lower(F.replace(text, F.lit("\n"), F.lit(" "))), " ", -1)


def _marked(count: Column, size: Column) -> Column:
    """Six steps of a count by four of its share of the text (about six characters a word)."""
    share = count * 6000 / size
    steps = F.when(count < 4, count).when(count < 7, 4).otherwise(5)
    return (steps * 4 + F.when(share < 2, 0).when(share < 6, 1).when(share < 20, 2).otherwise(3)).cast("int")


def features(text: Column, marks: tuple[str, ...] = ()) -> Column:
    """The binned features of a text, one small integer for each of FEATURES."""
    size = F.greatest(F.length(text), F.lit(1))
    many = lambda *signs: reduce(lambda a, b: a + b, [F.length(text) - F.length(F.replace(text, F.lit(s), F.lit(""))) for s in signs])
    middle = F.substring(text, (size / 2).cast("int") + 1, F.lit(10))
    again = F.length(text) - F.length(F.replace(text, middle, F.lit("")))
    marked = F.size(F.filter(_words(text), lambda w: F.left(w, F.lit(BEGIN)).isin(*marks))) if marks else F.lit(0)
    return F.array(
        _bin(F.log2(size) * 1.5), _bin((F.octet_length(text) - F.length(text)) / size * 100), _bin(many("!") / size * 100),
        _bin(many("\n") / size * 1000), _bin(many("*", "$", "#", "%", "&", "|") / size * 100),
        _bin(again / size * 20), _marked(marked, size),
    )


def label_domain(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 0, "low").when(quality.isNotNull() | toxic.isNotNull(), "clean")


def learn_marks(docs: DataFrame, labels: DataFrame, domain: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> tuple[str, ...]:
    """Word beginnings that come back within 8 sampled texts of ``domain`` at least, and
    that stand in as many of its texts as of all other labelled texts. The sample
    holds about ``sample_rows`` labels of each domain, chosen by a hash of the id; what is
    counted in it is scaled back to all labelled rows."""
    named = labels.filter("domain is not null and id is not null")
    # as many rows as domains
    share = {r["domain"]: min(1.0, sample_rows / r["count"]) for r in named.groupBy("domain").count().collect()}
    if domain not in share:
        return ()
    draw = F.pmod(F.xxhash64("id", F.lit("marks")), F.lit(1 << 30))
    bound = F.element_at(F.create_map(*[F.lit(x) for d, p in share.items() for x in (d, int(p * (1 << 30)))]), F.col("domain"))
    scale = F.element_at(F.create_map(*[F.lit(x) for d, p in share.items() for x in (d, 1 / p)]), F.col("domain"))
    # about sample_rows rows a domain: small enough to send to every task
    chosen = named.filter(draw < bound).select("id", (F.col("domain") == domain).alias("of"), scale.alias("weight"))
    words = F.filter(_words(F.col("text")), lambda w: F.length(w) >= BEGIN)
    each = docs.join(F.broadcast(chosen), "id").withColumn("row", F.monotonically_increasing_id()).select("row", "of", "weight", F.explode(F.transform(words, lambda w: F.left(w, F.lit(BEGIN)))).alias("begin"))
    texts = each.groupBy("row", "of", "weight", "begin").agg(F.count(F.lit(1)).alias("n"))
    of_texts = lambda cond: F.sum(F.when(cond, F.col("weight")).otherwise(0.0))
    found = texts.groupBy("begin").agg(F.count_if(F.col("of") & (F.col("n") > 1)).alias("seen"), of_texts(F.col("of")).alias("inside"), of_texts(~F.col("of")).alias("outside")).filter("seen >= 8 and inside >= outside")
    return tuple(r["begin"] for r in found.orderBy(F.desc(F.expr("inside - outside")), "begin").limit(MARKS).collect())


@dataclass
class Posterior:
    """log prior and log likelihoods by domain, feature and bin: a table of fixed size."""

    domains: list[str]
    prior: list[float]
    table: list[list[list[float]]]

    def column(self, bins: Column) -> Column:
        """Array of the domains' posteriors."""
        if len(self.domains) == 1:
            return F.array(F.lit(1.0))
        logs = []
        for prior, rows in zip(self.prior, self.table, strict=True):
            terms = [F.get(F.array(*[F.lit(float(v)) for v in row]), F.get(bins, F.lit(k))) for k, row in enumerate(rows)]
            logs.append(reduce(lambda a, b: a + b, terms, F.lit(prior)))
        soft = F.transform(F.array(F.array(*logs)), lambda a: F.transform(a, lambda x: F.exp(x - F.array_max(a))))
        return F.get(F.transform(soft, lambda a: F.transform(a, lambda x: x / F.aggregate(a, F.lit(0.0), lambda s, y: s + y))), F.lit(0))


def fit_domains(rows: DataFrame, labels: DataFrame) -> Posterior:
    """Learn from all rows (id, bins) that ``labels`` (id, domain) names."""
    each = rows.join(labels.filter("domain is not null"), "id").select("domain", F.posexplode("bins").alias("feature", "bin"))
    found = each.groupBy("domain", "feature", "bin").count().collect()  # domains x features x bins at most
    domains = sorted({r["domain"] for r in found})
    if not domains:
        return Posterior(["all"], [0.0], [])
    count = {(r["domain"], r["feature"], r["bin"]): r["count"] for r in found}
    size = {d: sum(v for (x, f, _), v in count.items() if x == d and f == 0) for d in domains}
    table = [[[math.log((count.get((d, f, b), 0) + 0.5) / (size[d] + 0.5 * BINS)) for b in range(BINS)] for f in range(len(FEATURES))] for d in domains]
    return Posterior(domains, [math.log(size[d] / sum(size.values())) for d in domains], table)


@dataclass
class Rates:
    """Rates as a function of posteriors: base + slopes . p, cut to [0, most]."""

    base: float = 1.0
    slopes: list[float] = field(default_factory=list)
    most: float = math.inf

    def line(self, posterior: Column) -> Column:
        return reduce(lambda a, b: a + b, [F.get(posterior, F.lit(d)) * F.lit(float(s)) for d, s in enumerate(self.slopes)], F.lit(float(self.base)))

    def column(self, posterior: Column) -> Column:
        return F.least(F.greatest(self.line(posterior), F.lit(0.0)), F.lit(float(self.most)))


@dataclass
class Mixture:
    posterior: Posterior
    rates: Rates
    targets: dict[str, float]
    marks: tuple[str, ...] = ()
    achieved: dict[str, float] = field(default_factory=dict)
    converged: bool = True
    steps: int = 0
    rows: DataFrame | None = None

    def columns(self, text: Column) -> Column:
        """Struct of n_tokens, posteriors, domain and rate of a text."""

        def of(t: Column) -> Column:
            return F.struct(token_count(t).alias("n_tokens"), self.of_bins(features(t, self.marks)).alias("m"))

        return F.get(F.transform(F.array(F.coalesce(text, F.lit(""))), of), F.lit(0))

    def of_bins(self, bins: Column) -> Column:
        """Struct of posteriors, domain and rate of a text's features."""
        names = F.array(*[F.lit(d) for d in self.posterior.domains])

        def named(p: Column) -> Column:
            return F.struct(p.alias("posteriors"), F.get(names, (F.array_position(p, F.array_max(p)) - 1).cast("int")).alias("domain"), F.round(self.rates.column(p), 6).alias("rate"))

        soft = F.transform(F.array(bins), lambda b: self.posterior.column(b))
        return F.get(F.transform(soft, named), F.lit(0))


def _solve(cells: DataFrame, k: int, wanted: np.ndarray, shares: np.ndarray, most: float, steps: int, tol: float, soft: float = 0.0) -> tuple[Rates, np.ndarray, bool, int]:
    """Multipliers of the domains for ``cells`` (t, p): rates, achieved totals, whether
    each is within ``tol`` of its target, steps. With ``soft``, gaps cost their square over it."""
    a = [F.get("p", F.lit(d)) - F.lit(float(s)) for d, s in enumerate(shares)]

    def at(x: np.ndarray) -> tuple[Rates, np.ndarray, np.ndarray, float]:
        rates = Rates(float(1 - x @ shares), [float(v) for v in x], most)
        z = rates.line(F.col("p"))
        base = cells.select("t", *[c.alias(f"a{d}") for d, c in enumerate(a)], *[F.get("p", F.lit(d)).alias(f"p{d}") for d in range(k)], z.alias("z"), rates.column(F.col("p")).alias("r"))
        free = F.when((F.col("z") > 0) & (F.col("z") <= most), F.col("t")).otherwise(0.0)
        sums = [F.sum(F.expr(f"t * r * p{d}")) for d in range(k)] + [F.sum(free * F.col(f"a{i}") * F.col(f"a{j}")) for i in range(k) for j in range(k)] + [F.sum(F.expr("t * (z * r - r * r / 2)"))]
        got = np.array([float(v or 0) for v in base.agg(*sums).first()])
        return rates, got[:k], got[k : k + k * k].reshape(k, k), float(got[-1] - x @ wanted + soft / 2 * (x @ x))

    x = np.zeros(k)
    rates, have, curve, value = at(x)
    used, size, damp = 0, 1.0, 1e-4 * curve + 1e-9 * float(have.sum()) * np.eye(k)  # all rates are free at first
    while True:
        gap = wanted + shares * have.sum() - have
        goal = wanted + shares * have.sum()
        met = bool(np.all(np.abs(gap) <= tol * np.where(goal > 0, goal, goal.sum())))
        push = gap - soft * x
        settled = met if not soft else bool(np.abs(push).max() <= tol * goal.sum())
        if settled or used >= steps or size < 1e-6:
            return rates, have, met, used
        move = np.linalg.solve(curve + damp + soft * np.eye(k), push)
        size = 1.0
        while size >= 1e-6 and used < steps:
            used += 1
            tried = at(x + size * move)
            if tried[3] <= value - 1e-4 * size * float(push @ move):
                x = x + size * move
                rates, have, curve, value = tried
                break
            size /= 2


def fit(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, headroom: float = 0.03, steps: int = 100, tol: float = 1e-3, most: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> Mixture:
    """Domains from ``labels`` (id, quality, toxic), rates from all documents."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = labels.select(F.col(id_col).alias("id"), label_domain(F.col("quality"), F.col("toxic")).alias("domain"))
    marks = learn_marks(docs.select(F.col(id_col).alias("id"), text.alias("text")), named)
    rows = materialize(docs.select(F.col(id_col).alias("id"), features(text, marks).alias("bins"), token_count(text).alias("t")), "features")
    posterior = fit_domains(rows, named)
    k = len(posterior.domains)
    weights = {d: w for d, w in (weights or WEIGHTS).items() if d in posterior.domains}
    cells = materialize(rows.groupBy("bins").agg(F.sum("t").cast("double").alias("t")).withColumn("p", posterior.column(F.col("bins"))), "cells")
    have = np.array([float(x or 0) for x in cells.agg(*[F.sum(F.col("t") * F.get("p", F.lit(d))) for d in range(k)]).first()])
    by_name = lambda x: dict(zip(posterior.domains, [float(v) for v in x], strict=True))
    whole = sum(weights.values())
    if k == 1 or not whole or not have.sum():
        return Mixture(posterior, Rates(), by_name(have), marks, by_name(have), rows=rows)
    share = np.array([weights.get(d, 0.0) / whole for d in posterior.domains])
    main = int(share.argmax())
    if most is None:
        wanted = have[main] * (1 + headroom) / share[main] * share
        problem = (cells, k, wanted, np.zeros(k), math.inf, steps, tol)
    else:
        problem = (cells, k, np.zeros(k), share, most, steps, tol)
    rates, got, met, used = _solve(*problem)
    if not met or most is not None and got[main] < have[main] / 2:
        wanted = have[main] * (1 if most else 1 + headroom) / share[main] * share
        for weight in (0.01, 0.1, 1, 10, 100, 1000):  # more and more towards rates of 1
            rates, got, met, used = _solve(cells, k, wanted, np.zeros(k), most or math.inf, steps, tol, weight * float(wanted.sum()))
            if got[main] >= have[main] / 2:
                break
    elif most is not None:
        wanted = share * got.sum()
    if not met:
        warnings.warn(f"the mixture misses its targets after {used} steps: wanted {by_name(wanted)}, achieved {by_name(got)}", stacklevel=2)
    return Mixture(posterior, rates, by_name(wanted), marks, by_name(got), met, used, rows)


def _chance(id_col: str) -> Column:
    """A fixed number in [0, 1) for each document."""
    return F.pmod(F.xxhash64(F.col(id_col), F.lit("mixing")), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _copies(id_col: str, rate: Column) -> Column:
    return (F.floor(rate) + (_chance(id_col) < rate - F.floor(rate)).cast("int")).cast("int")


def mix(docs: DataFrame, mixture: Mixture, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n_tokens, domain, posteriors, rate and ``copies``: how often the
    mixed corpus holds the document (its rate, the fraction by a fixed chance)."""
    new = ("n_tokens", "domain", "posteriors", "rate", "copies")
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    rows = docs.select(*keep, mixture.columns(F.col(text_col)).alias("__m"))
    rate = F.col("__m.m.rate")
    return rows.select(*keep, F.col("__m.n_tokens").alias("n_tokens"), F.col("__m.m.domain").alias("domain"), F.col("__m.m.posteriors").alias("posteriors"), rate.alias("rate"), _copies(id_col, rate).alias("copies"))


def mixing_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    mixture = fit(docs, labels)
    rows = mixture.rows.select(F.col("id").alias("doc_id"), F.col("t").alias("n_tokens"), mixture.of_bins(F.col("bins")).alias("m"))
    names = [F.round(F.get("m.posteriors", F.lit(k)), 6).alias(f"p_{d}") for k, d in enumerate(mixture.posterior.domains)]
    return rows.select("doc_id", "n_tokens", "m.domain", *names, "m.rate", _copies("doc_id", F.col("m.rate")).alias("copies"))


def thin(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The mixed corpus without repeats: a document stays when its rate, 1 at
    most, says so, and the kept documents meet the weights. Columns are unchanged."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")  # any names it may have
    rows = mix(docs.select(row, F.col("doc_id").alias("__id"), F.col("text").alias("__text")), fit(docs, labels, most=1.0), "__id", "__text")
    return rows.filter("copies > 0").select("__row.*")
