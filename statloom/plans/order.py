"""Orders over whole tables, cut in ranges of the order's values.

Bounds are picked once and stand in the plan as literals, so the range of a row is a
function of its value alone: whichever run, stage or retried task asks gets the same
answer. Ranges are summed up first and each is then windowed by itself; no window spans
a whole table, and what comes to the driver is a figure for each range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a range holds about, and how many ranges there are at most.
RANGE_ROWS, RANGES = 100_000, 4096
_BY_VALUE = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _bounds(df: DataFrame, order: str) -> list:
    """Rising distinct values that cut the order in even parts; none for a small table."""
    kind = df.schema[order].dataType
    value = F.col(f"`{order}`")
    rows = df.select(F.count(value)).first()[0]
    parts = min(RANGES, max(-(-rows // RANGE_ROWS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) if rows > RANGE_ROWS // 10 else 1))
    if parts < 2:
        return []
    if isinstance(kind, _BY_VALUE):
        found = df.select(F.percentile_approx(value, [k / parts for k in range(1, parts)], 16 * parts)).first()[0] or []
    else:  # the values with the smallest hashes are an even sample of the distinct ones
        tag = F.xxhash64(value)
        some = sorted(r[0] for r in df.select(value).filter(value.isNotNull()).distinct().orderBy(tag, value).limit(16 * parts).collect())
        found = some[len(some) // parts :: max(1, len(some) // parts)]
    return sorted({v for v in found if v == v})


def range_of(df: DataFrame, order: str) -> Column:
    """The number of the range that a row's value lies in, 0 for nulls: rising with the
    value. Equal values share a range."""
    bounds = _bounds(df, order)
    value = F.col(f"`{order}`")
    if not bounds:
        return F.lit(0)
    kind = df.schema[order].dataType

    def choose(low: int, high: int) -> Column:  # the bounds not above the value lie in low..high
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value < F.lit(bounds[middle]).cast(kind), choose(low, middle)).otherwise(choose(middle + 1, high))

    if len(bounds) < 256:
        return F.when(value.isNull(), 0).otherwise(choose(0, len(bounds)))
    # more bounds than compiled code should hold: a search by halves in an array literal
    table = F.array(*[F.lit(b).cast(kind) for b in bounds])
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    found = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= value, at + step).otherwise(at))
    return F.when(value.isNull(), 0).otherwise(found)


_JOIN = {"sum": lambda a, b: a + b, "max": max, "min": min}
_NOTHING = {"sum": 0, "max": None, "min": None}


def running(df: DataFrame, made: dict[str, tuple[str, Column]], order: str, reverse: bool = False, own: bool = True, part: str | None = None) -> DataFrame:
    """``df`` with columns ``made``, name: (sum, max or min, column), over the rows up to
    this one along ``order`` (with ``reverse`` from the far end; without ``own`` only over
    the rows before). ``part`` names a column that holds the range, where one is known."""
    here = part or "__p"
    rows = df if part else df.withColumn("__p", range_of(df, order))
    names = list(made)
    rows = rows.withColumns({f"__v{k}": made[n][1] for k, n in enumerate(names)})
    totals = rows.groupBy(here).agg(*[getattr(F, made[n][0])(f"__v{k}").alias(f"t{k}") for k, n in enumerate(names)]).collect()
    before: list[list] = [[] for _ in names]
    so_far = [_NOTHING[made[n][0]] for n in names]
    for r in sorted(totals, key=lambda r: r[here], reverse=reverse):
        for k, n in enumerate(names):
            before[k] += [F.lit(r[here]), F.lit(so_far[k])]
            new = r[f"t{k}"]
            if new is not None:
                so_far[k] = new if so_far[k] is None else _JOIN[made[n][0]](so_far[k], new)
    first = Window.partitionBy(here).orderBy(F.desc(order) if reverse else F.asc(order))
    w = first.rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    out = {}
    for k, n in enumerate(names):
        how = made[n][0]
        inside = getattr(F, how)(f"__v{k}").over(w)
        kind = rows.select(getattr(F, how)(f"__v{k}")).schema[0].dataType
        base = F.element_at(F.create_map(*before[k]), F.col(here)).cast(kind) if before[k] else F.lit(None).cast(kind)
        if how == "sum":
            out[n] = F.coalesce(inside, F.lit(0).cast(kind)) + F.coalesce(base, F.lit(0).cast(kind))
        else:
            out[n] = (F.greatest if how == "max" else F.least)(inside, base)
    return rows.withColumns(out).drop(*[f"__v{k}" for k in range(len(names))], *([] if part else ["__p"]))


def numbered(df: DataFrame, order: str = "ord", name: str = "rn") -> DataFrame:
    """``df`` with 1-based positions along ``order``."""
    rows = df.withColumn("__p", range_of(df, order))
    counts = sorted(tuple(r) for r in rows.groupBy("__p").agg(F.count(F.lit(1))).collect())
    start: list[Column] = []
    before = 0
    for p, n in counts:
        start += [F.lit(p), F.lit(before)]
        before += n
    offset = F.element_at(F.create_map(*start), F.col("__p")) if start else F.lit(0)
    own = F.row_number().over(Window.partitionBy("__p").orderBy(order))
    return rows.withColumn(name, own.cast("long") + offset.cast("long")).drop("__p")


def with_lags(df: DataFrame, columns: list[str], lags: list[int], order: str = "ord") -> DataFrame:
    """``df`` with columns ``c_l``: the value of c at l rows before, along ``order``.

    Rows are numbered, cut in blocks, and each block gets the few rows before it, so the
    lag windows are partitioned by block however long the series is."""
    if not lags:
        return df
    most = max(lags)
    size = max(50_000, 4 * most)
    rows = numbered(df, order, "__rn").withColumn("__b", F.floor((F.col("__rn") - 1) / size))
    tail = F.col("__rn") - 1 - F.col("__b") * size >= size - most
    own, next_ = F.struct(F.col("__b").alias("b"), F.lit(False).alias("g")), F.struct((F.col("__b") + 1).alias("b"), F.lit(True).alias("g"))
    rows = rows.withColumn("__c", F.explode(F.when(tail, F.array(own, next_)).otherwise(F.array(own))))
    w = Window.partitionBy("__c.b").orderBy("__rn")
    made = {f"{c}_{lag}": F.lag(c, lag).over(w) for c in columns for lag in lags}
    return rows.withColumns(made).filter(~F.col("__c.g")).drop("__c", "__b", "__rn")


def cumulative(counts: DataFrame) -> DataFrame:
    """Rows (__v, __n, ..) with ``__before``: the total of __n over smaller __v."""
    return running(counts, {"__before": ("sum", F.col("__n"))}, "__v", own=False)


def rank_table(df: DataFrame, value: str, keys: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """One row for each distinct (value, keys): how many rows ``n`` (or their ``weight``),
    the average ``rank`` of the value among all rows, and how many rows ``ties`` share it.
    Bounds and totals of the ranges come from sums over the rows as they are, so only the
    table itself is shuffled; rows of one value are summed up before. ``keys`` are few: the
    rows of one value, one for each key, are windowed together."""
    rows = df.withColumn("__p", range_of(df, value))
    n = F.sum(weight) if weight else F.count(F.lit(1))
    start: list[Column] = []
    before = 0.0
    for p, t in sorted(tuple(r) for r in rows.groupBy("__p").agg(n).collect()):
        start += [F.lit(p), F.lit(before)]
        before += t
    base = F.element_at(F.create_map(*start), F.col("__p")) if start else F.lit(0.0)
    table = rows.groupBy("__p", value, *keys).agg(n.cast("double").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("__p").orderBy(value).rangeBetween(Window.unboundedPreceding, 0))
    table = table.withColumns({"__u": upto, "ties": F.sum("n").over(Window.partitionBy("__p", value))})
    return table.withColumn("rank", base + F.col("__u") - (F.col("ties") - 1) / 2).drop("__p", "__u")


def dense_ids(values: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct values with their 0-based place in rising order, nulls first."""
    return numbered(values, column, name).withColumn(name, (F.col(name) - 1).cast("int"))
