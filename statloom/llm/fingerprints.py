"""Document fingerprints by winnowing; DataFrame functions only.

A text's words (lower-cased, split at white space) give a hash for every run of ``k``
words; of every ``window`` consecutive hashes the smallest is kept, the rightmost where
several tie, with its position. Two texts that share ``window + k - 1`` consecutive words
share a fingerprint entry.

An entry is one long: 40 bits of hash above 23 bits of falling position, so the minimum
of longs is the wanted one. Positions count modulo 2**23 (8.4 million words).

Defined results: fewer than ``k`` words make one hash of all words; a text without words
has an empty fingerprint; two empty fingerprints are alike (1). A null text is an empty
one. The next document goes by falling id, ties by text; null ids come last, and after
the last comes the first. Repeated rows follow one another. An empty table gives none. Very
long texts are fingerprinted whole. The query reads id and text only, whatever else a table
holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, WINDOW = 5, 8
_POSITIONS = (1 << 23) - 1
_HASH = (1 << 40) - 1


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def winnow(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """Fingerprint entries of a text in order of position: array of long."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+", -1), "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def entry(h: Column, at: Column) -> Column:
        return F.shiftleft(h.bitwiseAND(F.lit(_HASH)), 23) + (F.lit(_POSITIONS) - at.cast("long").bitwiseAND(F.lit(_POSITIONS)))

    def grams(h: Column) -> Column:
        one = F.array(entry(F.xxhash64(h), F.lit(0)))
        many = F.transform(F.slice(h, F.lit(1), F.size(h) - (k - 1)), lambda x, i: entry(F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)]), i))
        return F.when(F.size(h) == 0, F.expr("cast(array() as array<bigint>)")).when(F.size(h) < k, one).otherwise(many)

    def smallest(width: int):
        """Minimum of every ``width`` entries by doubling; of all, where there are fewer."""

        def step(values: Column, have: int) -> Column:
            if have == width:
                return F.array_distinct(values)
            by = min(have, width - have)
            pairs = lambda v: step(F.transform(F.slice(v, F.lit(1), F.size(v) - by), lambda x, i: F.least(x, F.get(v, i + by))), have + by)
            return _let(values, pairs)

        return lambda v: F.when(F.size(v) <= width, F.when(F.size(v) == 0, v).otherwise(F.array(F.array_min(v)))).otherwise(step(v, 1))

    return _let(_let(hashes, grams), smallest(window))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the hashes of two fingerprints."""
    of = lambda e: F.array_distinct(F.transform(e, lambda x: F.shiftright(x, 23)))
    ratio = lambda x, y: _let(F.size(F.array_intersect(x, y)), lambda n: F.when(F.size(x) + F.size(y) == 0, F.lit(1.0)).otherwise(n / (F.size(x) + F.size(y) - n)))
    return _let(of(a), lambda x: _let(of(b), lambda y: ratio(x, y)))


def spell(entries: Column) -> Column:
    """A fingerprint as text: hash:position in order of position, comma-joined."""
    return F.array_join(F.transform(entries, lambda e: F.concat(F.lower(F.hex(F.shiftright(e, 23))), F.lit(":"), (F.lit(_POSITIONS) - e.bitwiseAND(F.lit(_POSITIONS))).cast("string"))), ",")


def _bucket(ids: Column, bounds: list[float], parts: int) -> Column:
    """A number that never falls as the id grows: the interval between two bounds, found
    by halving, and within it one of ``parts`` equal steps."""

    def within(k: int) -> Column:
        low, high = bounds[k], bounds[k + 1]
        step = F.floor((ids - F.lit(low)) / F.lit(max(high - low, 1.0)) * parts)
        return (F.lit(k * parts) + F.least(F.greatest(step, F.lit(0)), F.lit(parts - 1))).cast("long")

    def halve(low: int, high: int) -> Column:
        if high - low == 1:
            return within(low)
        mid = (low + high) // 2
        return F.when(ids < F.lit(bounds[mid]), halve(low, mid)).otherwise(halve(mid, high))

    return F.when(ids.isNull(), F.lit(-1).cast("long")).otherwise(halve(0, len(bounds) - 1))


def with_next(docs: DataFrame, make: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", rows: int = 1000) -> DataFrame:
    """``docs`` with the columns ``make`` and, of the next document by falling id,
    ``next_text`` and ``next_`` of each of them. One shuffle, by ranges of ids of about
    ``rows`` rows; the first row of every range is copied to the range before it."""
    spark = docs.sparkSession
    total = docs.select(F.count(F.lit(1))).first()[0]
    buckets = min(100_000, max(1, -(-total // rows)))
    cuts = min(buckets, 256)
    bounds = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("double").alias("i")).approxQuantile("i", [k / cuts for k in range(cuts + 1)], 0.25 / cuts) if total else []
    bounds = sorted(set(bounds))
    bounds = bounds if len(bounds) > 1 else [bounds[0], bounds[0] + 1] if bounds else [0.0, 1.0]
    placed = docs.withColumn("__bucket", _bucket(F.col(id_col).cast("double"), bounds, -(-buckets // cuts)))
    # at most 100,000 + 256 ranges, two numbers each
    tops = sorted(((r["__bucket"], r["top"]) for r in placed.groupBy("__bucket").agg(F.max(id_col).alias("top")).collect()), reverse=True)
    ghosts = [(tops[k][1], tops[k - 1][0]) for k in range(len(tops))]
    kind = dict(docs.dtypes)[id_col]
    extra = spark.createDataFrame(ghosts, f"__top {kind}, __to long")
    copies = F.when(F.col("__to").isNull(), F.array(F.struct(F.col("__bucket").alias("b"), F.lit(False).alias("g")))).otherwise(F.array(F.struct(F.col("__bucket").alias("b"), F.lit(False).alias("g")), F.struct(F.col("__to").alias("b"), F.lit(True).alias("g"))))
    spread = placed.join(F.broadcast(extra), F.col(id_col).eqNullSafe(F.col("__top")), "left").withColumn("__c", F.explode(copies))
    spread = spread.withColumns({"__bucket": F.col("__c.b"), "__ghost": F.col("__c.g")}).drop("__c", "__top", "__to")
    made = spread.repartition("__bucket").withColumns(make)
    order = Window.partitionBy("__bucket").orderBy("__ghost", F.desc_nulls_last(id_col), F.col(text_col))
    ahead = {f"next_{c}": F.lead(c).over(order) for c in [text_col, *make]}
    return made.withColumns(ahead).filter(~F.col("__ghost")).drop("__bucket", "__ghost")


def fingerprint_query(docs: DataFrame) -> DataFrame:
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(texts, {"fp": winnow(F.col("text"))})
    size = F.length("text")
    cut = F.floor(size / 3).cast("int")
    edited = rows.withColumn("n_chars", size.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), size - cut), F.substring("next_text", F.lit(1), cut)))
    edited = edited.withColumn("efp", winnow(F.col("edited")))
    return edited.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), spell(F.col("fp")).alias("fingerprint"), spell(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
