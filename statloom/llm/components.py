"""Connected components of a distributed edge list, by alternating star contraction.

Every round joins each node's neighbours to the smallest one (first the larger
neighbours, then the smaller); the edges end as stars around each component's smallest
node. A round moves O(edges) rows, hubs are summed up before each shuffle, and no
component is ever gathered anywhere. Rounds repeat until nothing changes.

The few nodes with very many neighbours (*hubs*, fewer than HUBS) are sent to all tasks
with their answer, so their edges stay where they are; only the edges of other nodes are
dealt out by node, and no task gets a hub's edges together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import discard, materialize


#: Rows that make a hub at least, and how many keys can be hubs.
HUB, HUBS = 64, 8192


def told(rows: DataFrame, table: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` by ``key``, which is unique there; ``n`` of the table
    is how many of the ``total`` rows (or fewer) hold the key. Keys of more than HUB rows
    and more than total / HUBS, of which there are fewer than HUBS, are sent to all tasks
    and their rows stay where they are; other rows are dealt out by the key. With ``how``
    left, rows without a key in the table stay."""
    # a power of two, so that rounds of a loop share their compiled code
    many = F.col("n") > max(HUB, 1 << (max(total, 1) // HUBS).bit_length())
    new = [c for c in table.columns if c not in (key, "n")]
    hubs = table.filter(many).select(F.col(key).alias("__h"), F.struct(*new).alias("__m"))
    marked = rows.join(F.broadcast(hubs), F.col(key) == F.col("__h"), "left")
    here = marked.filter("__h is not null").select(*rows.columns, "__m.*")
    return here.unionByName(marked.filter("__h is null").select(*rows.columns).join(table.filter(~many).select(key, *new), key, how).select(*rows.columns, *new))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(u, v), longs in any order, to (u, root): the smallest node that u reaches, for
    every node u of the edges that is not the root itself."""
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(edges, "edges")
    mark = _mark(edges)
    while True:
        count = mark[0]
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = told(both.filter("v > u"), least, "u", 2 * count).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node's edge to its own smallest neighbour stays, else two stars could part
        large = large.unionByName(least.filter("u <> m").select("u", F.col("m").alias("v"))).filter("u <> v")
        large = materialize(large, "stars")  # at most as many rows as edges and nodes
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = told(large, least, "u", 3 * count).select(F.col("v").alias("u"), F.col("m").alias("v"))
        left = small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        left = materialize(left, "edges")
        discard(edges.sparkSession, edges, large)
        edges = left
        now = _mark(edges)
        if now == mark:
            return edges.groupBy("u").agg(F.min("v").alias("root"))
        mark = now
