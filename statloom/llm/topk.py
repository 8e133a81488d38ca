"""Exact top-k search by inner product: Fagin's threshold algorithm.

Candidates are dealt into blocks of bounded size by a hash of their id, queries into
blocks too; a task gets one block of each. In a block every dimension has a list of the
candidates sorted by that component. A query walks its lists (from the large end where
its own component is positive, from the small end where it is negative, not at all where
it is zero), each round on in those whose contribution falls most, scores the candidates
that are met for the first time and no others, and stops when the kth best score is above
the bound of all candidates not met yet: the sum of the query's components times the list
values reached. A bound equal to the kth score does not stop it, since a smaller id may
still tie. The kth score of the first block is carried to all others as a floor, so they
can stop where no candidate beats it. Block results are merged by rank.

How early it stops depends on the vectors. Where a few components carry the score, a part
of a block is met; dense vectors without such components (as in the test tables: 64
even ones) have every candidate met after about a sixth of the list entries, and the work
is that of scoring all. Every block of candidates meets every block of queries: where
queries are a share of the rows, the work grows with the square.

Scores are integers: each component x counts as floor(scale * x). They are computed in
doubles where no sum can pass 2**53, and in Python integers otherwise; a score that
doesn't fit a long raises.

Defined results: vectors that are null, empty or hold null or non-finite components take
no part, on either side; nor do rows with a null id. Only vectors with as many
components as the query are its candidates. Rows with the query's id are the query's own
and no candidates; other repeated rows each count. A query whose row is repeated is
answered once for each distinct vector. With fewer candidates than k, all are returned; an
empty table gives none. Ties go to the smaller id. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statloom.llm.common import materialize

CANDIDATES, QUERIES, ROUND = 8192, 512, 32
_NONE = -(1 << 63)


def _matrix(column: pd.Series, scale: float) -> np.ndarray:
    return np.floor(np.stack([np.asarray(v, np.float64) for v in column]) * scale)


class Lists:
    """One block's candidates, by rising id, with a sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.up = np.ascontiguousarray(np.argsort(rows, axis=0, kind="stable").T.astype(np.int32))
        self.values = np.take_along_axis(rows.T, self.up, axis=1)

    def search(self, query_id: int, query: np.ndarray, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best candidates for one query that reach ``floor``: (ids, scores, how many
        candidates were scored), best first; ties by id."""
        n = len(self.ids)
        own = self.ids != query_id
        dims = np.flatnonzero(query)
        if not len(dims):
            best_at = np.flatnonzero(own)[:k] if floor <= 0 else np.zeros(0, np.int64)
            return self.ids[best_at], np.zeros(len(best_at)), len(best_at)
        weight, down = query[dims], query[dims] > 0
        place = lambda of, depth: np.where(down[of], n - 1 - depth, depth)
        met, scored = ~own, 0
        best_at, best = np.zeros(0, np.int64), np.zeros(0)
        depth, width = np.zeros(len(dims), np.int64), ROUND
        every = np.arange(len(dims))
        here = weight * self.values[dims, place(every, depth)]
        while True:
            ahead = weight * self.values[dims, place(every, np.minimum(depth + width, n - 1))]
            steep = np.argsort(ahead - here, kind="stable")[: -(-len(dims) // 2)]  # largest falls first
            walk = np.minimum(depth[steep][:, None] + np.arange(width), n - 1)
            now = met.copy()
            now[self.up[dims[steep][:, None], np.where(down[steep][:, None], n - 1 - walk, walk)]] = True
            fresh = np.flatnonzero(now & ~met)
            met, scored = now, scored + len(fresh)
            score = self.rows[fresh] @ query
            good = score >= (best[-1] if len(best) == k else floor)
            best_at, best = np.concatenate([best_at, fresh[good]]), np.concatenate([best, score[good]])
            keep = np.lexsort((best_at, -best))[:k]
            best_at, best = best_at[keep], best[keep]
            depth[steep] += width
            # a list walked to its end has met every candidate
            if met.all() or (depth >= n).any():
                break
            here = weight * self.values[dims, place(every, depth)]
            bound = float(here.sum())
            if max(best[-1] if len(best) == k else -np.inf, floor) > bound:
                break
            width = min(2 * width, max(ROUND, n // 8))
        return self.ids[best_at], best, scored


def _exact(ids: np.ndarray, rows: np.ndarray, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, list[int]]:
    """The same by Python integers, for components too large for doubles."""
    q = [int(x) for x in query]
    scored = sorted((-sum(a * int(b) for a, b in zip(q, r, strict=True)), int(i)) for i, r in zip(ids, rows, strict=True) if i != query_id)[:k]
    if any(abs(s) >= 1 << 63 for s, _ in scored):
        raise OverflowError("a score doesn't fit a long")
    return np.array([i for _, i in scored], np.int64), [-s for s, _ in scored]


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, candidates: int = CANDIDATES, block_queries: int = QUERIES) -> DataFrame:
    """The ``k`` best rows of ``vectors`` for each row of ``queries``: query_id, rank,
    vec_id, score."""

    def usable(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
        return df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).filter(good).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))

    rows, asked = usable(vectors), usable(queries).distinct().withColumn("tag", F.xxhash64("v"))
    count = lambda df: df.select(F.count(F.lit(1))).first()[0]
    row_blocks, query_blocks = max(1, -(-count(rows) // candidates)), max(1, -(-count(asked) // block_queries))
    to = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # A repeated id or vector must not fill one block: the row's place in its file deals it out.
    left = rows.withColumn("c", to(row_blocks, "id", F.monotonically_increasing_id())).withColumn("q", every(query_blocks))
    right = asked.withColumn("q", to(query_blocks, "id", "v")).withColumn("c", every(row_blocks))
    key = ["c", "q", F.size("v").alias("dim")]

    def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, int]] = []
        if len(a) and len(b):
            a = a.sort_values("id", kind="stable")
            ids, matrix, wanted = a["id"].to_numpy(), _matrix(a["v"], scale), _matrix(b["v"], scale)
            small = float(np.abs(matrix).max()) * float(np.abs(wanted).max()) * matrix.shape[1] < 2.0**53
            lists = Lists(ids, matrix) if small else None
            for query_id, tag, floor, query in zip(b["id"].to_numpy(), b["tag"].to_numpy(), b["floor"].to_numpy(), wanted, strict=True):
                found, score = lists.search(query_id, query, k, -np.inf if floor == _NONE else float(floor))[:2] if small else _exact(ids, matrix, query_id, query, k)
                out += [(int(query_id), int(tag), int(i), int(s)) for i, s in zip(found, score, strict=True)]
        return pd.DataFrame(out, columns=["query_id", "tag", "vec_id", "score"])

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.groupBy(*key).cogroup(b.groupBy(*key)).applyInPandas(block, "query_id long, tag long, vec_id long, score long")

    right = right.withColumn("floor", F.lit(_NONE).cast("long"))
    if row_blocks == 1:
        near = met(left, right)
    else:
        near = materialize(met(left.filter("c = 0"), right.filter("c = 0")), "first")
        kth = near.groupBy(F.col("query_id").alias("__q"), F.col("tag").alias("__t")).agg(F.sort_array(F.collect_list("score"), False).alias("s"))  # at most k scores each
        kth = kth.filter(F.size("s") >= k).select("__q", "__t", F.get("s", F.lit(k - 1)).alias("kth"))
        rest = right.filter("c > 0").join(kth, (F.col("id") == F.col("__q")) & (F.col("tag") == F.col("__t")), "left").withColumn("floor", F.coalesce("kth", "floor")).select(*right.columns)
        near = near.unionByName(met(left.filter("c > 0"), rest))
    order = Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def topk_query(vectors: DataFrame) -> DataFrame:
    return search(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


TOPK_SQL = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(generate_series(1, len(q.v)), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
