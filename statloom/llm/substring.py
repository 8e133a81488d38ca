"""Substring dedup by a log-structured fingerprint index.

The index is a list of sorted, immutable runs of window hashes, each hash with the
smallest document id that holds the window. A new batch of documents (ids rise from
batch to batch) is made into a sorted run of its own, which is merge-joined with the
index's runs bucket by bucket; what the index doesn't know yet becomes a new run, and runs
are merged into one when there are more than a few. Every match is verified by a second,
independent hash of the window's words (96 bits together).

``dedup`` removes repeats within one table; so that only windows that can repeat are
indexed at all, every window of ``span`` words names an *anchor* first: the smallest hash
of its ``gram``-word runs. Equal windows have equal anchors, neighbouring windows share
theirs, and an anchor that stands in one document only (most do) rules out all its
windows. This loses nothing. ``dedup_increment`` takes batches as they come: the index
holds every window of what it has seen, can be saved and opened again, and is compacted
as it grows. (``dedup`` fills its index in two batches at any size: it joins one run and
does not compact.)

Words are runs without ASCII white space, unchanged. A word is removed when a window
over it also starts in a document with a smaller id, as the input stands. Defined
results: a null, empty or short text loses nothing; rows with a null id lose nothing and
count for no other; rows that share an id don't count for each other, and repeated rows
give repeated results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm.common import Words, bounded_batches, gathered, materialize, rolling, sliding_min, spans, text_buffer, worker_cache
from statloom.llm.packed import ARROW, SCHEMA, Rows, split_by, text_bytes, unpack

SPAN, GRAM = 50, 25
_BLOB, _FLAG, _ROW, _RUN, _DONE = 0, 1, 2, 3, 4
_CHECK_BASE = 0x9FB21C651E98DF25


def _anchors(words: Words, h: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(word number of each window's start, its anchor) of all windows in the texts."""
    least = sliding_min(rolling(h, gram), span - gram + 1)
    start = np.flatnonzero(words.doc[: len(least)] == words.doc[span - 1 :][: len(least)]) if len(least) else np.zeros(0, np.int64)
    return start, least[start]


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _first_pass(span: int, gram: int, buckets: int):
    """Anchors of every document, packed, and every document's own figures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("words")
        for batch in gathered(batches):
            rows = Rows()
            raw, offsets, _ = text_buffer(batch.column("text"))
            ids, th = batch.column("doc_id").to_pylist(), batch.column("th").to_numpy(zero_copy_only=False)
            known = np.array([i is not None for i in ids], bool)
            number = np.array([i if i is not None else 0 for i in ids], np.int64)
            token, own = [], []
            for i, j in spans(offsets):
                part, starts = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                words = Words(part, starts)
                for k in range(j - i):
                    text = part[starts[k] : starts[k + 1]].tobytes().split()
                    rows.add(_ROW, doc_id=ids[i + k], th=int(th[i + k]), n=len(text), s=_digest(text))
                at, anchor = _anchors(words, words.hashes(), span, gram)
                doc = words.doc[at]
                new = np.ones(len(at), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
                token.append(anchor[new])
                own.append(doc[new] + i)
            token, own = np.concatenate(token), np.concatenate(own).astype(np.int64)
            keep = known[own]
            token, own = token[keep], own[keep]
            order = np.lexsort((own, token))
            token, own = token[order], own[order]
            once = np.ones(len(token), bool)
            once[1:] = (token[1:] != token[:-1]) | (own[1:] != own[:-1])
            token, own = token[once], own[once]
            first = np.ones(len(token), bool)
            first[1:] = token[1:] != token[:-1]
            group = np.cumsum(first) - 1
            shared = (np.bincount(group) > 1)[group] if len(token) else first
            # known here: the token stands in several of the batch's documents
            for k, mine in split_by(own[shared], token[shared]):
                rows.add(_FLAG, bucket=ids[k] % buckets, doc_id=ids[k], th=int(th[k]), a=mine)
            # to be found out: one entry for each token, -1 where the batch shares it
            own = np.where(shared, -1, own)[first]
            token = token[first]
            for bucket, mine, who in split_by((token % np.uint64(buckets)).astype(np.int64), token, own):
                used, at = np.unique(who, return_inverse=True)
                used = used.astype(np.int64)
                rows.add(_BLOB, bucket=bucket, a=mine, b=np.where(who < 0, -1, at - int(len(used) > 0 and used[0] < 0)).astype(np.int32), c=number[used[used >= 0]], d=th[used[used >= 0]].astype(np.int64))
            yield rows.batch()

    return run


def _shared_anchors(table: pa.Table) -> pa.Table:
    """Which entries of one bucket stand in several documents, by document."""
    rows = Rows()
    kind = np.asarray(table.column("kind"))
    flags, blobs = table.filter(pa.array(kind == _FLAG)), table.filter(pa.array(kind == _BLOB))
    for r in flags.select(["doc_id", "th", "a"]).to_pylist():
        rows.add(_FLAG, doc_id=r["doc_id"], th=r["th"], a=r["a"])
    if blobs.num_rows:
        tokens, owns, ids, ths = (unpack(blobs, c, k) for c, k in (("a", np.uint64), ("b", np.int32), ("c", np.int64), ("d", np.int64)))
        base = np.cumsum([0, *map(len, ids)])
        token, own = np.concatenate(tokens), np.concatenate([np.where(o < 0, -1, o + b) for o, b in zip(owns, base[:-1], strict=True)])
        id_, th = np.concatenate(ids), np.concatenate(ths)
        order = np.argsort(token, kind="stable")
        token, own = token[order], own[order]
        group = np.cumsum(np.concatenate([[True], token[1:] != token[:-1]])) - 1
        hit = (np.bincount(group) > 1)[group] & (own >= 0)
        for k, mine in split_by(own[hit], token[hit]):
            rows.add(_FLAG, doc_id=int(id_[k]), th=int(th[k]), a=mine)
    return rows.table()


def _windows(span: int, gram: int, buckets: int):
    """Hashes of the windows whose anchors are shared, packed; repeats within the batch
    are settled at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("words")
        for batch in gathered(batches):
            rows = Rows()
            raw, offsets, _ = text_buffer(batch.column("text"))
            number, th = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64), batch.column("th").to_numpy(zero_copy_only=False).astype(np.int64)
            flagged = batch.column("tokens").to_pylist() if "tokens" in batch.schema.names else None
            out: list[tuple[np.ndarray, ...]] = []
            for i, j in spans(offsets):
                words = Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                h = words.hashes()
                at, anchor = _anchors(words, h, span, gram)
                edge = np.searchsorted(words.doc[at], np.arange(j - i + 1))
                keep = np.zeros(len(at), bool)
                for k in range(j - i) if flagged is not None else ():
                    mine = slice(edge[k], edge[k + 1])
                    keep[mine] = np.isin(anchor[mine], np.frombuffer(b"".join(flagged[i + k]), np.uint64))
                at = at[keep] if flagged is not None else at
                doc = words.doc[at]
                out.append((rolling(h, span)[at], (rolling(h, span, _CHECK_BASE)[at] >> np.uint64(32)).astype(np.uint32), doc + i, at - words.first[doc]))
            h, check, own, pos = (np.concatenate(x) for x in zip(*out, strict=True))
            order = np.lexsort((number[own], check, h))
            h, check, own, pos = h[order], check[order], own[order].astype(np.int64), pos[order].astype(np.int32)
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1])
            least = number[own[first]][np.cumsum(first) - 1] if len(h) else np.zeros(0, np.int64)
            late = number[own] > least
            for k, mine in split_by(own[late], pos[late]):
                rows.add(_DONE, bucket=int(number[k] % buckets), doc_id=int(number[k]), th=int(th[k]), a=mine)
            h, check, own, pos = h[~late], check[~late], own[~late], pos[~late]
            packed = np.stack([own, pos.astype(np.int64)], axis=1)
            for bucket, a, b, c in split_by((h % np.uint64(buckets)).astype(np.int64), h, check, packed):
                used, at = np.unique(c[:, 0], return_inverse=True)
                rows.add(_BLOB, bucket=bucket, a=a, b=b, c=np.stack([at, c[:, 1]], axis=1).astype(np.int32), d=np.stack([number[used], th[used]], axis=1))
            yield rows.batch()

    return run


def _merge_join(keep_run: bool):
    """One bucket: the batch's runs against the index's. Gives the places that repeat a
    window of a smaller id and, if wanted, the run of windows that are new."""

    def run(table: pa.Table) -> pa.Table:
        rows = Rows()
        kind = np.asarray(table.column("kind"))
        bucket = table.column("bucket")[0].as_py()
        for r in table.filter(pa.array(kind == _DONE)).select(["doc_id", "th", "a"]).to_pylist():
            rows.add(_DONE, doc_id=r["doc_id"], th=r["th"], a=r["a"])
        old, new = table.filter(pa.array(kind == _RUN)), table.filter(pa.array(kind == _BLOB))
        if not new.num_rows:
            return rows.table()
        docs = [x.reshape(-1, 2) for x in unpack(new, "d", np.int64)]
        places = [x.reshape(-1, 2) for x in unpack(new, "c", np.int32)]
        base = np.cumsum([0, *map(len, docs)])
        own = np.concatenate([p[:, 0] + b for p, b in zip(places, base[:-1], strict=True)])
        pos, doc = np.concatenate([p[:, 1] for p in places]), np.concatenate(docs)
        h, check, least = np.concatenate(unpack(new, "a", np.uint64)), np.concatenate(unpack(new, "b", np.uint32)), doc[own, 0]
        order, first = _sorted_run(h, check, least)
        key, second, smallest = h[order][first], check[order][first], least[order][first]
        unknown = np.ones(len(key), bool)
        for run_h, run_check, run_least in zip(*(unpack(old, c, k) for c, k in (("a", np.uint64), ("b", np.uint32), ("c", np.int64))), strict=True):
            at = _find(run_h, run_check, key, second)
            known = at >= 0
            smallest[known] = np.minimum(smallest[known], run_least[at[known]])
            unknown &= ~known
        late = order[least[order] > smallest[np.cumsum(first) - 1]]
        for k, mine in split_by(own[late], pos[late]):
            rows.add(_DONE, doc_id=int(doc[k, 0]), th=int(doc[k, 1]), a=mine)
        if keep_run:
            rows.add(_RUN, bucket=bucket, a=key[unknown], b=second[unknown], c=smallest[unknown])
        return rows.table()

    return run


def _sorted_run(h: np.ndarray, check: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by hash, check and id; where each distinct window begins in it)."""
    order = np.lexsort((least, check, h))
    h, check = h[order], check[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1])
    return order, first


def _find(run_h: np.ndarray, run_check: np.ndarray, h: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Where each window of one sorted run stands in another, or -1."""
    at = np.searchsorted(run_h, h)
    out = np.full(len(h), -1, np.int64)
    open_ = np.arange(len(h))
    while True:  # once, but for windows that share the hash and not the check
        open_ = open_[at[open_] < len(run_h)]
        open_ = open_[run_h[at[open_]] == h[open_]]
        if not len(open_):
            return out
        hit = run_check[at[open_]] == check[open_]
        out[open_[hit]] = at[open_[hit]]
        open_ = open_[~hit]
        at[open_] += 1


def _merge(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Two sorted runs (hash, check, least id) as one; each window keeps its smallest id."""
    at = _find(a[0], a[1], b[0], b[1])
    known = at >= 0
    least = a[2].copy()
    least[at[known]] = np.minimum(least[at[known]], b[2][known])
    place = np.searchsorted(a[0], b[0][~known]) + np.arange(int((~known).sum()))
    out = []
    for x, y in ((a[0], b[0][~known]), (a[1], b[1][~known]), (least, b[2][~known])):
        z = np.empty(len(x) + len(y), x.dtype)
        old = np.ones(len(z), bool)
        old[place] = False
        z[place], z[old] = y, x
        out.append(z)
    return tuple(out)


def _compact(table: pa.Table) -> pa.Table:
    """Merge a bucket's runs into one, the smaller ones first."""
    rows = Rows()
    runs = sorted(zip(*(unpack(table, c, k) for c, k in (("a", np.uint64), ("b", np.uint32), ("c", np.int64))), strict=True), key=lambda r: -len(r[0]))
    while len(runs) > 1:
        runs.append(_merge(runs.pop(-2), runs.pop(-1)))
        runs.sort(key=lambda r: -len(r[0]))
    h, check, least = runs[0]
    rows.add(_RUN, bucket=table.column("bucket")[0].as_py(), a=h, b=check, c=least)
    return rows.table()


class FingerprintIndex:
    """Sorted immutable runs of window hashes in the shared folder. ``save`` writes them
    to a folder that ``open`` reads in another session."""

    def __init__(self, buckets: int, span: int = SPAN, gram: int = GRAM, max_runs: int = 4):
        self.buckets, self.span, self.gram, self.max_runs = buckets, span, gram, max_runs
        self.runs: list[DataFrame] = []

    def probe(self, batch: DataFrame, keep: bool = True) -> DataFrame:
        """Places (doc_id, th, packed word positions ``a``) where windows of ``batch``
        (doc_id, th, text, tokens) repeat one of a smaller id, in the batch or the index;
        ids of a batch must not be below those of earlier ones. With ``keep``, the
        batch's new windows become a run."""
        rows = batch.mapInArrow(_windows(self.span, self.gram, self.buckets), SCHEMA)
        for run in self.runs:
            rows = rows.unionByName(run)
        found = rows.groupBy("bucket").applyInArrow(_merge_join(keep), SCHEMA)
        if keep:
            found = materialize(found, "windows")
            self.runs.append(found.filter(F.col("kind") == _RUN))
            if len(self.runs) > self.max_runs:
                self.compact()
        return found.filter(F.col("kind") == _DONE).select("doc_id", "th", "a")

    def save(self, path: str) -> None:
        self.compact()
        spark = self.runs[0].sparkSession
        spark.createDataFrame([(self.buckets, self.span, self.gram, self.max_runs)], "buckets long, span int, gram int, max_runs int").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
        self.runs[0].write.mode("overwrite").parquet(f"{path}/run")

    @staticmethod
    def open(spark: SparkSession, path: str) -> FingerprintIndex:
        index = FingerprintIndex(*spark.read.parquet(f"{path}/meta").first())
        index.runs = [spark.read.schema(SCHEMA).parquet(f"{path}/run")]
        return index

    def compact(self) -> None:
        rows = self.runs[0]
        for run in self.runs[1:]:
            rows = rows.unionByName(run)
        self.runs = [materialize(rows.groupBy("bucket").applyInArrow(_compact, SCHEMA), "runs")]


def _remaining(span: int):
    """What is left of each text whose repeated places are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = Rows()
            ids, ths, places = (batch.column(c).to_pylist() for c in ("doc_id", "th", "places"))
            for i, th, text, found in zip(ids, ths, batch.column("text"), places, strict=True):
                words = text.as_py().encode().split()
                at = np.frombuffer(b"".join(found), np.int32)
                step = np.zeros(len(words) + 1, np.int64)
                np.add.at(step, at, 1)
                np.add.at(step, at + span, -1)
                gone = np.cumsum(step[:-1]) > 0
                left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                rows.add(_ROW, doc_id=i, th=th, n=int(gone.sum()), s=_digest(left))
            yield rows.batch()

    return run


def dedup_increment(index: FingerprintIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of a new batch, against all batches before
    it and itself; its windows join the index. Ids are not below those of earlier batches."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    bounded_batches(docs.sparkSession)
    found = index.probe(texts.filter("doc_id is not null")).groupBy("doc_id", "th").agg(F.collect_list("a").alias("places"))
    left = texts.join(found, ["doc_id", "th"]).mapInArrow(_remaining(index.span), SCHEMA).groupBy("doc_id", "th").agg(F.first("n").alias("gone"), F.first("s").alias("left"))
    return _results(texts.mapInArrow(_figures, SCHEMA), left)


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every document's own figures."""
    for batch in batches:
        rows = Rows()
        for i, th, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "text")), strict=True):
            words = t.encode().split()
            rows.add(_ROW, doc_id=i, th=th, n=len(words), s=_digest(words))
        yield rows.batch()


def _results(own: DataFrame, left: DataFrame) -> DataFrame:
    return own.join(left, ["doc_id", "th"], "left").select("doc_id", F.col("n").alias("n_words"), F.coalesce("gone", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("left", "s").alias("kept_sha256"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM, batches: int = 2) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row, by an index that is filled
    in ``batches`` steps of rising ids."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    size = text_bytes(texts)
    bounded_batches(docs.sparkSession)
    first = materialize(texts.mapInArrow(_first_pass(span, gram, max(64, size >> 24)), SCHEMA), "anchors")
    flags = first.filter(F.col("kind").isin(_BLOB, _FLAG)).groupBy("bucket").applyInArrow(_shared_anchors, SCHEMA)
    by_doc = flags.groupBy("doc_id", "th").agg(F.collect_list("a").alias("tokens"))
    # rows that share id and text share one result, which the last join gives to each
    suspects = materialize(texts.join(by_doc, ["doc_id", "th"]), "suspects")
    edges = suspects.select(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    edges = sorted(set(edges or []))
    index = FingerprintIndex(max(32, text_bytes(suspects) >> 23), span, gram)
    places = None
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        part = suspects
        if low is not None:
            part = part.filter(F.col("doc_id") > low)
        if high is not None:
            part = part.filter(F.col("doc_id") <= high)
        found = index.probe(part, keep=high is not None)
        places = found if places is None else places.unionByName(found)
    by_doc = places.groupBy("doc_id", "th").agg(F.collect_list("a").alias("places"))
    left = suspects.select("doc_id", "th", "text").join(by_doc, ["doc_id", "th"]).mapInArrow(_remaining(span), SCHEMA)
    left = left.groupBy("doc_id", "th").agg(F.first("n").alias("gone"), F.first("s").alias("left"))
    return _results(first.filter(F.col("kind") == _ROW).select("doc_id", "th", "n", "s"), left)


DEDUP_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(words[i : i + 49], ' ') AS g
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 49)) AS i FROM w WHERE len(words) >= 50)
), seen AS (SELECT g, min(doc_id) AS least FROM win GROUP BY g),
late AS (SELECT win.doc_id, win.i FROM win JOIN seen USING (g) WHERE seen.least < win.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS k FROM late),
by_doc AS (SELECT doc_id, count(*) AS n, list(k) AS ks FROM gone GROUP BY doc_id),
each AS (
  SELECT w.doc_id, len(words) AS n_words, coalesce(n, 0) AS n_removed,
         CASE WHEN n IS NULL THEN words
              ELSE list_transform(list_filter(generate_series(1, len(words)), lambda i: NOT list_contains(ks, i)), lambda i: words[i]) END AS left_words
  FROM w LEFT JOIN by_doc USING (doc_id)
)
SELECT doc_id, n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(left_words, ' '), '')) AS kept_sha256 FROM each
"""
