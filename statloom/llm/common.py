"""Shared helpers of the subpackage: shared-folder tables, Arrow text access and hashing.

Everything here works on whole texts and holds at most a few megabytes of text at a
time: record batches are walked in chunks of ``CHUNK`` bytes (one text is never split,
so a single longer text makes a longer chunk).
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of text that are worked on at once in Python.
CHUNK = 1 << 18
#: Bytes of an Arrow batch between JVM and Python, where the session has Spark's default,
#: and of the texts that a task packs together.
BATCH_BYTES, GATHER_BYTES = 2 << 20, 16 << 20


# ---------------------------------------------------------------- shared tables


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the setting is missing on a local master (tests) is a local folder chosen
    and set; on a cluster the executors would write to disks of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="statloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage
    at a file that survives the loss of executors. Removed by ``discard``, or when the
    driver ends. The shuffle files of the writing go at once: Spark would keep them until
    the driver's JVM happens to collect the plan, those of all steps side by side."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/statloom/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    schema = df.schema
    first = spark._jsc.sc().newShuffleId()
    df.write.parquet(path)
    _drop_shuffles(spark, first)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(schema).parquet(path)
    _WRITTEN[out] = path
    return out


_WRITTEN: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more; other frames are left alone."""
    for df in tables:
        if (path := _WRITTEN.pop(df, None)) is not None:
            _remove(spark, path)


def _drop_shuffles(spark: SparkSession, first: int) -> None:
    """Remove the shuffles made since ``first``. A later job that comes upon one computes it
    again; while another thread has jobs running, all are left to Spark's own cleaner."""
    sc = spark._jsc.sc()
    last = sc.newShuffleId()
    if last - first > 1 and not spark.sparkContext.statusTracker().getActiveJobsIds():
        for number in range(first + 1, last):
            sc.env().blockManager().master().removeShuffle(number, False)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may be gone at exit; the folder's owner cleans up then
        pass


def fresh(columns: list[str], name: str) -> str:
    """``name``, or a longer one that no column has (Spark's names know no case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- Arrow text access


def bounded_batches(spark: SparkSession) -> None:
    """Long texts make large batches, which the JVM and every Python worker hold beside
    what they work on: the session's default bound is lowered, another setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("b") == "67108864":
        spark.conf.set(key, str(BATCH_BYTES))


def gathered(batches: Iterator[pa.RecordBatch], limit: int = GATHER_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes, one incoming batch at least."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size or any(b.num_rows for b in held):
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


_KEPT: dict = {}


def worker_cache(owner: str) -> dict:
    """What a Python worker keeps between the tasks of one operator. Workers serve many
    operators one after the other; the next operator's first task frees it."""
    if owner not in _KEPT:
        _KEPT.clear()
        _KEPT[owner] = {}
        pa.default_memory_pool().release_unused()
    return _KEPT[owner]


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError, TypeError):  # another C library
    _TRIM = None


def give_back() -> None:
    """Return freed memory to the system. A worker stays beside its executor's JVM for a
    minute after its last task, with all that its largest task once took."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def freeing(run: Callable) -> Callable:
    """``run``, a generator over a task's record batches, then ``give_back``."""

    def batchwise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return batchwise


def freeing_group(run: Callable) -> Callable:
    """The same for a function of a group's table."""

    def groupwise(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            give_back()

    return groupwise


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, is-null) of a string column, without a copy of the bytes."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    elif pa.types.is_string(column.type):
        kind = np.int32
    else:
        column, kind = column.cast(pa.string()), np.int32
    nulls = np.asarray(column.is_null()) if column.null_count else np.zeros(len(column), bool)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64), nulls
    where = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, where, nulls


def spans(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of rows that hold about ``limit`` bytes together, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def with_arrow_columns(df: DataFrame, text_col: str, fields: list[T.StructField], make: Callable[[pa.Array], list], owner: str = "") -> DataFrame:
    """``df`` with columns that ``make`` computes from the text column, batch by batch.

    ``make`` returns one array for each of ``fields``. A column of ``df`` that has the
    name of a new one is replaced; all others pass through untouched.
    """
    names = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType(kept + fields)
    arrow = to_arrow_schema(T.StructType(fields))
    bounded_batches(df.sparkSession)
    owner = owner or arrow.names[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            worker_cache(owner)
            made = [pa.array(x, f.type) if not isinstance(x, pa.Array) else x for x, f in zip(make(batch.column(text_col)), arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + made, [f.name for f in kept] + arrow.names)

    return df.select(*[f"`{c}`" for c in dict.fromkeys([f.name for f in kept] + [text_col])]).mapInArrow(freeing(run), schema)


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves remainder 2 by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learnable(id_col: str = "doc_id") -> Column:
    """True where labels may be learnt from: the remainder is known and not 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2, F.lit(False))


# ---------------------------------------------------------------- hashing of words

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BYTE_BASE, _WORD_BASE = 0x5851F42D4C957F2D, 0x2545F4914F6CDD1D
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept for chunks of the usual size."""
    table = next(iter(_KEPT.values()), {}).setdefault("powers", {})
    kept = table.get(base)
    if kept is not None and len(kept[0]) >= n:
        return kept
    size = max(n, CHUNK + 64)
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    made = (out[0], out[1])
    if size <= 4 * CHUNK:
        table[base] = made
    return made


class Words:
    """The words of some texts: where they start and end, their text and their hashes.

    ``raw`` are the bytes of texts i..j, ``starts`` the texts' offsets in it (one more
    than texts). Words are maximal runs without the six ASCII white-space characters.
    """

    def __init__(self, raw: np.ndarray, starts: np.ndarray, lower: bool = False, space: np.ndarray = _SPACE):
        if lower:
            raw = _LOWER[raw]
        self.raw, n = raw, len(raw)
        solid = ~space[raw]
        edge = np.zeros(n + 1, bool)
        edge[starts] = True
        first = solid.copy()
        first[1:] &= ~solid[:-1] | edge[1:n]
        last = solid.copy()
        last[:-1] &= ~solid[1:] | edge[1:n]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.doc = np.searchsorted(starts, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=len(starts) - 1) if len(self.doc) else np.zeros(len(starts) - 1, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])

    def hashes(self) -> np.ndarray:
        up, down = _powers(_BYTE_BASE, len(self.raw) + 1)
        total = np.zeros(len(self.raw) + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[self.raw] * up[: len(self.raw)], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start])


def rolling(values: np.ndarray, k: int, base: int = _WORD_BASE) -> np.ndarray:
    """Hash of every run of ``k`` consecutive values."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[k:] - total[:n]) * down[:n])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    if len(values) < width:
        return values[:0]
    have, out = 1, values
    while 2 * have <= width:
        out, have = np.minimum(out[:-have], out[have:]), 2 * have
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out
