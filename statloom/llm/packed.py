"""Packed rows: how hashes of words travel between tasks.

A task turns its record batch into a few rows, each with the hashes of one bucket (by
remainder) as one binary value; a row is a small sorted run. The task that gathers a
bucket merges its runs with numpy. Before packing, a batch's repeats are merged, so a
hash that a third of all documents hold takes one entry a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: kind says what a row is; a to d are packed arrays; the rest is for plain rows.
SCHEMA = T.StructType([
    T.StructField("kind", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("th", T.LongType()), T.StructField("n", T.LongType()),
    T.StructField("s", T.StringType()), T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType()), T.StructField("c", T.BinaryType()), T.StructField("d", T.BinaryType()),
])
ARROW = to_arrow_schema(SCHEMA)


class Rows:
    """Collects rows of SCHEMA."""

    def __init__(self) -> None:
        self.columns: dict[str, list] = {n: [] for n in ARROW.names}

    def add(self, kind: int, **values) -> None:
        for name, column in self.columns.items():
            v = kind if name == "kind" else values.get(name)
            column.append(v.tobytes() if isinstance(v, np.ndarray) else v)

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns.values(), ARROW, strict=True)], ARROW.names)

    def table(self) -> pa.Table:
        return pa.Table.from_batches([self.batch()])


def unpack(table: pa.Table, column: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in table.column(column).to_pylist()]


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    return docs.select(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0


def split_by(keys: np.ndarray, *columns: np.ndarray):
    """(key, columns' parts) for each distinct key."""
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    edges = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
    columns = tuple(c[order] for c in columns)
    for x, y in zip(edges[:-1], edges[1:], strict=True):
        yield int(keys[x]), *(c[x:y] for c in columns)
