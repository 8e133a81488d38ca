"""Sources and sinks: readers for Spark's formats, typed column access, durable tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.plans.formula import InvalidInput

FORMATS = ("parquet", "orc", "csv", "json", "jdbc")
_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, **options) -> DataFrame:
    """A table of one of FORMATS; other installed formats pass through to Spark."""
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load() if fmt == "jdbc" else reader.load(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error", partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.format(fmt).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def from_pandas(spark: SparkSession, frame, columns: list[str] | None = None) -> DataFrame:
    """A frame of double and string columns from pandas (or anything pandas takes); other
    types, and gaps in number columns, are refused."""
    import pandas as pd

    frame = pd.DataFrame(frame)
    frame = frame[columns] if columns else frame
    for name in frame.columns:
        if pd.api.types.is_numeric_dtype(frame[name]) or pd.api.types.is_bool_dtype(frame[name]):
            frame = frame.assign(**{name: frame[name].astype(float)})
            if frame[name].isna().any():
                raise InvalidInput(f"column {name!r} has gaps")
        elif not frame[name].map(lambda v: isinstance(v, str)).all():
            raise InvalidInput(f"column {name!r} is neither numeric nor text")
    return spark.createDataFrame(frame)


def with_column(df: DataFrame, name: str, value) -> DataFrame:
    """A numeric column more; a name that is taken is refused."""
    if not name.strip() or name in df.columns:
        raise InvalidInput(f"column name {name!r} is blank or taken")
    return df.withColumn(name, value.cast("double"))


def with_categorical_column(df: DataFrame, name: str, value) -> DataFrame:
    if not name.strip() or name in df.columns:
        raise InvalidInput(f"column name {name!r} is blank or taken")
    return df.withColumn(name, value.cast("string"))


def column(df: DataFrame, name: str) -> DataFrame:
    """One numeric column as double."""
    kind = dict(df.dtypes).get(name)
    if kind is None or not (kind in _NUMERIC or kind.startswith("decimal")):
        raise InvalidInput(f"{name!r} is no numeric column")
    return df.select(F.col(f"`{name}`").cast("double").alias(name))


def categorical_column(df: DataFrame, name: str) -> DataFrame:
    if dict(df.dtypes).get(name) != "string":
        raise InvalidInput(f"{name!r} is no text column")
    return df.select(f"`{name}`")


def from_array(df: DataFrame, array: str, names: list[str]) -> DataFrame:
    """Columns from the entries of an array column."""
    return df.select("*", *[F.get(F.col(array), F.lit(k)).cast("double").alias(n) for k, n in enumerate(names)])


def durable(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a written table in the folder that spark.checkpoint.dir names: cuts the
    lineage of loops at files that outlive an executor."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise InvalidInput("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="statloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/statloom/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
