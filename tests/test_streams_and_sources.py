"""Stream operators against their batch forms; readers, writers and typed access."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from statloom.operators.statespace import local_level
from statloom.plans.formula import InvalidInput
from statloom.sources import tables
from statloom.streaming import kalman


def _drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def test_local_level_stream(spark, tmp_path):
    y = [3.0, 4.0, 2.5, 5.0, 4.5]
    rows = spark.createDataFrame([("a", k, v) for k, v in enumerate(y)], "k string, t long, y double")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    got = _drain(kalman.local_level_stream(stream, "k", "t", "y", 1.0, 0.5), "levels", "append").orderBy("t").toPandas()
    expected = local_level(1.0, 0.5).filter(y)
    assert got["level"].to_numpy() == pytest.approx(expected.states[:, 0])
    assert got["variance"].to_numpy() == pytest.approx(expected.covs[:, 0, 0])


def test_windowed_moments(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-01 00:0{k}:00", float(k)) for k in range(6)], "ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    got = _drain(kalman.windowed_moments(stream, "ts", "v", "3 minutes"), "moments", "complete").orderBy("start").collect()
    assert [(r["n"], r["mean"]) for r in got] == [(3, 1.0), (3, 4.0)]


@pytest.mark.parametrize("fmt", ["parquet", "orc", "csv", "json"])
def test_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1.5, "a"), (2.5, "b")], "x double, g string")
    tables.write(df, f"{tmp_path}/t", fmt, partition_by=() if fmt == "csv" else ("g",))
    got = tables.read(spark, f"{tmp_path}/t", fmt, schema=df.schema)
    assert sorted(map(tuple, got.select("x", "g").collect())) == [(1.5, "a"), (2.5, "b")]


def test_typed_access(spark):
    df = tables.from_pandas(spark, pd.DataFrame({"x": [1, 2], "g": ["a", "b"]}))
    assert df.dtypes == [("x", "double"), ("g", "string")]
    assert tables.column(df, "x").count() == 2 and tables.categorical_column(df, "g").count() == 2
    for bad in (lambda: tables.column(df, "g"), lambda: tables.categorical_column(df, "x"), lambda: tables.with_column(df, "x", F.lit(1)), lambda: tables.from_pandas(spark, {"x": [1.0, None]})):
        with pytest.raises(InvalidInput):
            bad()
    assert tables.durable(df, "t").count() == 2
    assert tables.from_array(df.select(F.array("x").alias("a")), "a", ["b"]).columns == ["a", "b"]
