"""The pipeline's stages: what each keeps, and that the whole runs on a small folder."""

import pytest

from tests.llm.test_operators import ROWS, SCHEMA


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i * 3, i % 2, int(i % 5 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, folder)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns, name
            assert after.count() <= before.count()
            before = after.cache()
        else:
            assert after.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            assert after.count() == before.count()


def test_run_and_entry(spark, folder):
    import __spark_entry__

    every = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in every} and "pipeline" in every
    assert set(__spark_entry__.oracle_sql()) <= set(every)
    assert every["pipeline"](spark, folder).count() > 20


def test_stages_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
