import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    """The folder that a cluster would name in spark.checkpoint.dir."""
    folder = str(tmp_path_factory.mktemp("shared"))
    spark.sparkContext.setCheckpointDir(folder)
    return folder


@pytest.fixture
def docs(spark):
    """``docs((id, text), ...)`` with columns whose names clash with those of operators."""

    def make(*rows, partitions=3):
        schema = "doc_id long, text string, ids string, score string, shard int, `a.b` string, key string"
        data = [(i, t, "x", "y", 1, "z", "k") for i, t in rows]
        return spark.createDataFrame(data, schema).repartition(partitions)

    return make
