import pytest


@pytest.fixture(scope="session", autouse=True)
def shared(tmp_path_factory, spark):
    """The shared folder of the tests, where none is named."""
    if spark.sparkContext.getCheckpointDir() is None and not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
