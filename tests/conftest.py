import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parents[1]), str(Path(__file__).parent)]

from tablewarden.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    # the folder of the cluster stays in force where one is set
    spark = session(
        "tests",
        master="local[4]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="4g",
    )
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    spark.sparkContext.setLogLevel("OFF")
    yield spark
    spark.stop()


@pytest.fixture
def values(spark):
    """A column of values: ``values([1, None], 'int')``."""

    def make(items, kind="string"):
        return spark.createDataFrame([(i,) for i in items], f"v {kind}")

    return make
