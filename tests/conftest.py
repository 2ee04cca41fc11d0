import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from compare import session

    s = session(**{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    yield s
    s.stop()


@pytest.fixture
def cut(spark):
    """Force chunking: every key with more than a few rows is cut."""
    spark.conf.set("gapwise.hot.rows", "25")
    yield spark
    spark.conf.unset("gapwise.hot.rows")


@pytest.fixture(scope="session")
def sf():
    return SF
