import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

from cohortspark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", f"local[{os.environ.get('TEST_CPUS', '8')}]", spark__sql__shuffle__partitions="4"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """``frame("a int, b string", (1, "x"), ...)``."""

    def make(schema, *rows):
        return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)

    return make


@pytest.fixture
def values():
    """Sorted plain tuples of a frame."""

    def collect(df, *columns):
        rows = df.select(*columns).collect() if columns else df.collect()
        return sorted((tuple(r) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])

    return collect
