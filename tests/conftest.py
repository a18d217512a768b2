import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from marginalia.plans.session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build("tests", cores="4", shuffle=4)
    yield session
    session.stop()


@pytest.fixture
def notes(spark):
    """Notes from (path, content) pairs, in file order."""

    def make(*pairs):
        rows = []
        for i, (path, content) in enumerate(pairs):
            name = path.rsplit("/", 1)[-1]
            base, _, ext = name.rpartition(".")
            rows.append((i, path, path.rpartition("/")[0], name, base, ext, content))
        return spark.createDataFrame(rows, "ord long, path string, dir string, name string, basename string, ext string, content string")

    return make
