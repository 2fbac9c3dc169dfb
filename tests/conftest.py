import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from slidelake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def folder():
    """A fresh folder per test; nothing is deleted afterwards."""
    return tempfile.mkdtemp(prefix="run-")


@pytest.fixture(scope="session")
def three_levels(spark):
    """A 2048 x 2048 slide with levels of downsample 4, 2 and 1."""
    return spark.createDataFrame(
        [(1, 0, 4, 1, 1, 512, 2.0), (1, 1, 2, 2, 2, 512, 1.0), (1, 2, 1, 4, 4, 512, 0.5)],
        "slide_id bigint, level int, downsample int, cols int, rows int, tile_size int, mpp double",
    )


@pytest.fixture(scope="session")
def square_slide(spark):
    return spark.createDataFrame(
        [(1, 2048, 2048, 512, 0.25, 0.5)],
        "slide_id bigint, width int, height int, tile_size int, source_mpp double, target_mpp double",
    )
