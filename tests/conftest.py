import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from relief.session import ensure_checkpoint_dir, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", shuffle_partitions=8, app="relief-tests")
    ensure_checkpoint_dir(s)
    yield s
    s.stop()


def grid_of(rows):
    """Row-major list of lists -> (flat list, cols)."""
    return [v for r in rows for v in r], len(rows[0])


@pytest.fixture
def raster(spark):
    from relief.operators.tiles import raster_from_array

    def make(rows):
        flat, cols = grid_of(rows)
        flat = [None if v is None else float(v) for v in flat]
        df = spark.createDataFrame([(flat,)], "a array<double>")
        return raster_from_array(df, "a", cols)

    return make
