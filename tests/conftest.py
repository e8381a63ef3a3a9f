import os
import sys
from datetime import datetime

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from driftlens.session import build_session  # noqa: E402

from scenario import DEPOT_ROWS, MODES, MODES_AFTER, PARCEL_ROWS, depot_columns, fingerprint, frame, parcel_columns  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "driftlens-tests",
        master="local[4]",
        shuffle_partitions=4,
        extra={"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def past(spark):
    """Six fingerprints of the depots and of the parcels."""
    rows = [fingerprint(f"depot-{i}", "depot", datetime(2027, 3, 2 + 2 * i), n, depot_columns(MODES), True) for i, n in enumerate(DEPOT_ROWS)]
    rows += [fingerprint(f"parcel-{i}", "parcel", datetime(2027, 3, 3 + 2 * i), n, parcel_columns(), True) for i, n in enumerate(PARCEL_ROWS)]
    return frame(spark, rows)


@pytest.fixture(scope="session")
def after_rename(spark):
    return frame(
        spark,
        [
            fingerprint("depot-new", "depot", datetime(2027, 3, 20, 6), 251, depot_columns(MODES_AFTER)),
            fingerprint("parcel-new", "parcel", datetime(2027, 3, 20, 7), 9010, parcel_columns()),
        ],
    )
