import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cuestrata.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", 4, "6g")
    session.conf.set("spark.sql.session.timeZone", "UTC")
    return session


@pytest.fixture(scope="session")
def make(spark):
    """Cue rows (start_ms, end_ms, text) as a table of one recording."""
    def build(rows, rec=1):
        data = [(rec, i, s, e, t) for i, (s, e, t) in enumerate(rows)]
        return spark.createDataFrame(data, "recording_id bigint, pos int, start_ms bigint, end_ms bigint, text string")
    return build
