import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from caselog.session import clear_scratch, local_session  # noqa: E402

TESTDATA = Path(os.environ.get("CASELOG_TESTDATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark():
    # Small files and fixed partitions: a sort really has several partitions.
    session = local_session(
        8, **{"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "6"})
    yield session
    clear_scratch(session)
    session.stop()


@pytest.fixture(scope="session")
def testdata():
    if not TESTDATA.exists():
        pytest.skip("no test tables")
    return TESTDATA
