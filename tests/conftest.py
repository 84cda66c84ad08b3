import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

#: Where the driver's tables are; tests that need them are skipped without them.
DATA = os.environ.get("PARTWEAVE_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from partweave.session import local_session

    session = local_session(4, app="tests", spark__sql__shuffle__partitions="4", spark__sql__warehouse__dir="/tmp/partweave-warehouse")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not Path(DATA, "store_items.parquet").exists():
        pytest.skip("the tables are not here")
    return DATA
