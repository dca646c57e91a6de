import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from wavemill.session import get_session

    return get_session(4, "wavemill-tests", **{"spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "4"})


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
