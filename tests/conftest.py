import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from borei.session import build_session

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = build_session("borei-tests", cores=4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def smallest():
    return f"{DATA}/sf0.001"
