import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from recallframe.session import get_spark

    session = get_spark("tests", "local[2]", **{"spark__sql__shuffle__partitions": "4", "spark__ui__enabled": "false", "spark__driver__memory": "3g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
