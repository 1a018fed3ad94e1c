import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from skeinwork.session import build_session

    s = build_session("tests", "local[4]", shuffle_partitions=4, **{"spark.ui.enabled": "false", "spark.driver.memory": "3g", "spark.sql.warehouse.dir": "/tmp/skeinwork-warehouse"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
