import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from voxelake.session import get_session

    shared = tmp_path_factory.mktemp("shared")
    session = get_session("local[4]", 4, **{"spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{shared}", "spark.sql.warehouse.dir": f"{shared}/warehouse"})
    yield session
    session.stop()
