import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from millrace.session import local_session

    folder = tmp_path_factory.mktemp("spark")
    session = local_session(4, 4, "4g", **{"spark.checkpoint.dir": f"file://{folder}/shared", "spark.local.dir": str(folder / "local"), "spark.sql.warehouse.dir": str(folder / "warehouse")})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
