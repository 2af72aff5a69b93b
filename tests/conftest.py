import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pairlens.session import local_session

    return local_session(8)


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(autouse=True)
def jvm_survives(request):
    """Stop at the test that loses the JVM instead of failing all later ones."""
    yield
    if "spark" in request.fixturenames:
        try:
            request.getfixturevalue("spark").range(1).count()
        except Exception as e:  # noqa: BLE001 - whatever it is, the session is gone
            pytest.exit(f"{request.node.nodeid} lost the Spark session: {e}", returncode=3)
