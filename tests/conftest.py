import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from weftline.session import session, ship

    s = session("4", 4, **{"spark.driver.memory": "4g", "spark.sql.adaptive.enabled": "true"})
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    return s
