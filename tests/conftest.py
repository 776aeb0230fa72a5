import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from docspark.session import get_spark
from docspark.work import Work


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", "local[4]")
    yield s
    s.stop()


@pytest.fixture()
def work(spark, request):
    return Work(spark, request.node.name[:30].replace("[", "-").replace("]", ""))
