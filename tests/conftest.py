import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from statloom.session import clear, session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session(4, "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    clear(spark)
    spark.stop()
