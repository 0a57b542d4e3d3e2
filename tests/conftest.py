import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from ravelin.session import SETTINGS
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[8]").config(map=SETTINGS | {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "6g"}).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s
