import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "3g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{base}/shared").config("spark.sql.warehouse.dir", f"file://{base}/warehouse").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from sablequery.session import ship_package

    yield ship_package(session)
    session.stop()


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"
