import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from spindrift.session import session

    root = tmp_path_factory.mktemp("spark")
    spark = session(
        "tests", "local[4]", spark_sql_shuffle_partitions="4", spark_driver_memory="4g", spark_ui_enabled="false",
        spark_checkpoint_dir=f"file://{root}/shared", spark_sql_warehouse_dir=f"file://{root}/warehouse",
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def sf() -> str:
    return SF
