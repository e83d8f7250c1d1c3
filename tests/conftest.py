import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from ledgerspark.session import session

    shared = tmp_path_factory.mktemp("shared")
    s = session(
        "local[4]",
        **{
            "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": f"file://{shared}",
            "spark.sql.warehouse.dir": f"{shared}/warehouse", "spark.driver.memory": "2g", "spark.driver.host": "127.0.0.1",
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
