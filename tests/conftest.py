import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark():
    from tarnis.session import build_session

    session = build_session(
        "tarnis-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            # keep several partitions even for a few rows, so pieces really have to be combined
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
            # tiny data: compiling generated code would take most of the time
            "spark.sql.codegen.wholeStage": "false",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
