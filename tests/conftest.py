"""One small session for all tests, with its checkpoints and temporary files in a folder of its own."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from planimetra.session import session

    folder = tmp_path_factory.mktemp("spark")
    conf = {"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{folder}/checkpoints", "spark.local.dir": str(folder), "spark.sql.warehouse.dir": str(folder / "warehouse")}
    spark = session("tests", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
