import itertools
import os
import re
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def sent(df):
    """The plan below each broadcast of df, as text."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [m.start() if (m := re.search("[A-Z]", x)) else -1 for x in lines]
    return ["\n".join(lines[j] for j in itertools.takewhile(lambda j: depth[j] > depth[i], range(i + 1, len(lines)))) for i, x in enumerate(lines) if "BroadcastExchange" in x]
