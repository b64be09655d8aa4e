import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from obslytics.session import checkpoint_dir, get_spark
    scratch = tempfile.mkdtemp(prefix="obslytics-test-")
    s = get_spark("local[*]", 8, extra={"spark.ui.showConsoleProgress": "false",
                                        "spark.sql.warehouse.dir": f"{scratch}/wh",
                                        "spark.checkpoint.dir": f"{scratch}/ckpt"})
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="obslytics-t-")
