import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from gleanery.session import build_session, use_utc

    session = build_session(8, "gleanery-tests")
    session.sparkContext.setLogLevel("ERROR")
    use_utc(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def evaluate(spark):
    """Evaluate one Column per input text: evaluate(['a'], fn) -> [fn('a')]."""
    from pyspark.sql import functions as F

    def run(values, build):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        return [r.out for r in df.select("i", build(F.col("v")).alias("out")).orderBy("i").collect()]

    return run
