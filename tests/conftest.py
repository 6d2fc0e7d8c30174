import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from planlens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "planlens-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.driver.memory": "8g",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate expressions over one column ``x`` and return one list per row."""

    def run(kind, data, *expressions):
        frame = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, x {kind}")
        rows = frame.orderBy("i").select(*[e.alias(f"e{k}") for k, e in enumerate(expressions)]).collect()
        return [tuple(row) if len(expressions) > 1 else row[0] for row in rows]

    return run
