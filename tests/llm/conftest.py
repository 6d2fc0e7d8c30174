import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    """Stored tables go to a folder of the test run, unless the session names one."""
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def awkward(spark):
    """Missing values in every column, empty and long texts, repeated rows and ids, clashing extra columns."""
    long = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))
    mixed = "Ärger über <|endoftext|> 中文 <|im_end|> it's\r\n\tÉté  ''s"
    rows = [
        (1, "the cat sat on the mat " * 20, "en", "a", 1, "k", 0.1, 5),
        (1, "the cat sat on the mat " * 20, "en", "a", 1, "k", 0.1, 5),
        (2, None, None, None, None, None, None, None),
        (None, "no id here at all, only text that goes on for a while", "en", "b", 3, "x", 0.2, 1),
        (None, None, None, None, None, None, None, None),
        (3, "", "de", "a", 0, "", 0.0, 0),
        (4, " \n\t ", "de", None, 4, "y", 0.3, 2),
        (5, long, "en", "b", len(long), "z", 0.4, 3),
        (6, mixed, "fr", "c", len(mixed), "w", 0.5, 4),
        (6, "another text under the same id", "fr", "c", 30, "w", 0.5, 4),
        (-7, "x", "en", "c", 1, "v", 0.6, 6),
    ]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, score double, size long"
    )


@pytest.fixture(scope="session")
def empty(spark, documents):
    return spark.createDataFrame([], documents.schema)
