from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[4]").appName("veilspan-tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def fake(prefix: str, n: int, alphabet: str = "aB3dE5fG7hJ9kL2mN4pQ6rS8tU0vWxYzC") -> str:
    """A credential-shaped value, assembled when the test runs."""
    return prefix + "".join(alphabet[(7 * i + 3 * (i // len(alphabet))) % len(alphabet)] for i in range(n))
