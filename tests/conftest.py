import datetime
import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidemark.session import tuned  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (tuned(SparkSession.builder.master("local[8]")).config("spark.sql.shuffle.partitions", "8")
               .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session


DAY = datetime.date(2019, 1, 1)


def day(i):
    return DAY + datetime.timedelta(days=i)


def bars_of(spark, series):
    """Bars from ``{ticker: [(open, high, low, close), ...]}`` on consecutive days."""
    rows = [(day(i), t, *map(float, p), 100 + i % 7) for t, prices in series.items() for i, p in enumerate(prices)]
    return spark.createDataFrame(rows, "timestamp date, ticker string, open double, high double, low double, close double, volume long")


def walk(n, seed):
    """A gapped random path with sound bars."""
    rng, out, last = random.Random(seed), [], 100.0
    for _ in range(n):
        opening = last * (1 + rng.gauss(0, 0.02))
        last = opening * (1 + rng.gauss(0, 0.03))
        out.append((opening, max(opening, last) * (1 + rng.random() * 0.03), min(opening, last) * (1 - rng.random() * 0.03), last))
    return out
