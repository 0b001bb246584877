import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent
sys.path[:0] = [str(ROOT.parent), str(ROOT)]

from rookery.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Collect a frame as a sorted list of tuples, with None first."""

    def collect(df, *columns):
        found = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in found.collect()), key=lambda r: [(v is not None, v) for v in r])

    return collect


@pytest.fixture
def social(spark):
    """Small social tables from Python rows; missing columns are NULL."""
    from rookery.sources.schemas import SOCIAL
    from rookery.sources.tables import SocialTables, conform

    def make(**tables):
        frames = {}
        for name in SOCIAL:
            data = tables.get(name, [])
            if data:
                names = sorted({k for row in data for k in row})
                types = {f.split(" ")[0]: f.split(" ")[1] for f in SOCIAL[name].split(", ")}
                schema = ", ".join(f"{n} {types[n]}" for n in names)
                df = spark.createDataFrame([tuple(row.get(n) for n in names) for row in data], schema)
            else:
                df = spark.createDataFrame([], SOCIAL[name])
            frames[name] = conform(df, name)
        return SocialTables(**frames)

    return make
