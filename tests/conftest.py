from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from martlet.session import build_session  # noqa: E402
from martlet.sources.schemas import RETAIL  # noqa: E402
from martlet.sources.star import star_from_retail  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    """Build declared retail tables from rows given as dicts; other columns are NULL."""

    def build(**rows):
        out = {}
        for name, spec in RETAIL.items():
            data = [tuple(r.get(f.name) for f in spec.schema) for r in rows.get(name, [])]
            out[name] = spark.createDataFrame(data, spec.schema)
        return out

    return build


@pytest.fixture(scope="session")
def star(tables):
    return lambda **rows: star_from_retail(tables(**rows))
