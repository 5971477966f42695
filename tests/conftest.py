import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from aerolith.session import build_session, scratch_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 4, **{"spark.sql.shuffle.partitions": "2", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="module")
def interpreted(spark):
    """Many plans over a few rows: compiling them would take longer than running them."""
    settings = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name in settings:
        spark.conf.unset(name)


@pytest.fixture
def folder(spark):
    return scratch_dir(spark, "test")


@pytest.fixture
def one(spark):
    """Evaluates column expressions on a single row."""

    def evaluate(*columns):
        row = spark.range(1).select(*columns).first()
        return row[0] if len(columns) == 1 else tuple(row)

    return evaluate
