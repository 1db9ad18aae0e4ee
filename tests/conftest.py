from __future__ import annotations

import os

import pytest

from airloom.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        os.environ.get("TEST_MASTER", "local[8]"),
        "tests",
        **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))},
    )
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """``frame(rows, ddl)``: a DataFrame from literal rows, times given as text."""

    def build(rows, ddl):
        names = [part.split()[0] for part in _split(ddl)]
        types = [part.split(None, 1)[1] for part in _split(ddl)]
        text = ", ".join(
            f"{name} {'string' if kind.startswith('timestamp') else kind}"
            for name, kind in zip(names, types, strict=True)
        )
        df = spark.createDataFrame(rows, text)
        for name, kind in zip(names, types, strict=True):
            if kind.startswith("timestamp"):
                df = df.withColumn(name, df[name].cast(kind))
        return df

    return build


def _split(ddl):
    return [part.strip() for part in ddl.split(",")]


def rows_of(df):
    """All rows as plain tuples, in order."""
    return sorted((tuple(row) for row in df.collect()), key=lambda row: [(v is None, str(v)) for v in row])
