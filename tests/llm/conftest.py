from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, texts, first=0, source=None):
    rows = [(first + i, t, "en", source(i) if source else f"s{i % 3}", len(t) if t else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def docs(spark):
    return lambda texts, **more: make(spark, texts, **more)


@pytest.fixture
def tables(spark, tmp_path):
    """A folder of tables for a query to read."""

    def write(**frames):
        for name, df in frames.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
