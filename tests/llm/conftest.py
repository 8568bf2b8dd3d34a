from __future__ import annotations

import pytest

from edictal.llm.queries import prepared


@pytest.fixture(scope="session")
def ready(spark):
    return prepared(spark)


@pytest.fixture(scope="session")
def frame(ready):
    """Rows as a table with extra columns whose names an operator might use itself."""

    def make(rows, schema):
        from pyspark.sql import functions as F

        df = ready.createDataFrame(rows, schema)
        taken = {f.name for f in df.schema}
        return df.withColumns({c: F.lit("x") for c in ("row", "id", "key", "score", "kept", "part", "label", "n", "probe", "__text") if c not in taken})

    return make
