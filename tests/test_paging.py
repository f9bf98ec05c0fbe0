"""Slices of an order, near its start and deep inside."""

import pytest
from pyspark.sql import functions as F

from gleaner.operators import shaping


@pytest.mark.parametrize("top", [0, 100_000])
@pytest.mark.parametrize("start, rows", [(0, 5), (37, 20), (95, 20), (200, 5), (0, 0)])
def test_page_slice(spark, monkeypatch, top, start, rows):
    monkeypatch.setattr(shaping, "TOP_ROWS", top)
    df = spark.range(100).withColumn("v", F.col("id") * 7 % 100).repartition(7)
    got = shaping.page_slice(df, [F.desc("v"), "id"], start, count=10, max_results=rows)
    assert sorted((r.v for r in got.collect()), reverse=True) == list(range(99, -1, -1))[start : start + rows]
    assert got.columns == df.columns
    assert shaping.page_slice(df, ["id"], start, count=0, max_results=rows).count() == 0
