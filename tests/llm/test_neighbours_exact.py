"""Neighbours on rows that no share measured on a sample speaks for: near copies by the thousand, lengths of all sizes, queries unlike the other rows, very large components."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from senseloom.llm import ann


@pytest.mark.parametrize("kind", ["near copies", "lengths", "other queries", "large"])
def test_every_nearest_vector_is_found(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16))
    if kind == "near copies":
        x = rng.normal(size=(5, 16))[rng.integers(0, 5, 3000)] + 1e-3 * x
    elif kind == "lengths":
        x *= np.exp(1.5 * rng.normal(size=(3000, 1)))
    elif kind == "other queries":
        x[::20] = rng.normal(size=(150, 16)) * 0.1 - x.mean(0) - 5 * np.eye(16)[rng.integers(0, 16, 150)]
    else:
        x *= 1e25
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(frame, F.col("vec_id") % 20 == 0, k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = {}
    for q in range(0, 3000, 20):
        score = (x * x[q]).sum(1)
        score[q] = -np.inf
        want[q] = np.lexsort((np.arange(3000), -score))[:10].tolist()
    assert got == want
