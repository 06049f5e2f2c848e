"""A vector of very large norm beside unit vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import nearest


@pytest.mark.parametrize("norm", [1e8, 1e12])
def test_outlier(spark, norm):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[5] *= norm
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest.nearest(df, F.col("vec_id") % 20 == 0, 20).select("query_id", "rank", "vec_id", "score").collect()
    expected = set()
    for i in range(0, 600, 20):
        best = sorted((-float(np.cumsum(x[j] * x[i])[-1]), j) for j in range(600) if j != i)[:20]
        expected |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(best)}
    assert set(map(tuple, got)) == expected
