"""Nearest vectors where codes tell little: tight clusters, far from the origin, uneven dimensions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import anisotropic_ann


def tables():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(3, 16))
    return {
        "clusters": np.repeat(centres, 1500, 0) + 1e-3 * rng.normal(size=(4500, 16)),
        "offset": 1000 + rng.normal(size=(4500, 16)),
        "uneven": rng.normal(size=(4500, 15)) * 10.0 ** np.arange(-7, 8) * rng.lognormal(sigma=3, size=(4500, 1)),
    }


@pytest.mark.parametrize("name", ["clusters", "offset", "uneven"])
def test_every_nearest_row_is_found(spark, name):
    x = tables()[name]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = anisotropic_ann.nearest(v, F.col("id") % 100 == 0).toPandas().sort_values(["query_id", "rank"])
    for q in range(0, len(x), 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        of = got[got.query_id == q]
        assert set(of.vec_id) == set(np.argsort(d, kind="stable")[:10])
        assert np.allclose(of.score, np.sort(d)[:10], rtol=1e-9)
