"""op5 with rows that repeat a vec_id more than k times, with one vector and with several."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.llm import mips
from tillroll.llm.ship import ship


@pytest.mark.parametrize("bucket", [8, 1024])
def test_op5_repeated_rows(spark, monkeypatch, bucket):
    ship(spark)
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(c)) for c in x]) for i, x in enumerate(rng.normal(size=(150, 6)))]
    rows += [(7, rows[7][1])] * 3 + [(900, [9.0] * 6)] * 12 + [(901, [-9.0] * 6)] * 12  # best for some query, more than k times
    rows += [(902, [8.0 + j / 4] * 6) for j in range(9)] + [(50, [1.0, -2.0, 0.5, 3.0, 0.0, 1.5])]  # other vectors, a query's too
    rows += [(100, rows[100][1])] * 7 + [(0, [1.0, 2.0]), (903, [2.0, 1.0]), (903, [2.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    ints = [(i, np.floor(256 * np.array(x)).astype(np.int64)) for i, x in rows]
    best = {}
    for q, a in ints:
        for i, c in ints:
            if q % 50 == 0 and q < 200 and i != q and len(a) == len(c):
                best.setdefault(q, {})[i] = max(best.get(q, {}).get(i, -2**62), int(a @ c))
    want = [(q, r + 1, i, -s) for q, found in best.items() for r, (s, i) in enumerate(sorted((-s, i) for i, s in found.items())[:5])]
    assert len(want) == 15
    for cosine in (0.2, 2.0):
        monkeypatch.setattr(mips, "COSINE", cosine)
        monkeypatch.setattr(mips, "BUCKET", bucket)
        out = mips.top_k(table, (F.col("vec_id") % 50 == 0) & (F.col("vec_id") < 200))
        assert sorted(map(tuple, out.select("query_id", "rank", "vec_id", "score").collect())) == sorted(want)
