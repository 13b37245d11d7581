import numpy as np
from pyspark.sql import functions as F

from citegrove.llm.topk_search import top_k


def brute(rows, k):
    usable = [(i, np.floor(np.array(v, np.float64) * 256).astype(int)) for i, v in rows
              if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in usable), default=0)
    usable = [(i, np.pad(v, (0, width - len(v)))) for i, v in usable]
    out = set()
    for q, x in usable:
        if q % 3 == 0:
            ranked = sorted((-int(x @ y), j) for j, y in usable if j != q)[:k]
            out |= {(q, r, j, -s) for r, (s, j) in enumerate(ranked, 1)}
    return out


def test_same_as_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(90)]
    rows += [(100 + i, rows[1][1]) for i in range(20)] + [(200, None), (201, [1.0, None]), (202, [float("nan")]), (203, [float("inf")] * 6),
             (None, [1.0] * 6), (204, [2.0]), (207, [])]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<float>, score double")
    as_read = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = {tuple(r) for r in top_k(df, F.col("vec_id") % 3 == 0, query_block=7, row_block=30).collect()}
    assert got == brute(as_read, 5)
    assert {tuple(r) for r in top_k(df, F.col("vec_id") % 3 == 0, k=200).collect()} == brute(as_read, 200)


def test_empty_table(spark):
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0
