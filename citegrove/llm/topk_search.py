"""Exact top-k search by inner product with a pivot table: bounds first, then candidates in bound order until none can win."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citegrove.llm.common import stored


def whole_numbers(embeddings: DataFrame, id_col: str, vector: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of each component; null, empty-named or non-finite vectors and null ids leave."""
    x = F.col(vector)
    usable = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return embeddings.filter(usable).select(
        F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as int64, padded with zeros to `width`."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def choose_pivots(vectors: DataFrame, width: int, count: int, pivots: int, sample: int) -> np.ndarray:
    """Farthest-first choice among at most `sample` vectors (those of smallest hashed id): each pivot is the vector farthest
    from those before it."""
    share = 2 * sample / max(2 * sample, count)
    some = vectors.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20))
    rows = some.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()
    pool = matrix(rows.column(0), width).astype(np.float64) if rows.num_rows else np.zeros((0, width))
    chosen: list[int] = []
    near = np.full(len(pool), np.inf)
    while len(chosen) < min(pivots, len(pool)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((pool - pool[chosen[-1]]) ** 2).sum(1))
    return pool[chosen]


def pivot_table(vectors: DataFrame, pivot: np.ndarray, width: int) -> DataFrame:
    """(id, v, far): far holds the distance to every pivot."""
    def measure(batches):
        for batch in batches:
            x = matrix(batch.column(1), width).astype(np.float64)
            squares = (x ** 2).sum(1)[:, None] + (pivot ** 2).sum(1) - 2 * x @ pivot.T
            far = np.sqrt(np.maximum(squares, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(far), pa.list_(pa.float64()))], ["id", "v", "far"])
    return vectors.mapInArrow(measure, "id long, v array<long>, far array<double>")


def _search(q: pa.Table, c: pa.Table, width: int, pivots: int, k: int, own: bool) -> tuple[list, list, list]:
    queries, rows = matrix(q["v"], width), matrix(c["v"], width)
    q_id, c_id = q["id"].to_numpy(), c["id"].to_numpy()
    most = max(np.abs(queries).max(initial=0), np.abs(rows).max(initial=0))
    if float(most) ** 2 * width < 2**52:
        queries, rows = queries.astype(np.float64), rows.astype(np.float64)
    q_far, c_far = (np.array(x["far"].to_pylist(), np.float64).reshape(len(x), pivots) for x in (q, c))
    lengths = (rows.astype(np.float64) ** 2).sum(1)
    query, found, score = [], [], []
    for i in range(len(q)):
        apart = np.abs(c_far - q_far[i]).max(1, initial=0)
        size = float((queries[i].astype(np.float64) ** 2).sum())
        # <q, x> = (|q|^2 + |x|^2 - d(q, x)^2) / 2, and no distance is below `apart`; the slack covers rounding
        bound = (size + lengths - apart ** 2) / 2 + 1e-9 * (size + lengths) + 0.5
        usable = c_id != q_id[i] if own else np.ones(len(rows), bool)
        bound[~usable] = -np.inf
        order = np.argsort(-bound, kind="stable")[:int(usable.sum())]
        ids, scores, at, step = np.zeros(0, np.int64), np.zeros(0), 0, 256
        while at < len(order) and (len(scores) < k or bound[order[at]] >= scores[-1]):
            part = order[at:at + step]
            ids, scores = np.concatenate([ids, c_id[part]]), np.concatenate([scores, rows[part] @ queries[i]])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores, at, step = ids[best], scores[best], at + step, 2 * step
        query += [q_id[i]] * len(ids)
        found += ids.tolist()
        score += [int(s) for s in scores]
    return query, found, score


def top_k(embeddings: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256,
          pivots: int = 16, sample: int = 1024, query_block: int = 1024, row_block: int = 16_384) -> DataFrame:
    """(query_id, rank, id_col, score): each query's k rows of highest integer inner product, ties to the smaller id.

    Queries are the rows where the column `is_query` holds; a row never answers a query of its own id. Queries meet all
    rows in blocks of bounded size: every pair of a query block and a row block is one group, so no task holds more, and
    the work is queries times rows at worst. Within a block candidates are read in the order of their upper bounds, until
    the next bound is below the k-th score; so the answer is exact. Vectors that are null or hold null or non-finite
    components, and rows without id, take no part; shorter vectors count as padded with zeros; of queries of one id the
    smallest vector asks; repeated rows are candidates each. An empty table gives no rows. Only the pivot sample (at most
    `sample` vectors) reaches the driver."""
    spark = embeddings.sparkSession
    vectors = whole_numbers(embeddings, id_col, vector, scale)
    width, rows = vectors.select(F.coalesce(F.max(F.size("v")), F.lit(0)), F.count("*")).first()
    pivot = choose_pivots(vectors, width, rows, pivots, sample)
    every = stored(pivot_table(vectors, pivot, width), "pivot-table")
    asking = every.withColumnRenamed("id", id_col).filter(is_query).withColumnRenamed(id_col, "id")
    asking = asking.groupBy("id").agg(F.min(F.struct("v", "far")).alias("x")).select("id", "x.v", "x.far")
    q_blocks, lanes = max(1, math.ceil(asking.count() / query_block)), max(1, math.ceil(rows / row_block))
    q = asking.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(q_blocks))).withColumn(
        "lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
    c = every.withColumn("lane", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(lanes))).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))))
    own, n_pivots = True, len(pivot)

    def search(q_part: pa.Table, c_part: pa.Table) -> pa.Table:
        a, b, s = _search(q_part, c_part, width, n_pivots, k, own)
        return pa.table({"query_id": pa.array(a, pa.int64()), id_col: pa.array(b, pa.int64()), "score": pa.array(s, pa.int64())})

    keys = ["block", "lane"]
    answers = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(search, f"query_id long, `{id_col}` long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return (answers.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", id_col, "score"))
