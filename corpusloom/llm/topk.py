"""Exact top-k search by inner product with Fagin's threshold algorithm.

Rows are dealt into blocks of bounded size and so are the queries; each pair of a query block and a row block is one
task's work, and the k best of each query over the row blocks are merged. In a block the rows are sorted once per
dimension. A query walks its lists downward from the end its weight's sign prefers, looks up what it meets in full, and
stops once no unseen row can reach its kth score: the bound is the score of a row holding each list's next value.

Where dimensions are independent and alike, as in random vectors, no bound prunes: the lists are walked for a third of
their length, by which time every row has been met; a walk that has met all rows ends.

Components become floor(scale * x); vectors that are null or hold null or non-finite components take no part, nor do
rows without an id. A query meets only vectors of its own length. Repeated rows are candidates of their own, rows that share
a query's id are not its candidates, and repeated query rows count once. Ties go to the smaller id. An empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import read, stage_table

#: Rows, and queries, in one block, about. Each row is copied once for every block of queries, each query once for every block of rows.
BLOCK_ROWS = 8192
BLOCK_QUERIES = 4096
#: Ranks of each list that are read at a time.
DEPTH = 64


def threshold_search(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, depth: int = DEPTH) -> list[tuple[int, int, int]]:
    """(query, row, score): for each query the k best rows, and all ties with the kth that smaller ids can win."""
    n, dims = rows.shape
    order = np.argsort(rows, axis=0, kind="stable")  # ascending lists, one a dimension
    lists = np.take_along_axis(rows, order, axis=0)
    out: list[tuple[int, int, int]] = []
    columns = np.arange(dims)
    most = max((int(abs(x).max(initial=0)) for x in (queries, rows)), default=0)
    exact = rows.astype(np.float64) if most * most * dims < 1 << 53 else rows  # whole numbers below 2^53 are exact as doubles
    for q, (weights, own) in enumerate(zip(queries, query_ids, strict=True)):
        down = weights > 0
        live = columns[weights != 0]
        seen = np.zeros(n, bool)
        best_id, best_score = np.empty(0, np.int64), np.empty(0, np.int64)
        at = 0
        while True:
            stop = min(n, at + depth)
            up_ranks = np.arange(at, stop)
            met = np.concatenate([order[up_ranks[::-1]][:, live[~down[live]]].ravel(), order[n - 1 - up_ranks][:, live[down[live]]].ravel()]) if len(live) else np.arange(n)
            before = seen.copy()
            seen[met] = True
            fresh = np.flatnonzero(seen & ~before & (ids != own))
            best_id = np.concatenate([best_id, ids[fresh]])
            best_score = np.concatenate([best_score, (exact[fresh] @ weights.astype(exact.dtype)).astype(np.int64)])
            if len(best_score) > k:  # all that reach the kth score, then the smaller ids
                reach = np.flatnonzero(best_score >= np.partition(best_score, -k)[-k])
                best_id, best_score = best_id[reach], best_score[reach]
            keep = np.lexsort((best_id, -best_score))[:k]
            best_id, best_score = best_id[keep], best_score[keep]
            at = stop
            if at >= n or not len(live) or seen.all():
                break
            bound = int(np.where(down[live], lists[n - 1 - at, live], lists[at, live]) @ weights[live])
            if len(best_score) == k and bound < best_score[-1]:
                break
        out += [(q, int(i), int(s)) for i, s in zip(best_id, best_score, strict=True)]
    return out


def top_k(df: DataFrame, is_query, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score) for rows that meet the condition is_query, against all rows."""
    whole = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    sound = F.col(f"`{id_col}`").isNotNull() & F.col(f"`{vector_col}`").isNotNull()
    sound &= F.forall(whole, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = df.filter(sound).select(F.col(f"`{id_col}`").alias("id"), F.transform(whole, lambda x: F.floor(x * scale).cast("bigint")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = stage_table(rows.withColumn("salt", F.monotonically_increasing_id()), "vectors")
    asked = rows.filter("asks").select("id", "v").distinct()
    n, asks = rows.count(), asked.count()
    nx, ny = max(1, math.ceil(asks / BLOCK_QUERIES)), max(1, math.ceil(n / BLOCK_ROWS))
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    sides = asked.select(F.pmod(F.xxhash64("id", "v"), F.lit(nx)).alias("x"), each(ny).alias("y"), F.lit(True).alias("asks"), "id", "v")
    sides = sides.union(rows.select(each(nx).alias("x"), F.pmod(F.xxhash64("salt"), F.lit(ny)).alias("y"), F.lit(False).alias("asks"), "id", "v"))

    def search(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy()
        ids = group.column("id").to_numpy()
        vectors = group.column("v").combine_chunks()
        lengths = vectors.value_lengths().to_numpy()
        values = vectors.flatten().to_numpy()
        starts = np.cumsum(lengths) - lengths
        found = {"query_id": [], "id": [], "score": []}
        for length in np.unique(lengths[asks]):
            of = lambda side: np.flatnonzero(side & (lengths == length))  # noqa: B023,E731
            take = lambda at: values[(starts[at][:, None] + np.arange(length)[None, :])]  # noqa: B023,E731
            q, r = of(asks), of(~asks)
            if len(r):
                for a, b, s in threshold_search(take(q), ids[q], take(r), ids[r], k):
                    found["query_id"].append(ids[q[a]])
                    found["id"].append(b)
                    found["score"].append(s)
        return pa.table({c: pa.array(v, pa.int64()) for c, v in found.items()})

    found = sides.groupBy("x", "y").applyInArrow(search, "query_id bigint, id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL = """
WITH whole AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = len([x FOR x IN embedding IF isfinite(x)])
), asked AS (
  SELECT DISTINCT vec_id AS query_id, v AS q FROM whole WHERE vec_id % 50 = 0
), scored AS (
  SELECT query_id, vec_id, CAST(list_sum([q[i] * v[i] FOR i IN range(1, len(q) + 1)]) AS BIGINT) AS score
  FROM asked, whole WHERE vec_id <> query_id AND len(q) = len(v)
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
