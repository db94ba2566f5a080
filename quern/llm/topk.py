"""Exact top-k search by inner product, with no random access (NRA).

The rows are dealt into blocks, and in each block every dimension is a list sorted by component. A
query reads its lists from the top, or from the bottom where its own component is negative, so
contributions fall along each list. After every step a row's lower bound is the sum of the
contributions read plus the least that each unread list can give, its upper bound the sum plus the
next entry of each unread list. A query stops when the k-th largest lower bound reaches the upper
bounds of all rows but k; or else when no list has more. Rows that may still qualify get their
final scores. The steps double, and all queries of a block of queries read together: what is read
is the same for all queries of one sign, so the bounds are four matrix products.

Ranks of blocks are merged by window. Blocks of rows and of queries have fixed sizes, so a task's
memory does not grow with the input.

Scores are integers and exact: sums stay below 2**53 or the products are made in 64-bit integers.

Defined cases: vectors that are null or hold null or non-finite components, and rows without an id,
take no part; vectors of different lengths are not compared; ties go to the smaller id; repeated
ids are rows of their own; a query leaves out all rows of its id, and is asked once if repeated; a query with fewer than k
other rows gets them all; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.session import attach, table

ROW_BLOCK = 4096
QUERY_BLOCK = 512
FIRST_STEP = 64
SCHEMA = "query_id long, vec_id long, score long"


def quantised(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each column."""
    return np.partition(values, len(values) - k, axis=0)[len(values) - k]


def nra(rows: np.ndarray, queries: np.ndarray, k: int, own: np.ndarray) -> list[np.ndarray]:
    """For each query the places of the rows that can be among its k best. ``own``: bool, rows x
    queries, marks what a query must leave out. The last step leaves exact bounds."""
    n, dims = rows.shape
    order = np.argsort(rows, axis=0, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(n)[:, None], axis=0)
    ranked = np.take_along_axis(rows, order, axis=0)
    out: list[np.ndarray] = [np.arange(n)] * len(queries)
    live = np.arange(len(queries))
    depth = FIRST_STEP
    while len(live):
        q = queries[live].T
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        if depth >= n:
            low = high = rows @ q
        else:
            top, bottom = (rank >= n - depth).astype(rows.dtype), (rank < depth).astype(rows.dtype)
            read = (rows * top) @ up + (rows * bottom) @ down
            worst = up * ranked[0][:, None] + down * ranked[-1][:, None]
            ahead = up * ranked[n - depth - 1][:, None] + down * ranked[depth][:, None]
            rises, falls = (q > 0).astype(rows.dtype), (q < 0).astype(rows.dtype)
            low = read + worst.sum(axis=0) - top @ (worst * rises) - bottom @ (worst * falls)
            high = read + ahead.sum(axis=0) - top @ (ahead * rises) - bottom @ (ahead * falls)
        low = np.where(own[:, live], -np.inf, low)
        bar = _kth(low, min(k, n))
        may = (high >= bar) & ~own[:, live]
        settled = (may.sum(axis=0) <= max(4 * k, n // 64)) | (depth >= n)
        for j in np.flatnonzero(settled):
            out[live[j]] = np.flatnonzero(may[:, j])
        live = live[~settled]
        depth *= 4
    return out


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = t.column("vec_id").to_numpy()
    flat = t.column("v").combine_chunks().flatten().to_numpy()
    return ids, flat.reshape(len(ids), -1)


def block_best(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The k best rows of the block for each query of the block."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(queries) and len(rows):
        q_ids, q = _matrix(queries)
        r_ids, r = _matrix(rows)
        own = r_ids[:, None] == q_ids[None, :]
        small = float(np.abs(q).max(initial=0)) * float(np.abs(r).max(initial=0)) * max(1, r.shape[1]) < 2**52
        if not r.shape[1]:
            candidates = [np.arange(len(r))] * len(q)
        elif small:
            candidates = nra(r.astype(np.float64), q.astype(np.float64), k, own)
        else:
            candidates = [np.arange(len(r))] * len(q)
        for j, places in enumerate(candidates):
            places = places[~own[places, j]]
            score = r[places] @ q[j]
            best = np.lexsort((r_ids[places], -score))[:k]
            found.append((np.full(len(best), q_ids[j]), r_ids[places][best], score[best]))
    columns = [np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in range(3)]
    return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("query_id", "vec_id", "score"), columns, strict=True)})


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best rows. Both inputs:
    vec_id, and ``v``, an array of longs."""
    attach(vectors.sparkSession)
    valid = "vec_id is not null and v is not null"
    rows = vectors.select(F.col("vec_id").cast("long"), "v").filter(valid)
    asked = queries.select(F.col("vec_id").cast("long"), "v").filter(valid).distinct()
    # Written with the tables: made beside explode(), each copy of a row would get a number of its own.
    rows = table(rows.withColumn("_rid", F.monotonically_increasing_id()), "vectors")
    asked = table(asked.withColumn("_rid", F.monotonically_increasing_id()), "vector-queries")
    row_blocks = max(1, -(-rows.count() // ROW_BLOCK))
    query_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    deal = lambda n, seed: F.pmod(F.xxhash64("_rid", F.lit(seed)), F.lit(n))
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    size = F.size("v").alias("dims")
    dealt_rows = rows.select("vec_id", "v", size, deal(row_blocks, 3).cast("int").alias("rb"), copies(query_blocks).alias("qb"))
    dealt_asked = asked.select("vec_id", "v", size, deal(query_blocks, 4).cast("int").alias("qb"), copies(row_blocks).alias("rb"))
    key = ("rb", "qb", "dims")
    best = dealt_asked.groupBy(*key).cogroup(dealt_rows.groupBy(*key)).applyInArrow(lambda a, b: block_best(a, b, k), SCHEMA)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
