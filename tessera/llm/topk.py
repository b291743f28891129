"""Exact top-k search: tiled integer matrix products, partial selection, tree merging.

Queries are dealt to blocks and candidates to shards; a tile is one block against one
shard. Both sides are copied to their tiles by key, so nothing is broadcast, and a tile
gives only its best k a query. Partial lists are merged over shards in a tree.

Cases: vectors that are null or hold null or non-finite components take no part; vectors
meet only those of their own length; ties go to the smaller id; a row never meets itself; a
query without candidates gives no row, and so does an empty table; other columns, whatever
their names, are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.runtime import ship

#: Rows of a tile: queries and candidates. A candidate is sent once for each block of queries.
BLOCK, SHARD = 8192, 8192
#: Queries and candidates of a tile that are multiplied at once.
PIECE = (1024, 4096)
#: Partial lists merged at once.
FAN_IN = 32
_EXACT = float(1 << 53)


def quantise(vector: Column, scale: int = 256) -> Column:
    """floor(scale * component), components as double; null where a component is no number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    return F.when(vector.isNotNull() & finite, scaled)


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=np.int64).reshape(len(flat), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles while every sum stays below 2**53."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of each row's k best: higher score first, then the earlier position."""
    n = scores.shape[1]
    if n > 4 * k and float(np.abs(scores).max(initial=0)) * n < float(1 << 62):
        keys = scores * -n + np.arange(n)  # one order for score and position
        found = np.argpartition(keys, k - 1, axis=1)[:, :k]
        return np.take_along_axis(found, np.argsort(np.take_along_axis(keys, found, axis=1), axis=1), axis=1)
    return np.argsort(-scores, axis=1, kind="stable")[:, :k]


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "vector",
) -> DataFrame:
    """Each query's k best: query_id, rank, id, score. ``vector_col`` holds arrays of long.

    A query is an id; rows with its id are no candidates for it, copies of its vector under
    other ids are. Where an id repeats, its smallest vector asks.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.size(vector_col).alias("dim"), is_query.alias("asks")
    )
    total, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    blocks, shards = max(1, math.ceil(asking / BLOCK)), max(1, math.ceil(total / SHARD))
    spread = F.xxhash64("id", "v")
    queries = rows.where("asks").groupBy("id").agg(F.min("v").alias("v"), F.min_by("dim", "v").alias("dim")).select(
        F.lit(True).alias("q"), "id", "v", "dim", F.pmod(spread, F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    )
    candidates = rows.select(
        F.lit(False).alias("q"), "id", "v", "dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(spread, F.lit(shards)).cast("int").alias("shard")
    )

    def tile(t: pa.Table) -> pa.Table:
        asks = t["q"].to_numpy()
        ask = t.filter(pa.array(asks)).sort_by("id")
        have = t.filter(pa.array(~asks)).sort_by("id")
        out = []
        if len(ask) and len(have):
            ids, of = have["id"].to_numpy(), ask["id"].to_numpy()
            a, b = _matrix(ask["v"]), _matrix(have["v"])
            own_rows = int(np.unique(ids, return_counts=True)[1].max())  # a query's own rows may be among its best
            for x in range(0, len(a), PIECE[0]):
                mine, best = of[x : x + PIECE[0], None], None
                for y in range(0, len(b), PIECE[1]):
                    scores = products(a[x : x + PIECE[0]], b[y : y + PIECE[1]])
                    found = _best(scores, k + own_rows)
                    new = (np.take_along_axis(scores, found, axis=1), ids[y : y + PIECE[1]][found])
                    best = new if best is None else tuple(np.concatenate(p, axis=1) for p in zip(best, new, strict=True))
                    order = np.lexsort((best[1], -best[0], best[1] == mine))[:, :k]  # a query's own rows last
                    best = tuple(np.take_along_axis(p, order, axis=1) for p in best)
                real = best[1] != mine
                out.append((np.broadcast_to(mine, real.shape)[real], best[1][real], best[0][real]))
        columns = [np.concatenate([o[n] for o in out]) if out else np.zeros(0, np.int64) for n in range(3)]
        where = [np.full(len(columns[0]), t[c][0].as_py()) for c in ("block", "shard")]
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "id", "score", "block", "shard"), [*columns, *where], strict=True)})

    parts = queries.unionByName(candidates).groupBy("block", "shard", "dim").applyInArrow(tile, "query_id long, id long, score long, block long, shard long")
    best = F.struct((-F.col("score")).alias("less"), F.col("id").alias("id"))
    level = parts
    while True:  # up the tree: FAN_IN lists become one
        width = shards
        shards = math.ceil(shards / FAN_IN)
        level = (
            level.withColumn("shard", F.floor(F.col("shard") / FAN_IN))
            .groupBy("query_id", "shard")
            .agg(F.slice(F.array_sort(F.collect_list(best)), 1, k).alias("top"))
            .select("query_id", "shard", F.explode("top").alias("b"))
            .select("query_id", "shard", (-F.col("b.less")).alias("score"), F.col("b.id").alias("id"))
        )
        if width <= FAN_IN:
            break
    return (
        level.groupBy("query_id")
        .agg(F.array_sort(F.collect_list(best)).alias("top"))
        .select("query_id", F.posexplode("top").alias("pos", "b"))
        .select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), (-F.col("b.less")).alias("score"))
    )
