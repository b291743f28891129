"""Connected components of a distributed edge table by alternating star contractions.

Each round every node hands its larger neighbours to its smallest one, then its smaller
neighbours to the smallest of them; rounds are logarithmic in practice, and nothing but a
count and a checksum comes to the driver. Lineage is cut each round in the shared folder;
the smallest neighbours are written before rows of a hub meet them, so that Spark sees a
hub's rows as skew and splits them.

Cases: edges with a null end or from a node to itself are left out; repeated edges count
once; without edges there are no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.runtime import Scratch


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "w"))).first()
    return row[0], row[1] or 0


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``node`` and ``label``, the smallest node reachable; nodes without edges are absent.
    ``edges`` has columns ``a`` and ``b`` of long."""
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("w")).distinct()
    now = scratch.save(now, f"{name}-0")
    before, k = _state(now), 0
    while True:
        both = now.unionByName(now.select(F.col("w").alias("u"), F.col("u").alias("w")))
        least = scratch.save(both.groupBy("u").agg(F.min("w").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-least")
        large = scratch.save(both.join(least, "u").where("w > u").select(F.col("w").alias("u"), F.col("m").alias("w")).distinct(), f"{name}-large")
        inner = scratch.save(large.groupBy("u").agg(F.min("w").alias("m")), f"{name}-inner")
        small = large.join(inner, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("w")), F.struct(F.col("w").alias("u"), F.col("m").alias("w")))).alias("e"))
        k += 1
        then = scratch.save(small.select("e.u", "e.w").where("u <> w").distinct(), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}", f"{name}-least", f"{name}-large", f"{name}-inner")
        after = _state(then)
        now = then
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("w").alias("label")).unionByName(now.select(F.col("w").alias("node"), F.col("w").alias("label")).distinct())
        before = after
