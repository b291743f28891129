"""A cohort study end to end: which subjects, their metrics, and the statistics.

``python -m tessera.plans.study TABLES OUT [--step NAME]`` reads Parquet tables ``volume``
(subject, method, tissue, space, data), ``exclusion`` and ``reference`` settings, and
writes a table for each step where later steps find it.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import cohort, metrics, statistics


@dataclass(frozen=True)
class Study:
    """Settings of a study."""

    methods: tuple[str, ...] = ("mr", "ct_plain", "ct_new")
    silver: str = "mr"
    tissues: tuple[str, ...] = ("GM", "WM", "CSF")
    threshold: float = 0.5
    alpha: float = 0.05
    voxel_mm3: float = 1.0
    dim: tuple[int, int, int] | None = None  # of the native volumes; without it no distances
    size: tuple[float, float, float] = (1.0, 1.0, 1.0)
    only: tuple[str, ...] = field(default=())
    first: int | None = None


def subjects(volume: DataFrame, exclusion: DataFrame, study: Study) -> DataFrame:
    """Subjects with every method and tissue, less the excluded."""
    kept = cohort.exclude(volume.select("subject").distinct(), exclusion)
    cells = volume.where(F.col("tissue").isin(*study.tissues)).groupBy("subject").agg(F.countDistinct("method", "tissue").alias("n"))
    whole = cells.where(F.col("n") == len(study.methods) * len(study.tissues)).select("subject")
    kept = kept.join(whole, "subject", "left_semi")
    if study.only:
        kept = cohort.only(kept, kept.sparkSession.createDataFrame([(s,) for s in study.only], "subject string"))
    return kept if study.first is None else cohort.first_n(kept, study.first)


def overlap(volume: DataFrame, chosen: DataFrame, study: Study) -> DataFrame:
    """Dice and distances of each method against the silver standard, by subject and tissue."""
    keys = ("subject", "tissue", "method")
    native = volume.where(F.col("space") == "native").join(chosen, "subject", "left_semi").select(*keys, metrics.mask_of(F.col("data"), study.threshold).alias("_mask"))
    silver = native.where(F.col("method") == study.silver).select("subject", "tissue", F.col("_mask").alias("_silver"))
    met = native.where(F.col("method") != study.silver).join(silver, ["subject", "tissue"])
    long = lambda df, *names: df.unpivot(list(keys), list(names), "metric", "value")
    found = long(metrics.dice_masks(met, keys, "_mask", "_silver"), "dice")
    if study.dim is not None:
        found = found.unionByName(long(metrics.distances_tiles(met, keys, "_mask", "_silver", study.dim, study.size), "hd95", "assd"))
    return found


def volumes(volume: DataFrame, chosen: DataFrame, study: Study) -> DataFrame:
    modulated = volume.where(F.col("space") == "modulated").join(chosen, "subject", "left_semi")
    return metrics.volumes_ml(modulated, ("subject", "method"), "tissue", "data", study.voxel_mm3, study.tissues[:2], study.tissues)


def compare(metric: DataFrame, a: str, b: str, study: Study) -> DataFrame:
    """Two methods paired by subject: quartiles, signed-rank p (Bonferroni), marker."""
    side = lambda m, name: metric.where(F.col("method") == m).select("subject", "tissue", "metric", F.col("value").alias(name))
    pairs = side(a, "x").join(side(b, "y"), ["subject", "tissue", "metric"])
    by = ("metric", "tissue")
    q = statistics.hazen(pairs, by, "x", (0.25, 0.5, 0.75), ("x25", "x50", "x75")).join(statistics.hazen(pairs, by, "y", (0.25, 0.5, 0.75), ("y25", "y50", "y75")), list(by))
    p = statistics.signed_rank_test(pairs, by, "x", "y").select(*by, statistics.bonferroni(F.col("p"), len(study.tissues)).alias("p"))
    out = q.join(p, list(by), "left")
    return out.withColumn("mark", statistics.better_flag(F.col("metric"), F.col("p"), F.col("x50"), F.col("y50"), study.alpha))


def agreement(volumetrics: DataFrame, silver: str, value: str) -> DataFrame:
    """Each method's volumes against the silver standard's."""
    x = volumetrics.where(F.col("method") == silver).select("subject", F.col(value).alias("x"))
    pairs = volumetrics.where(F.col("method") != silver).select("subject", "method", F.col(value).alias("y")).join(x, "subject")
    limits = statistics.bland_altman(pairs, ("method",), "x", "y").select("method", "bias", F.col("lower").alias("limit_low"), F.col("upper").alias("limit_high"))
    return statistics.icc_interval(pairs, ("method",), "x", "y").join(limits, "method").join(statistics.correlation(pairs, ("method",), "x", "y").drop("n"), "method")


STEPS = ("subjects", "overlap", "volumes", "comparison", "agreement")


def run(spark: SparkSession, tables: str, out: str, study: Study, steps: tuple[str, ...] = STEPS) -> None:
    """Steps in order, each written; a step on its own reads what earlier ones wrote."""
    volume, exclusion = spark.read.parquet(f"{tables}/volume"), spark.read.parquet(f"{tables}/exclusion")
    read = lambda name: spark.read.parquet(f"{out}/{name}")
    rest = [m for m in study.methods if m != study.silver]
    make = {
        "subjects": lambda: subjects(volume, exclusion, study),
        "overlap": lambda: overlap(volume, read("subjects"), study),
        "volumes": lambda: volumes(volume, read("subjects"), study),
        "comparison": lambda: compare(read("overlap"), rest[0], rest[-1], study),
        "agreement": lambda: agreement(read("volumes"), study.silver, "tbv_ml"),
    }
    for name in STEPS:
        if name in steps:
            make[name]().write.mode("overwrite").parquet(f"{out}/{name}")


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("tables")
    args.add_argument("out")
    args.add_argument("--step", choices=STEPS)
    args.add_argument("--first", type=int, help="only so many subjects, as a test")
    got = args.parse_args()
    run(SparkSession.builder.getOrCreate(), got.tables, got.out, Study(first=got.first), (got.step,) if got.step else STEPS)


if __name__ == "__main__":
    main()
