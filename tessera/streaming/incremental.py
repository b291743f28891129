"""Work that runs again when inputs arrive: once for each input, in micro-batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.cohort import pending
from tessera.plans.runtime import Scratch


def run_step(work: DataFrame, done_path: str, keys: Sequence[str], step: str, process: Callable[[DataFrame], DataFrame], force: bool = False, out: str | None = None) -> DataFrame:
    """Process what the completion table lacks and add it there. ``process`` gives the keys
    and ``error`` (NULL where it went well); rows with errors stay to be done.

    The result is written before anything is marked as done: below ``out``, a folder for
    each run, or in the shared folder. A run that breaks off in between is done again."""
    spark = work.sparkSession
    schema = work.select(*keys).withColumn("step", F.lit(step)).schema
    try:
        done = spark.read.schema(schema).parquet(done_path).where(F.col("step") == step)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = spark.createDataFrame([], schema)
    result = process(pending(work, done, keys, force))
    if out is None:
        result = Scratch(spark, f"step-{step}").save(result, "result")
    else:
        own, made = f"{out}/run-{uuid.uuid4().hex}", result.schema
        result.write.parquet(own)
        result = spark.read.schema(made).parquet(own)
    result.where(F.col("error").isNull()).select(*keys, F.lit(step).alias("step")).write.mode("append").parquet(done_path)
    return result


def stream_new(spark: SparkSession, folder: str, schema, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Each Parquet file that arrives in the folder is processed once; ends when all are.
    The checkpoint remembers which are done, also across restarts."""
    source = spark.readStream.schema(schema).parquet(folder)
    return process(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def running_moments(stream: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Count, sum and sum of squares so far: what means and variations are made of."""
    v = F.col(value)
    return stream.where(v.isNotNull()).groupBy(*by).agg(F.count(v).alias("n"), F.sum(v).alias("s1"), F.sum(v * v).alias("s2"))


def variation_of_moments(moments: DataFrame) -> DataFrame:
    """Mean and coefficient of variation from running sums."""
    mean = F.col("s1") / F.col("n")
    var = F.greatest(F.try_divide(F.col("s2") - F.col("n") * mean * mean, F.col("n") - 1), F.lit(0.0))
    return moments.withColumn("mean", mean).withColumn("cov", F.try_divide(F.sqrt(var), F.abs(mean)))


def stream_volumes(spark: SparkSession, folder: str, process: Callable[[DataFrame], DataFrame], out: str, state: str, **options: str):
    """Process the volumes of a folder's NIfTI sets that were written since the last start,
    each once; a volume that is written again is processed again. Returns the ended query's
    handle to wait for."""
    from tessera.sources import nifti_source

    nifti_source.register(spark)
    stream = process(spark.readStream.format("nifti").options(**options).load(folder))
    return stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
