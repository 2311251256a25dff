"""Intermediate tables that several steps read, in the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.runtime import removed_at_exit, shared_folder


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back.

    Unlike a cached frame it survives the loss of an executor and is not computed
    again by each reader. The table is removed when the driver ends.
    """
    spark = df.sparkSession
    path = removed_at_exit(spark, f"{shared_folder(spark)}/folio-{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_sample(df: DataFrame, key: str, rows: int) -> list:
    """About ``rows`` rows (all, if there are fewer) with the smallest hashes of ``key``, as a list; for fitting models only.

    A count sets the share of hashes that is read, so tasks send about ``rows``
    rows to the driver together, not each.
    """
    total = df.count()
    if not total:
        return []
    limit = (1 << 63) * min(1.0, 1.2 * rows / total)
    hashed = df.withColumn("_h", F.xxhash64(key).bitwiseAND(F.lit((1 << 63) - 1)))
    found = hashed.where(F.col("_h") < F.lit(min(int(limit), (1 << 63) - 1))).collect()
    return sorted(found, key=lambda r: r["_h"])[:rows]


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where a plain scan has fewer partitions than the session has cores, as with one small file.

    Larger inputs have more partitions than that and are left alone, as is
    anything but a plain scan, so nothing runs and nothing large is shuffled.
    """
    spark = df.sparkSession
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "Exchange" in plan or "Adaptive" in plan or "FileScan" not in plan:
        return df
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
