"""Lineage cuts in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder in the warehouse."""
    sc, told = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(told or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/quillon-checkpoints")
    return told or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and read back from the shared folder, so that a lost executor loses nothing."""
    _folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, but as a table that forgets how it came about: what the optimizer knows of a checkpoint's columns grows in loops that join it again and again."""
    path = f"{_folder(df.sparkSession).rstrip('/')}/turn-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered_rows(df: DataFrame, order: list, out: str = "i") -> tuple[DataFrame, int]:
    """df with a column ``out``, the row's number from 0 in the global order, and the number of rows. Rows are sorted by ranges; only a number a range goes through the driver."""
    sorted_ = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("q_part", F.spark_partition_id()))
    counts = sorted_.groupBy("q_part").count().orderBy("q_part").collect()
    first, total = {}, 0
    for r in counts:
        first[r["q_part"]], total = total, total + r["count"]
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    start = F.element_at(F.create_map(*[F.lit(x) for p, n in first.items() for x in (p, n)]), F.col("q_part")) if first else F.lit(0)
    return sorted_.withColumn(out, (start + inside).cast("long")).drop("q_part"), total
