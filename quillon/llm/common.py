"""What the training-data operators share: words, normal form, shared folder, lineage cuts."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: A-Z to a-z on UTF-8 bytes; other bytes stay.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: One word: any run without ASCII white space. On UTF-8 bytes, bytes.split() finds the same words.
WORD = r"[^\x20\x09-\x0D]+"


def normal(text: Column) -> Column:
    """The text with A-Z lower-cased; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def id_crc32(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, 0 for a null id."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where it is unset we set one, in the warehouse."""
    sc = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(told or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/quillon-checkpoints")
    return told or sc.getCheckpointDir()


def fresh_dir(spark: SparkSession, kind: str) -> str:
    """A new place below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and read back from the shared folder, so a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def _trim() -> None:
    """Freed memory goes back to the system, where the C library can do so."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def forgetful(run: Callable, *forget: Callable[[], None]) -> Callable:
    """``run`` for mapInArrow. When a task's rows are through, ``forget`` drops what the worker remembers, since workers live on through later stages."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for f in forget:
                f()
            _trim()

    return task


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_sized(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows joined to their group. groups: key, size (rows of the group) and what else it brings; rows: to be read twice; total: all rows.

    A group of more than total / 2^16 rows (there are fewer than 2^16 of them) is broadcast, so a hot key's rows stay where they are; all others meet by a shuffle.
    """
    bound = max(1000, total >> 16)
    hot = F.broadcast(groups.where(F.col(size) > bound))
    rest = rows.join(hot.select(key), key, "left_anti").join(groups.where(F.col(size) <= bound), key)
    return rows.join(hot, key).unionByName(rest)


def row_hashes(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of a whole row that differ where only nulls or their places do. Nested values are hashed as JSON with their nulls."""
    nested = lambda t: isinstance(t, T.ArrayType | T.MapType | T.StructType)
    flat = [F.to_json(F.struct(f"`{f.name}`"), {"ignoreNullFields": "false"}) if nested(f.dataType) else F.col(f"`{f.name}`") for f in df.schema]
    gaps = F.concat_ws("", *[F.col(f"`{c}`").isNull().cast("int").cast("string") for c in df.columns])
    return [F.xxhash64(*flat, gaps).alias("q_h1"), F.xxhash64(F.lit(1), *flat, gaps).alias("q_h2")]


def packed(df: DataFrame, *more: Column, row: str = "q_row") -> DataFrame:
    """All columns as one struct, so that no name of theirs can clash with ours, and what is computed from them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(row), *more)
