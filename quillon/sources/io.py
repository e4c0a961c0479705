"""Scans, sinks and provenance. Filters and column lists reach the Parquet scan; sinks are zstd Parquet by partition."""

from __future__ import annotations

import hashlib
import json
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators.bars import DataContractError, validate

MINUTE_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType()), *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume", "wap")], T.StructField("bar_count", T.LongType()), T.StructField("contract_con_id", T.LongType()),
    T.StructField("contract_expiry", T.LongType()), T.StructField("local_symbol", T.StringType()), T.StructField("root", T.StringType()),
])


def load_minutes(spark: SparkSession, path: str, roots: list[str] | None = None, check: bool = True) -> DataFrame:
    """Minute bars of some instruments, validated: schema, nulls, keys."""
    found = spark.read.parquet(path)
    if [(f.name, f.dataType) for f in found.schema] != [(f.name, f.dataType) for f in MINUTE_SCHEMA]:
        raise DataContractError(f"{path}: {found.schema.simpleString()}")
    found = found if roots is None else found.where(F.col("root").isin(roots))
    if check:
        validate(found, MINUTE_SCHEMA, ["root", "timestamp"], roots)
    return found


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, since: str | None = None, until: str | None = None, on: str = "timestamp", with_file: bool = False) -> DataFrame:
    """A pruned scan of one file, a folder or a wildcard path, with a half-open range that reaches the scan."""
    df = spark.read.parquet(path)
    df = df if since is None else df.where(F.col(on) >= F.lit(since))
    df = df if until is None else df.where(F.col(on) < F.lit(until))
    df = df if columns is None else df.select(*columns, *([F.input_file_name().alias("file")] if with_file else []))
    return df


def load_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, timestampFormat="yyyy-MM-dd HH:mm:ss")


def save(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    """zstd Parquet, by partition columns where given; with them, only the partitions that df has are replaced."""
    w = df.write.mode(mode).option("compression", "zstd")
    if by:
        w = w.partitionBy(*by).option("partitionOverwriteMode", "dynamic")
    w.parquet(path)


def save_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes, sha256 of every file below a path, hashed by the tasks that read them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [hashlib.sha256(x).hexdigest() for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sums, pa.string())], names=["file", "bytes", "sha256"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("bytes"), "content").mapInArrow(run, "file string, bytes long, sha256 string")


def manifest(spark: SparkSession, inputs: str, config: dict, repo: str = ".") -> str:
    """JSON of input hashes, configuration and commit."""
    git = subprocess.run(["git", "-C", repo, "rev-parse", "HEAD"], capture_output=True, text=True)
    files = [r.asDict() for r in file_hashes(spark, inputs).orderBy("file").collect()]  # one row a file
    return json.dumps({"commit": git.stdout.strip() or None, "config": config, "config_sha256": hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest(), "inputs": files}, indent=1, sort_keys=True)


def markdown(df: DataFrame, digits: int = 4, rows: int = 200) -> str:
    """A small report table."""
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    found = df.limit(rows).collect()
    lines = [df.columns, ["---"] * len(df.columns), *[[show(v) for v in r] for r in found]]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)
