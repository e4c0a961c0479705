"""Token counts of documents in flat token files, by a separator scan.

A flat file is little-endian ids only, an end-of-document id behind each document, without an index. Files are read in blocks of equal length, any block by any task. A block's
separators are found with one vectorised comparison. Blocks know nothing of each other, so a prefix scan over (separators, position of the last one) gives each block the
number of documents before it and where its first document began; a document may start many blocks before it ends. The scan runs within runs of
``SCANNED`` blocks and then over the runs, so that one huge file isn't one task.

Defined cases: a separator right behind another is an empty document (count 0); tokens behind a file's last separator are a last document with ended false; an empty file has no
documents; a length that is no multiple of an id's is an error. For documents: a null text counts as empty, a null doc_id is kept, rows that repeat are documents
of their own, the strings of special tokens are ordinary text, an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.byte_bpe import Encoder, default_file
from quillon.llm.common import cut, documents, fresh_dir, partitions

END = 50256
BLOCK_IDS = 1 << 20
SCANNED = 1024


def _open(path: str):
    """The file system of a shared path, and the path in it."""
    from pyarrow import fs

    uri = "file:///" + path[6:].lstrip("/") if path.startswith("file:/") else path
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), path)


def write_flat(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end: int = END) -> DataFrame:
    """One flat file of 16-bit ids for each task, in its order of rows. Returns (file, ordinal, doc_id), as committed: a file of a lost attempt is never named."""
    spark, vocabulary = docs.sparkSession, tokenizer or default_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary, True)
        if encoder.kind is not np.uint16:
            raise ValueError("flat files hold 16-bit ids")
        system, folder = _open(path)
        system.create_dir(folder, recursive=True)
        name, out, n = f"{uuid.uuid4().hex}.ids", None, 0
        for b in batches:
            out = out or system.open_output_stream(f"{folder}/{name}")
            for i in range(0, b.num_rows, 256):
                ids = b.column(0).slice(i, 256)
                for tokens in encoder.encode(b.column(1).slice(i, 256).to_pylist()):
                    out.write(tokens.astype("<u2").tobytes() + end.to_bytes(2, "little"))
                order = np.arange(n, n + len(ids))
                n += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}"] * len(ids)), pa.array(order), ids], names=["file", "ordinal", "doc_id"])
        if out:
            out.close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows.mapInArrow(run, "file string, ordinal long, doc_id long").write.parquet(f"{path}/written")
    return spark.read.parquet(f"{path}/written")


def count_tokens(files: DataFrame, end: int = END, block_ids: int = BLOCK_IDS) -> DataFrame:
    """files: distinct (file). Returns (file, ordinal, n_tokens, ended): the tokens of each document without its separator."""
    spark = files.sparkSession

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = []
            for path in b.column(0).to_pylist():
                system, name = _open(path)
                size = system.get_file_info(name).size
                if size % 2:
                    raise ValueError(f"{path} does not hold whole 16-bit ids")
                n.append(size // 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["file", "ids"])

    def separators(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, block, ids in zip(*(c.to_pylist() for c in b.columns)):
                system, name = _open(path)
                with system.open_input_file(name) as f:
                    first = block * block_ids
                    f.seek(2 * first)
                    found = np.flatnonzero(np.frombuffer(f.read(2 * min(block_ids, ids - first)), "<u2") == end) + first
                last = int(found[-1]) if len(found) else None
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((path, pa.string()), (block, pa.int64()), (len(found), pa.int64()), (last, pa.int64()), (ids, pa.int64()), (found.astype("<i8").tobytes(), pa.binary()))], names=["file", "block", "n", "last", "ids", "at"])

    n = partitions(spark)
    blocks = files.repartition(n).mapInArrow(sizes, "file string, ids long").where("ids > 0").select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(ids - 1) div {block_ids}"))).alias("block"), "ids")
    found = cut(blocks.repartition(n).mapInArrow(separators, "file string, block long, n long, last long, ids long, at binary"))

    thin = found.select("file", "block", "n", "last", F.expr(f"block div {SCANNED}").alias("run"))
    before = lambda *by, order: W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    own = before("file", "run", order="block")
    inner = thin.select("file", "block", "run", F.coalesce(F.sum("n").over(own), F.lit(0)).alias("docs"), F.max("last").over(own).alias("prev"))
    runs = thin.groupBy("file", "run").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    over = before("file", order="run")
    outer = runs.select("file", "run", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("run_docs"), F.max("last").over(over).alias("run_prev"))
    scan = inner.join(outer, ["file", "run"]).select("file", "block", (F.col("docs") + F.col("run_docs")).alias("docs"), F.coalesce("prev", "run_prev", F.lit(-1)).cast("long").alias("prev"))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, block, ids, at, docs, prev in zip(*(c.to_pylist() for c in b.columns)):
                at = np.frombuffer(at, "<i8")
                n, ended = np.diff(at, prepend=prev) - 1, np.ones(len(at), bool)
                tail = ids - 1 - (int(at[-1]) if len(at) else prev)
                if (block + 1) * block_ids >= ids and tail > 0:  # the last block of a file that doesn't end with a separator
                    n, ended = np.append(n, tail), np.append(ended, False)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(n), pa.string()), pa.array(docs + np.arange(len(n)), pa.int64()), pa.array(n, pa.int64()), pa.array(ended)], names=["file", "ordinal", "n_tokens", "ended"])

    joined = found.select("file", "block", "ids", "at").join(scan, ["file", "block"]).select("file", "block", "ids", "at", "docs", "prev")
    return joined.mapInArrow(counts, "file string, ordinal long, n_tokens long, ended boolean")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count, from flat files written here."""
    written = write_flat(documents(spark, sf_dir), fresh_dir(spark, "flat"))
    counts = count_tokens(written.select("file").distinct())
    return written.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")


SQL: dict[str, str] = {}
QUERIES = {"op10_token_counts": op10_token_counts}
