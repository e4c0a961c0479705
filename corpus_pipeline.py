"""The corpus pipeline: quality, exact copies, near copies, mix, token ids. Part of the llm subpackage.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps, whole, so its decisions hold for all later stages; the last returns digests of ids.
Each works on all rows that its predecessor kept.

Null texts count as empty, rows that repeat are rows of their own until the copy stages drop them, empty tables pass through, and further columns of
documents are carried whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import documents, fresh_dir, labels
from quillon.llm.exact_dedup import drop_exact_copies
from quillon.llm.mixing import mixed_documents
from quillon.llm.near import drop_similar
from quillon.llm.piece_bpe import encoded_digests
from quillon.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7, learned from the labels of these documents: those with a score below 0.7 go."""
    return keep_good(docs, labels(spark, sf_dir))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of equal texts the largest doc_id stays."""
    return drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9's work at shingles of five words and similarity 0.8 or more: of each component the smallest doc_id stays."""
    return drop_similar(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: a document comes as often as the mix takes it, 0 to 3 times."""
    return mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    return encoded_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mix", mix),
    ("token_ids", token_ids),
]
#: Support vectors and connected components have no SQL form; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet to the shared folder and read again by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = fresh_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
