"""Content-addressed store of token ids.

Ids of each document are cut where a rolling hash of the last 16 ids has its lowest bits zero, so equal passages are cut alike wherever they stand. A chunk's address is the
BLAKE2b hash of its bytes; the store holds each distinct chunk once. A document's recipe is its list of addresses and lengths; recipes stand in
ascending doc_id order (null first) with the number of ids before each document and the Merkle root of its addresses, and a manifest holds a root for each recipe
file and one over all.

Layout, all Parquet: ``log/kind=0`` (body: address, payload: little-endian ids, of 16 bits where the vocabulary allows it), ``log/kind=1`` (recipes as tasks finish them),
``recipes/`` (part, doc_id, start, n_tokens, root, entries: 16 bytes of address and 4 of length each), ``manifest/`` (part, documents, root; part -1 is the whole store).

Reading back: ``digests`` checks the recipes against the manifest (``check_manifest`` raises where they differ), hashes every stored payload again and needs only thin rows to give each document's CRC-32, as CRCs of pieces can be shifted and added;
``read_documents`` joins the payloads into whole id streams.

Defined cases: a null text counts as empty and has the end id only; rows that repeat are stored as documents of their own, of the same chunks; a null doc_id comes first;
an empty table makes an empty store; other columns are ignored. A payload that is missing or damaged leaves its documents in ``digests`` with ``verified`` false, and makes the
query fail; a missing or changed recipe makes both fail.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.byte_bpe import Encoder, default_file
from quillon.llm.common import cut, documents, fresh_dir, partitions
from quillon.llm.mixing import running

END = 2
WINDOW = 16
#: A chunk has LEAST to MOST ids; between them a cut comes at one id in MEAN.
LEAST, MEAN, MOST = 64, 256, 2048
#: Addresses that a writing task remembers, to send a payload once.
CACHED = 500_000
_A = 0x9E3779B97F4A7C15


def rolling(ids: np.ndarray) -> np.ndarray:
    """At each id the hash of the last 16 (fewer at the start), by doubling the window four times."""
    h = (ids.astype(np.int64) + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)  # -1 is nothing and hashes to 0
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    size, factor = 1, _A
    while size < WINDOW:
        moved = h * np.uint64(factor)
        new = h.copy()
        new[size:] += moved[:-size]
        h, size, factor = new, size * 2, factor * factor & (1 << 64) - 1
    return h


def all_cut_points(docs: list[np.ndarray]) -> list[list[int]]:
    """Ends of the chunks of each document's ids. Documents are hashed together, apart from each other by a window of nothing."""
    size = np.array([len(x) for x in docs], np.int64)
    begin = np.cumsum(size + WINDOW) - size - WINDOW
    flat = np.full(int(size.sum()) + WINDOW * len(docs), -1, np.int64)
    for at, ids in zip(begin.tolist(), docs):
        flat[at : at + len(ids)] = ids
    marks = np.flatnonzero((rolling(flat) >> np.uint64(40) & np.uint64(MEAN - 1) == 0) & (flat >= 0)) + 1
    of = np.searchsorted(marks, begin + 1).tolist(), np.searchsorted(marks, begin + size, side="right").tolist()
    out = []
    for at, n, i, j in zip(begin.tolist(), size.tolist(), *of):
        own, ends, last, k = (marks[i:j] - at).tolist(), [], 0, 0
        while n - last > LEAST:
            while k < len(own) and own[k] < last + LEAST:
                k += 1
            last = min(own[k] if k < len(own) else n, last + MOST, n)
            ends.append(last)
        if last < n:
            ends.append(n)
        out.append(ends)
    return out


def cut_points(ids: np.ndarray) -> list[int]:
    return all_cut_points([ids])[0]


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node goes up alone."""
    level = leaves or [b""]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _address(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def write_store(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> None:
    """Tokenises docs and writes the store to ``path``. Ids are shuffled once, by address, and sent at most once by a task."""
    spark, file = docs.sparkSession, tokenizer or default_file()
    n = partitions(spark)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = Encoder.of(file), set()
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                kind, key, doc, body, payload = [], [], [], [], []
                streams = [np.append(ids, ids.dtype.type(END)) for ids in encoder.encode(part.column(1).to_pylist())]
                for doc_id, ids, ends in zip(part.column(0).to_pylist(), streams, all_cut_points(streams)):
                    entries, last, whole, wide = [], 0, ids.tobytes(), ids.itemsize
                    for end in ends:
                        raw = whole[last * wide : end * wide]
                        address = _address(raw)
                        entries.append(address + (end - last).to_bytes(4, "little"))
                        last = end
                        if address not in seen:
                            if len(seen) >= CACHED:
                                seen.clear()
                            seen.add(address)
                            kind.append(0)
                            key.append(int.from_bytes(address[:8], "little", signed=True))
                            doc.append(None)
                            body.append(address)
                            payload.append(raw)
                    kind.append(1)
                    key.append(zlib.crc32(entries[0]) ^ len(kind))  # a recipe may go anywhere
                    doc.append(doc_id)
                    body.append(b"".join(entries))
                    payload.append(None)
                yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(key, pa.int64()), pa.array(doc, pa.int64()), pa.array(body, pa.binary()), pa.array(payload, pa.binary())], names=["kind", "key", "doc_id", "body", "payload"])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # of this partition's share of the addresses
        for b in batches:
            keep = []
            for kind, body in zip(b.column(0).to_pylist(), b.column(3).to_pylist()):
                keep.append(kind == 1 or body not in seen)
                if kind == 0:
                    seen.add(body)
            yield b.filter(pa.array(keep, pa.bool_()))

    schema = "kind int, key long, doc_id long, body binary, payload binary"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut_up, schema)
    log = rows.repartition(n, "key").mapInArrow(once, schema).drop("key")
    log.write.partitionBy("kind").option("compression", "snappy").parquet(f"{path}/log")
    _write_recipes(spark, path)


def _log(spark: SparkSession, path: str, kind: int) -> DataFrame:
    return spark.read.schema("doc_id long, body binary, payload binary, kind int").parquet(f"{path}/log").where(F.col("kind") == kind)


def _write_recipes(spark: SparkSession, path: str) -> None:
    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            entries = b.column(1).to_pylist()
            n = [int(np.frombuffer(e, "<u4").reshape(-1, 5)[:, 4].sum()) for e in entries]
            root = [merkle([e[i : i + 16] for i in range(0, len(e), 20)]) for e in entries]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(root, pa.binary()), b.column(1)], names=["doc_id", "n_tokens", "root", "entries"])

    recipes = _log(spark, path, 1).select("doc_id", "body").mapInArrow(sized, "doc_id long, n_tokens long, root binary, entries binary")
    ordered = running(recipes, [F.col("doc_id").asc_nulls_first(), F.col("root")], "n_tokens", "start")
    ordered.select(F.spark_partition_id().alias("part"), "doc_id", "start", "n_tokens", "root", "entries").write.option("compression", "zstd").parquet(f"{path}/recipes")

    spark.createDataFrame(_manifest(spark, path), "part int, documents long, root binary").coalesce(1).write.parquet(f"{path}/manifest")


def _manifest(spark: SparkSession, path: str) -> list[tuple[int, int, bytes]]:
    """What the recipes say: (part, documents, root) of each recipe file, and of the whole store as part -1."""

    def roots(key, part):
        part = part.sort_by("start")
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "documents": pa.array([part.num_rows], pa.int64()), "root": [merkle(part["root"].to_pylist())]})

    files = spark.read.parquet(f"{path}/recipes").select("part", "start", "root").groupBy("part").applyInArrow(roots, "part int, documents long, root binary").toArrow().sort_by("part")
    whole = (-1, sum(files["documents"].to_pylist()), merkle(files["root"].to_pylist()))  # one row for each recipe file
    return [*zip(*(files[c].to_pylist() for c in files.column_names)), whole]


def check_manifest(spark: SparkSession, path: str) -> None:
    """Raises unless every recipe file and the whole store have the documents and roots that the manifest names."""
    told = sorted((r.part, r.documents, bytes(r.root)) for r in spark.read.parquet(f"{path}/manifest").collect())  # one row for each recipe file
    if told != sorted((p, n, bytes(r)) for p, n, r in _manifest(spark, path)):
        raise ValueError(f"the recipes of {path} are not those of its manifest")


def _kind(tokenizer: str | None) -> np.dtype:
    return np.dtype(Encoder.of(tokenizer or default_file()).kind).newbyteorder("<")


def _uses(spark: SparkSession, path: str) -> DataFrame:
    """start, body (address), after (ids of the document behind the chunk), n: each place where a document uses a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start, body, after, size = [], [], [], []
            for s, e in zip(*(c.to_pylist() for c in b.columns)):
                n = np.frombuffer(e, "<u4").reshape(-1, 5)[:, 4].astype(np.int64)
                start += [s] * len(n)
                body += [e[i : i + 16] for i in range(0, len(e), 20)]
                after.append(n.sum() - np.cumsum(n))
                size.append(n)
            if start:
                yield pa.RecordBatch.from_arrays([pa.array(start, pa.int64()), pa.array(body, pa.binary()), pa.array(np.concatenate(after)), pa.array(np.concatenate(size))], names=["start", "body", "after", "n"])

    return spark.read.parquet(f"{path}/recipes").select("start", "entries").mapInArrow(run, "start long, body binary, after long, n long")


def _shifts() -> np.ndarray:
    """Row j: what each bit of a CRC-32 register becomes after 2^j zero bytes."""

    def apply(rows, v):
        out = 0
        for i in range(32):
            if v >> i & 1:
                out ^= rows[i]
        return out

    bit = [0xEDB88320, *(1 << i for i in range(31))]
    for _ in range(3):
        bit = [apply(bit, x) for x in bit]
    out = []
    for _ in range(48):
        out.append(bit)
        bit = [apply(bit, x) for x in bit]
    return np.array(out, np.uint32)


def shifted(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """CRC registers (without the usual inversions) after so many zero bytes."""
    out, table = crc.astype(np.uint32), _shifts()
    for j in range(int(zeros.max(initial=0)).bit_length()):
        on = np.flatnonzero(zeros >> j & 1)
        v, new = out[on], np.zeros(len(on), np.uint32)
        for i in range(32):
            new ^= np.where(v >> np.uint32(i) & np.uint32(1), table[j, i], np.uint32(0))
        out[on] = new
    return out


def ones_shifted(zeros: np.ndarray) -> np.ndarray:
    """The register of all ones after so many zero bytes; each count is worked out once."""
    counts, at = np.unique(zeros, return_inverse=True)
    return shifted(np.full(len(counts), 0xFFFFFFFF, np.uint32), counts)[at]


def digests(spark: SparkSession, path: str, tokenizer: str | None = None) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32 (of the ids as 32-bit integers), chunks, verified (every chunk was there and hashed to its address, the length and the Merkle root agree)."""
    kind = _kind(tokenizer)
    full = np.uint32(0xFFFFFFFF)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            address, raw = b.column(0).to_pylist(), b.column(1).to_pylist()
            ids = [np.frombuffer(x, kind).astype("<u4") for x in raw]
            size = np.array([len(x) for x in ids], np.int64)
            crc = np.array([zlib.crc32(x.tobytes()) for x in ids], np.uint32) ^ full ^ ones_shifted(4 * size)
            good = [_address(x) == a for a, x in zip(address, raw)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(crc.astype(np.int64)), pa.array(size), pa.array(good, pa.bool_())], names=["body", "crc", "size", "good"])

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc = shifted(b.column(1).to_numpy().astype(np.uint32), 4 * b.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(crc.astype(np.int64)), b.column(3), b.column(4)], names=["start", "crc", "n", "good"])

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, start, n, root, entries, crc, read, count = b.columns[:8]
            size = n.to_numpy()
            whole = crc.to_numpy().astype(np.uint32) ^ ones_shifted(4 * size) ^ full
            leaves = [[e[i : i + 16] for i in range(0, len(e), 20)] for e in entries.to_pylist()]
            good = [len(x) == c and r == s and merkle(x) == t for x, c, r, s, t in zip(leaves, count.to_pylist(), read.to_pylist(), size.tolist(), root.to_pylist())]
            yield pa.RecordBatch.from_arrays([doc, start, n, pa.array(whole.astype(np.int64)), count, pa.array(good, pa.bool_())], names=["doc_id", "start", "n_tokens", "ids_crc32", "chunks", "verified"])

    check_manifest(spark, path)
    chunks = _log(spark, path, 0).select("body", "payload").mapInArrow(hashed, "body binary, crc long, size long, good boolean")
    good = F.coalesce(F.col("good") & (F.col("size") == F.col("n")), F.lit(False))  # a chunk that is gone makes its documents unverified, not absent
    met = _uses(spark, path).join(cut(chunks), "body", "left").select("start", F.coalesce("crc", F.lit(0)).alias("crc"), "after", F.coalesce("size", F.lit(0)).alias("n"), good.alias("good"))
    of = met.mapInArrow(moved, "start long, crc long, n long, good boolean").groupBy("start").agg(F.bit_xor("crc").alias("crc"), F.sum("n").alias("read"), F.count_if("good").alias("count"))
    recipes = spark.read.parquet(f"{path}/recipes").select("doc_id", "start", "n_tokens", "root", "entries")
    seen = [F.coalesce(c, F.lit(0)).alias(c) for c in ("crc", "read", "count")]
    joined = recipes.join(of, "start", "left").select("doc_id", "start", "n_tokens", "root", "entries", *seen)
    return joined.mapInArrow(checked, "doc_id long, start long, n_tokens long, ids_crc32 long, chunks long, verified boolean")


def read_documents(spark: SparkSession, path: str, tokenizer: str | None = None) -> DataFrame:
    """doc_id, start, ids: the whole id streams, put together from their chunks."""
    kind = _kind(tokenizer)

    def together(key, part):
        raw = b"".join(part.sort_by([("after", "descending")])["payload"].to_pylist())
        return pa.table({"start": [key[0].as_py()], "ids": pa.array([np.frombuffer(raw, kind).astype(np.int32)], pa.list_(pa.int32()))})

    met = _uses(spark, path).join(_log(spark, path, 0).select("body", "payload"), "body").select("start", "after", "payload")
    streams = met.groupBy("start").applyInArrow(together, "start long, ids array<int>")
    return spark.read.parquet(f"{path}/recipes").select("doc_id", "start").join(streams, "start").select("doc_id", "start", "ids")


def op2_chunk_store(spark, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "store")
    write_store(documents(spark, sf_dir), path)
    found = digests(spark, path)
    broken = F.raise_error(F.concat(F.lit("not verified: the document that starts at id "), F.col("start").cast("string")))
    # In both columns, so that no selection leaves the check out.
    return found.withColumns({"ids_crc32": F.when(F.col("verified"), F.col("ids_crc32")).otherwise(broken.cast("long")), "verified": F.when(F.col("verified"), F.lit(True)).otherwise(broken.cast("boolean"))})


SQL: dict[str, str] = {}
QUERIES = {"op2_chunk_store": op2_chunk_store}
