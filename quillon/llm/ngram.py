"""LM scoring by deleted interpolation.

p(w | v) = a2[b] f(v w) / f(v) + a1[b] c(w) / N + a0[b] / (V + 1), where b is a bucket of the context's frequency f(v) (powers of two). A part of the training documents is held
out ("deleted"): n-grams are counted on the rest, and expectation-maximisation on the deleted part's counts learns the three weights of every bucket. Scores then use
the counts of all training documents. A text is its words and one end; the first word's context is the start.

Every word is a context, and all counts are taken in full and grow with the corpus. A table of at most ``TABLE`` frequent words is broadcast so that most occurrences can travel as small numbers; what is in
it changes the work and never the result:

- both words among the ``HEAD`` most frequent: the occurrences stay with their documents, only the counts of these few pairs are added up and broadcast, so hot pairs don't meet anywhere;
- both in the table: dealt to the partition of the pair, which counts it;
- only the context in it: dealt by the word, whose partition counts the word and the pair; only the word in it: dealt by the context, likewise;
- neither in it: such occurrences are counted at both places, and the rows themselves (about one token of a hundred) are joined to the counts of all words.

Occurrences are combined by pair and document and travel as packed blocks; a block is some
documents of one scan task. What a partition finds for a block's documents goes back to the block and is added up there.

Words are told apart by 64-bit hashes. The deleted part's counts are binned by eighths of a power of two for the weights only.

Defined cases: a null text counts as empty and has its end only; a null doc_id has crc32 0, so it trains; rows that repeat a doc_id each get a row and each count;
without training documents the model is uniform, p = 1 / (V + 1) = 1, and base_score is 0; without deleted documents the weights are equal; every weight has a prior count of one, so no estimate, and no score, is minus infinity; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.common import LOWER_BYTES, cut, documents, fresh_dir, id_crc32, partitions

#: Words in the broadcast table at most (24 bytes each), and how many of these are the head.
TABLE, HEAD = 1 << 17, 128
#: The training documents' remainder (of 7) that is deleted from the counts while the weights are learned.
DELETED = 3
#: A head pair is numbered by context and word; the start is a context of the head.
HEAD_CODES = HEAD + 1
BLOCK_TOKENS = 1 << 19
CACHED = 200_000
#: A partition's keys fall into so many groups, which it counts one after the other.
GROUPS = 4
BINS = 8
_IDS = 18  # bits of a table index
_DOCS = 24  # bits of a document's number in its block
_END = 0x656E64  # stands for the end; a word's hash is never so small but by chance
_hashes: dict[bytes, int] = {}


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's words and its end."""
    from xxhash import xxh64_intdigest

    known, out = _hashes.get, []
    for w in (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split():
        h = known(w)
        if h is None:
            if len(_hashes) >= CACHED:
                _hashes.clear()
            h = _hashes[w] = xxh64_intdigest(w)
        out.append(h)
    out.append(_END)
    return np.array(out, np.uint64)


def forget() -> None:
    _hashes.clear()


def split_of(doc_id) -> object:
    """0: counted, 1: deleted, 2: never learned from."""
    rest = id_crc32(doc_id) % 7
    return F.when(rest == 2, 2).when(rest == DELETED, 1).otherwise(0)


@dataclass
class Table:
    """The frequent words: hashes ascending, with counts in the counted part and in all training documents."""

    hashes: np.ndarray
    counted: np.ndarray  # one more at the end: the start as a context
    all: np.ndarray
    head: np.ndarray  # of each word its number in the head, or -1; one more: the start's
    n_counted: int
    n_all: int
    v_counted: int
    v_all: int
    pairs: np.ndarray | None = None  # counts of head pairs, counted part and all

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    @property
    def start(self) -> int:
        return len(self.hashes)

    @property
    def none(self) -> int:
        return len(self.hashes) + 1


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), split_of(F.col("doc_id")).alias("split"))


def word_counts(rows: DataFrame) -> DataFrame:
    """w, c0 (counted part), c1 (deleted part), over all training words and ends. Tasks send sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sums():
            w, at = np.unique(np.concatenate([k for k, _, _ in held]), return_inverse=True)
            return w, *(np.bincount(at, np.concatenate([x[i] for x in held]), len(w)).astype(np.int64) for i in (1, 2))

        def batch(w, c0, c1):
            return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c0), pa.array(c1)], names=["w", "c0", "c1"])

        held, size = [], 0
        for b in batches:
            texts, split = b.column(0), b.column(1).to_numpy()
            for i in range(0, b.num_rows, 500):
                for s in (0, 1):
                    own = [word_hashes(x) for x, y in zip(texts.slice(i, 500).to_pylist(), split[i : i + 500]) if y == s]
                    if own:
                        w, n = np.unique(np.concatenate(own), return_counts=True)
                        zero = np.zeros(len(w), np.int64)
                        held.append((w, zero, n) if s else (w, n, zero))
                        size += len(w)
                if size > 1 << 21:
                    held = [sums()]
                    size = len(held[0][0])
                    if size > 1 << 20:
                        yield batch(*held[0])
                        held, size = [], 0
        if held:
            yield batch(*sums())

    return rows.where("split < 2").select("text", "split").mapInArrow(run, "w long, c0 long, c1 long").groupBy("w").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def word_table(rows: DataFrame, table: int = TABLE, head: int = HEAD) -> tuple[Table, DataFrame]:
    """The table of frequent words, and the counts (w, c0, c1) of all words."""
    spark = rows.sparkSession
    path = fresh_dir(spark, "words")
    word_counts(rows).write.parquet(path)
    counts = spark.read.parquet(path)
    n0, n1, v0, v1 = counts.agg(*(F.coalesce(x, F.lit(0)) for x in (F.sum("c0"), F.sum(F.col("c0") + F.col("c1")), F.count_if(F.col("c0") > 0), F.count("*")))).first()
    # Words by bucket of their count, from the most frequent on as many whole buckets as fit; a bucket is a 256th of a power of two.
    level = F.floor(F.log2(F.col("c0") + F.col("c1")) * 256).cast("int")
    some, least = 0, 1 << 20
    for x in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).toLocalIterator():  # 16,384 levels at most
        some += x["count"]
        if some > table:
            break
        least = x["level"]
    top = counts.where(level >= least).toArrow()  # so many rows at most
    w, c0, c1 = (top[c].to_numpy() for c in ("w", "c0", "c1"))
    w = w.view(np.uint64)
    order = np.argsort(w)
    ends = counts.where(F.col("w") == _END).select("c0", "c1").first() or (0, 0)
    w, c0, c1 = w[order], c0[order], c1[order]
    number = np.full(len(w) + 1, -1)
    number[np.argsort(-(c0 + c1), kind="stable")[:head]] = np.arange(min(head, len(w)))
    number[-1] = head
    return Table(w, np.append(c0, ends[0]), np.append(c0 + c1, ends[0] + ends[1]), number, n0, n1, v0, v1), counts


def _pack(*arrays: np.ndarray) -> bytes:
    from zstandard import ZstdCompressor

    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), a.dtype.itemsize))], np.int64)
    return ZstdCompressor(level=1).compress(head.tobytes() + b"".join(a.tobytes() for a in arrays))


def _unpack(blob: bytes) -> list[np.ndarray]:
    from zstandard import ZstdDecompressor

    raw = ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    shape, at, out = np.frombuffer(raw, np.int64, 2 * n, 8), 8 + 16 * n, []
    for size, width in shape.reshape(-1, 2).tolist():
        out.append(np.frombuffer(raw, f"<u{width}", size, at))
        at += size * width
    return out


def _spread(x: np.ndarray, n: int) -> np.ndarray:
    return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(n)


_IDS_OF_BLOCK, _HEAD_PAIRS, _BOTH_RARE = -1, -2, -3  # kinds of blobs that are no group of keys


def dealt(rows: DataFrame, table: Table, n: int) -> DataFrame:
    """part, block, kind, blob: occurrences in n partitions (kind: group of keys), and what stays with each block: its ids and splits, its head pairs, its pairs of words outside the table."""
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def combined(codes: np.ndarray, doc: np.ndarray):
        """(code, document) once each, and how often: codes have 40 bits at most."""
        code, count = np.unique((codes << np.uint64(_DOCS)) | doc, return_counts=True)
        return code >> np.uint64(_DOCS), (code & np.uint64((1 << _DOCS) - 1)).astype(np.uint32), count

    def narrow(count: np.ndarray) -> np.ndarray:
        return count.astype(np.uint8 if not len(count) or count.max() < 256 else np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, task = shared.value, TaskContext.get().partitionId()
        made, ids, splits, words, size = 0, [], [], [], 0

        def block():
            number = task << 32 | made
            length = np.array([len(w) for w in words])
            h = np.concatenate(words)
            doc = np.repeat(np.arange(len(words), dtype=np.uint64) * np.uint64(4) + np.array(splits, np.uint64), length)  # the split goes with the document's number
            first = np.concatenate(([0], np.cumsum(length)[:-1]))
            at = t.find(h)
            context, before = np.concatenate(([t.start], at[:-1])), np.concatenate((h[:1], h[:-1]))
            context[first] = t.start
            known, led = at >= 0, context >= 0
            head = known & led & (t.head[at] >= 0) & (t.head[context] >= 0)
            mid = known & led & ~head
            pair, pair_doc, count = combined((context[mid].astype(np.uint64) << np.uint64(_IDS)) | at[mid].astype(np.uint64), doc[mid])
            # A word outside the table with its context (or none, to be counted only), and such a context with its word (or none).
            rare, ctx = h[~known], np.where(led, context, t.none)[~known].astype(np.uint32)
            lone, word = before[~led], np.where(known, at, t.none)[~led].astype(np.uint32)
            parts = [(pair, (pair_doc, narrow(count))), (rare, (ctx, doc[~known].astype(np.uint32))), (lone, (word, doc[~led].astype(np.uint32)))]
            sorted_parts = []
            for key, more in parts:
                to = _spread(key, n * GROUPS)
                order = np.argsort(to, kind="stable")
                sorted_parts.append((key[order], [x[order] for x in more], np.searchsorted(to[order], np.arange(n * GROUPS + 1))))
            for k in range(n * GROUPS):
                own = [(key[c[k] : c[k + 1]], [x[c[k] : c[k + 1]] for x in more]) for key, more, c in sorted_parts]
                if any(len(key) for key, _ in own):
                    step = np.diff(own[0][0], prepend=np.uint64(0))
                    step = step.astype(np.uint32) if not len(step) or step.max() < 1 << 32 else step
                    yield k // GROUPS, number, k % GROUPS, _pack(step, *own[0][1], own[1][0], *own[1][1], own[2][0], *own[2][1])
            none = np.array([x is None for x in ids], np.uint8)
            yield number % n, number, _IDS_OF_BLOCK, _pack(np.array([x or 0 for x in ids], np.int64).view(np.uint64), none, np.array(splits, np.uint8))
            code, code_doc, count = combined((t.head[context[head]] * HEAD_CODES + t.head[at[head]]).astype(np.uint64), doc[head])
            yield number % n, number, _HEAD_PAIRS, _pack(code.astype(np.uint32), code_doc, narrow(count))
            both = ~known & ~led
            if both.any():
                yield number % n, number, _BOTH_RARE, _pack(before[both], h[both], doc[both].astype(np.uint32))

        def batch(found):
            cols = list(zip(*found))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary())], names=["part", "block", "kind", "blob"])

        for b in batches:
            for i in range(0, b.num_rows, 100):
                part = b.slice(i, 100)
                for doc_id, text, split in zip(*(c.to_pylist() for c in part.columns)):
                    w = word_hashes(text)
                    ids.append(doc_id)
                    splits.append(split)
                    words.append(w)
                    size += len(w)
                    if size >= BLOCK_TOKENS:
                        yield batch(block())
                        made, ids, splits, words, size = made + 1, [], [], [], 0
        if words:
            yield batch(block())

    return cut(rows.mapInArrow(run, "part int, block long, kind int, blob binary").repartitionById(n, F.col("part")))


@dataclass
class Found:
    """A partition's occurrences, with counts in the counted part (0) and in all training documents (1)."""

    block: np.ndarray
    doc: np.ndarray
    many: np.ndarray
    pair: tuple[np.ndarray, np.ndarray]
    context: tuple[np.ndarray, np.ndarray]
    word: tuple[np.ndarray, np.ndarray]


def _sums(at: np.ndarray, n: int, many: np.ndarray, split: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.bincount(at, many * (split <= s), n)[at] for s in (0, 1))


def head_counts(blocks: DataFrame) -> np.ndarray:
    """Counts of head pairs, counted part and all training documents. Tasks send sums of a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, HEAD_CODES * HEAD_CODES), np.int64)
        for b in batches:
            for blob in b.column(0).to_pylist():
                code, doc, many = _unpack(blob)
                for s in (0, 1):
                    sums[s] += np.bincount(code, many * ((doc & 3) <= s), sums.shape[1]).astype(np.int64)
        some = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, sums[0][some], sums[1][some])], names=["code", "n0", "n1"])

    found = blocks.where(F.col("kind") == _HEAD_PAIRS).select("blob").mapInArrow(run, "code long, n0 long, n1 long").groupBy("code").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    out = np.zeros((2, HEAD_CODES * HEAD_CODES))
    out[:, found["code"].to_numpy()] = np.stack([found[c].to_numpy() for c in ("n0", "n1")])
    return out


def by_group(batches: Iterator[pa.RecordBatch], t: Table) -> tuple[list[tuple[int, bytes]], Iterator[Found]]:
    """A partition's blocks' ids, and its occurrences with their counts, by group of keys."""
    ids, head, groups = [], [], {}
    for b in batches:
        for block, kind, blob in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
            (ids if kind == _IDS_OF_BLOCK else head if kind == _HEAD_PAIRS else groups.setdefault(kind, [])).append((block, blob))
    groups.pop(_BOTH_RARE, None)

    def found():
        for i in range(0, len(head), 4):
            yield head_found(head[i : i + 4], t)
        for packed in groups.values():
            yield counted(packed, t)

    return ids, found()


def head_found(packed: list[tuple[int, bytes]], t: Table) -> Found:
    block, code, doc, many = [], [], [], []
    for number, blob in packed:
        for part, x in zip((code, doc, many), _unpack(blob)):
            part.append(x)
        block.append(np.full(len(code[-1]), number))
    block, code, doc, many = (np.concatenate(x) for x in (block, code, doc, many))
    v, w = np.divmod(code, HEAD_CODES)
    at = np.zeros(HEAD_CODES, np.int64)
    at[t.head[t.head >= 0]] = np.flatnonzero(t.head >= 0)
    return Found(block, doc, many, (t.pairs[0][code], t.pairs[1][code]), tuple(x[at[v]] for x in (t.counted, t.all)), tuple(x[at[w]] for x in (t.counted, t.all)))


def counted(packed: list[tuple[int, bytes]], t: Table) -> Found:
    """A group's occurrences. Entries of a rare word (a rare context) without a context (a word) in the table only count."""
    parts = []
    for block, blob in packed:
        step, *rest = _unpack(blob)
        parts.append((np.cumsum(step, dtype=np.uint64), *rest, *(np.full(len(x), block) for x in (step, rest[2], rest[5]))))
    pair, doc, many, rare, ctx, rare_doc, lone, word, lone_doc, block, rare_block, lone_block = (np.concatenate(x) for x in zip(*parts))
    del parts
    of = [np.append(x, 0) for x in (t.counted, t.all)]  # the last: not in the table
    u, at = np.unique(pair, return_inverse=True)
    pair_n = _sums(at, len(u), many.astype(np.float64), doc & 3)
    v, w = (pair >> np.uint64(_IDS)).astype(np.int64), (pair & np.uint64((1 << _IDS) - 1)).astype(np.int64)
    found = [(block, doc, many, pair_n, tuple(x[v] for x in of), tuple(x[w] for x in of))]
    for key, other, d, b, lead in ((rare, ctx, rare_doc, rare_block, False), (lone, word, lone_doc, lone_block, True)):
        one, split = np.ones(len(key)), d & 3
        u, at = np.unique(key, return_inverse=True)
        key_n = _sums(at, len(u), one, split)
        u, at = np.unique((at.astype(np.uint64) << np.uint64(32)) | other, return_inverse=True)
        both_n = _sums(at, len(u), one, split)
        keep = np.flatnonzero(other != t.none)
        mine, others = tuple(x[keep] for x in key_n), tuple(x[other[keep]] for x in of)
        found.append((b[keep], d[keep], one[keep], tuple(x[keep] for x in both_n), *((mine, others) if lead else (others, mine))))
    plain = [np.concatenate([x[i] for x in found]) for i in range(3)]
    return Found(*plain, *(tuple(np.concatenate([x[i][s] for x in found]) for s in (0, 1)) for i in (3, 4, 5)))


def both_rare(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """block, doc (with its split), n, and the counts p0, p1 of pairs, v0, v1 of contexts and w0, w1 of words, of pairs of two words outside the table: joined to the counts of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v, w, doc = _unpack(blob)
                yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(w.view(np.int64)), pa.array(np.full(len(v), block)), pa.array(doc.astype(np.int64))], names=["v", "w", "block", "doc"])

    rows = blocks.where(F.col("kind") == _BOTH_RARE).select("block", "blob").mapInArrow(run, "v long, w long, block long, doc long").withColumn("n", F.lit(1).cast("long"))
    for c in "wv":
        rows = rows.join(counts.select(F.col("w").alias(c), F.col("c0").alias(f"{c}0"), (F.col("c0") + F.col("c1")).alias(f"{c}1")), c, "left")
    pair = W.partitionBy("v", "w")
    seen = {f"p{s}": F.sum(F.when(F.col("doc").bitwiseAND(3) <= s, F.col("n")).otherwise(0)).over(pair) for s in (0, 1)}
    return rows.withColumns(seen).select("block", "doc", "n", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("p0", "p1", "v0", "v1", "w0", "w1")])


def _found(b: pa.RecordBatch) -> Found:
    x = [b.column(i).to_numpy().astype(np.float64) for i in range(2, 9)]
    return Found(b.column(0).to_numpy(), b.column(1).to_numpy(), x[0], (x[1], x[2]), (x[3], x[4]), (x[5], x[6]))


def bucket(context: np.ndarray) -> np.ndarray:
    """0 without a count, else 1 + the power of two."""
    return np.where(context > 0, np.log2(np.maximum(context, 1)).astype(np.int64) + 1, 0)


def binned(blocks: DataFrame, table: Table, rare: DataFrame) -> DataFrame:
    """b, q2, q1, n: the deleted part's counts by bucket and binned estimates (null where an estimate is 0). Its size is bounded by the bins."""
    shared = blocks.sparkSession.sparkContext.broadcast(table)

    def bins(f: Found, t: Table) -> pa.RecordBatch:
        own = (f.doc & 3) == 1
        with np.errstate(divide="ignore", invalid="ignore"):
            q2 = np.rint(BINS * np.log2(f.pair[0][own] / f.context[0][own]))
            q1 = np.rint(BINS * np.log2(f.word[0][own] / max(t.n_counted, 1)))
        q2, q1 = (np.where(np.isfinite(q), q, 999).astype(np.int64) for q in (q2, q1))
        code, at = np.unique((bucket(f.context[0][own]) << 40) | ((q2 + 4096) << 20) | (q1 + 4096), return_inverse=True)
        n = np.bincount(at, f.many[own], len(code))
        cols = [code >> 40, ((code >> 20) & 0xFFFFF) - 4096, (code & 0xFFFFF) - 4096]
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), pa.array(n.astype(np.int64))], names=["b", "q2", "q1", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in by_group(batches, shared.value)[1]:
            yield bins(f, shared.value)

    def run_rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield bins(_found(b), shared.value)

    schema = "b long, q2 long, q1 long, n long"
    return blocks.mapInArrow(run, schema).union(rare.mapInArrow(run_rare, schema)).groupBy("b", "q2", "q1").agg(F.sum("n").alias("n"))


def learn(bins: pa.Table, v: int, rounds: int = 100) -> np.ndarray:
    """Weights (pair, word, uniform) of each of 64 buckets by expectation-maximisation. A bucket without held-out counts gets those of all buckets."""
    b, q2, q1, n = (bins[c].to_numpy().astype(np.float64) for c in ("b", "q2", "q1", "n"))
    p = np.stack([np.where(q2 == 999, 0, 2 ** (q2 / BINS)), np.where(q1 == 999, 0, 2 ** (q1 / BINS)), np.full(len(b), 1 / (v + 1))])

    def fitted(own):
        a = np.full(3, 1 / 3)
        for _ in range(rounds if own.any() else 0):
            part = a[:, None] * p[:, own]
            new = ((part / part.sum(axis=0)) @ n[own] + 1) / (n[own].sum() + 3)  # one count beforehand for each weight
            if abs(new - a).max() < 1e-9:
                break
            a = new
        return a

    whole = fitted(np.ones(len(b), bool))
    out = np.tile(whole, (64, 1))
    for x in np.unique(b).astype(int):
        out[x] = fitted(b == x)
    out[0, 0] = 0
    return out / out.sum(axis=1, keepdims=True)


def scored(docs: DataFrame, table: int = TABLE, head: int = HEAD) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = _rows(docs)
    words, counts = word_table(rows, table, min(head, HEAD))
    blocks = dealt(rows, words, max(partitions(spark), words.n_all >> 23))
    words.pairs = head_counts(blocks)
    rare = cut(both_rare(blocks, counts))
    weights = learn(binned(blocks, words, rare).toArrow(), words.v_counted) if words.n_counted else np.tile([0.0, 0.0, 1.0], (64, 1))
    shared = spark.sparkContext.broadcast((words, weights))
    total = words.n_all

    def sums(f: Found, names: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """By document (its block's place in names, its number): log10 of the model's and the base probability, tokens, known tokens."""
        t, a = shared.value
        w = a[bucket(f.context[1])]
        p = w[:, 0] * f.pair[1] / np.maximum(f.context[1], 1) + w[:, 1] * f.word[1] / max(t.n_all, 1) + w[:, 2] / (t.v_all + 1)
        code, at = np.unique((np.searchsorted(names, f.block) << _DOCS) | (f.doc >> 2).astype(np.int64), return_inverse=True)
        values = (np.log10(p), np.log10((f.word[1] + 1) / (t.n_all + t.v_all + 1)), np.ones(len(p)), f.word[1] > 0)
        return code, [np.bincount(at, f.many * x, len(code)) for x in values]

    def packed_sums(names: np.ndarray, code: np.ndarray, found: list[np.ndarray]):
        cuts = np.searchsorted(code, np.arange(len(names) + 1) << _DOCS)
        for i, block in enumerate(names.tolist()):
            own = slice(cuts[i], cuts[i + 1])
            if own.stop > own.start:
                yield block, 0, _pack((code[own] & ((1 << _DOCS) - 1)).astype(np.uint32), found[0][own].view(np.uint64), found[1][own].view(np.uint64), *(x[own].astype(np.uint32) for x in found[2:]))

    def batch(out) -> pa.RecordBatch:
        cols = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], names=["block", "kind", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, groups = by_group(batches, shared.value[0])
        out: list[tuple[int, int, bytes]] = [(block, 1, blob) for block, blob in ids]
        names, codes, parts = np.zeros(0, np.int64), [], []
        for f in groups:
            own = np.unique(f.block)
            code, found = sums(f, own)
            both = np.union1d(names, own)
            codes = [(np.searchsorted(both, names)[c >> _DOCS] << _DOCS) | (c & ((1 << _DOCS) - 1)) for c in codes] if len(both) > len(names) else codes
            names = both
            codes.append((np.searchsorted(names, own)[code >> _DOCS] << _DOCS) | (code & ((1 << _DOCS) - 1)) if len(code) else code)
            parts.append(found)
        if codes:
            code, at = np.unique(np.concatenate(codes), return_inverse=True)
            out += packed_sums(names, code, [np.bincount(at, np.concatenate(x), len(code)) for x in zip(*parts)])
        if out:
            yield batch(out)

    def run_rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = _found(b)
            f.doc = f.doc.astype(np.int64)
            names = np.unique(f.block)
            if len(names):
                yield batch(packed_sums(names, *sums(f, names)))

    def together(group: pa.Table) -> pa.Table:
        kind, blob = group["kind"].to_pylist(), group["blob"].to_pylist()
        ids, none, split = _unpack(blob[kind.index(1)])
        total_of = np.zeros((4, len(ids)))
        for k, x in zip(kind, blob):
            if not k:
                doc, s, base, n, known = _unpack(x)
                for i, y in enumerate((s.view(np.float64), base.view(np.float64), n, known)):
                    total_of[i] += np.bincount(doc, y, len(ids))
        return pa.table({
            "doc_id": pa.array(ids.view(np.int64), mask=none == 1), "held_out": pa.array(split == 2), "n_tokens": pa.array(total_of[2].astype(np.int64)), "n_known": pa.array(total_of[3].astype(np.int64)),
            "train_tokens": pa.array(np.full(len(ids), total, np.int64)), "base_score": pa.array(total_of[1]), "score": pa.array(total_of[0]),
        })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    found = "block long, kind int, blob binary"
    return blocks.mapInArrow(run, found).union(rare.mapInArrow(run_rare, found)).groupBy("block").applyInArrow(together, schema)


def op1_lm_score(spark, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir))


SQL: dict[str, str] = {}
QUERIES = {"op1_lm_score": op1_lm_score}
