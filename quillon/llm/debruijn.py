"""Substring dedup by De Bruijn compaction: words of a later document that repeat a long passage of an earlier one are removed.

A window of ``k`` words is an edge of the graph, its first and last k - 1 words are nodes. Only repeated edges matter, those that several documents have. A path
of repeated edges is compacted where nothing branches: the first edge is always followed by the second and the second always preceded by the first. So every document that has a
path's first edge has all of it, and a path stands for all its edges.

1. Documents are put into blocks, written to the shared folder. A block stays where it is written (the table is bucketed), only thin columns travel to and from it.
2. Which edges repeat: each block sends a 32-bit slot of each distinct edge to the partition of the edge's hash range, as a sparse Bloom filter, and gets back which slots another block has hit.
3. Which nodes branch: for each edge that may repeat, the block sends the slot with tags of the word before and the word after, or none where it has several or the run of repeated edges ends there.
   It gets back if the edge repeats, and if its predecessor and its successor are the same everywhere. Two edges of one slot only cut more, and alike in all documents.
4. Paths: runs of repeated edges, cut where nodes branch, are Spark rows of 128 bits of hash of the path's whole words, with the coordinates where they stand. A group-by finds each path's source, the smallest (document, place), and a join
   gives it to all places, so a repeat is confirmed on all its words, whatever slots and tags were equal by chance. Paths of many places are broadcast instead of gathered.
5. Places behind their source go back to their blocks, which remove the words they cover.

What a task holds doesn't grow with the table: one block with its answers, and one hash range, of which there are as many as the blocks need.

A block sends one entry for each distinct edge, so copies within a block and frequent passages are combined before they travel. Pieces of a block are flat Arrow values without headers: with many ranges they become single
entries, but never more than entries. Tags are 39 bits, so one branch of 5 * 10^11 could be overlooked.

Defined cases: a null text has no words; a document with a null id is compared with none and keeps all its words; rows of one id don't repeat each other; texts of fewer than k words keep all; what is equal in several earlier
documents has the smallest (doc_id, place) as its source; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut, documents, fresh_dir, join_sized, partitions

WINDOW = 13
BLOCK_BYTES = 4 << 20
#: Hash ranges a shuffle partition, at least, and the bytes of text to a hash range: what a task holds of a range doesn't grow with the table.
RANGES = 4
RANGE_BYTES = 8 << 20
#: Blocks to a row group: a reader holds the texts of one row group at a time.
GROUP_BLOCKS = 2
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_LONG = 64  # bytes from which a word is hashed by itself
_REPEATS, _LED, _FOLLOWED = 1, 2, 4
_ENTRY = np.dtype([("slot", "<u4"), ("before", "<u4"), ("after", "<u4"), ("more", "<u2")])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[3]
    return x ^ (x >> np.uint64(29))


@dataclass
class Words:
    """The words of a block's documents: places in the bytes, hashes, and the document of each."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # of each document its first word, and the number of words

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        """texts: a string array without nulls."""
        texts = texts.cast(pa.large_binary())
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
        off = off - off[0]
        word = ~_SPACE[data]
        before, after = np.concatenate(([False], word[:-1])), np.concatenate((word[1:], [False]))
        if len(data):
            edge = off[(off > 0) & (off < len(data))]
            before[edge], after[edge - 1] = False, False
        starts = np.flatnonzero(word & ~before) if len(data) else np.zeros(0, np.int64)
        ends = np.flatnonzero(word & ~after) + 1 if len(data) else starts
        return cls(data, starts, ends, np.searchsorted(starts, off))

    def hashes(self) -> np.ndarray:
        from xxhash import xxh64_intdigest

        size = self.ends - self.starts
        padded = np.concatenate((self.data, np.zeros(8, np.uint8)))
        eight = np.ndarray(shape=(len(self.data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        part = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
        out = _mixed(((eight[self.starts] & part[np.minimum(size, 8)]) + size.astype(np.uint64) * _ODD[1]) * _ODD[0])
        for i in range(8, _LONG, 8):
            at = np.flatnonzero(size > i)
            if not len(at):
                break
            x = eight[self.starts[at] + i] & part[np.minimum(size[at] - i, 8)]
            out[at] = _mixed((out[at] ^ x) * _ODD[2])
        for i in np.flatnonzero(size > _LONG):
            out[i] = xxh64_intdigest(self.data[self.starts[i] : self.ends[i]].tobytes())
        return out

    def canonical(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The bytes with one space after each word that white space follows, and where words start and end in them."""
        word = ~_SPACE[self.data]
        keep = word.copy()
        keep[1:] |= word[:-1]
        at = np.cumsum(keep)
        return np.where(word, self.data, np.uint8(32))[keep].tobytes(), at[self.starts] - 1, at[self.ends - 1]


class Edges:
    """The windows of a block: word each starts with, document, hash, and the distinct hashes ascending."""

    def __init__(self, words: Words, ids: pa.Array, k: int):
        h = words.hashes()
        n = len(h)
        document = np.repeat(np.arange(len(ids)), np.diff(words.first))
        sums = np.zeros(max(0, n - k + 1), np.uint64)
        for i in range(k):
            sums = sums * _ODD[0] + h[i : i + len(sums)]
        known = np.array(ids.is_valid())
        self.at = np.flatnonzero((document[: len(sums)] == document[k - 1 :]) & known[document[: len(sums)]]) if len(sums) else np.zeros(0, np.int64)
        self.document, self.hash, self.words, self.k = document[self.at], _mixed(sums[self.at]), h, k

    def distinct(self) -> np.ndarray:
        return np.unique(self.hash)

    def sort(self) -> None:
        self.order = np.argsort(self.hash, kind="stable")
        x = self.hash[self.order]
        new = np.ones(len(x), bool)
        new[1:] = x[1:] != x[:-1]
        self.heads = np.flatnonzero(new)
        self.each = np.empty(len(x), np.int64)
        self.each[self.order] = np.cumsum(new) - 1
        self.keys = x[new]

    def may_repeat(self, hit: np.ndarray) -> np.ndarray:
        """By distinct edge: hit elsewhere, or in several documents of this block. hit: by distinct edge."""
        last = np.append(self.heads[1:], len(self.order))[: len(self.heads)] - 1
        self.several = self.document[self.order[self.heads]] != self.document[self.order[last]]
        return hit | self.several

    def tags(self, which: np.ndarray) -> np.ndarray:
        """Entries of the distinct edges of ``which``, in order."""
        on = which[self.each]
        linked = np.zeros(len(on) + 1, bool)
        linked[1:-1] = on[1:] & on[:-1] & (self.document[1:] == self.document[:-1])
        out = np.zeros(int(which.sum()), _ENTRY)
        out["slot"] = self.keys[which].astype(np.uint32)
        out["more"] = self.several[which]
        inside = self.order[on[self.order]]
        heads = np.flatnonzero(np.diff(self.each[inside], prepend=-1))
        for name, step, shift in (("before", -1, 1), ("after", self.k, 8)):
            there = linked[inside] if step < 0 else linked[inside + 1]
            tag = np.where(there, _mixed(self.words[np.where(there, self.at[inside] + step, 0)] * _ODD[2]) | np.uint64(1 << 38), np.uint64(0)) & np.uint64((1 << 39) - 1)
            if len(heads):
                low, high = np.minimum.reduceat(tag, heads), np.maximum.reduceat(tag, heads)
                one = np.where(low == high, low, np.uint64(0))
                out[name] = one.astype(np.uint32)
                out["more"] |= (one >> np.uint64(32)).astype(np.uint16) << np.uint16(shift)
        return out

    def paths(self, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last edge of each path's place. mark: by distinct edge."""
        m = mark[self.each]
        on = (m & _REPEATS) > 0
        linked = np.zeros(len(on) + 1, bool)
        linked[1:-1] = on[1:] & on[:-1] & (self.document[1:] == self.document[:-1]) & ((m[1:] & _LED) > 0) & ((m[:-1] & _FOLLOWED) > 0)
        return np.flatnonzero(on & ~linked[:-1]), np.flatnonzero(on & ~linked[1:])


def _range_ends(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Ends of the hash ranges in ascending hashes."""
    return np.searchsorted(((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32), np.arange(parts), side="right")


def _pieces(block: int, hashes: np.ndarray, values: np.ndarray, parts: int) -> pa.RecordBatch:
    """part, block, entries: the values of the ascending hashes by hash range, without ranges that have none."""
    ends = _range_ends(hashes, parts)
    some = np.flatnonzero(np.diff(ends, prepend=0))
    at = np.concatenate(([0], ends[some])).astype(np.int64) * values.dtype.itemsize
    entries = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), block)), entries.cast(pa.binary())], names=["part", "block", "entries"])


def _values(column: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The entries of pieces one behind the other, and where each piece starts and ends."""
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x).cast(pa.large_binary())
    off = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1]
    size = np.dtype(dtype).itemsize
    return np.frombuffer(x.buffers()[2] or b"", np.uint8)[off[0] : off[-1]].view(dtype), (off - off[0]) // size


def _answers(pieces: pa.Table, at: np.ndarray, answer: np.ndarray) -> pa.Table:
    """part, block, answer: a byte for each entry."""
    out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(answer, np.uint8))])
    return pa.table({"part": pieces["part"], "block": pieces["block"], "answer": out.cast(pa.binary())})


def _hit_twice(pieces: pa.Table) -> pa.Table:
    slots, at = _values(pieces["entries"], np.uint32)
    _, each, n = np.unique(slots, return_inverse=True, return_counts=True)
    return _answers(pieces, at, n[each] > 1)


def _branches(pieces: pa.Table) -> pa.Table:
    e, at = _values(pieces["entries"], _ENTRY)
    order = np.argsort(e["slot"], kind="stable")
    slot = e["slot"][order]
    new = np.ones(len(slot), bool)
    new[1:] = slot[1:] != slot[:-1]
    heads = np.flatnonzero(new)
    each = np.empty(len(slot), np.int64)
    each[order] = np.cumsum(new) - 1
    several = np.maximum.reduceat(e["more"][order] & 1, heads) > 0
    answer = np.where(several | (np.diff(np.append(heads, len(slot))) > 1), _REPEATS, 0)
    for name, shift, bit in (("before", 1, _LED), ("after", 8, _FOLLOWED)):
        tag = (e[name].astype(np.uint64) | ((e["more"].astype(np.uint64) >> np.uint64(shift)) & np.uint64(127)) << np.uint64(32))[order]
        low = np.minimum.reduceat(tag, heads)
        answer |= np.where((low > 0) & (low == np.maximum.reduceat(tag, heads)), bit, 0)
    return _answers(pieces, at, answer[each])


class Blocks:
    """Documents in blocks, in a bucketed table of the shared folder: home (the task that wrote them), block, ids, texts."""

    def __init__(self, docs: DataFrame, k: int, id_col: str, text_col: str):
        spark, self.k = docs.sparkSession, k
        self.buckets = min(100_000, partitions(spark))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            home, made, held, size = TaskContext.get().partitionId(), 0, [], 0

            def block():
                t = pa.Table.from_batches(held).combine_chunks()
                lists = [pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t[c].combine_chunks()) for c in ("id", "text")]
                return pa.RecordBatch.from_arrays([pa.array([home]), pa.array([home << 32 | made]), *lists], names=["home", "block", "ids", "texts"])

            for b in batches:
                ends = np.cumsum(np.diff(np.frombuffer(b.column(1).cast(pa.large_binary()).buffers()[1], np.int64)[b.column(1).offset :][: b.num_rows + 1]))
                i = 0
                while i < b.num_rows:  # documents up to the one that fills the block
                    done = ends[i - 1] if i else 0
                    j = min(b.num_rows, int(np.searchsorted(ends, done + BLOCK_BYTES - size)) + 1)
                    held.append(b.slice(i, j - i))
                    size, i = size + int(ends[j - 1] - done), j
                    if size >= BLOCK_BYTES:
                        yield block()
                        made, held, size = made + 1, [], 0
            if held:
                yield block()

        rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
        path = fresh_dir(spark, "blocks")
        name = path.rsplit("/", 1)[1].replace("-", "_")
        written = rows.mapInArrow(run, "home long, block long, ids array<long>, texts array<string>").write.bucketBy(self.buckets, "home")
        written.option("path", path).option("compression", "zstd").option("parquet.block.row.count.limit", GROUP_BLOCKS).saveAsTable(name)
        self.table = spark.read.table(name)
        self.parts = max(self.buckets * RANGES, self.table.count() * BLOCK_BYTES // RANGE_BYTES)

    def with_answers(self, **answers: DataFrame) -> DataFrame:
        """The blocks with a list for each of the tables (part, block, answer), in the order of part. Blocks aren't shuffled."""
        out = self.table
        for name, x in answers.items():
            x = x.withColumn("home", F.shiftright("block", 32)).repartition(self.buckets, "home")
            x = x.groupBy("home", "block").agg(F.array_sort(F.collect_list(F.struct("part", "answer"))).alias("a")).select("home", F.col("block").alias("of"), F.col("a.answer").alias(name))
            out = out.join(x, (out["home"] == x["home"]) & (out["block"] - x["of"] == 0), "left").select(*[out[c] for c in out.columns], x[name])
        return out

    def each(self, blocks: DataFrame, run, schema: str) -> DataFrame:
        """run(block, ids, words, answers of the block): a record batch. A block is a group of its own, so that no batch holds the texts of several; groups stay in their bucket."""

        def task(one: pa.Table) -> pa.Table:
            own = [c.combine_chunks() for c in one.columns]
            ids, texts = (x.flatten() for x in own[2:4])
            return pa.Table.from_batches([run(own[1][0].as_py(), ids, Words.of(texts), *[x.flatten() for x in own[4:]])])

        return blocks.groupBy("home", "block").applyInArrow(task, schema)


def _bytes(answers: pa.Array, n: int) -> np.ndarray:
    x = _values(answers, np.uint8)[0] if len(answers) else np.zeros(0, np.uint8)
    return x if len(x) == n else np.zeros(n, np.uint8)


def _stored(df: DataFrame, kind: str) -> DataFrame:
    path = fresh_dir(df.sparkSession, kind)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


_PIECES, _ANSWERS = "part int, block long, entries binary", "part int, block long, answer binary"


def paths(blocks: Blocks) -> DataFrame:
    """c1, c2 (128 bits of hash of a path's words), block, word (of the block), n_words, doc_id, first (word of the document): every place of every path."""
    k, parts = blocks.k, blocks.parts

    def slots(block, ids, words):
        keys = Edges(words, ids, k).distinct()
        return _pieces(block, keys, keys.astype(np.uint32), parts)

    def tagged(block, ids, words, hit):
        e = Edges(words, ids, k)
        e.sort()
        which = e.may_repeat(_bytes(hit, len(e.keys)) > 0)
        return _pieces(block, e.keys[which], e.tags(which), parts)

    def places(block, ids, words, hit, marks):
        from xxhash import xxh3_128_digest

        e = Edges(words, ids, k)
        e.sort()
        which = e.may_repeat(_bytes(hit, len(e.keys)) > 0)
        mark = np.zeros(len(e.keys), np.uint8)
        mark[which] = _bytes(marks, int(which.sum()))
        one, last = e.paths(mark)
        text, start, end = words.canonical()
        at, to = e.at[one], e.at[last] + k
        view = memoryview(text)
        names = np.frombuffer(b"".join([xxh3_128_digest(view[i:j]) for i, j in zip(start[at].tolist(), end[to - 1].tolist())]), np.int64).reshape(-1, 2)
        document = e.document[one]
        cols = [names[:, 0].copy(), names[:, 1].copy(), np.full(len(at), block), at.astype(np.int32), (to - at).astype(np.int32), ids.take(pa.array(document)), (at - words.first[document]).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["c1", "c2", "block", "word", "n_words", "doc_id", "first"])

    sent = blocks.each(blocks.table, slots, _PIECES)
    hit = _stored(sent.groupBy("part").applyInArrow(_hit_twice, _ANSWERS), "hit")
    sent = blocks.each(blocks.with_answers(hit=hit), tagged, _PIECES)
    marks = sent.groupBy("part").applyInArrow(_branches, _ANSWERS)
    found = blocks.each(blocks.with_answers(hit=hit, marks=marks), places, "c1 long, c2 long, block long, word int, n_words int, doc_id long, first int")
    return _stored(found, "paths")


def repeats(blocks: Blocks) -> DataFrame:
    """The places of paths that stand in a document behind their source's, with source_id and source_first."""
    found = paths(blocks)
    key = ["c1", "c2"]
    source = found.groupBy(*key).agg(F.min(F.struct("doc_id", "first")).alias("source"), F.max("doc_id").alias("last"), F.count("*").alias("places")).where("last > source.doc_id")
    joined = join_sized(found, cut(source.select(*key, "source", "places")), key, "places", found.count())
    return joined.where("source.doc_id < doc_id").select("block", "word", "n_words", "doc_id", "first", F.col("source.doc_id").alias("source_id"), F.col("source.first").alias("source_first"))


def repeated_spans(docs: DataFrame, k: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, first, n_words, source_id, source_first: words first .. first + n_words - 1 of a document are those from source_first on of an earlier one. Spans of one document may overlap."""
    return repeats(Blocks(docs, k, id_col, text_col)).drop("block", "word")


def without_repeats(docs: DataFrame, k: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words joined by one space), one row for each row of docs."""
    blocks = Blocks(docs, k, id_col, text_col)
    spans = repeats(blocks).select("block", F.lit(0).alias("part"), F.shiftleft(F.col("word").cast("long"), 32).bitwiseOR(F.col("n_words").cast("long")).alias("answer"))

    def kept(block, ids, words, spans):
        x = spans.to_numpy(zero_copy_only=False).astype(np.int64) if len(spans) else np.zeros(0, np.int64)
        steps = np.zeros(len(words.starts) + 1, np.int32)
        np.add.at(steps, x >> 32, 1)
        np.add.at(steps, (x >> 32) + (x & 0xFFFFFFFF), -1)
        gone = np.cumsum(steps[:-1]) > 0
        text, start, end = words.canonical()
        sums = np.concatenate(([0], np.cumsum(gone)))
        n_removed = sums[words.first[1:]] - sums[words.first[:-1]]
        out = []
        for i, j, n in zip(words.first[:-1].tolist(), words.first[1:].tolist(), n_removed.tolist()):
            own = text[start[i] : end[j - 1]] if j > i else b""
            if n:
                own = b" ".join([w for w, g in zip(own.split(b" "), gone[i:j].tolist()) if not g])
            out.append(own)
        cols = [ids, pa.array(np.diff(words.first)), pa.array(n_removed), pa.array(out, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "kept"])

    return blocks.each(blocks.with_answers(spans=spans), kept, "doc_id long, n_words long, n_removed long, kept string")


def op11_debruijn(spark, sf_dir: str) -> DataFrame:
    out = without_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = {
    "op11_debruijn": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        e AS (SELECT r, doc_id, i, hash(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS g, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS t
              FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE doc_id IS NOT NULL)),
        m AS (SELECT g, t, min(doc_id) AS source FROM e GROUP BY g, t),
        c AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS p FROM e JOIN m USING (g, t) WHERE source < doc_id),
        words AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
        k AS (SELECT words.r, count(*) FILTER (c.p IS NULL) AS n_kept, coalesce(string_agg(word, ' ' ORDER BY words.p) FILTER (c.p IS NULL), '') AS kept
              FROM words LEFT JOIN c ON words.r = c.r AND words.p = c.p GROUP BY words.r)
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.r = k.r""",
}
QUERIES = {"op11_debruijn": op11_debruijn}
