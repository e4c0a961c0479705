"""Hard-negative mining by a secondary-sort shuffle.

Scores of anchors against all rows are packed into keys (anchor, descending score, kind, id) and dealt by anchor with the keys sorted inside each partition; one iterator streams over a partition. A row of the anchor's
label opens a window [low * score, high * score], the first ``positives`` of them; a row of another label is emitted for each window it falls into, while that window has fewer than ``negatives``. At equal scores
rows of the anchor's label come first, as a window of score 0 has its negatives there. The iterator holds one anchor's open windows and never its rows.

Anchors are sent to all rows in blocks of ``ANCHORS`` (a bounded broadcast: anchors x dimensions x 8 bytes), so each block is one scan. A first scan finds each anchor's best own-label rows of every batch, whose best are the positives.
With their windows known, the second scan sends of every batch of rows only what can be emitted: for each window the batch's best ``negatives`` rows. So what is shuffled grows with anchors x batches, not with anchors x rows,
and no anchor's rows meet in one task but its batches' best. Scores are inner products of whole numbers, computed in doubles where they are exact and in 64-bit integers beyond.

Defined cases: rows with a null label, vector or id, or a null or non-finite component, take no part; rows whose id is the anchor's are no other rows; further rows that repeat an id each count; of anchors that repeat an id each is mined;
ties go to the smaller id; vectors of different lengths are filled up with zeros; without own-label rows an anchor has no rows, and positives of negative score have an empty window; an empty table gives an empty result;
other columns are ignored. Scores have to fit into 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut, fresh_dir

ANCHORS = 8192
EVERY, SCALE = 100, 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score in hundredths of the positive's.
LOW, HIGH = 30, 90
_STEP = 256  # anchors whose scores are in memory at once
_ROWS = 4096


def whole_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, label, v (whole numbers) of the rows that take part."""
    x = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    return x.where(~bad).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE)).alias("v"))


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """A row for each list, filled up with zeros."""
    size = np.array([len(x) for x in lists]) if lists.null_count else np.diff(lists.offsets.to_numpy())
    width = int(size.max(initial=0))
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = min(a.shape[1], b.shape[1])
    a, b = a[:, :n], b[:, :n]
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(n, 1)
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


class Anchors:
    """A block of anchors: numbers, ids, labels, vectors by ascending label; positives' scores once they are known."""

    def __init__(self, found: pa.Table):
        found = found.sort_by([("label", "ascending"), ("slot", "ascending")])
        self.slot, self.id, self.label = (found[c].to_numpy() for c in ("slot", "vec_id", "label"))
        self.v = _matrix(found["v"].combine_chunks())
        self.positive: dict[int, np.ndarray] = {}


def _best(score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n highest scores, ties by smaller id."""
    if len(score) > n:
        some = np.flatnonzero(score >= np.partition(score, len(score) - n)[len(score) - n])
        return some[np.lexsort((ids[some], -score[some]))[:n]]
    return np.lexsort((ids, -score))


def _scan(rows: DataFrame, anchors: Anchors, pick) -> DataFrame:
    """slot, minus (score, negated), kind (0: the anchor's label), vec_id of the rows that ``pick`` chooses for an anchor among a batch's."""
    shared = rows.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        for b in batches:
            for i in range(0, b.num_rows, _ROWS):
                part = b.slice(i, _ROWS)
                ids, label, v = part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2))
                for j in range(0, len(a.slot), _STEP):
                    out = []
                    for at, score in enumerate(_products(a.v[j : j + _STEP], v), j):
                        for kind, some in pick(a, at, score, label == a.label[at], ids):
                            out.append((np.full(len(some), a.slot[at]), -score[some], np.full(len(some), kind, np.int8), ids[some]))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["slot", "minus", "kind", "vec_id"])

    return rows.mapInArrow(run, "slot long, minus long, kind byte, vec_id long")


def _own(a: Anchors, at: int, score: np.ndarray, same: np.ndarray, ids: np.ndarray):
    some = np.flatnonzero(same & (ids != a.id[at]))
    if len(some):
        yield 0, some[_best(score[some], ids[some], POSITIVES)]


def _window(score: int) -> tuple[int, int]:
    """Least and greatest score of a positive's negatives; none if the score is negative."""
    return -(-LOW * score // 100), HIGH * score // 100


def _others(a: Anchors, at: int, score: np.ndarray, same: np.ndarray, ids: np.ndarray):
    p = a.positive.get(int(a.slot[at]), np.zeros(0))
    p = p[p >= 0]
    if not len(p):
        return
    windows = [_window(x) for x in sorted(set(p.tolist()))]
    other = np.flatnonzero(~same & (ids != a.id[at]) & (score >= windows[0][0]) & (score <= windows[-1][1]))
    s, chosen = score[other], []
    for low, high in windows:
        some = np.flatnonzero((s >= low) & (s <= high))
        chosen.append(some[_best(s[some], ids[other[some]], NEGATIVES)])
    some = np.unique(np.concatenate(chosen))
    if len(some):
        yield 1, other[some]


def sorted_keys(keys: DataFrame) -> DataFrame:
    """Keys dealt by anchor, each partition in their order."""
    return keys.repartition("slot").sortWithinPartitions("slot", "minus", "kind", "vec_id")


def _positives(keys: DataFrame) -> DataFrame:
    """slot, score, vec_id of each anchor's first own-label rows, streamed from sorted keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, n = None, 0
        for b in batches:
            keep = []
            for s in b.column(0).to_pylist():
                slot, n = (s, n + 1) if s == slot else (s, 1)
                keep.append(n <= POSITIVES)
            yield b.filter(pa.array(keep, pa.bool_()))

    return sorted_keys(keys).mapInArrow(run, keys.schema)


def _windows(keys: DataFrame) -> DataFrame:
    """slot, positive_id, rank, negative_id and both scores, streamed from sorted keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, open_ = None, []  # windows: positive's id and score, negatives so far
        for b in batches:
            out = []
            for s, minus, kind, i in zip(*(c.to_pylist() for c in b.columns)):
                if s != slot:
                    slot, open_ = s, []
                if kind == 0:
                    open_.append([i, -minus, 0])
                    continue
                for w in open_:
                    if w[2] < NEGATIVES and LOW * w[1] <= -100 * minus <= HIGH * w[1]:
                        w[2] += 1
                        out.append((s, w[0], w[2], i, w[1], -minus))
            if out:
                cols = list(zip(*out))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["slot", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return sorted_keys(keys).mapInArrow(run, "slot long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def hard_negatives(rows: DataFrame) -> DataFrame:
    """rows: vec_id, label, v. anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows whose vec_id is divisible by ``EVERY``."""
    spark, path = rows.sparkSession, fresh_dir(rows.sparkSession, "vectors")
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    anchors = cut(rows.where(F.col("vec_id") % EVERY == 0).withColumn("slot", F.monotonically_increasing_id()))
    cuts = anchors.selectExpr("spark_partition_id() AS part").groupBy("part").count().orderBy("part").collect()  # a row a partition
    out = None
    for block in _blocks(anchors, cuts):
        a = Anchors(block.toArrow())
        if not len(a.slot):
            continue
        first = cut(_positives(_scan(rows, a, _own)))
        found = first.select("slot", "minus").toArrow()  # ANCHORS * POSITIVES rows at most
        slot, score = found["slot"].to_numpy(), -found["minus"].to_numpy()
        order = np.argsort(slot, kind="stable")
        heads = np.flatnonzero(np.diff(slot[order], prepend=-1))
        a.positive = {int(slot[own[0]]): score[own] for own in np.split(order, heads[1:]) if len(own)}
        mined = _windows(first.unionByName(_scan(rows, a, _others)))
        named = block.select("slot", F.col("vec_id").alias("anchor_id"))
        one = mined.join(F.broadcast(named), "slot").drop("slot")  # ANCHORS rows at most
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _blocks(anchors: DataFrame, cuts: list) -> Iterator[DataFrame]:
    """Anchors in blocks of at most ANCHORS, by ranges of their numbers: a partition's are consecutive from its start."""
    low, size = 0, 0
    for part, n in ((r["part"], r["count"]) for r in cuts):
        start, at = part << 33, 0
        while at < n:
            if size == 0:
                low = start + at
            some = min(n - at, ANCHORS - size)
            at, size = at + some, size + some
            if size == ANCHORS:
                yield anchors.where((F.col("slot") >= low) & (F.col("slot") < start + at))
                size = 0
    if size:
        yield anchors.where(F.col("slot") >= low)


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    return hard_negatives(whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


SQL = {
    "op12_hard_negatives": f"""
        WITH r AS (SELECT row_number() OVER () AS n, vec_id::BIGINT AS vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
                          list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
                   FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.n, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
              FROM r a JOIN r b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id),
        p AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS place FROM s WHERE same QUALIFY place <= {POSITIVES})
        SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.n, p.place ORDER BY s.score DESC, s.vec_id)::INT AS rank,
               s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
        FROM p JOIN s ON p.n = s.n AND NOT s.same AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score
        QUALIFY rank <= {NEGATIVES}""",
}
QUERIES = {"op12_hard_negatives": op12_hard_negatives}
