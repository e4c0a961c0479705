"""SimHash near-dedup from a similarity of ``SIMILARITY`` on, for the pipeline: operator 9 with wide sketches, confirmed on whole sets.

A text's set holds the 64-bit hashes of its runs of five words; its sketch is the SimHash of this set, of 128 bits. At a similarity of 0.8 two sketches differ in 19 bits on average (standard
deviation 4), at which distance segments of a fingerprint alone find no small set of partners. So sketches are compared where sets can meet: in any one order of all
shingles, two sets whose Jaccard similarity is 4/5 or more share one of the first n - ceil(4n / 5) + 1 of each, and a set is filed under these only. The order puts rare shingles first, by counts
over all texts in 2^20 cells of their hashes; it decides the work and never the result. What meets is pruned by sizes and by what the sets have left behind the place where they meet, then by pigeonring chains (eight segments on a ring, from some start chains of one, two and three of them within
5, 10 and 15 bits), then by the full distance of ``DISTANCE`` bits, which is over five standard deviations away for true pairs; sets of fewer than ``SHORT`` shingles skip the pruning. Survivors are confirmed exactly on
their whole sets.

A group of near copies isn't enumerated: each set first meets one partner only, the set among its keys' best whose shingles are shared most (in a group of copies of one text, that text). Then, in keys
whose members aren't connected yet, members of different components meet. Components come from ``components``.

Defined cases: a null text counts as empty; texts without words are equal to each other and like no other; texts with fewer words than a shingle have the whole sequence as their only one;
of a component the row with the smallest doc_id stays, a null id only where there is no other, and of rows that repeat a doc_id the one with the smallest row hash; an empty table gives an empty result;
all columns are carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.common import cut, forgetful, fresh_dir, join_sized, packed, row_hashes
from quillon.llm.components import components
from quillon.llm.exact_dedup import SLOT_BITS, bloom, split_by_filter
from quillon.llm.ngram import forget, word_hashes

WORDS = 5
#: Similarity as a fraction.
SIMILARITY = (4, 5)
DISTANCE = 40
SEGMENTS = 8
SHORT = 16
_CELLS = 20  # bits of a cell of the rarity table
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
_STEP = 1 << 14


def shingle_set(text: str | None) -> np.ndarray:
    """Ascending distinct hashes of a text's shingles."""
    h = word_hashes(text)[:-1]
    k = min(WORDS, len(h))
    if not k:
        return np.zeros(0, np.uint64)
    x = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        y = (h[i : i + len(x)] ^ _ODD[i]) * _ODD[k - 1 - i]
        x = (x ^ y ^ (y >> np.uint64(29))) * _ODD[i]
    return np.unique(x ^ (x >> np.uint64(32)))


def name_of(shingles: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(shingles.tobytes())


def sketch(shingles: np.ndarray) -> np.ndarray:
    """SimHash of a set, two 64-bit numbers: a bit is set if it is set in over half of the shingles' hashes."""
    total = np.zeros(128, np.int64)
    for i in range(0, len(shingles), _STEP):
        x = shingles[i : i + _STEP]
        y = (x ^ (x >> np.uint64(31))) * _ODD[0]
        both = np.column_stack((x * _ODD[4], y ^ (y >> np.uint64(29))))
        total += np.unpackbits(both.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(shingles)).view(np.uint64)


def prefix(shingles: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    n = len(shingles)
    size = n + (SIMILARITY[0] * -n) // SIMILARITY[1] + 1 if n else 0
    return shingles[np.lexsort((shingles, rarity[shingles >> np.uint64(64 - _CELLS)]))[:size]]


def ring_close(x: str, y: str) -> Column:
    """Pigeonring pruning, then the full distance, of the sketches (s1, s2) of two structs, where the sets' sizes n allow the similarity, and v, what each has from the shared key on in the order of all shingles.

    The shingles before the first shared key aren't shared, so at that key the condition on v holds for every similar pair.
    """
    a, b = SIMILARITY
    n, m = (F.col(f"{z}.n") for z in (x, y))
    sizes = (F.least(n, m) * b >= F.greatest(n, m) * a) & (F.least(f"{x}.v", f"{y}.v") * (a + b) >= (n + m) * a)
    s, t = SEGMENTS // 2, 128 // SEGMENTS
    turned = [F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}")) for c in ("s1", "s2")]
    d = [F.bit_count(F.shiftrightunsigned(turned[i // s], t * (i % s)).bitwiseAND((1 << t) - 1)) for i in range(SEGMENTS)]
    budget = DISTANCE // SEGMENTS
    at = lambda i, k: sum((d[(i + j) % SEGMENTS] for j in range(1, k)), d[i])
    chains = F.lit(False)
    for i in range(SEGMENTS):
        chains = chains | ((at(i, 1) <= budget) & (at(i, 2) <= 2 * budget) & (at(i, 3) <= 3 * budget))
    whole = F.bit_count(turned[0]) + F.bit_count(turned[1]) <= DISTANCE
    return sizes & ((F.least(n, m) < SHORT) | (chains & whole))


def _stored(df: DataFrame, kind: str) -> DataFrame:
    path = fresh_dir(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _rarity(texts: DataFrame) -> np.ndarray:
    """How many of all texts' shingles are in each cell of hashes. A task sends a cell once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << _CELLS, np.int64)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                found = np.concatenate([shingle_set(x) for x in b.column(0).slice(i, 500).to_pylist()])
                np.add.at(counts, (found >> np.uint64(64 - _CELLS)).astype(np.int64), 1)
        cell = np.flatnonzero(counts)
        for i in range(0, len(cell), _STEP):
            some = cell[i : i + _STEP]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["cell", "n"])

    found = texts.mapInArrow(forgetful(run, forget), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1").toArrow()  # 2^20 rows at most
    out = np.zeros(1 << _CELLS, np.int64)
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out


def filed(thin: DataFrame) -> DataFrame:
    """thin: text, doc_id, q_h1, q_h2. Returns doc_id, q_h1, q_h2, fp (the set's name), n, s1, s2 and keys: what the set is filed under."""
    rarity = thin.sparkSession.sparkContext.broadcast(_rarity(thin.select("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                sets = [shingle_set(x) for x in part.column(0).to_pylist()]
                keys = [prefix(x, rarity.value) for x in sets]
                ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys).view(np.int64)))
                s = np.stack([sketch(x) for x in sets]).view(np.int64)
                fp = np.array([name_of(x) for x in sets], np.uint64).view(np.int64)
                cols = [*part.columns[1:], pa.array(fp), pa.array([len(x) for x in sets], pa.int32()), pa.array(s[:, 0].copy()), pa.array(s[:, 1].copy()), lists]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "q_h1", "q_h2", "fp", "n", "s1", "s2", "keys"])

    return _stored(thin.mapInArrow(forgetful(run, forget), "doc_id long, q_h1 long, q_h2 long, fp long, n int, s1 long, s2 long, keys array<long>"), "filed")


def similar(pairs: DataFrame, rows: DataFrame, thin: DataFrame) -> DataFrame:
    """pairs: (a, b) names of sets. Those that are similar enough, by their whole sets. Only texts of these sets are read into sets, and one of each set travels."""
    pairs = _stored(pairs, "pairs")
    wanted = cut(pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct())
    chosen = rows.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min(F.struct("q_h1", "q_h2")).alias("p"))
    some = bloom(chosen.select(F.shiftrightunsigned("p.q_h1", 64 - SLOT_BITS).alias("slot")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                found = [shingle_set(x) for x in b.column(0).slice(i, 500).to_pylist()]
                names = np.array([name_of(x) for x in found], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([x.tobytes() for x in found], pa.binary())], names=["fp", "shingles"])

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = np.sort(np.concatenate((x, y)))
                both = int((both[1:] == both[:-1]).sum())
                ok.append(both * SIMILARITY[1] >= (len(x) + len(y) - both) * SIMILARITY[0])
            yield b.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    hits = split_by_filter(thin.select("text", F.col("q_h1").alias("h")), some)[0]
    held = _stored(hits.select("text").mapInArrow(forgetful(sets, forget), "fp long, shingles binary").join(wanted, "fp", "left_semi").dropDuplicates(["fp"]), "sets")
    met = pairs.join(held.select(F.col("fp").alias("b"), F.col("shingles").alias("y")), "b").join(held.select(F.col("fp").alias("a"), F.col("shingles").alias("x")), "a")
    return cut(met.select("a", "b", "x", "y").mapInArrow(confirmed, "a long, b long"))


def set_roots(rows: DataFrame, thin: DataFrame) -> DataFrame:
    """rows: what ``filed`` gives. Returns (node, root) for the names of sets that have a near copy."""
    w = W.partitionBy("key")
    index = rows.select("fp", F.posexplode("keys").alias("i", "key")).repartition("key").dropDuplicates(["key", "fp"])
    live = _stored(index.withColumn("c", F.count("*").over(w)).where("c > 1"), "live")
    shared = live.groupBy("fp").agg(F.sum(F.log2("c")).alias("q"))
    known = rows.groupBy("fp").agg(F.first(F.struct("n", F.size("keys").alias("p"), "s1", "s2")).alias("m")).join(shared, "fp")
    me = F.struct((F.col("q") / F.col("m.p")).cast("float").alias("q"), "fp", "m.n", (F.col("m.n") - F.col("i")).alias("v"), "m.s1", "m.s2")
    live = _stored(live.select("key", "fp", "i").join(known, "fp").select("key", me.alias("me")), "live")
    best = live.withColumn("of", F.max("me").over(w)).where((F.col("me.fp") != F.col("of.fp")) & ring_close("me", "of"))
    first = best.groupBy(F.col("me.fp").alias("b")).agg(F.max(F.struct("of.q", "of.fp")).alias("of")).select(F.col("of.fp").alias("a"), "b")
    tried = _stored(first, "tried")
    links = similar(tried, rows, thin)
    roots = components(links)
    left = live.join(roots, F.col("me.fp") == F.col("node"), "left").select("key", "me", F.coalesce("root", "me.fp").alias("root"))
    left = _stored(left.withColumns({"lo": F.min("root").over(w), "hi": F.max("root").over(w)}).where("lo <> hi").select("key", "me", "root"), "left")
    x, y = (left.select("key", F.col("me").alias(s), F.col("root").alias(f"{s}_root")) for s in "xy")
    rest = x.join(y, "key").where((F.col("x.fp") < F.col("y.fp")) & (F.col("x_root") != F.col("y_root")) & ring_close("x", "y")).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()
    done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return components(links.union(similar(rest.join(done, ["a", "b"], "left_anti"), rows, thin)))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' rows, whole, one of each component: the row with the smallest doc_id. Rows are told apart by a 128-bit hash of all their columns."""
    print_of = ["q_h1", "q_h2"]
    hashed = packed(docs, *row_hashes(docs))
    thin = hashed.select(F.col(f"q_row.`{text_col}`").cast("string").alias("text"), F.col(f"q_row.`{id_col}`").cast("long").alias("doc_id"), *print_of)
    rows = filed(thin)
    roots = cut(set_roots(rows, thin))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), *print_of)
    sized = rows.groupBy("fp").agg(F.count("*").alias("size")).join(roots, F.col("fp") == F.col("node"), "left").select("fp", "size", F.coalesce("root", "fp").alias("root"))
    stays = join_sized(rows.select("doc_id", *print_of, "fp"), cut(sized), "fp", "size", rows.count()).groupBy("root").agg(F.min(order).alias("s")).select(*[f"s.{c}" for c in print_of]).distinct()
    return hashed.join(cut(stays), print_of, "left_semi").dropDuplicates(print_of).select("q_row.*")
