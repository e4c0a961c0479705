"""SimHash near-duplicates, linked by pigeonring filtering.

A 64-bit fingerprint is cut into m = 5 segments on a ring. If two fingerprints differ in at most t = 4 bits, then from some start
segment every chain of l consecutive segments differs in at most l * t / m bits (the pigeonring principle, a stronger
pigeonhole). With t = 4 the budgets are 0, 1, 2, 3, 4: the first segment is equal and the second differs in one bit at most. So a fingerprint
is filed, for each start, under its first two segments, and looked up there and under every key that clears one set bit of the second: each linked
pair meets at least once. What meets is pruned by the budgets of the chains of 3 and 4 segments, and only then by the full distance.

Fingerprints are made distinct first, so a group of copies is one entry. Keys are dealt by hash and each task streams through its sorted keys; in a
large bucket a breadth-first search compares a reached fingerprint only with those not reached yet and gives a spanning star, so neither
links nor pairs within a group are enumerated. Components come from ``components``.

Defined cases: a null text counts as empty; a text without words has fingerprint zero and is linked like any other; texts with fewer words than a shingle
have the whole sequence as their only shingle; of rows that repeat a doc_id each gets its row; a null doc_id gets a row, and is
a component_id only where its component has no other id; an empty table gives an empty result; other columns are ignored
(``near_groups``) or carried (``drop_near_copies``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import LOWER_BYTES, cut, documents, join_sized, packed, partitions, row_hashes
from quillon.llm.components import components

WIDTHS = (13, 13, 13, 13, 12)
OFFSETS = tuple(int(x) for x in np.cumsum((0, *WIDTHS[:-1])))
DISTANCE = 4
SHINGLE = 4
#: Above so many members a bucket is searched breadth-first.
SEARCHED = 64
_CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """The SimHash of a whole text: unsigned, bit i set if set in over half of its shingles' XXH64 (seed 42)."""
    from xxhash import xxh64_intdigest

    tokens = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    n = max(1, len(tokens) - words + 1)
    first, last = starts[:n].tolist(), (ends[words - 1 :] if len(tokens) >= words else ends[-1:]).tolist()
    total = np.zeros(64, np.int64)
    for i in range(0, n, _CHUNK):
        part = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(first[i : i + _CHUNK], last[i : i + _CHUNK])], dtype=">u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n).view(">u8")[0])


def with_fingerprints(docs: DataFrame, text_col: str = "text", words: int = SHINGLE, out: str = "fp") -> DataFrame:
    """docs' columns and ``out``: the fingerprint as a signed long."""
    kept = docs.columns
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x, words) for x in b.column(at).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps)], names=[*kept, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())]))


def _rotated(fps: np.ndarray, start: int) -> np.ndarray:
    """With segment ``start`` in the highest bits."""
    k = np.uint64(OFFSETS[start])
    return fps if start == 0 else (fps << k) | (fps >> (np.uint64(64) - k))


def _mask(start: int, length: int) -> np.uint64:
    bits = sum(WIDTHS[(start + i) % 5] for i in range(length))
    return np.uint64(((1 << bits) - 1) << (64 - bits))


def ring_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which fingerprints are filed and looked up, and the fingerprints again. Key: start, then two segments."""
    keys, out = [], []
    for start in range(5):
        second = WIDTHS[(start + 1) % 5]
        bits = WIDTHS[start] + second
        key = _rotated(fps, start) >> np.uint64(64 - bits)
        base = np.uint64(start << 28)
        keys.append(key | base)
        out.append(fps)
        for b in range(second):
            has = (key >> np.uint64(b)) & np.uint64(1) == 1
            keys.append((key[has] ^ np.uint64(1 << b)) | base)
            out.append(fps[has])
    return np.concatenate(keys), np.concatenate(out)


def _passes(xor: np.ndarray, start: int, distance: int) -> np.ndarray:
    """Positions whose chains of 3 and 4 segments keep their budgets and whose full distance is small enough."""
    at = np.arange(len(xor))
    turned = _rotated(xor, start)
    for length in (3, 4):
        ok = np.bitwise_count(turned & _mask(start, length)) <= length * distance // 5
        at, turned = at[ok], turned[ok]
    return at[np.bitwise_count(turned) <= distance]


def _search(fps: np.ndarray, start: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of a bucket's distinct fingerprints."""
    left, a, b = fps, [], []
    while len(left):
        root, left, front = left[0], left[1:], [left[0]]
        while front and len(left):
            near = _passes(left ^ front.pop(), start, distance)
            if len(near):
                found = left[near]
                left = np.delete(left, near)
                a.append(np.full(len(found), root))
                b.append(found)
                front.extend(found)
    none = np.zeros(0, np.uint64)
    return np.concatenate(a or [none]), np.concatenate(b or [none])


def bucket_links(keys: np.ndarray, fps: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """keys: sorted. Links found within each run of one key; enough of them to connect all that is linked there."""
    cuts = np.flatnonzero(np.diff(keys)) + 1
    begin, end = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
    size = end - begin
    left, right = [], []
    small = (size > 1) & (size <= SEARCHED)
    for n in np.unique(size[small]):
        rows = begin[small & (size == n)][:, None] + np.arange(n)
        i, j = np.triu_indices(n, 1)
        step = max(1, (1 << 20) // len(i))
        for at in range(0, len(rows), step):
            group = fps[rows[at : at + step]]
            of = (keys[rows[at : at + step, 0]] >> np.uint64(28)).astype(np.int64)
            for start in np.unique(of):
                own = group[of == start]
                x, y = own[:, i].ravel(), own[:, j].ravel()
                ok = _passes(x ^ y, int(start), distance)
                left.append(x[ok])
                right.append(y[ok])
    for k in np.flatnonzero(size > SEARCHED):
        x, y = _search(np.unique(fps[begin[k] : end[k]]), int(keys[begin[k]] >> np.uint64(28)), distance)
        left.append(x)
        right.append(y)
    none = np.zeros(0, np.uint64)
    x, y = np.concatenate(left or [none]), np.concatenate(right or [none])
    differ = x != y
    return x[differ], y[differ]


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """distinct: one column ``fp`` (long) of distinct fingerprints. Returns (a, b): links that connect what any links connect."""
    if not 0 <= distance <= DISTANCE:
        raise ValueError("the ring of five segments serves distances up to 4")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(fps), _CHUNK):
                keys, out = ring_keys(fps[i : i + _CHUNK])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(out.view(np.int64))], names=["key", "fp"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(keys, fps):
            x, y = bucket_links(keys, fps, distance)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray]] = []  # the last key's rows, which the next batch may go on with
        for b in batches:
            keys, fps = (b.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            if not len(keys):
                continue
            whole = int(np.searchsorted(keys, keys[-1]))
            if held and keys[0] != held[0][0][0] or whole:
                yield found(np.concatenate([*(k for k, _ in held), keys[:whole]]), np.concatenate([*(f for _, f in held), fps[:whole]]))
                held = []
            held.append((keys[whole:], fps[whole:]))
        if held:
            yield found(np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held]))

    n = max(partitions(distinct.sparkSession), distinct.count() * 33 >> 22)  # some 4 million filed entries a task
    return distinct.mapInArrow(keyed, "key long, fp long").repartition(n, "key").sortWithinPartitions("key").mapInArrow(linked, "a long, b long")


def fingerprint_groups(rows: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """rows: (doc_id, fp). Returns (fp, root, component_id, size) with one row per distinct fingerprint; root names the component, size counts the rows."""
    least = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")))
    roots = components(links(least.select("fp"), distance))
    placed = cut(least.join(roots, least["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least", "size"))
    named = cut(placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")))
    return join_sized(placed, named, "root", "members", placed.count()).select("fp", "root", "component_id", "size")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    rows = cut(with_fingerprints(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "text", words).select("doc_id", "fp"))
    placed = join_sized(rows, cut(fingerprint_groups(rows, distance)), "fp", "size", rows.count())
    return placed.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """docs' rows, whole, one of each component: the row with the smallest doc_id (a null id only where there is no other).

    Rows are told apart by a 128-bit hash of all their columns and nulls, so one of fully repeated rows stays too.
    """
    print_of = ["q_h1", "q_h2"]
    hashed = packed(docs, *row_hashes(docs))
    thin = hashed.select(F.col(f"q_row.`{id_col}`").cast("long").alias("doc_id"), F.col(f"q_row.`{text_col}`").alias("text"), *print_of)
    rows = cut(with_fingerprints(thin, "text", words).select("doc_id", "fp", *print_of))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), *print_of)
    stays = join_sized(rows, cut(fingerprint_groups(rows, distance)), "fp", "size", rows.count()).groupBy("root").agg(F.min(order).alias("s")).select("s.*")
    stays = cut(stays.select(*print_of).distinct())
    return hashed.join(stays, print_of, "left_semi").dropDuplicates(print_of).select("q_row.*")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))


SQL: dict[str, str] = {}
QUERIES = {"op9_simhash": op9_simhash}
