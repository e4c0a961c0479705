"""What the learned scorers share: sparse text features, the labelled table, class counts over all of it and bounded samples.

Labels are joined by doc_id. Rows with a null doc_id or label are left out; where rows disagree on a doc_id the mean decides, 0.5 and more counting as 1.
A null text counts as empty (one indicator of its own in ``shape_features``, no words in ``word_features``); very long texts are read whole; of rows that repeat a doc_id each is a row
of its own, and the bounded sample orders them by a hash of the text; empty tables give empty counts and samples.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut, forgetful, id_crc32

#: Size of the hashed feature space.
FEATURES = 1 << 18
#: Words that a worker remembers before it starts anew.
CACHED = 150_000
#: Up to so many labels are broadcast; beyond, features are joined to them by a shuffle.
BROADCAST_ROWS = 1 << 18
#: Labelled rows of each class that a model is fitted on at most; class counts cover all rows.
SAMPLED = 4000
_LETTERS, _DIGITS, _SAME = re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"(.)\1+")
_shapes: dict[str, int] = {}
_words: dict[str, tuple[int, int]] = {}


def shape(token: str) -> int:
    """A number for a token's form: letters by case, digits and marks, each run once (runs of marks twice)."""
    if (found := _shapes.get(token)) is None:
        form = _LETTERS.sub(lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "B" if m[0][0].isupper() else "a", token)
        form = _SAME.sub(r"\1\1", _DIGITS.sub("0", form))
        if len(_shapes) >= CACHED:
            _shapes.clear()
        found = _shapes[token] = zlib.crc32(form.encode("utf-8", "surrogatepass"))
    return found


def word(token: str) -> tuple[int, int]:
    """Numbers for a token without marks around it, in lower case, and for its first four letters (the same number again for shorter words)."""
    if (found := _words.get(token)) is None:
        form = re.sub(r"^\W+|\W+$", "", token).lower().encode("utf-8", "surrogatepass").decode("utf-8", "replace")
        if len(_words) >= CACHED:
            _words.clear()
        whole = zlib.crc32(form.encode())
        found = _words[token] = (whole, zlib.crc32(f"{form[:4]}*".encode()) if len(form) > 4 else whole)
    return found


def forget() -> None:
    _shapes.clear()
    _words.clear()


def _mixed(codes: np.ndarray, salt: int) -> np.ndarray:
    """Feature numbers of 64-bit codes."""
    x = (codes + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - 18)).astype(np.int32)


def shape_features(text: str | None) -> np.ndarray:
    """Indicators of token-form n-grams (1 and 2), and of a token that repeats the one before, at the levels of share they reach: any, 1/64, 1/16, 1/4."""
    tokens = (text or "").split()
    if not tokens:
        return _mixed(np.array([0], np.uint64), 1)
    known = _shapes.get
    one = np.array([known(t) or shape(t) for t in tokens], np.uint64)
    two = one[:-1] * np.uint64(0x100000001B3) + one[1:] if len(one) > 1 else one[:0]
    again = sum(a == b for a, b in zip(tokens, tokens[1:]))
    out = []
    for order, codes in ((1, one), (2, two), (3, np.zeros(again, np.uint64))):
        if len(codes):
            u, n = np.unique(codes, return_counts=True)
            for level, share in enumerate((0, 1 / 64, 1 / 16, 1 / 4)):
                out.append(_mixed(u[n >= share * len(tokens)], 16 * order + level))
    return np.unique(np.concatenate(out))


def word_features(text: str | None) -> np.ndarray:
    """Hashed words and word beginnings, repeats included."""
    tokens = (text or "").split()
    known = _words.get
    if not tokens:
        return np.zeros(0, np.int32)
    codes = np.array([known(t) or word(t) for t in tokens], np.uint64)
    whole, begin = codes[:, 0], codes[:, 1]
    return _mixed(np.concatenate((whole, begin[begin != whole])), 7)


def labelled(docs: DataFrame, labels: DataFrame, label: str, features: Callable[[str | None], np.ndarray], train_rest: int = 2, modulus: int = 4) -> DataFrame:
    """doc_id, y, h (a hash of the text), f (distinct features), n (how often each stands in the text): the documents with a label whose crc32(doc_id as text) mod ``modulus`` is not ``train_rest``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                found = [np.unique(features(x), return_counts=True) for x in part.column(1).to_pylist()]
                cols = [pa.array([x[j] for x in found], pa.list_(pa.int32())) for j in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], *cols], names=["doc_id", *b.schema.names[2:], "f", "n"])

    rows = docs.where(F.col("doc_id").isNotNull() & (id_crc32(F.col("doc_id")) % modulus != train_rest)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    y = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    y = cut(y)
    h = F.xxhash64("text").alias("h")
    if y.count() <= BROADCAST_ROWS:  # 16 bytes each: texts stay where they are and only labelled ones are read into features
        return cut(rows.join(F.broadcast(y), "doc_id").select("doc_id", "text", "y", h).mapInArrow(forgetful(run, forget), "doc_id long, y int, h long, f array<int>, n array<int>"))
    return cut(rows.select("doc_id", "text", h).mapInArrow(forgetful(run, forget), "doc_id long, h long, f array<int>, n array<int>").join(y, "doc_id").select("doc_id", "y", "h", "f", "n"))  # features are thinner than texts


def class_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(documents with each feature by class, documents by class), over all labelled rows. Tasks send sums of a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n = np.zeros((2, FEATURES), np.int64), np.zeros(2, np.int64)
        for b in batches:
            y, f = b.column(0).to_numpy(), b.column(1)
            of = np.repeat(y, np.diff(f.offsets.to_numpy()))
            flat = f.values.to_numpy()[f.offsets[0].as_py() : f.offsets[-1].as_py()]
            for c in (0, 1):
                table[c] += np.bincount(flat[of == c], minlength=FEATURES)
                n[c] += int((y == c).sum())
        some = np.flatnonzero(table.any(axis=0))
        index = np.concatenate(([-1], some))
        yield pa.RecordBatch.from_arrays([pa.array(index), *(pa.array(np.concatenate((n[[c]], table[c][some]))) for c in (0, 1))], names=["i", "n0", "n1"])

    sums = rows.select("y", "f").mapInArrow(run, "i long, n0 long, n1 long").groupBy("i").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    i, counts = sums["i"].to_numpy(), np.stack([sums["n0"].to_numpy(), sums["n1"].to_numpy()])
    table = np.zeros((2, FEATURES), np.int64)
    table[:, i[i >= 0]] = counts[:, i >= 0]
    return table, counts[:, i == -1].sum(axis=1)


def sample(rows: DataFrame, n: np.ndarray, each: int = SAMPLED) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Features, their counts and labels of at most ``each`` rows of each class, the first by a hash of the id, then the id, then the text. n: rows of each class.

    Only rows with hashes low enough for about twice as many are sorted, so what meets in one task doesn't grow with the table.
    """
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    found = []
    for c in (0, 1):
        own = rows.where(F.col("y") == c)
        low = own.where(place <= min(int(2 * each / max(int(n[c]), 1) * 2.0**63), 2**63 - 1))
        part = low.orderBy(place, "doc_id", "h").limit(each).select("y", "f", "n").toArrow()
        if part.num_rows < min(each, int(n[c])):  # chance left too few
            part = own.orderBy(place, "doc_id", "h").limit(each).select("y", "f", "n").toArrow()
        found.append(part)
    f, many = ([np.asarray(x, np.int64) for t in found for x in t[c].to_pylist()] for c in ("f", "n"))
    return f, many, np.concatenate([t["y"].to_numpy() for t in found]).astype(np.int64)
