"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents, in an order shuffled by a hash, lie on a line of words. The mix has a slot for each word of the corpus, whatever its size. Slot j is mapped by the golden-ratio
point frac(j * phi) through the cumulative target weights to a source, and the slots of a source are ranked: the slot of rank r takes the
source's word r modulo its size, in pass r div that size. Low discrepancy keeps every prefix of the mix near the weights.

Every slot is made: a task makes ``SLOTS`` slots at a time, maps each to its source and counts them, running sums over these runs rank them, and runs meet the documents whose words they take in
cells of the line of words. This is the schedule, a row for each run of slots, pass and document; what a document takes is its sum. ``points_below`` gives a source's number of slots in whole numbers by Euclid's steps, as a check.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share 100 % of all words; a target stops at 3 times its source, and the excess is
shared again by weight until none is above.

Positions on the lines are running sums over a range-partitioned order, so a hot source is spread over many tasks.

Defined cases: null text has size 0; null is a source of its own; documents of size 0 take nothing; rows that repeat a doc_id lie side by side and count
each (among rows of one doc_id the smaller comes first, then their other columns decide, so reruns and other partitionings agree); sources of no words have target 0; a null doc_id is kept; an empty table gives an empty result; other columns are ignored by ``mix`` and carried by ``mixed_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import WORD, cut, documents, packed, partitions, row_hashes

WEIGHTS = (5, 2, 1)
PASSES = 3
GOLDEN = 0.6180339887498949
#: Slots of a run of the schedule, words of a cell of the line, sources that a task maps slots to at a time.
SLOTS = 1 << 20
CELL = 1 << 20
SOURCES = 1 << 16


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def running(rows: DataFrame, order: list[Column], value: str, out: str) -> DataFrame:
    """rows and ``out``: the sum of ``value`` over all rows before, in the global order. No task sees more than its range of the order."""
    spark = rows.sparkSession
    ranged = cut(rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("q_part", F.spark_partition_id()))
    sums = {r[0]: r[1] for r in ranged.groupBy("q_part").agg(F.sum(value)).collect()}  # one number for each partition
    before, total = {}, 0
    for part in sorted(sums):
        before[part], total = total, total + (sums[part] or 0)
    at_value, at_part, names = ranged.columns.index(value), ranged.columns.index("q_part"), ranged.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far: dict[int, int] = {}
        for b in batches:
            values, parts = b.column(at_value).to_numpy(zero_copy_only=False), b.column(at_part).to_numpy()
            sums_here = np.zeros(len(values), np.int64)
            for p in np.unique(parts).tolist():
                own = parts == p
                ends = np.cumsum(values[own]) + so_far.get(p, before[p])
                sums_here[own], so_far[p] = ends - values[own], int(ends[-1])
            yield pa.RecordBatch.from_arrays([*(c for c, n in zip(b.columns, names) if n != "q_part"), pa.array(sums_here)], names=[*(n for n in names if n != "q_part"), out])

    schema = rows.withColumn(out, F.lit(0).cast("long")).schema
    return ranged.mapInArrow(run, schema)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """sizes: (source, source_size). Adds no (rank by code point, null last), weight and target.

    Each round of sharing is an aggregate of two numbers, so the number of sources may be large.
    """
    ordered = running(sizes.select("source", "source_size", F.lit(1).cast("long").alias("one")), [F.col("source").asc_nulls_last()], "one", "no").drop("one")
    table = cut(ordered.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("no") % len(weights) + 1).cast("int"))).withColumn("full", F.lit(False)))
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    while True:
        capped, weight = table.agg(F.coalesce(F.sum(F.when(F.col("full"), F.col("source_size") * passes)), F.lit(0)), F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))), F.lit(0))).first()
        share = (F.col("weight") * F.lit(total - capped)).cast("double") / F.lit(float(max(weight, 1)))
        marked = cut(table.withColumn("full", F.col("full") | (share > F.col("source_size") * passes)))
        if not marked.exceptAll(table).take(1):
            return table.withColumn("target", F.when(F.col("full"), (F.col("source_size") * passes).cast("double")).otherwise(share)).drop("full")
        table = marked


def floor_sum(n: int, m: int, a: int, b: int) -> int:
    """Sum of (a * i + b) // m over i from 0 to n - 1, for a, b >= 0."""
    total = 0
    while n > 0:
        total += n * (n - 1) // 2 * (a // m) + n * (b // m)
        a, b = a % m, b % m
        top = a * n + b
        n, b = divmod(top, m)
        m, a = a, m
        if top < a:
            break
    return total


def points_below(slots: int, low: int, whole: int) -> int:
    """How many of frac(j * GOLDEN) * whole, j from 1 to ``slots``, are below low; GOLDEN is a whole number of 2^-53."""
    one, step = 1 << 53, int(GOLDEN * (1 << 53))
    bound = -(-low * one // whole)
    return slots + floor_sum(slots, one, step, step) - floor_sum(slots, one, step, step + one - bound)


def slot_runs(table: DataFrame, total: int) -> DataFrame:
    """no, run, n: how many of the slots run * SLOTS + 1 to (run + 1) * SLOTS, ``total`` at most, each source has."""
    spark, one, step = table.sparkSession, 1 << 53, np.uint64(int(GOLDEN * (1 << 53)))
    spans = cut(running(table.select("no", F.round("target").cast("long").alias("units")), [F.col("no")], "units", "low"))
    whole = spans.agg(F.coalesce(F.sum("units"), F.lit(0))).first()[0]

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            no, units, low = (b.column(i).to_pylist() for i in range(3))
            at = [[-(-x * one // whole) for x in xs] for xs in (low, [u + x for u, x in zip(units, low)])]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in at)], names=["no", "q_low", "q_high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = np.arange(1, SLOTS + 1, dtype=np.uint64) * step
        for b in batches:
            for i in range(b.num_rows):
                at, s = b.column(0)[i].as_py(), b.column(1).slice(i, 1).flatten()
                low, high, no = (s.field(j).to_numpy(zero_copy_only=False) for j in range(3))
                points = ((steps[: min(SLOTS, total - at * SLOTS)] + np.uint64(at * SLOTS) * step) & np.uint64(one - 1)).astype(np.int64)
                n = np.bincount(np.searchsorted(np.append(low, high[-1]), points, side="right"), minlength=len(no) + 2)[1:-1]
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(no[some]), pa.array(np.full(len(some), at)), pa.array(n[some])], names=["no", "run", "n"])

    salts = 4 * partitions(spark)
    ends = spans.select("no", "units", "low").where("units > 0").mapInArrow(bounds, "no long, q_low long, q_high long")
    held = ends.groupBy(F.expr(f"no div {SOURCES}").alias("q_b")).agg(F.array_sort(F.collect_list(F.struct("q_low", "q_high", "no"))).alias("s"))
    held = held.withColumn("q_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    runs = spark.range(0, -(-total // SLOTS), 1, partitions(spark)).select(F.col("id").alias("run"), (F.col("id") % salts).cast("int").alias("q_salt"))
    return cut(runs.join(held, "q_salt").select("run", "s").mapInArrow(run, "no long, run long, n long"))


def schedule(line: DataFrame, sources: DataFrame, passes: int = PASSES) -> DataFrame:
    """The mix: q_at (a document's first word on the line of all words), first_slot, last_slot, pass, words (how many of these slots hold the document's words).

    line: no, q_at, size; sources: what ``targets`` gives.
    """
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    ranked = cut(running(slot_runs(sources, total), [F.col("no"), F.col("run")], "n", "q_rank"))
    begins = line.groupBy("no").agg(F.min("q_at").alias("q_begin")).join(ranked.groupBy("no").agg(F.min("q_rank").alias("q_first")), "no").join(sources.select("no", "source_size"), "no")
    size, rank = F.col("source_size"), F.col("q_rank") - F.col("q_first")
    parts = ranked.join(begins, "no").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    parts = parts.withColumns({"q_from": F.greatest(rank - F.col("pass") * size, F.lit(0)), "q_to": F.least(rank + F.col("n") - F.col("pass") * size, size)}).where("q_from < q_to")
    parts = parts.select("run", "pass", (F.col("q_begin") + F.col("q_from")).alias("q_from"), (F.col("q_begin") + F.col("q_to")).alias("q_to"))
    cells = lambda a, b: F.explode(F.sequence(F.expr(f"{a} div {CELL}"), F.expr(f"({b} - 1) div {CELL}"))).alias("q_cell")

    def meet(docs: pa.Table, runs: pa.Table) -> pa.Table:
        at, to = (docs[c].to_numpy() for c in ("q_at", "q_end"))
        order = np.argsort(at)
        at, to = at[order], to[order]
        cell, low, high, run, turn = (runs[c].to_numpy() for c in ("q_cell", "q_from", "q_to", "run", "pass"))
        low, high = np.maximum(low, cell * CELL), np.minimum(high, (cell + 1) * CELL)
        first = np.searchsorted(to, low, side="right")
        n = np.searchsorted(at, high, side="left") - first
        of = np.repeat(np.arange(len(n)), n)
        doc = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of]
        words = np.minimum(to[doc], high[of]) - np.maximum(at[doc], low[of])
        slots = run[of] * SLOTS
        return pa.table({"q_at": at[doc], "first_slot": slots + 1, "last_slot": np.minimum(slots + SLOTS, total), "pass": turn[of], "words": words})

    docs = line.where("size > 0").withColumn("q_end", F.col("q_at") + F.col("size")).select("q_at", "q_end", cells("q_at", "q_end"))
    met = docs.groupBy("q_cell").cogroup(parts.select("*", cells("q_from", "q_to")).groupBy("q_cell"))
    return met.applyInArrow(meet, "q_at long, first_slot long, last_slot long, pass int, words long")


def mix(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """rows: doc_id, source, size and more thin columns that can be ordered; rows equal in all of them are alike. Adds source_size, target and taken (words the mix takes, repeats counted)."""
    rows = cut(rows)
    more = [c for c in rows.columns if c != "source"]
    sources = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, passes))
    placed = rows.join(sources.withColumnRenamed("source", "q_source"), F.col("source").eqNullSafe(F.col("q_source"))).select("no", "source_size", "target", *more)
    keyed = placed.withColumn("q_key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    line = cut(running(keyed, [F.col(c) for c in ("no", "q_key", *more)], "size", "q_at").drop("q_key"))
    words = schedule(line.select("no", "q_at", "size"), sources, passes).groupBy(F.col("q_at").alias("q_of")).agg(F.sum("words").alias("q_words"))
    line = line.join(words, (F.col("q_at") == F.col("q_of")) & (F.col("size") > 0), "left")
    taken = F.coalesce("q_words", F.lit(0)).cast("long")
    return line.select(*more, "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs' rows, whole, each as often as the mix takes it: round(taken / size) times, 0 to 3. Texts without words have nothing to take."""
    hashes = ["q_h1", "q_h2"]
    hashed = packed(docs, *row_hashes(docs))
    thin = hashed.select(F.col(f"q_row.`{id_col}`").cast("long").alias("doc_id"), F.col(f"q_row.`{source_col}`").alias("source"), n_words(F.col(f"q_row.`{text_col}`")).alias("size"), *hashes)
    often = mix(thin).where("size > 0").groupBy(*hashes).agg(F.sum(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int").alias("n"))
    often = cut(often.where("n > 0"))  # fully repeated rows count together
    return hashed.dropDuplicates(hashes).join(often, hashes).select("q_row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("q_row.*")


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return mix(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size")))


SQL = {
    "op4_mixing": f"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM d GROUP BY source),
        w AS (SELECT *, CASE no % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
        o AS (SELECT *, sum(source_size) OVER () AS total,
                     coalesce(sum(3 * source_size) OVER b, 0) AS caps, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS rest
              FROM w WINDOW b AS (ORDER BY source_size::DOUBLE / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        k AS (SELECT *, (weight * (total - caps))::DOUBLE / rest > 3 * source_size AS is_full FROM o),
        t AS (SELECT *, sum(CASE WHEN is_full THEN 3 * source_size ELSE 0 END) OVER () AS full_caps,
                     sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () AS full_rest FROM k),
        g AS (SELECT no, source, source_size, total::BIGINT AS total,
                     CASE WHEN is_full THEN (3 * source_size)::DOUBLE ELSE (weight * (total - full_caps))::DOUBLE / full_rest::DOUBLE END AS target FROM t),
        u AS (SELECT no, round(target)::BIGINT AS units, coalesce(sum(round(target)::BIGINT) OVER (ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS low,
                     (sum(round(target)::BIGINT) OVER ())::BIGINT AS whole FROM g),
        p AS (SELECT (((j::HUGEINT * {int(GOLDEN * (1 << 53))}) % {1 << 53}) * (SELECT any_value(whole) FROM u)::HUGEINT // {1 << 53})::BIGINT AS point
              FROM range(1, (SELECT any_value(total) FROM g) + 1) r(j)),
        n AS (SELECT u.no, count(*) AS slots FROM p JOIN u ON point >= low AND point < low + units GROUP BY u.no),
        l AS (SELECT d.doc_id, d.size, g.source_size, g.target, least(coalesce(n.slots, 0), 3 * g.source_size) AS n,
                     coalesce(sum(d.size) OVER (PARTITION BY g.no ORDER BY md5(d.doc_id::VARCHAR), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
              FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN n ON n.no = g.no)
        SELECT doc_id, size::BIGINT AS size, source_size, target,
               (CASE WHEN size > 0 THEN n // source_size * size + greatest(0, least(n % source_size, pos + size) - pos) ELSE 0 END)::BIGINT AS taken
        FROM l""",
}
QUERIES = {"op4_mixing": op4_mixing}
