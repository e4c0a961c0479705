"""Exact dedup by two-pass Bloom filtering, in DataFrame operations only.

Pass one hashes every normalised text to a slot of a sparse first filter. Its tasks send the numbers of the slots they hit (8 bytes; dense bit arrays of that many
bits would be larger than these from a few tasks on), and merging finds the slots that are hit at least twice. These go into a second, blocked Bloom filter: 64-bit words in
which each slot sets two bits, one word for four slots, ``filter_words`` at most, so that it can be broadcast. Pass two tests every row against it.
A row that misses is certainly unique and passes straight through: neither its text nor its digest or id is shuffled. Only the rows that hit are, and there
the full SHA-256 decides. A filter that is too small for the corpus lets more rows through to the shuffle; it never changes the result.

Defined cases: a null text counts as empty; texts are equal when identical after lower-casing A-Z only; of equal texts the row with
the largest doc_id stays (a null doc_id is below all others, and a hash of the whole row decides between rows of one doc_id); of rows that repeat a doc_id and its text one stays; an empty
table gives an empty result; other columns are carried by ``drop_exact_copies`` whatever their names and ignored by ``exact_groups``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut, documents, join_sized, normal, packed, row_hashes

SLOT_BITS = 40
#: The second filter's bound: 64 MB as rows of a broadcast, enough for 16 million repeated texts at four slots a word.
FILTER_WORDS = 1 << 22


def _slot(hashed: Column, slot_bits: int) -> Column:
    return F.shiftrightunsigned(hashed, 64 - slot_bits)


def _word(slot: Column, filter_words: int) -> Column:
    return F.pmod(F.xxhash64(slot), F.lit(filter_words))


def _bits(slot: Column) -> Column:
    """The two bits that a slot sets in its word."""
    mixed = F.xxhash64(slot, F.lit("bits"))
    one = F.expr("1L")
    low, high = F.pmod(mixed, F.lit(64)).cast("int"), F.pmod(F.shiftrightunsigned(mixed, 8), F.lit(64)).cast("int")
    return F.call_function("shiftleft", one, low).bitwiseOR(F.call_function("shiftleft", one, high))


def bloom(slots: DataFrame, filter_words: int = FILTER_WORDS) -> tuple[DataFrame, int]:
    """slots: one column ``slot``. The Bloom filter (word, bits) of these, written to the shared folder, and how many words it was given: a power of two by their number, filter_words at most."""
    slots = cut(slots)
    words = min(filter_words, max(64, 1 << (slots.count() // 4).bit_length()))
    return cut(slots.select(_word(F.col("slot"), words).alias("word"), _bits(F.col("slot")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))), words


def repeat_filter(hashes: DataFrame, slot_bits: int = SLOT_BITS, filter_words: int = FILTER_WORDS) -> tuple[DataFrame, int]:
    """hashes: one column ``h``. The Bloom filter of the slots that were hit twice or more."""
    return bloom(hashes.select(_slot(F.col("h"), slot_bits).alias("slot")).groupBy("slot").agg(F.count("*").alias("n")).where("n > 1").select("slot"), filter_words)


def split_by_filter(rows: DataFrame, filter_of: tuple[DataFrame, int], slot_bits: int = SLOT_BITS) -> tuple[DataFrame, DataFrame]:
    """Rows (with a column ``h``) whose slot may be in the filter, and those whose slot certainly isn't. Neither is shuffled."""
    found, words = filter_of
    slot = _slot(rows["h"], slot_bits)
    hit = (_word(slot, words) == found["word"]) & (found["bits"].bitwiseAND(_bits(slot)) == _bits(slot))
    small = F.broadcast(found)  # at most filter_words rows of 16 bytes
    return rows.join(small, hit, "left_semi"), rows.join(small, hit, "left_anti")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slot_bits: int = SLOT_BITS, filter_words: int = FILTER_WORDS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    norm = normal(F.col(text_col))
    rows = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), norm.alias("norm")).select("doc_id", F.xxhash64("norm").alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha")))
    maybe, once = split_by_filter(rows, repeat_filter(rows.select("h"), slot_bits, filter_words), slot_bits)
    ids = cut(maybe.groupBy("sha", "doc_id").agg(F.count("*").alias("n")))
    groups = cut(ids.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size")))
    # Each (text, doc_id) once; rows that repeat both come back as n rows, of which the first can stay.
    several = join_sized(ids, groups, "sha", "group_size", rows.count())
    several = several.select("doc_id", "keep_id", "group_size", "sha", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i"))
    several = several.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)).alias("kept"), "sha")
    alone = once.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    return alone.unionByName(several).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slot_bits: int = SLOT_BITS, filter_words: int = FILTER_WORDS) -> DataFrame:
    """The rows of docs, whole, without exact copies. Unique rows are not shuffled; a hot group is combined before its shuffle."""
    norm = normal(F.col(f"`{text_col}`"))
    rows = packed(docs, F.xxhash64(norm).alias("h"), norm.alias("norm"), row_hashes(docs)[0])
    maybe, once = split_by_filter(rows, repeat_filter(rows.select("h"), slot_bits, filter_words), slot_bits)
    best = F.struct(F.col(f"q_row.`{id_col}`"), F.col("q_h1"))
    stays = maybe.groupBy(F.sha2("norm", 256).alias("sha")).agg(F.max_by("q_row", best).alias("q_row"))
    return once.select("q_row.*").unionByName(stays.select("q_row.*"))


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


_SQL_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = {
    "op3_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_SQL_NORM} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
        FROM d WINDOW g AS (PARTITION BY t)""",
}
QUERIES = {"op3_exact_dedup": op3_exact_dedup}
