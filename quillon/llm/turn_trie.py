"""Prefix trie of conversations by fixed-length block hashing.

A conversation's turns are cut into blocks of ``BLOCK``. Every turn has a 128-bit hash of its place, role and text; a block's digest is the exclusive or of its turns, a prefix's that of its blocks and turns, so
prefixes are equal (up to chance) just where their digests are. Conversations are first grouped by the digests at block borders: a cell is a prefix of whole blocks, its members are the conversations that go on from there.
Where all members have the same next block, they share the turns inside it, which are taken from one of them. Only where siblings diverge in a block are its turns grouped one by one.

Sums over subtrees need no walk down the trie. Of a node's members the smallest names it, and once it names a node it names all deeper nodes on its path: these are its chain. A subtree is its naming member's chain from
the node on, and the whole chains of all other members; so it is a second grouping of the same cells, with the chains' sums.

Groupings combine before they shuffle; cells and nodes of many rows are broadcast instead of gathered (``join_sized``); what runs along conversations runs along ranges of the global order, so a long conversation is
split. The ids that end at a node are sorted by ranges too, put into strings of at most ``CHUNK`` ids, and one task streams a node's strings through SHA-256, which can't be split.

Defined cases: a null role or text is empty; turns of one conversation are ordered by turn, null first, equal ones by a hash of role and text; rows without conv_id are left out; repeated rows are turns of their own; an empty
table gives an empty result, without a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.common import cut, id_crc32, join_sized, partitions

BLOCK = 4
CHUNK = 1 << 16
EMPTY = hashlib.sha256(b"").hexdigest()
NODE, CELL = ["depth", "hx", "hy"], ["k", "px", "py"]


def along(rows: DataFrame, order: list[str], sums: dict[str, str], xors: dict[str, str]) -> DataFrame:
    """rows and, for each out: value, the sum (or exclusive or) of value over all rows before, in the global order. No task sees more than its range of it."""
    ranged = cut(rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order).withColumn("q_part", F.spark_partition_id()))
    kinds = {**{o: (v, np.add) for o, v in sums.items()}, **{o: (v, np.bitwise_xor) for o, v in xors.items()}}
    totals = ranged.groupBy("q_part").agg(*[F.sum(v).alias(o) for o, v in sums.items()], *[F.bit_xor(v).alias(o) for o, v in xors.items()]).orderBy("q_part").collect()  # a row a partition
    before, now = {}, {o: np.int64(0) for o in kinds}
    for t in totals:
        before[t["q_part"]] = now
        now = {o: op(now[o], np.int64(t[o] or 0)) for o, (_, op) in kinds.items()}
    names = ranged.columns
    kept = [n for n in names if n != "q_part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, dict] = {}
        for b in batches:
            part = b.column(names.index("q_part")).to_numpy()
            made = {o: np.zeros(len(part), np.int64) for o in kinds}
            for p in np.unique(part).tolist():
                own, at = part == p, state.setdefault(p, dict(before[p]))
                for o, (v, op) in kinds.items():
                    x = op.accumulate(np.concatenate(([at[o]], b.column(names.index(v)).to_numpy()[own])))
                    made[o][own], at[o] = x[:-1], x[-1]
            yield pa.RecordBatch.from_arrays([*(b.column(names.index(n)) for n in kept), *(pa.array(made[o]) for o in kinds)], names=[*kept, *kinds])

    schema = rows.withColumns({o: F.lit(0).cast("long") for o in kinds}).schema
    return ranged.mapInArrow(run, schema)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), t1, t2 (hash of role and text), size (UTF-8 bytes of the text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    thin = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").isNotNull().alias("timed"), "turn", F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit(1), text, role).alias("t2"),
        F.octet_length(text).cast("long").alias("size"), F.lit(1).cast("long").alias("one"),
    )
    line = cut(along(thin, ["conv_id", "timed", "turn", "t1", "t2"], {"at": "one"}, {}))
    first = line.groupBy("conv_id").agg(F.min("at").alias("begin"), F.count("*").alias("turns"))
    line = join_sized(line, cut(first), "conv_id", "turns", line.count())
    return line.select("conv_id", (F.col("at") - F.col("begin") + 1).alias("pos"), "t1", "t2", "size")


def rebuilt(turns: DataFrame, family: int = 5, lengths: int = 9) -> tuple[DataFrame, DataFrame]:
    """turns as ``ordered_turns`` gives them. Conversation c starts with the first h turns of c - c % family, h = crc32(c) % lengths, then has its own after its first h. Returns ids (conv_id) and turns."""
    own = cut(turns)
    ids = own.groupBy("conv_id").agg(F.count("*").alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % family
    ids = cut(ids.select("conv_id", "n", base.alias("base"), (id_crc32(F.col("conv_id")) % lengths).alias("h")))
    lent = ids.select(F.col("conv_id").alias("base"), F.col("n").alias("lent"))
    ids = cut(ids.join(lent, "base", "left").withColumn("lent", F.least(F.coalesce("lent", F.lit(0).cast("long")), F.col("h"))))
    heads = own.where(F.col("pos") < lengths).withColumnRenamed("conv_id", "base").join(ids.select("conv_id", "base", "h"), "base").where("pos <= h").select("conv_id", "pos", "t1", "t2", "size")
    tails = join_sized(own, ids, "conv_id", "n", own.count()).where("pos > h").select("conv_id", (F.col("lent") + F.col("pos") - F.col("h")).alias("pos"), "t1", "t2", "size")
    return ids.select("conv_id"), heads.unionByName(tails)


def _placed(turns: DataFrame, blocks: DataFrame) -> DataFrame:
    """The turns of those blocks: depth, digests up to each turn (hx, hy) and before it (ox, oy), and the blocks' other columns."""
    w = W.partitionBy("conv_id", "k").orderBy("pos")  # a block's turns
    out = turns.join(blocks, ["conv_id", "k"]).withColumns({"hx": F.col("px").bitwiseXOR(F.bit_xor("x").over(w)), "hy": F.col("py").bitwiseXOR(F.bit_xor("y").over(w))})
    return out.withColumns({"ox": F.col("hx").bitwiseXOR(F.col("x")), "oy": F.col("hy").bitwiseXOR(F.col("y"))}).withColumnRenamed("pos", "depth")


def _ends(ids: DataFrame, blocks: DataFrame) -> DataFrame:
    """NODE, ends_sha256: of the conversations that end at each node."""
    last = blocks.groupBy("conv_id").agg(F.max_by(F.struct((F.col("k") * BLOCK + F.col("n")).alias("depth"), F.col("px").bitwiseXOR(F.col("bx")).alias("hx"), F.col("py").bitwiseXOR(F.col("by")).alias("hy")), "k").alias("e"))
    zero = F.lit(0).cast("long")
    ended = ids.join(last, "conv_id", "left").select(*[F.coalesce(f"e.{c}", zero).alias(c) for c in NODE], "conv_id")
    line = cut(ended.repartitionByRange(partitions(ids.sparkSession), *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id"))

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.column_stack([b.column(i).to_numpy() for i in range(3)])
            cuts = [*np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, b.num_rows]
            ids, rows, i = b.column(3).to_pylist(), [], 0
            for end in cuts:
                for j in range(i, end, CHUNK):
                    own = ids[j : min(j + CHUNK, end)]
                    rows.append((*keys[i].tolist(), own[0], ",".join(map(str, own))))
                i = end
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4])], names=[*NODE, "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows):
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3])], names=[*NODE, "ends_sha256"])

        node, sha, rows = None, None, []
        for b in batches:
            for *key, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if key == node:
                    sha.update(b"," + ids.encode())
                    continue
                if node is not None:
                    rows.append((*node, sha.hexdigest()))
                node, sha = key, hashlib.sha256(ids.encode())
            if len(rows) > 1000:
                yield batch(rows)
                rows = []
        if node is not None:
            yield batch([*rows, (*node, sha.hexdigest())])

    ints = ", ".join(f"{c} long" for c in NODE)
    chunks = line.mapInArrow(strings, f"{ints}, first long, ids string")
    return chunks.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digests, f"{ints}, ends_sha256 string")


def trie(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """ids: conv_id of every conversation, each once. turns: conv_id, pos, t1, t2, size. One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    place: list[Column] = [F.xxhash64("pos", "t1", "t2"), F.xxhash64("pos", "t2", "t1")]
    turns = cut(turns.select("conv_id", F.expr(f"(pos - 1) div {BLOCK}").alias("k"), "pos", place[0].alias("x"), place[1].alias("y"), "size"))
    ids = cut(ids)
    blocks = turns.groupBy("conv_id", "k").agg(F.bit_xor("x").alias("bx"), F.bit_xor("y").alias("by"), F.count("*").alias("n"))
    line = cut(along(blocks, ["conv_id", "k"], {}, {"ax": "bx", "ay": "by"}))
    begins = cut(line.groupBy("conv_id").agg(F.min_by(F.struct("ax", "ay"), "k").alias("b"), F.count("*").alias("blocks")))
    total = line.count()
    line = cut(join_sized(line, begins, "conv_id", "blocks", total).select("conv_id", "k", "bx", "by", "n", F.col("ax").bitwiseXOR(F.col("b.ax")).alias("px"), F.col("ay").bitwiseXOR(F.col("b.ay")).alias("py")))
    alike = (F.min("bx") == F.max("bx")) & (F.min("by") == F.max("by"))
    cells = cut(line.groupBy(*CELL).agg(F.min("conv_id").alias("least"), F.count("*").alias("members"), alike.alias("alike")))
    line = cut(join_sized(line, cells, CELL, "members", total))

    # Nodes: turns of cells whose members agree come from their smallest member, all others are grouped one by one.
    shared = cut(_placed(turns, line.where("alike AND conv_id = least").select("conv_id", *CELL, "members")))
    split = cut(_placed(turns, line.where("NOT alike").select("conv_id", *CELL)))
    own = [*NODE, "ox", "oy", "conv_id", "n_convs", "size"]
    grouped = split.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("ox").alias("ox"), F.min("oy").alias("oy"), F.min("size").alias("size"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(*[zero.alias(c) for c in NODE], none.alias("ox"), none.alias("oy"), "conv_id", "n_convs", zero.alias("size"))
    nodes = cut(shared.withColumnRenamed("members", "n_convs").select(*own).unionByName(grouped.select(*own)).unionByName(root.select(*own)))

    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("ox").alias("hx"), F.col("oy").alias("hy")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = cut(nodes.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("size")}))
    n_nodes = nodes.count()

    # Chains: sums of each naming member's nodes, and from each of its nodes on.
    chain = cut(along(nodes, ["conv_id", "depth"], {"leaf_at": "leaf", "saved_at": "saved"}, {}))
    chains = chain.groupBy("conv_id").agg(F.sum("leaf").alias("all_leaves"), F.sum("saved").alias("all_saved"), F.min("leaf_at").alias("leaf_from"), F.min("saved_at").alias("saved_from"), F.count("*").alias("links"))
    chains = cut(chains)
    chain = join_sized(chain, chains, "conv_id", "links", n_nodes)
    chain = cut(chain.withColumns({"less_leaves": F.col("leaf_at") - F.col("leaf_from"), "less_saved": F.col("saved_at") - F.col("saved_from")}))

    # Subtrees: the members' chains, less what the naming member has above the node.
    sums = [F.sum("all_leaves").alias("leaves"), F.sum("all_saved").alias("sum_saved")]
    weights = chains.select("conv_id", "all_leaves", "all_saved")
    heavy = cut(line.join(weights, "conv_id"))
    by_cell = heavy.where("alike").groupBy(*CELL).agg(*sums)
    inside = shared.select(*NODE, *CELL).join(by_cell, CELL).select(*NODE, "leaves", "sum_saved")
    by_turn = split.select("conv_id", *NODE).join(weights, "conv_id").groupBy(*NODE).agg(*sums)
    at_root = weights.agg(*sums).select(*[zero.alias(c) for c in NODE], "leaves", "sum_saved")
    under = inside.unionByName(by_turn).unionByName(at_root)
    out = chain.join(under, NODE).withColumns({"n_leaves": F.col("leaves") - F.col("less_leaves"), "saved_tokens": F.col("sum_saved") - F.col("less_saved")})

    out = cut(out.select(*own, "n_children", "n_leaves", "saved_tokens").withColumnRenamed("depth", "level").withColumns({"up": F.col("level") - 1}))
    parents = cut(nodes.where("n_children > 0").select(F.col("depth").alias("up"), F.col("hx").alias("ox"), F.col("hy").alias("oy"), F.col("conv_id").alias("parent_conv_id"), "n_children"))
    below = join_sized(out.where("level > 0").drop("n_children"), parents.withColumnRenamed("n_children", "siblings"), ["up", "ox", "oy"], "siblings", n_nodes)
    top = out.where("level = 0").drop("n_children").withColumns({"parent_conv_id": none, "siblings": none})
    named = below.unionByName(top).withColumnRenamed("level", "depth").join(nodes.select(*NODE, "n_children"), NODE)
    named = named.join(_ends(ids, line), NODE, "left")
    return named.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def op13_turn_trie(spark, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(ordered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


_BIT = "xor(c, CASE WHEN i % 8 = 0 THEN ascii(substr(s, i // 8 + 1, 1)) ELSE 0 END)"
SQL = {
    "op13_turn_trie": f"""
        WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM conversations WHERE conv_id IS NOT NULL),
        s AS (SELECT conv_id, count(*) AS n, conv_id::VARCHAR AS s FROM o GROUP BY conv_id),
        i AS (SELECT conv_id, n, conv_id - conv_id % 5 AS base,
                     xor(list_reduce(list_concat([4294967295], range(8 * len(s))), lambda c, i: xor({_BIT} >> 1, ({_BIT} & 1) * 3988292384)), 4294967295) % 9 AS h FROM s),
        r AS (SELECT i.conv_id, o.p, role, text FROM i JOIN o ON o.conv_id = i.base AND o.p <= i.h
              UNION ALL
              SELECT i.conv_id, least(i.h, coalesce(b.n, 0)) + o.p - i.h, role, text FROM i JOIN o ON o.conv_id = i.conv_id AND o.p > i.h LEFT JOIN i b ON b.conv_id = i.base),
        x AS (SELECT conv_id, p AS depth, strlen(text) AS size, string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY p) AS path FROM r
              UNION ALL SELECT conv_id, 0, 0, '' FROM i),
        n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size FROM x GROUP BY path, depth),
        c AS (SELECT left(path, len(path) - 64) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
        m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (path)),
        u AS (SELECT x.path, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * m.size) AS saved_tokens FROM m JOIN x ON x.conv_id = m.conv_id AND x.depth <= m.depth GROUP BY x.path),
        e AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM (SELECT conv_id, arg_max(path, depth) AS path FROM x GROUP BY conv_id) GROUP BY path)
        SELECT m.conv_id, m.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, m.n_convs, m.n_children, u.n_leaves::BIGINT AS n_leaves, u.saved_tokens::BIGINT AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
        FROM m JOIN u USING (path) LEFT JOIN e USING (path) LEFT JOIN n up ON m.depth > 0 AND up.path = left(m.path, len(m.path) - 64)""",
}
QUERIES = {"op13_turn_trie": op13_turn_trie}
