"""Substring dedup, hard negatives and the conversation trie against brute force, and their defined cases on odd tables."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

K = 13


def words_of(text):
    return (text or "").encode().split()


def passages():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 3)))
    shared = [[word() for _ in range(r.randint(14, 60))] for _ in range(6)]
    texts = []
    for _ in range(60):
        own = [word() for _ in range(r.randint(0, 30))]
        for p in r.sample(shared, r.randint(0, 3)):
            at = r.randint(0, len(own))
            i = r.randint(0, 10)
            own[at:at] = p[i : i + r.randint(8, 60)]
        if own and r.random() < 0.5:
            own[r.randrange(len(own))] = "changed"
        texts.append(r.choice([" ", "\n", "  \t"]).join(own))
    texts += texts[:4] + [None, "", " \n ", "a " * 500, "a " * 700, "b" * 3000 + " c" * 20, "b" * 3000 + " c" * 20, "x y " * 30, "x y " * 31]
    rows = [(i, t, i, "p", 7) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[0], 1, "p", 7), (None, texts[0], 1, "p", 7), (5, texts[40], 0, "p", 7), (-4, texts[2], 0, "p", 7)]
    r.shuffle(rows)
    return rows


def brute_kept(rows, k=K):
    """Each row's words and which of them go, straight from the definition."""
    first = {}
    for i, t, *_ in rows:
        w = words_of(t)
        if i is not None:
            for j in range(len(w) - k + 1):
                g = tuple(w[j : j + k])
                first[g] = min(i, first.get(g, i))
    out = []
    for i, t, *_ in rows:
        w = words_of(t)
        gone = set()
        if i is not None:
            for j in range(len(w) - k + 1):
                if first[tuple(w[j : j + k])] < i:
                    gone |= set(range(j, j + k))
        out.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return out


SCHEMA = "doc_id long, text string, block long, part string, home int"


@pytest.mark.parametrize("size", [4 << 20, 1, 900])
def test_without_repeats(spark, monkeypatch, size):
    """By blocks of any size the words that go are those of the definition."""
    from quillon.llm import debruijn

    monkeypatch.setattr(debruijn, "BLOCK_BYTES", size)
    rows = passages()
    got = debruijn.without_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3))
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_kept(rows), key=key)
    assert any(x[2] for x in brute_kept(rows))


def test_spans_have_their_source(spark):
    """A span's words stand at its source's coordinates, in an earlier document."""
    from quillon.llm.debruijn import repeated_spans

    rows = [x for x in passages() if x[0] is not None]
    rows = list({x[0]: x for x in rows}.values())  # coordinates need ids of one row
    text = {x[0]: words_of(x[1]) for x in rows}
    spans = repeated_spans(spark.createDataFrame(rows, SCHEMA)).collect()
    assert spans
    for s in spans:
        assert s.n_words >= K and s.source_id < s.doc_id
        assert text[s.doc_id][s.first : s.first + s.n_words] == text[s.source_id][s.source_first : s.source_first + s.n_words]
    gone = defaultdict(set)
    for s in spans:
        gone[s.doc_id] |= set(range(s.first, s.first + s.n_words))
    assert {i: len(x) for i, x in gone.items()} == {i: n for i, _, n, _ in brute_kept(rows) if n}
    assert max(s.n_words for s in spans) > 2 * K  # paths are compacted


def test_paths_end_where_nodes_branch(spark):
    from quillon.llm.debruijn import Blocks, paths

    a, b, c = ([f"{x}{i}" for i in range(30)] for x in "abc")
    rows = [(0, " ".join(a + b)), (1, " ".join(a + b)), (2, " ".join(a + c)), (3, " ".join(a + c))]
    found = paths(Blocks(spark.createDataFrame(rows, "doc_id long, text string"), K, "doc_id", "text")).collect()
    assert sorted((x.doc_id, x.first, x.n_words) for x in found) == sorted((i, *p) for i in range(4) for p in ((0, 30), (18, 42)))


def test_words_are_hashed_whole():
    import pyarrow as pa

    from quillon.llm.debruijn import Words

    r = random.Random(2)
    texts = ["", " a", "a ", "ab\tc", "漢字 é", "a" * 8 + " " + "a" * 9, "x" * 63 + " " + "x" * 64 + " " + "x" * 65, " ".join("".join(r.choice("ab") for _ in range(r.randint(1, 90))) for _ in range(300))]
    w = Words.of(pa.array(texts))
    flat = [x for t in texts for x in words_of(t)]
    assert [bytes(w.data[i:j]) for i, j in zip(w.starts, w.ends)] == flat
    by = defaultdict(set)
    for x, h in zip(flat, w.hashes().tolist()):
        by[h].add(x)
    assert all(len(x) == 1 for x in by.values()) and len(by) == len(set(flat))
    assert [bytes(w.canonical()[0][i:j]) for i, j in zip(*w.canonical()[1:])] == flat


def test_passages_of_empty_tables(spark):
    from quillon.llm.debruijn import repeated_spans, without_repeats

    none = spark.createDataFrame([], SCHEMA)
    assert without_repeats(none).count() == 0 and repeated_spans(none).count() == 0
    short = spark.createDataFrame([(1, None), (2, ""), (3, "a b c")], "doc_id long, text string")
    assert sorted(map(tuple, without_repeats(short).collect())) == [(1, 0, 0, ""), (2, 0, 0, ""), (3, 3, 0, "a b c")]


def vectors():
    r = random.Random(5)
    rows = [(i, [r.choice([-0.5, 0.0, 0.25, 0.5, 0.75]) for _ in range(4)], r.randint(0, 2), "s", 1) for i in range(0, 700, 2)]
    rows += [(1, None, 1, "s", 1), (3, [0.1, float("nan")], 1, "s", 1), (5, [0.1, None], 1, "s", 1), (9, [float("inf"), 1.0], 0, "s", 1), (11, [0.5] * 4, None, "s", 1), (None, [0.5] * 4, 1, "s", 1)]
    rows += [(13, [0.5, 0.5], 1, "s", 1), (15, [], 2, "s", 1), rows[10], rows[10], rows[50], (900, [0.0] * 4, 9, "s", 1)]  # repeated rows, a repeated anchor, an anchor alone with its label
    rows += [(1000, [0.0] * 4, 1, "s", 1), (1100, [1e9, 0.0, 0.0, 3.0], 2, "s", 1), (1101, [1e5, -1.0, 0.0, 3.0], 2, "s", 1), (1103, [7e4, -1.0, 0.0, 3.0], 1, "s", 1)]  # scores of zero, and beyond doubles
    return rows


VECTORS = "vec_id long, embedding array<double>, label int, minus string, slot int"


def brute_negatives(rows):
    x = [(i, (b + 1) % 10 if i % 7 == 0 else b, [math.floor(256 * c) for c in v]) for i, v, b, *_ in rows if i is not None and v is not None and b is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for i, b, v in x:
        if i % 100 == 0:
            scored = sorted((-sum(p * q for p, q in zip(v, w)), j, c == b) for j, c, w in x if j != i)
            for p, j, _ in [s for s in scored if s[2]][:5]:
                for rank, (n, m, _) in enumerate([s for s in scored if not s[2] and 30 * -p <= 100 * -s[0] <= 90 * -p][:10], 1):
                    out.append((i, j, rank, m, -p, -n))
    return sorted(out)


@pytest.mark.parametrize("block", [8192, 3])
def test_hard_negatives(spark, monkeypatch, block):
    from quillon.llm import hard_negatives as h

    monkeypatch.setattr(h, "ANCHORS", block)
    monkeypatch.setattr(h, "_ROWS", 50)
    rows = vectors()
    got = h.hard_negatives(h.whole_vectors(spark.createDataFrame(rows, VECTORS).repartition(3)))
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)
    assert any(x[4] == 0 for x in brute_negatives(rows))


def test_hard_negatives_of_empty_tables(spark):
    from quillon.llm.hard_negatives import hard_negatives, whole_vectors

    assert hard_negatives(whole_vectors(spark.createDataFrame([], VECTORS))).count() == 0
    assert hard_negatives(whole_vectors(spark.createDataFrame([(1, [0.5], 1, "", 0), (200, None, 1, "", 0)], VECTORS))).count() == 0


def turns():
    r = random.Random(8)
    rows = []
    for c in [*range(0, 60), 1007, -3, -5, -12]:
        if c % 10 == 5:
            continue  # conversations without a base
        base = random.Random(c % 4)
        n = r.randint(1, 14)
        for t in range(n):
            text = base.choice(["hi", "yes", "no", "é", ""]) if t < r.randint(1, 12) else str(r.random())
            rows.append((c, None if t == 0 and c % 3 == 0 else t, None if t % 5 == 4 else "user", None if t % 7 == 6 else text, c, 1))
    rows += [(None, 1, "user", "x", 1, 1), rows[4], (3, 2, "user", "again", 0, 1)]  # a row without conversation, a repeated row, a repeated turn
    rows += [(200, t, "user", f"{t}", 1, 1) for t in range(60)]
    r.shuffle(rows)
    return rows


TURNS = "conv_id long, turn int, role string, text string, depth long, k int"


def brute_trie(ordered):
    """ordered: conv_id, pos, role-and-text key, size of the original turns."""
    own = defaultdict(list)
    for c, _, key, size in sorted(ordered, key=lambda x: x[:2]):
        own[c].append((key, size))
    whole = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + x[h:]
    members, kids = defaultdict(list), defaultdict(set)
    for c, x in whole.items():
        for d in range(len(x) + 1):
            p = tuple(k for k, _ in x[:d])
            members[p].append((c, x[d - 1][1] if d else 0))
            if d:
                kids[p[:-1]].add(p)

    def under(p):
        leaves, saved = int(not kids[p]), (len(members[p]) - 1) * members[p][0][1]
        for q in kids[p]:
            x, y = under(q)
            leaves, saved = leaves + x, saved + y
        return leaves, saved

    out = []
    for p, m in list(members.items()):
        ends = ",".join(map(str, sorted(c for c, _ in m if len(whole[c]) == len(p))))
        out.append((min(m)[0], len(p), min(members[p[:-1]])[0] if p else None, len(m), len(kids[p]), *under(p), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [1 << 16, 2])
def test_trie(spark, monkeypatch, chunk):
    from quillon.llm import turn_trie

    monkeypatch.setattr(turn_trie, "CHUNK", chunk)
    ordered = turn_trie.ordered_turns(spark.createDataFrame(turns(), TURNS).repartition(3)).collect()
    want = brute_trie([(x.conv_id, x.pos, (x.t1, x.t2), x.size) for x in ordered])
    again = spark.createDataFrame(ordered, "conv_id long, pos long, t1 long, t2 long, size long")
    got = sorted(map(tuple, turn_trie.trie(*turn_trie.rebuilt(again)).collect()), key=str)
    assert got == want


def test_turns_are_ordered(spark):
    from quillon.llm.turn_trie import ordered_turns

    rows = turns()
    got = defaultdict(list)
    for x in ordered_turns(spark.createDataFrame(rows, TURNS).repartition(3)).orderBy("conv_id", "pos").collect():
        got[x.conv_id].append((x.pos, x.size))
    want = defaultdict(list)
    for c, t, _, text, *_ in rows:
        if c is not None:
            want[c].append((-1 if t is None else t, len((text or "").encode())))
    assert set(got) == set(want)
    for c, x in want.items():
        assert [p for p, _ in got[c]] == list(range(1, len(x) + 1)) and sorted(s for _, s in got[c]) == sorted(s for _, s in x)
        by_time = [s for _, s in sorted(x)]
        assert c == 3 or len({t for t, _ in x}) < len(x) or [s for _, s in got[c]] == by_time


def test_trie_of_empty_tables(spark):
    from quillon.llm.turn_trie import ordered_turns, rebuilt, trie

    assert trie(*rebuilt(ordered_turns(spark.createDataFrame([], TURNS)))).count() == 0
    lone = trie(*rebuilt(ordered_turns(spark.createDataFrame([(1, 1, "user", "x", 0, 0)], TURNS)))).collect()  # 1's first turns are those of 0, which is absent
    h = zlib.crc32(b"1") % 9
    assert len(lone) == (1 if h else 2) and lone[0].n_convs == 1


def test_sketches_of_similar_sets_stay_within_the_distance():
    """Sets of similarity 0.8, from as few shingles as are pruned at all to very many."""
    import numpy as np

    from quillon.llm.near import DISTANCE, SHORT, sketch

    g, most = np.random.default_rng(9), 0
    for union in (SHORT, SHORT + 1, 20, 25, 60, 300, 5000):
        for _ in range(200 if union < 1000 else 20):
            x = g.integers(0, 1 << 63, union, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            lone = union - -(-4 * union // 5)
            split = int(g.integers(0, lone + 1))
            a, b = np.unique(np.delete(x, np.s_[:split])), np.unique(np.delete(x, np.s_[split:lone]))
            most = max(most, int(np.bitwise_count(sketch(a) ^ sketch(b)).sum()))
    assert 20 < most <= DISTANCE


def test_repeats_with_many_blocks_hold_one_block_and_a_bounded_range(spark, monkeypatch):
    from pathlib import Path

    import pyarrow.parquet as pq

    from quillon.llm import debruijn

    monkeypatch.setattr(debruijn, "BLOCK_BYTES", 200)
    monkeypatch.setattr(debruijn, "RANGE_BYTES", 100)
    rows = passages()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(1)
    blocks = debruijn.Blocks(docs, K, "doc_id", "text")
    assert blocks.parts >= 2 * blocks.table.count() > 4 * debruijn.RANGES
    folder = Path(blocks.table.inputFiles()[0].removeprefix("file:")).parent
    groups = [f.metadata.row_group(i).num_rows for f in map(pq.ParquetFile, folder.glob("*.parquet")) for i in range(f.metadata.num_row_groups)]
    assert sum(groups) > 20 and max(groups) <= debruijn.GROUP_BLOCKS
    got = blocks.each(blocks.table, lambda block, ids, words: debruijn.pa.RecordBatch.from_pydict({"n": [len(ids)]}), "n long").collect()
    assert len(got) == sum(groups) and sum(x.n for x in got) == len(rows)
    assert sorted(map(repr, map(tuple, debruijn.without_repeats(docs).collect()))) == sorted(map(repr, brute_kept(rows)))


def test_rarity_counts_all_texts(spark, monkeypatch):
    import numpy as np

    from quillon.llm import near

    seen, counted = [], near._rarity
    monkeypatch.setattr(near, "_rarity", lambda texts: seen.append((texts.collect(), counted(texts))) or seen[0][1])
    rows = [(i, " ".join(f"w{(i * 7 + j) % 50}" for j in range(3 + i % 40)), i, "p", 7) for i in range(300)] + [(900, None, 0, "p", 7)]
    kept = near.drop_similar(spark.createDataFrame(rows, SCHEMA)).count()
    assert 0 < kept <= len(rows) and len(seen) == 1
    assert sorted(str(x.text) for x in seen[0][0]) == sorted(str(x[1]) for x in rows)
    want = np.zeros(1 << 20, np.int64)
    for x in rows:
        for h in near.shingle_set(x[1]).tolist():
            want[h >> 44] += 1
    assert (seen[0][1] == np.where(want > 1, want, 0)).all()
