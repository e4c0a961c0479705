"""The training-data operators against brute force, and their defined cases on odd tables."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, kept boolean, fp string, size string, q_at int, `key` string"


def norm(x):
    return (x or "").encode().translate(LOWER)


def rows():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7)))
    base = [" ".join(word() for _ in range(r.randint(1, 60))) for _ in range(30)]
    texts = [*base, *(b.upper() for b in base[:6]), *(b + " zz" for b in base[6:14]), None, "", "  \n\t ", "x " * 30000, "The End", "the end", "THE END", "<|endoftext|> a", "漢字 😀 \x00 ▁ a", "one", "one two three"]
    out = [(i, t, "en", None if i % 7 == 3 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    out += [out[2], out[2], (None, "the end", None, None, None), (None, None, "en", "s1", None)]  # repeated rows and null ids
    return [(*x, 1, True, "f", "s", 5, "k") for x in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    r = [(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(40)] + [(None, 1, 1), (3, None, None), (5, 0, 1), (5, 1, 0)]
    return spark.createDataFrame(r, "doc_id long, quality int, toxic int")


def test_exact_groups(docs, none):
    from quillon.llm.exact_dedup import exact_groups

    want = {}
    for x in rows():
        want.setdefault(norm(x[1]), []).append(x[0])
    for words in (1 << 18, 1):  # a filter that is full changes nothing
        got = exact_groups(docs, filter_words=words).collect()
        assert len(got) == len(rows())
        by = {}
        for g in got:
            by.setdefault(g.text_sha256, []).append(g)
        assert set(by) == {hashlib.sha256(t).hexdigest() for t in want}
        for t, ids in want.items():
            g = by[hashlib.sha256(t).hexdigest()]
            best = max((i for i in ids if i is not None), default=None)
            assert sorted(str(x.doc_id) for x in g) == sorted(map(str, ids))
            assert {(x.keep_id, x.group_size) for x in g} == {(best, len(ids))} and sum(x.kept for x in g) == 1
            assert [x.doc_id for x in g if x.kept] == [best]
    assert exact_groups(none).count() == 0


def test_drop_exact_copies(docs, none):
    from quillon.llm.exact_dedup import drop_exact_copies

    got = drop_exact_copies(docs)
    assert got.columns == docs.columns
    kept = got.collect()
    assert sorted(norm(x.text) for x in kept) == sorted({norm(x[1]) for x in rows()})
    assert drop_exact_copies(none).count() == 0


def brute_fingerprint(text, n=4):
    import xxhash

    w = norm(text).split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def test_simhash_groups(docs, none):
    from quillon.llm.simhash import near_groups

    data = rows()
    fps = [brute_fingerprint(x[1]) for x in data]
    root = union(set(fps), [(a, b) for a in set(fps) for b in set(fps) if (a ^ b).bit_count() <= 4])
    least = {}
    for x, f in zip(data, fps):
        if x[0] is not None:
            least[root[f]] = min(x[0], least.get(root[f], x[0]))
    want = Counter((x[0], f"{f:016x}", least.get(root[f])) for x, f in zip(data, fps))
    assert Counter(map(tuple, near_groups(docs).collect())) == want
    assert near_groups(none).count() == 0


def test_spark_hash_is_the_shingle_hash(spark):
    from pyspark.sql import functions as F

    from quillon.llm.simhash import fingerprint

    got = spark.createDataFrame([("some words é",)], "t string").select(F.xxhash64("t")).first()[0]
    assert fingerprint("Some  words\té") == got % (1 << 64)


@pytest.mark.parametrize("spread", [2, 6, 20])
def test_ring_finds_all_links(spread):
    from quillon.llm.simhash import bucket_links, ring_keys

    r = random.Random(spread)
    centres = [r.getrandbits(64) for _ in range(12)]
    fps = np.unique(np.array([c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, spread))) for c in centres for _ in range(90)], np.uint64))
    keys, out = ring_keys(fps)
    order = np.argsort(keys, kind="stable")
    a, b = bucket_links(keys[order], out[order])
    assert (np.bitwise_count(a ^ b) <= 4).all()
    brute = [(x, y) for i, x in enumerate(fps.tolist()) for y in fps[i + 1 :][np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 4].tolist()]
    one, two = union(fps.tolist(), brute), union(fps.tolist(), zip(a.tolist(), b.tolist()))
    assert len(set(one.values())) == len(set(two.values())) == len(set(zip(one.values(), (two[n] for n in one))))


def test_drop_near_copies(docs, none):
    from quillon.llm.simhash import drop_near_copies

    data = rows()
    fps = {brute_fingerprint(x[1]) for x in data}
    root = union(fps, [(a, b) for a in fps for b in fps if (a ^ b).bit_count() <= 4])
    got = drop_near_copies(docs)
    assert got.columns == docs.columns
    kept = got.collect()
    assert Counter(root[brute_fingerprint(x.text)] for x in kept) == Counter(set(root.values()))
    assert drop_near_copies(none).count() == 0


def test_near_copies_from_similarity_08_on_go(spark):
    import corpus_pipeline as cp

    rng = np.random.default_rng(3)
    texts = []
    for _ in range(40):
        base = [f"w{x}" for x in rng.integers(0, 3000, 120)]
        for edits in (0, 1, 2, 3, 5):
            copy = list(base)
            for at in rng.choice(120, edits, replace=False):
                copy[at] = f"n{rng.integers(0, 10**6)}"
            texts.append(" ".join(copy))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for t in texts]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    root = union(range(len(sets)), near)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [x.doc_id for x in cp.near_copies(spark, docs, "").collect()]
    assert sorted(got) == sorted({r: min(i for i in root if root[i] == r) for r in root.values()}.values())


def test_components(spark):
    from quillon.llm.components import components

    r = random.Random(1)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    root = union({n for e in edges for n in e}, edges)
    least = {}
    for n, k in root.items():
        least[k] = min(n, least.get(k, n))
    assert got == {n: least[k] for n, k in root.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing(docs, none):
    from pyspark.sql import functions as F

    from quillon.llm.mixing import mix, mixed_documents, n_words

    thin = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    got = mix(thin).collect()
    sizes = Counter()
    for x in rows():
        sizes[x[3]] += len((x[1] or "").split(None)) if x[1] is None or x[1].isascii() else len(norm(x[1]).split())
    total, weight = sum(sizes.values()), {}
    for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s))):
        weight[s] = (5, 2, 1)[i % 3]
    full = set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        share = {s: weight[s] * rest / sum(weight[t] for t in sizes if t not in full) for s in sizes if s not in full}
        over = {s for s, v in share.items() if v > 3 * sizes[s]}
        if not over:
            break
        full |= over
    share |= {s: 3.0 * sizes[s] for s in full}
    assert len(got) == len(rows())
    taken = Counter()
    for g in got:
        assert 0 <= g.taken <= 3 * g.size
        taken[g.target] += g.taken
    for s, v in share.items():
        assert any(math.isclose(v, t) for t in taken)
    for t, n in taken.items():
        assert abs(n - t) <= 0.02 * t + 3
    assert sorted(map(str, got)) == sorted(map(str, mix(thin.repartition(2)).collect()))
    assert mix(none.select("doc_id", "source", F.lit(0).cast("long").alias("size"))).count() == 0
    out = mixed_documents(docs)
    assert out.columns == docs.columns and max(Counter(x.doc_id for x in out.collect() if x.doc_id not in (None, 2)).values()) <= 3
    assert mixed_documents(none).count() == 0


def test_mixing_small_sources_of_a_large_corpus(spark):
    from quillon.llm.mixing import GOLDEN, mix, points_below

    for slots, low, whole in ((1000, 0, 700), (1000, 1, 700), (1000, 333, 700), (1000, 700, 700), (7, 3, 5)):
        assert points_below(slots, low, whole) == sum(j * GOLDEN % 1 * whole < low for j in range(1, slots + 1))
    small = {f"s{i:03}": 1000 + 500 * (i % 40) for i in range(50)}
    data = [(i, "big", 10**9) for i in range(5)] + [(100 * k + i, s, n // 10) for k, (s, n) in enumerate(small.items(), 1) for i in range(10)]
    taken, target = Counter(), {}
    for g in mix(spark.createDataFrame(data, "doc_id long, source string, size long")).collect():
        s = "big" if g.doc_id < 100 else f"s{g.doc_id // 100 - 1:03}"
        taken[s] += g.taken
        target[s] = g.target
    for s, t in target.items():
        assert abs(taken[s] - t) <= 0.001 * t + 5, s
    assert all(target[s] == 3 * n for s, n in small.items())


def test_mixing_makes_the_schedule(spark, monkeypatch):
    """Runs of slots, sources and cells of any size: every slot is mapped, ranked and given a document's word, as in a loop over slots."""
    from quillon.llm import mixing

    for name, n in (("SLOTS", 64), ("CELL", 100), ("SOURCES", 3)):
        monkeypatch.setattr(mixing, name, n)
    r = random.Random(4)
    data = [(f"s{i % 7}", i, r.choice([0, 1, 3, 30])) for i in range(60)]
    size = Counter()
    for s, _, n in data:
        size[s] += n
    at, lines, begin = 0, [], {}
    for i, s in enumerate(sorted(size)):
        begin[i] = at
        for _, k, n in (d for d in data if d[0] == s):
            lines.append((i, at, n))
            at += n
    sources = mixing.targets(spark.createDataFrame(list(size.items()), "source string, source_size long")).cache()
    table = sorted((x.no, x.source_size, round(x.target)) for x in sources.collect())
    whole, want, rank = sum(x[2] for x in table), Counter(), Counter()
    for j in range(1, at + 1):
        point = (j * int(mixing.GOLDEN * 2**53) % 2**53) * whole >> 53
        for no, n, units in table:
            if 0 <= point < units:
                break
            point -= units
        turn, place = divmod(rank[no], n)
        rank[no] += 1
        if turn < 3:
            doc = next(a for i, a, m in lines if m and a <= begin[no] + place < a + m)
            first = (j - 1) // 64 * 64 + 1
            want[doc, first, min(first + 63, at), turn] += 1
    got = Counter()
    for x in mixing.schedule(spark.createDataFrame(lines, "no long, q_at long, size long"), sources).collect():
        got[tuple(x)[:4]] += x.words
    assert got == want and sum(want.values()) > 300


def test_mixing_ties_and_nulls(spark):
    from quillon.llm.mixing import mix, mixed_documents

    r = random.Random(8)
    made = spark.createDataFrame([(None if i % 3 else i % 5, f"s{i % 4}", r.randint(0, 40)) for i in range(500)], "doc_id long, source string, size long")
    key = lambda d: Counter(map(tuple, d.collect()))
    assert key(mix(made.repartition(7))) == key(mix(made.repartition(2, "size")))
    odd = spark.createDataFrame([(1, "a b c", "x", None), (1, "a b c", None, "x")], "doc_id long, text string, source string, lang string")
    got = {tuple(x) for x in mixed_documents(odd).collect()}
    assert got <= {tuple(x) for x in odd.collect()}
    one = spark.createDataFrame([(1, "a b c", "x", None), (2, "a b c", "x", "y"), (1, "a b c", "x", "y")], odd.schema)
    assert {tuple(x) for x in mixed_documents(one).collect()} == {tuple(x) for x in one.collect()}


def test_sentencepiece(docs, none):
    from sentencepiece import SentencePieceProcessor

    from quillon.llm.piece_bpe import PieceBpe, default_model, encode_documents, encoded_digests

    sp = SentencePieceProcessor(model_file=default_model())
    want = Counter()
    for x in rows():
        ids = sp.encode(x[1] or "", add_eos=True)
        want[x[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()] += 1
    assert Counter(map(tuple, encoded_digests(docs).collect())) == want
    assert encoded_digests(none).count() == encode_documents(none).count() == 0
    bpe, r = PieceBpe.of(default_model()), random.Random(2)
    parts = [" ", "  ", "a", "the", "▁", "\n", "\t", "é", "漢", "😀", "<s>", "</s>", "<0x41>", "1", "23", "--", "...", "ing", "   ", "\r\n", "\x00", "A", "²", "! "]
    for _ in range(3000):
        x = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert bpe.encode(x)[0] == sp.encode(x, add_eos=True), x
    for n in range(1, 60):
        assert bpe.encode(" " * n)[0] == sp.encode(" " * n, add_eos=True)


def test_lm_score(docs, none):
    from quillon.llm import ngram

    data = rows()
    got = {}
    for g in ngram.scored(docs).collect():
        got.setdefault(g.doc_id, []).append(g)
    split = lambda i: zlib.crc32(str(i).encode()) % 7 if i is not None else 0
    tokens = [(x[0], [*norm(x[1]).split(), None]) for x in data]
    c, pairs = Counter(), Counter()
    for i, w in tokens:
        if split(i) != 2:
            c.update(w)
            pairs.update(zip(["<s>", *w[:-1]], w))
    n, v, starts = sum(c.values()), len(c), sum(split(i) != 2 for i, _ in tokens)
    # An independent expectation-maximisation, on the deleted part's occurrences one by one, with the estimates binned as stated.
    held = lambda i: split(i) == 3
    c0, pairs0 = Counter(), Counter()
    for i, w in tokens:
        if split(i) not in (2, 3):
            c0.update(w)
            pairs0.update(zip(["<s>", *w[:-1]], w))
    n0, v0 = sum(c0.values()), len(c0)
    starts0 = sum(split(i) not in (2, 3) for i, _ in tokens)
    eighth = lambda q: 2 ** (round(8 * math.log2(q)) / 8) if q else 0
    seen = {}
    for i, w in tokens:
        if held(i):
            for a, b in zip(["<s>", *w[:-1]], w):
                f = starts0 if a == "<s>" else c0[a]
                seen.setdefault(int(math.log2(f)) + 1 if f else 0, []).append((eighth(pairs0[a, b] / f if f else 0), eighth(c0[b] / n0), 1 / (v0 + 1)))

    def em(own):
        k = [1 / 3] * 3
        for _ in range(100 if own else 0):
            got_ = [1.0] * 3
            for q in own:
                s = sum(x * y for x, y in zip(k, q))
                got_ = [g + x * y / s for g, x, y in zip(got_, k, q)]
            new = [g / (len(own) + 3) for g in got_]
            if max(abs(x - y) for x, y in zip(new, k)) < 1e-9:
                break
            k = new
        return k

    whole = em([q for own in seen.values() for q in own])
    weights = {b: em(own) for b, own in seen.items()}
    none_ = weights.get(0, whole)
    weights[0] = [0, none_[1] / (none_[1] + none_[2]), none_[2] / (none_[1] + none_[2])]
    assert sum(map(len, got.values())) == len(data)
    for i, w in tokens:
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        score = 0.0
        for a, b in zip(["<s>", *w[:-1]], w):
            f = starts if a == "<s>" else c[a]
            k = weights.get(int(math.log2(f)) + 1 if f else 0, whole)
            score += math.log10(k[0] * (pairs[a, b] / f if f else 0) + k[1] * c[b] / n + k[2] / (v + 1))
        assert any(g.n_tokens == len(w) and g.n_known == sum(c[x] > 0 for x in w) and g.train_tokens == n and g.held_out == (split(i) == 2) and math.isclose(g.base_score, base, rel_tol=1e-9) and math.isclose(g.score, score, rel_tol=1e-5) for g in got[i])
    assert ngram.scored(none).count() == 0
    for size, head in ((3, 1), (0, 0), (40, 5)):  # what is in the table changes nothing
        few = ngram.scored(docs, table=size, head=head).collect()
        assert sum(any(math.isclose(g.score, x.score, rel_tol=1e-9) and (g.n_tokens, g.n_known, g.held_out) == (x.n_tokens, x.n_known, x.held_out) for x in got[g.doc_id]) for g in few) == len(few) == len(data)


def test_lm_learns_weights():
    import pyarrow as pa

    from quillon.llm.ngram import BINS, learn

    rng = np.random.default_rng(0)
    # Words follow their context's pair estimate (1/2) four times of five, and else are uniform over 100.
    own = rng.random(20000) < 0.8
    q2 = np.where(own, -BINS, 999)
    w = learn(pa.table({"b": np.full(20000, 5), "q2": q2, "q1": np.full(20000, 999), "n": np.ones(20000, int)}), 99)
    assert abs(w[5][0] - 0.8) < 0.03
    # A bucket whose held-out words are all known leaves something to unknown words.
    w = learn(pa.table({"b": np.full(50, 2), "q2": np.full(50, -1), "q1": np.full(50, -20), "n": np.full(50, 10**6)}), 10**6)
    assert w.min() >= 0 and (w[:, 2] > 1e-9).all()


def test_chunk_store(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    from quillon.llm import chunk_store
    from quillon.llm.byte_bpe import default_file

    path = f"{tmp_path}/store"
    chunk_store.write_store(docs, path)
    t = Tokenizer.from_file(default_file())
    want = Counter()
    for x in rows():
        ids = np.array([*t.encode(x[1] or "", add_special_tokens=False).ids, 2], "<u4")
        want[x[0], len(ids), zlib.crc32(ids.tobytes())] += 1
    got = chunk_store.digests(spark, path).collect()
    assert Counter((g.doc_id, g.n_tokens, g.ids_crc32) for g in got) == want and all(g.verified for g in got)
    at = 0
    for g in sorted(got, key=lambda g: g.start):
        assert g.start == at
        at += g.n_tokens
    assert [g.doc_id for g in sorted(got, key=lambda g: g.start) if g.doc_id is not None] == sorted(g.doc_id for g in got if g.doc_id is not None)
    back = Counter((d.doc_id, zlib.crc32(np.array(d.ids, "<u4").tobytes())) for d in chunk_store.read_documents(spark, path).collect())
    assert back == Counter((i, c) for i, _, c in want.elements())
    log = spark.read.parquet(f"{path}/log").where("kind = 0")
    assert log.count() == log.select("body").distinct().count()
    chunk_store.write_store(none, f"{tmp_path}/empty")
    assert chunk_store.digests(spark, f"{tmp_path}/empty").count() == 0


def test_chunk_store_notices_damage(spark, docs, tmp_path):
    import os
    import shutil

    from quillon.llm import chunk_store

    whole = f"{tmp_path}/whole"
    chunk_store.write_store(docs, whole)
    n = docs.count()

    def rewritten(name, part, change):
        """A copy of the store in which ``part`` has been read, changed and written again."""
        path = f"{tmp_path}/{name}"
        shutil.copytree(whole, path)
        table = change(spark.read.parquet(f"{whole}/{part}"))
        shutil.rmtree(f"{path}/{part}")
        table.write.parquet(f"{path}/{part}")
        return path

    body = spark.read.parquet(f"{whole}/log/kind=0")
    one = body.orderBy("body").first().body
    lit = __import__("pyspark.sql.functions", fromlist=["lit"]).lit
    expr = __import__("pyspark.sql.functions", fromlist=["expr"]).expr
    gone = rewritten("gone", "log/kind=0", lambda t: t.where(t.body != lit(one)))
    flipped = rewritten("flipped", "log/kind=0", lambda t: t.withColumn("payload", expr(f"CASE WHEN hex(body) = '{one.hex().upper()}' THEN concat(substr(payload, 2), substr(payload, 1, 1), payload) ELSE payload END")))
    for path in (gone, flipped):
        got = chunk_store.digests(spark, path).collect()
        assert len(got) == n and any(not g.verified for g in got), path
    for path in (rewritten("recipe", "recipes", lambda t: t.where("start > 0")), rewritten("manifest", "manifest", lambda t: t.withColumn("documents", expr("documents + 1")))):
        with pytest.raises(ValueError, match="manifest"):
            chunk_store.digests(spark, path)
    assert os.path.isdir(whole) and all(g.verified for g in chunk_store.digests(spark, whole).collect())


def test_crc_shift_and_chunks():
    from quillon.llm.chunk_store import MOST, cut_points, rolling, shifted

    raw = bytes(range(200))
    state = np.array([zlib.crc32(raw) ^ 0xFFFFFFFF], np.uint32)
    for n in (0, 1, 7, 1000, 123456):
        assert shifted(state, np.array([n]))[0] == zlib.crc32(raw + bytes(n)) ^ 0xFFFFFFFF
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 50000, 9000).astype(np.uint16)
    ends = cut_points(ids)
    assert ends[-1] == 9000 and max(np.diff([0, *ends])) <= MOST
    moved = np.concatenate((rng.integers(0, 50000, 777).astype(np.uint16), ids))
    assert len({e - 777 for e in cut_points(moved)} & set(ends)) > len(ends) * 0.7
    assert (rolling(moved)[-100:] == rolling(ids)[-100:]).all()


def test_jpeg_round_trip(docs, none):
    from quillon.llm import jpeg
    from quillon.llm.common import fresh_dir

    got = {g.payload_sha256: g for g in jpeg.media_features(jpeg.media_column(docs)).collect()}
    for x in rows():
        p = jpeg.payload(x[1])
        g = got[hashlib.sha256(p).hexdigest()]
        assert len(p) % 192 == 0 and g.payload_bytes == len(p) and g.tail_crc32 == zlib.crc32(p[-16:]) and g.n_bytes == len((x[1] or "").encode())
        media = jpeg.encode_payloads([p])[0]
        assert g.media_sha256 == hashlib.sha256(media).hexdigest() and g.media_bytes == len(media)
    assert jpeg.media_features(jpeg.media_column(none)).count() == 0
    for table in (docs, none):  # what is read from the stored form is what went in
        path = fresh_dir(table.sparkSession, "media-test")
        kept = jpeg.stored(jpeg.media_column(table), path)
        assert all(path in f for f in kept.inputFiles())
        assert sorted(map(str, jpeg.media_features(kept).collect())) == sorted(map(str, jpeg.media_features(jpeg.media_column(table)).collect()))
    wide = jpeg.payload("ab" * 1_000_000)
    assert b"".join(t.tobytes() for _, t in jpeg.dc_thumbnails(jpeg.encode_payloads([wide]))[0]) == wide


def written(width, height, parts, interval, blocks, q):
    """A small baseline writer: parts (h, v), blocks[mcu][k] -> (dc difference, [(run, value)])."""
    from quillon.llm.jpeg import _segment

    dc = {s: (4, s) for s in range(12)}
    ac = {s: (8, i) for i, s in enumerate([0x00, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 9))])}
    out = b"\xff\xd8" + _segment(0xE0, b"JFIF\0") + _segment(0xDB, bytes([0, *[q] * 64])) + _segment(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(parts)]) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(parts)))
    out += _segment(0xC4, bytes([0, 0, 0, 0, 12, *[0] * 12, *range(12)])) + _segment(0xC4, bytes([0x10, *[0] * 7, len(ac), *[0] * 8, *ac]))
    out += (_segment(0xDD, interval.to_bytes(2, "big")) if interval else b"") + _segment(0xDA, bytes([len(parts)]) + b"".join(bytes([i + 1, 0]) for i in range(len(parts))) + bytes([0, 63, 0]))
    bits, n = "", 0
    put = lambda v: format(v if v > 0 else v + (1 << abs(v).bit_length()) - 1, f"0{abs(v).bit_length()}b") if v else ""

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")

    for m, mcu in enumerate(blocks):
        if interval and m and m % interval == 0:
            out += flush(bits) + bytes([0xFF, 0xD0 + n % 8])
            bits, n = "", n + 1
        for d, coefs in mcu:
            length, code = dc[abs(d).bit_length()]
            bits += format(code, f"0{length}b") + put(d)
            for run, v in coefs:
                while run > 15:
                    bits, run = bits + format(ac[0xF0][1], "08b"), run - 16
                bits += format(ac[run << 4 | abs(v).bit_length()][1], "08b") + put(v)
            bits += format(ac[0][1], "08b")
    return out + flush(bits) + b"\xff\xd9"


@pytest.mark.parametrize("parts,interval", [([(1, 1)], 0), ([(2, 2), (1, 1), (1, 1)], 0), ([(2, 1), (1, 1), (1, 1)], 3), ([(1, 1), (1, 1), (1, 1)], 2)])
def test_jpeg_reads_other_files(parts, interval):
    from quillon.llm import jpeg

    r = random.Random(len(parts) + interval)
    width, height = 53, 35
    h, v = max(p[0] for p in parts), max(p[1] for p in parts)
    cols, rows_ = (-(-width // (8 * h)), -(-height // (8 * v))) if len(parts) > 1 else (-(-width // 8), -(-height // 8))
    layout = [i for i, p in enumerate(parts) for _ in range(p[0] * p[1])] if len(parts) > 1 else [0]
    blocks, grid, last = [], np.zeros((rows_ * (v if len(parts) > 1 else 1), cols * (h if len(parts) > 1 else 1)), int), [0] * len(parts)
    for m in range(cols * rows_):
        if interval and m % interval == 0:
            last = [0] * len(parts)
        mcu, k = [], 0
        for c in layout:
            dc = r.randint(-120, 120)
            mcu.append((dc - last[c], [(r.randint(0, 19), r.choice([-9, -1, 1, 30])) for _ in range(r.randint(0, 3))]))
            last[c] = dc
            if c == 0:
                hh, vv = (parts[0] if len(parts) > 1 else (1, 1))
                grid[m // cols * vv + k // hh, m % cols * hh + k % hh] = dc
                k += 1
        blocks.append(mcu)
    q = 5
    (frame, thumb), = jpeg.dc_thumbnails([written(width, height, parts, interval, blocks, q)])[0]
    want = np.clip((grid * q + 4) // 8 + 128, 0, 255)[: -(-height // 8), : -(-width // 8)]
    assert (frame.width, frame.height) == (width, height) and (thumb == want).all()


def test_jpeg_refuses():
    from quillon.llm import jpeg

    media = jpeg.encode_payloads([b" " * 192])[0]
    for bad in (b"", media[:-40], b"GIF89a", media.replace(b"\xff\xc0", b"\xff\xc2")):
        if bad:
            with pytest.raises(ValueError):
                jpeg.dc_thumbnails([bad])


def test_token_counts(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    from quillon.llm import token_counts
    from quillon.llm.byte_bpe import default_file

    t = Tokenizer.from_file(default_file())
    t.encode_special_tokens = True
    written_ = token_counts.write_flat(docs, f"{tmp_path}/flat")
    counts = token_counts.count_tokens(written_.select("file").distinct(), block_ids=500)
    got = Counter((g.doc_id, g.n_tokens) for g in written_.join(counts, ["file", "ordinal"]).collect())
    assert got == Counter((x[0], len(t.encode(x[1] or "", add_special_tokens=False).ids)) for x in rows())
    assert token_counts.count_tokens(token_counts.write_flat(none, f"{tmp_path}/none").select("file").distinct()).count() == 0


def test_flat_files_of_any_shape(spark, tmp_path, monkeypatch):
    from quillon.llm import token_counts

    monkeypatch.setattr(token_counts, "SCANNED", 3)
    r, want = random.Random(8), []
    for k in range(6):
        sizes, tail = [r.choice([0, 0, 1, 3, 50, 300]) for _ in range(r.randint(0, 40))], r.choice([0, 4, 90])
        ids = [x for n in sizes for x in [7] * n + [token_counts.END]] + [7] * tail
        np.array(ids, "<u2").tofile(f"{tmp_path}/{k}")
        want += [(f"{tmp_path}/{k}", i, n, True) for i, n in enumerate(sizes)] + ([(f"{tmp_path}/{k}", len(sizes), tail, False)] if tail else [])
    files = spark.createDataFrame([(f"{tmp_path}/{k}",) for k in range(6)], "file string")
    assert sorted(map(tuple, token_counts.count_tokens(files, block_ids=16).collect())) == sorted(want)


def test_encoder_matches_library():
    from quillon.llm.byte_bpe import Encoder, default_file

    r, parts = random.Random(3), [" ", "  ", "a", "é", "th", "\n", "\t", "漢", "😀", "<|endoftext|>", "1", "23", "--", "'s", "'ll", "ß", "\r\n", "\x00", "A", "\x1c", "İ", "ſ", "Ŀ", " "]
    for only in (False, True):
        e = Encoder.of(default_file(), only)
        texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(1500)]
        assert [list(x) for x in e.encode(texts)] == [x.ids for x in e.library.encode_batch_fast(texts, add_special_tokens=False)]


def junk(i, r):
    words = ["".join(r.choice("abcdef") for _ in range(r.randint(2, 6))) for _ in range(40)]
    bad, rude = i % 4 == 0, i % 6 == 1
    if rude:
        for _ in range(r.randint(1, 8)):
            words[r.randint(0, 39)] = r.choice(["vilex", "rottex", "grimex"])
    return " ".join(w.upper() + "!!" if bad else w for w in words), int(not bad), int(rude)


def test_labels_beyond_the_broadcast_bound(spark, monkeypatch):
    from quillon.llm import learned, quality

    r = random.Random(9)
    made = [(i, *junk(i, r)) for i in range(200)]
    d = spark.createDataFrame([(i, t) for i, t, _, _ in made], "doc_id long, text string")
    lab = spark.createDataFrame([(i, q) for i, _, q, _ in made], "doc_id long, quality int")
    one = {g.doc_id: g.score for g in quality.scored(d, lab).collect()}
    monkeypatch.setattr(learned, "BROADCAST_ROWS", 0)
    two = {g.doc_id: g.score for g in quality.scored(d, lab).collect()}
    assert one.keys() == two.keys() and all(math.isclose(one[i], two[i], rel_tol=1e-9, abs_tol=1e-12) for i in one)


def test_quality_and_toxicity(spark, docs, none, labels):
    from quillon.llm import quality, toxicity

    r = random.Random(6)
    made = [(i, *junk(i, r)) for i in range(600)]
    d = spark.createDataFrame([(i, t) for i, t, _, _ in made], "doc_id long, text string")
    lab = spark.createDataFrame([(i, q, x) for i, _, q, x in made], "doc_id long, quality int, toxic int")
    got = {g.doc_id: g for g in quality.scored(d, lab).collect()}
    held = [i for i in got if got[i].held_out]
    assert {i for i in got if zlib.crc32(str(i).encode()) % 4 == 2} == set(held)
    assert all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.7) for g in got.values())
    assert np.mean([got[i].predicted == made[i][2] for i in held]) > 0.97
    assert quality.keep_good(d, lab).count() == sum(g.predicted for g in got.values())
    tox = {g.doc_id: g for g in toxicity.scored(d, lab).collect()}
    assert np.mean([tox[i].predicted == made[i][3] for i in held]) > 0.97
    worse = [tox[i].severity for i in held if made[i][3] and sum(made[i][1].count(w) for w in ("vilex", "rottex", "grimex")) >= 6]
    mild = [tox[i].severity for i in held if made[i][3] and sum(made[i][1].count(w) for w in ("vilex", "rottex", "grimex")) <= 2]
    assert np.mean(worse) > np.mean(mild)
    for m in (quality, toxicity):
        assert m.scored(docs, labels).count() == len(rows())
        assert m.scored(none, labels).count() == 0
        assert m.scored(docs, labels.limit(0)).count() == len(rows())
    assert quality.keep_good(docs, labels.limit(0)).count() == len(rows())  # nothing is known against any
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_dual_descent_separates():
    from quillon.llm.quality import dual_descent

    f = [np.array([0, 2]), np.array([0, 1, 2]), np.array([1, 2]), np.array([1])]
    w, bias = dual_descent(f, np.array([1.0, -1.0, 0.2]), np.array([1, 1, -1, -1]), np.full(4, 50.0), 500)
    values = np.array([1.0, -1.0, 0.2])
    assert [np.sign(w[x] @ values[x] + bias) for x in f] == [1, 1, -1, -1]


def test_quality_fit_is_the_plain_one(spark):
    """Weights of a tiny table against support vectors solved in the primal by subgradients, and class ratios counted in plain Python."""
    from quillon.llm import learned, quality

    r = random.Random(3)
    texts = ["".join(r.choice(["Aa ", "bb ", "CC ", "12 ", "!! "]) for _ in range(r.randint(2, 9))) for _ in range(24)]
    y = [int("12" not in t) for t in texts]
    keep = [i for i in range(24) if zlib.crc32(str(i).encode()) % 4 != 2]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lab = spark.createDataFrame(list(enumerate(y)), "doc_id long, quality int")
    rows_ = learned.labelled(d, lab, "quality", learned.shape_features)
    table, n = learned.class_counts(rows_)
    sets = {i: set(learned.shape_features(texts[i]).tolist()) for i in keep}
    assert n.tolist() == [sum(y[i] == c for i in keep) for c in (0, 1)]
    for f in set().union(*sets.values()):
        assert table[:, f].tolist() == [sum(f in sets[i] and y[i] == c for i in keep) for c in (0, 1)]
    ratio = np.log((table[1] + 1) / (n[1] + 2)) - np.log((table[0] + 1) / (n[0] + 2))
    used = sorted(set().union(*sets.values()))
    x = np.array([[ratio[f] * (f in sets[i]) for f in used] + [1.0] for i in keep])
    sign = np.array([2 * y[i] - 1 for i in keep])
    w, bias = quality.dual_descent([np.array(sorted(sets[i])) for i in keep], ratio, sign, np.full(len(keep), 0.1), epochs=3000)
    own = np.append(w[used], bias)
    loss = lambda v: v @ v / 2 + 0.1 * np.maximum(0, 1 - sign * (x @ v)).sum()
    best, v = np.inf, np.zeros(len(used) + 1)
    for k in range(1, 20001):
        v = v - (v - 0.1 * ((sign * (sign * (x @ v) < 1)) @ x)) / k
        best = min(best, loss(v))
    assert abs(loss(own) - best) < 2e-3 * best  # descent stops when no step moves by 1e-4
    one, two = (quality.fit(d.repartition(k), lab) for k in (1, 5))
    assert np.array_equal(one.weight, two.weight) and one.slope == two.slope


def test_toxicity_features_and_fit(spark):
    """Fit and score see the same numbers, and the ordinal likelihood's gradient is zero at the fitted model."""
    from quillon.llm import learned, toxicity

    texts = ["bad bad bad word", "good day", "bad thing here", "nice nice words all day", "x" * 300 + " bad " * 20000, None, "good good", "bad worst worst bad"]
    y = [1, 0, 1, 0, 1, 0, 0, 1]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lab = spark.createDataFrame([(i, v) for i, v in enumerate(y)], "doc_id long, toxic int")
    rows_ = learned.labelled(d, lab, "toxic", learned.word_features).collect()
    for row in rows_:
        f, n = np.unique(learned.word_features(texts[row.doc_id]), return_counts=True)
        assert (row.f, row.n) == (f.tolist(), n.tolist())
    rng = np.random.default_rng(2)
    x, grade = rng.random((60, 3)), rng.integers(0, 4, 60)
    w, cuts = toxicity._fit_ordinal(x, grade, np.ones(60), 4, rounds=5000)

    def loss(t):
        w, c = t[:3], t[3:]
        low = np.concatenate(([np.inf * -1], c))[grade]
        high = np.concatenate((c, [np.inf]))[grade]
        p = 1 / (1 + np.exp(-(high - x @ w))) - 1 / (1 + np.exp(-(low - x @ w)))
        return -np.log(p).mean() + 1e-3 / 2 * w @ w

    at = np.concatenate((w, cuts))
    slope = [(loss(at + e) - loss(at - e)) / 2e-5 for e in np.eye(6) * 1e-5]
    assert np.abs(slope).max() < 1e-3 and (np.diff(cuts) > 0).all()
    got = toxicity.scored(d, lab).collect()
    assert len(got) == len(texts) and all(0 <= g.score <= 1 for g in got)


def test_pipeline_rows_are_those_of_brute_force_stages(spark, tmp_path):
    """Exact copies, near copies, the mix and ids of a small corpus, each stage done plainly."""
    import sentencepiece

    import corpus_pipeline as cp
    from quillon.llm.piece_bpe import default_model as default_file
    from quillon.llm.quality import scored

    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(2, 6)))
    texts = []
    for _ in range(30):
        base = [word() for _ in range(r.randint(30, 80))]
        texts.append(" ".join(base))
        if r.random() < 0.5:
            texts.append(" ".join(base).upper())
        if r.random() < 0.5:
            texts.append(" ".join([*base[:-1], word()]))
    docs_ = [(i, t, f"s{i % 3}") for i, t in enumerate(texts)]
    spark.createDataFrame(docs_, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 7 > 0), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d, lab = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    good = {g.doc_id for g in scored(d, lab).collect() if g.score >= 0.7}
    last = {}
    for i, t, s in sorted(docs_):
        if i in good:
            last[norm(t)] = (i, t, s)
    kept = sorted(last.values())
    sets = [{tuple(norm(t).split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for _, t, _ in kept]
    root = union(range(len(kept)), [(i, j) for i in range(len(kept)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])])
    kept = [x for i, x in enumerate(kept) if i == min(j for j in root if root[j] == root[i])]
    size = {i: len(t.split()) for i, t, _ in kept}
    of = {s: sum(size[i] for i, _, u in kept if u == s) for s in sorted({s for _, _, s in kept})}
    weight, full = {s: (5, 2, 1)[k % 3] for k, s in enumerate(of)}, set()
    while True:
        share = {s: weight[s] * (sum(of.values()) - sum(3 * of[u] for u in full)) / sum(weight[u] for u in of if u not in full) for s in of if s not in full}
        if not (over := {s for s in share if share[s] > 3 * of[s]}):
            break
        full |= over
    target = {s: 3 * of[s] if s in full else share[s] for s in of}
    low, slots, whole = 0, Counter(), sum(round(x) for x in target.values())
    step = int(0.6180339887498949 * 2**53)
    spans = []
    for s in of:
        spans.append((low, low + round(target[s]), s))
        low += round(target[s])
    for j in range(1, sum(of.values()) + 1):
        at = (j * step % 2**53) * whole // 2**53
        slots[next(s for a, b, s in spans if a <= at < b)] += 1
    want = Counter()
    for s in of:
        n, pos = min(slots[s], 3 * of[s]), 0
        for i, _, _ in sorted((x for x in kept if x[2] == s), key=lambda x: hashlib.md5(str(x[0]).encode()).hexdigest()):
            taken = n // of[s] * size[i] + max(0, min(n % of[s], pos + size[i]) - pos)
            want[i] = math.floor(taken / size[i] + 0.5)
            pos += size[i]
    got = cp.run(spark, str(tmp_path)).collect()
    assert Counter(g.doc_id for g in got) == +want
    p = sentencepiece.SentencePieceProcessor(model_file=default_file())
    text = dict((i, t) for i, t, _ in kept)
    for g in got:
        ids = p.encode(text[g.doc_id], add_eos=True)
        assert g.n_tokens == len(ids) and g.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_pipeline_is_its_operators(spark, docs, tmp_path):
    import corpus_pipeline as cp

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        before, after = at, stage(spark, at, str(tmp_path))
        assert after.columns == before.columns, name
        rows_before = {str(x) for x in before.collect()}
        found = [str(x) for x in after.collect()]
        assert set(found) <= rows_before, name
        at = spark.createDataFrame(after.collect(), SCHEMA)
    last = cp.STAGES[-1][1](spark, at, str(tmp_path))
    assert Counter(x.doc_id for x in last.collect()) == Counter(x.doc_id for x in at.collect())
    assert cp.run(spark, str(tmp_path)).columns == last.columns
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
