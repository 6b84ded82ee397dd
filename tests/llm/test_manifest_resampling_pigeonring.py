"""Fingerprint components, importance resampling and Merkle manifests against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigweave.llm import merkle, pigeonring, resampling

DOCS = "doc_id long, text string, lang string, source string, n_chars long, print string, tree int, score int, pos int"
WORDS = "alpha beta Gamma delta eps zeta ETA theta iota kappa é漢字 x1 2y".split()


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", ",", "\n", "-z", "\x0b", "\x00"]) for _ in range(n))


def edited(text, seed):
    rng = random.Random(seed)
    words = text.split(" ")
    words[rng.randrange(len(words))] = "edit%d" % seed
    return " ".join(words)


TEXTS = [None, "", " \n ", "one", "one two", "one  two", prose(30, 1), prose(30, 1), prose(4000, 2), "same " * 5000, "ÀB éÀ", "\u00a0nb\u00a0 sp\u2003em"]
TEXTS += [edited(prose(300, 3), s) for s in range(12)] + [prose(25, s) for s in range(40, 60)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 7 else None, t, [None, "en"][i % 2], [None, "s1", "", "é", "s0"][i % 5], [None, 4][i % 3 > 0], "p", 1, 2, 3) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[6], rows[8], rows[0]], DOCS)


def print_of(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    runs = [words[i : i + 3] for i in range(len(words) - 2)] or ([words] if words else [])
    return [b" ".join(r) for r in runs]


def linked(nodes, near):
    """Least of each node's component."""
    head = {n: n for n in nodes}

    def find(n):
        while head[n] != n:
            n = head[n]
        return n

    for a, b in itertools.combinations(nodes, 2):
        if near(a, b):
            x, y = sorted((find(a), find(b)))
            head[y] = x
    return {n: find(n) for n in nodes}


def test_fingerprints_equal_sparks_hash_and_a_count_of_bits(spark, docs):
    got = docs.select("doc_id", "text").collect()
    flat = [(i, s.decode()) for i, r in enumerate(got) for s in print_of(r["text"])]
    hashed = defaultdict(list)
    for i, h in spark.createDataFrame(flat, "i int, s string").select("i", F.xxhash64("s")).collect():
        hashed[i].append(h % (1 << 64))
    for i, r in enumerate(got):
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed[i]) > len(hashed[i]))
        assert pigeonring.majority(pigeonring.shingle_digests((r["text"] or "").encode())) == want


def test_every_pattern_within_the_radius_is_found_and_none_beyond(spark):
    base = 0x1234_5678_9ABC_DEF0
    flips = [sum(1 << b for b in c) for n in (1, 2, 3) for c in itertools.combinations(range(64), n)]
    rng = random.Random(1)
    far = [sum(1 << b for b in rng.sample(range(64), rng.randint(4, 9))) for _ in range(4000)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = spark.createDataFrame([(signed(base ^ x),) for x in flips + far], "print long").distinct()
    one = pigeonring.keys(spark.createDataFrame([(base,)], "print long")).withColumnRenamed("print", "b")
    met = pigeonring.keys(rows).join(one, ["start", "key"]).filter(pigeonring.within("print", "b", "start")).select("print").distinct()
    assert {r[0] for r in met.collect()} == {signed(base ^ x) for x in flips}


def test_components_equal_all_pairs(docs):
    rows = pigeonring.op11_pigeonring(docs).collect()
    texts = docs.select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    want = Counter()
    prints = {t: pigeonring.majority(pigeonring.shingle_digests((t or "").encode())) for _, t in texts}
    heads = linked(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 3)
    least = defaultdict(list)
    for i, t in texts:
        least[heads[prints[t]]] += [] if i is None else [i]
    for i, t in texts:
        want[i, f"{prints[t]:016x}", min(least[heads[prints[t]]], default=None)] += 1
    assert Counter(tuple(r) for r in rows) == want
    assert prints[None] == prints[""] == 0 and len({r["component_id"] for r in rows}) < len(set(heads.values())) + 1


@pytest.mark.parametrize("few", [0, 32])
def test_dense_keys_lose_no_link(spark, monkeypatch, few):
    """A cloud of fingerprints with many of its pairs out of the radius, and chains of links, all sharing keys."""
    monkeypatch.setattr(pigeonring, "FEW", few)
    rng = random.Random(9)
    prints = {0}
    for _ in range(260):
        prints.add(sum(1 << b for b in rng.sample(range(40, 64), rng.randint(2, 7))))
    step = 0
    for k in range(14):
        step |= 7 << (3 * k)
        prints.add((0xABC << 52) ^ step)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = sorted(signed(p) for p in prints)
    want = linked(nodes, lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 3)
    got = pigeonring.components_of(spark.createDataFrame([(n,) for n in nodes], "print long"))
    held = {n: n for n in nodes} | {r["node"]: r["label"] for r in got.collect()}
    assert held == want


def test_empty_tables(spark, docs):
    empty = docs.limit(0)
    assert pigeonring.op11_pigeonring(empty).collect() == []
    assert merkle.op13_merkle_manifest(empty).collect() == []
    target = spark.createDataFrame([], "item_id long, text string")
    assert resampling.op12_importance_resampling(empty, target).collect() == []
    assert resampling.op12_importance_resampling(docs, target).count() == docs.count()


def brute_features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [zlib.crc32(f.encode()) % 10000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def test_resampling_equals_brute_force(spark, docs):
    items = [(1, "Alpha beta delta 2Y"), (2, None), (3, prose(50, 77))]
    target = spark.createDataFrame(items, "item_id long, text string")
    rows = docs.select("doc_id", "text").collect()
    s, t = (Counter(b for text in texts for b in brute_features(text)[1]) for texts in ([r["text"] for r in rows], [x for _, x in items]))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    scored = []
    for i, text in rows:
        words, buckets = brute_features(text)
        weight = sum(map(gain, buckets)) // len(buckets) if buckets else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((i, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= 20))
    able = sorted((x for x in scored if x[4]), key=lambda x: (-x[3], x[0] is None, x[0]))
    n = 25 * len(able) // 100
    want = Counter([(*x[:4], k + 1 if k < n else None) for k, x in enumerate(able)] + [(*x[:4], None) for x in scored if not x[4]])
    got = Counter(tuple(r) for r in resampling.op12_importance_resampling(docs, target).collect())
    assert got == want and n > 5


def test_ranks_within_scores_go_by_id(spark):
    """Many ties at the cutoff: the draw is whole, gapless and goes to the smaller ids."""
    rows = [(i, 40, 30 if i % 10 else 3, 0, [5, 5, 9, -4][i % 4]) for i in range(200)]
    got = resampling.drawn(spark.createDataFrame(rows, "doc_id long, n_features long, n_words long, weight long, score long").repartition(7), 60).collect()
    able = sorted((r for r in rows if r[2] >= 20), key=lambda r: (-r[4], r[0]))
    want = {r[0]: k + 1 for k, r in enumerate(able[: 60 * len(able) // 100])}
    assert {r["doc_id"]: r["rank"] for r in got if r["rank"]} == want and len(got) == 200


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(nodes):
    """Root, and the siblings (left, right) of each node on its way up."""
    proofs = [[] for _ in nodes]
    groups = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, held = [], []
        for a in range(0, len(nodes), 3):
            run = nodes[a : a + 3]
            for k in range(len(run)):
                for i in groups[a + k]:
                    proofs[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(H(*run))
            held.append([i for g in groups[a : a + 3] for i in g])
        nodes, groups = up, held
    return nodes[0], proofs


def brute_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, s, g, n, t: H(*map(field, (i, s, g, n, t)))
    trees = defaultdict(list)
    for i, t, g, s, n in rows:
        changed = t is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0
        trees[s].append((i is not None, i or 0, leaf(i, s, g, n, t), leaf(i, s, g, n, t.replace("\n", "")) if changed else leaf(i, s, g, n, t), i))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    held = [sorted(trees[s]) for s in order]
    built = [brute_tree([x[2] for x in x_s]) for x_s in held]
    root, upper = brute_tree([b[0] for b in built])
    out = Counter()
    for x_s, (subroot, proofs), top in zip(held, built, upper):
        for (_, _, own, now, i), proof in zip(x_s, proofs):
            whole = proof + top
            acc = now
            for a, b in whole:
                acc = H(a, acc, b)
            out[i, own, subroot, root, H(*(a + b for a, b in whole)), acc, acc == root] += 1
    return out


def test_manifest_equals_brute_force(docs):
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars").collect()
    got = Counter(tuple(r) for r in merkle.op13_merkle_manifest(docs).collect())
    assert got == brute_manifest(rows)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("sizes", [(1,), (3, 1), (4, 81, 82, 2), (700, 1, 28)])
def test_manifest_pages(spark, sizes):
    """Trees of one node to several pages, of one source or more, over several partitions."""
    rows = [(1000 * k + 7 * i % 991, f"line\n{i}", "en", f"s{k}", i) for k, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert Counter(tuple(r) for r in merkle.op13_merkle_manifest(df).collect()) == brute_manifest(rows)


def test_manifest_of_many_sources(spark):
    rows = [(i, "t", None, f"s{i % 100}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert Counter(tuple(r) for r in merkle.op13_merkle_manifest(df).collect()) == brute_manifest(rows)


def test_proofs_catch_what_the_caller_changes(spark):
    rows = [(i, "a\nb" if i % 2 else "ab", "en", "s", 3) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = merkle.manifest(df, changed=F.col("doc_id") == 41)
    bad = out.filter(merkle.folded(F.coalesce("now", "leaf"), F.col("proof")) != F.col("root"))
    assert [r["doc_id"] for r in bad.collect()] == [41]


def test_oracles_agree(spark, docs, tmp_path):
    import duckdb

    from sigweave.llm.queries import ORACLE, QUERIES

    one = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    one.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "Alpha beta delta"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("op12_importance_resampling", "op13_merkle_manifest"):
        got = QUERIES[name](spark, str(tmp_path))
        want = con.sql(ORACLE[name])
        assert set(got.columns) == set(want.columns)
        assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(want.fetchall())


def test_long_texts(spark):
    """A text of a million words among short ones."""
    long = " ".join(f"w{i % 977}" for i in range(1_000_000))
    rows = [(1, long, "en", "s", 1), (2, long + "\n", "en", "s", 1), (3, "x", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"]: r["component_id"] for r in pigeonring.op11_pigeonring(df).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r["doc_id"]: r["n_features"] for r in resampling.op12_importance_resampling(df, df).collect()} == {1: 1_999_999, 2: 1_999_999, 3: 1}
    assert Counter(tuple(r) for r in merkle.op13_merkle_manifest(df).collect()) == brute_manifest([(r[0], r[1], r[2], r[3], r[4]) for r in rows])
