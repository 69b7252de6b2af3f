import os
import random

import numpy as np
import pytest
import xxhash

from quillspark.llm import simhash
from quillspark.llm.graph import components, forest
from quillspark.llm.simhash import groups, keep_one, links, op3_simhash_groups
from quillspark.llm.work import Workspace


def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))


def roots(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def test_groups_against_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(vocab, k=rng.randint(60, 200))) for _ in range(25)]
    texts = list(base)
    for b in base:
        w = b.split()
        for _ in range(3):
            w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append("\t".join(w).upper())
    texts += [None, "", " \n", "one", "ONE", "one two", base[0], base[0]]
    rows = [(i * 3 + 1, t, 0) for i, t in enumerate(texts)] + [(None, base[1], 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in groups(spark, df).collect()}
    fps = {i * 3 + 1: fingerprint(t) for i, t in enumerate(texts)}
    ids = sorted(fps)
    pairs = [(a, b) for a in ids for b in ids if a < b and bin(fps[a] ^ fps[b]).count("1") <= 3]
    want = roots(pairs, ids)
    assert {k: v for k, v in got.items() if k is not None} == {i: (fps[i], want[i]) for i in ids}
    assert got[None][1] is None
    left = sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in keep_one(spark, df).collect())
    assert left == sorted([-1, *set(want.values())])
    assert groups(spark, df.limit(0)).count() == 0


def test_links_with_long_lists(spark, monkeypatch):
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 700:
        x = rng.choice(sorted(fps)) if rng.random() < 0.5 else centre
        for _ in range(rng.randint(1, 5)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    pairs = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin(a ^ b).count("1") <= 3]
    want = roots(pairs, fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    for long, longer in ((10_000, 10_000), (20, 10_000), (20, 10)):
        monkeypatch.setattr(simhash, "LONG", long)
        monkeypatch.setattr(simhash, "LONGER", longer)
        got = roots([(r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1) for r in links(Workspace(spark), df).collect()], fps)
        assert got == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 200)] + [(300, 301), (301, 300)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in components(Workspace(spark), df).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}, 300: 300, 301: 300}
    a, b = forest(np.array([1, 2, 5]), np.array([2, 3, 6]))
    assert sorted(zip(a.tolist(), b.tolist())) == [(2, 1), (3, 1), (6, 5)]


def test_variants_find_what_pairs_find():
    rng = random.Random(9)
    low = sorted({rng.getrandbits(24) & 0x0F0F3F for _ in range(400)})
    fp = np.array([(0xABCDEF1234 << 24) | x for x in low], np.uint64)
    a, b = simhash._variants(fp, 0xFFFFFFFFFF000000)
    want = {(int(x), int(y)) for i, x in enumerate(fp) for y in fp[i + 1 :] if bin(int(x) ^ int(y)).count("1") <= 3}
    assert set(zip(a.tolist(), b.tolist())) == want


def test_a_repeated_doc_id_removes_no_other_text(spark):
    long = [" ".join(f"{c}{i}" for i in range(60)) for c in "xyz"]
    df = spark.createDataFrame([(2, long[0]), (5, long[0]), (5, long[1]), (5, long[2]), (7, long[2]), (5, long[2])], "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"]) for r in keep_one(spark, df).collect())
    assert got == [(2, long[0]), (5, long[1]), (5, long[2])]


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("needs the driver's tables")
    fps = {r["doc_id"]: fingerprint(r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(fps)
    want = roots([(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 3], ids)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op3_simhash_groups(spark, sf).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in ids}
