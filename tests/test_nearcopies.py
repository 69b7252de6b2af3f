import itertools
import re

import numpy as np
from pyspark.sql import functions as F

from quillspark.plans.versions import Store
from quillspark.streaming import nearcopies as N


def brute(rows):
    """(id, smallest id of the near copies) by comparing all pairs."""
    sets = []
    for i, text in rows:
        w = [x for x in re.split("[ \t-\r]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if x]
        sets.append((i, frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else None))
    sets = list(dict.fromkeys(sets))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and len(x & y) * 5 >= len(x | y) * 4:
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, least[find(k)]) for k, (i, _) in enumerate(sets))


def corpus():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: [str(x) for x in rng.choice(words, n)]
    rows, bases = [], [text(120) for _ in range(6)]
    for k in range(90):
        t = list(bases[k % 6])
        for at in rng.integers(0, len(t), k % 4):  # a changed word costs five shingles of 116
            t[at] = f"new{k}"
        rows.append((k, " ".join(t)))
    # a chain: each is near the next alone, so groups of different batches grow together
    chain = text(200)
    rows += [(100 + j, "\n".join(chain[j * 12 : j * 12 + 120])) for j in range(6)]
    return rows + [(200, None), (201, ""), (202, " \t "), (203, "One two"), (204, "one  TWO"), (205, "one two three"), (206, "Ä ä"), (207, "ä ä"), (0, rows[0][1]), (0, "another text of the same id")]


def added(spark, path, batches):
    store = Store(spark, str(path))
    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "id long, text string").withColumns({"set": F.lit(1), "SET_": F.lit("x"), "keys": F.lit(None).cast("int")})
        N.update(store, df, n)
    return store


def test_batches_give_the_groups_of_all_pairs(spark, tmp_path):
    rows = corpus()
    want = brute(rows)
    parts = [[r for k, r in enumerate(rows) if k * 7 % 4 % 3 == b] for b in range(3)]
    store = added(spark, tmp_path, parts)
    assert sorted(map(tuple, N.groups(store).collect())) == want
    assert sorted(map(tuple, N.groups(store, 1).collect())) == brute(parts[0])  # the index as it was


def test_one_batch_repeated_batch_and_empty_batch(spark, tmp_path):
    rows = corpus()
    store = added(spark, tmp_path, [[], rows, []])
    before = store.latest()
    assert sorted(map(tuple, N.groups(store).collect())) == brute(rows)
    assert N.update(store, spark.createDataFrame(rows[:3], "id long, text string"), 1) == before == store.latest()
    N.update(store, spark.createDataFrame(rows, "id long, text string"), 3)
    assert store.read("near_texts").count() == store.read("near_texts", before).count()  # nothing is kept twice
    assert sorted(map(tuple, N.groups(store).collect())) == brute(rows)


def test_lists_of_texts_that_stay_apart_and_of_many_copies(spark, tmp_path, monkeypatch):
    # one key for all texts: every pair has to be settled by the rounds alone
    monkeypatch.setattr(N, "BROADCAST_SETS", 3)
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(60)]
    rows = [(k, " ".join([*base[:k], f"x{k}", *base[k:]])) for k in range(40)] + [(50 + k, " ".join(f"q{x}" for x in rng.integers(0, 9999, 60))) for k in range(12)]
    store, tables = Store(spark, str(tmp_path)), N._Tables(spark)
    sets = tables.keep(N.signed(spark.createDataFrame(rows, "id long, text string")))
    lists = sets.select(F.lit(1).cast("long").alias("key"), "set", "n", F.lit(True).alias("fresh"), F.col("set").alias("start"))
    roots = {bytes(r.node): bytes(r.root) for r in N._links(tables, lists, sets.select("set", "n", "hashes")).collect()}
    names = {r.id: bytes(r.set) for r in sets.collect()}
    groups = {}
    for i, s in names.items():
        groups.setdefault(roots.get(s, s), []).append(i)
    assert sorted((i, min(g)) for g in groups.values() for i in g) == brute(rows)
    assert store.latest() == 0


def test_shingles_and_keys(spark):
    words = np.array([1, 2, 3, 1, 2, 3, 4, 5, 6, 1, 2, 3, 4, 5, 1, 2, 3, 4, 5], np.uint64)
    hashes, n = N.shingle_sets(words, np.array([3, 6, 5, 5]))
    assert n.tolist() == [1, 2, 1, 1] and hashes[-1] == hashes[-2] and hashes[0] not in hashes[1:]
    keys = N.band_keys(hashes, n)
    assert keys.shape == (4, N.BANDS) and (keys[2] == keys[3]).all() and len(set(keys[0])) == N.BANDS


def test_hashes_of_many_sets_are_fetched_without_an_exchange_of_all_texts(spark, monkeypatch):
    monkeypatch.setattr(N, "BROADCAST_SETS", 4)
    name = lambda k: bytearray([k] * 16)
    texts = spark.createDataFrame([(name(k), 10, list(range(k // 2, k // 2 + 10))) for k in range(40)], "set binary, n int, hashes array<long>")
    pairs = spark.createDataFrame([(name(k), name(k + j), 10) for k in range(0, 20, 2) for j in (1, 9)], "a binary, b binary, n_other int")
    found = N._similar(pairs, texts)
    assert sorted((r["a"][0], r["b"][0]) for r in found.collect()) == [(k, k + 1) for k in range(0, 20, 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == plan.count("strategy=broadcast") > 2
