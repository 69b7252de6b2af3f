import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from quillspark.llm import toxicity
from quillspark.llm.toxicity import BlockMaxIndex, bags, first_copies, op7_toxicity_neighbours, score, train


def test_block_max_search_is_exact(monkeypatch):
    monkeypatch.setattr(toxicity, "TOGETHER", 7)
    rng = random.Random(3)
    vectors = []
    for _ in range(900):
        v = {t: rng.choice([0.5, 1.0, rng.random()]) for t in {min(int(rng.expovariate(0.08)), 59) for _ in range(rng.randint(0, 9))}}
        n = sum(x * x for x in v.values()) ** 0.5
        vectors.append({t: x / n for t, x in sorted(v.items())})
    ptr = np.cumsum([0, *map(len, vectors)])
    terms, weights = (np.array([x for v in vectors for x in f(v)]) for f in (dict.keys, dict.values))
    for bounded in (0.0, 0.01, 0.3, 1.0):
        monkeypatch.setattr(toxicity, "BOUNDED", bounded)
        index = BlockMaxIndex(ptr, terms, weights, 60, block=16)
        assert 0 < len(index.dense) < 60
        asked = [rng.randrange(900) for _ in range(60)]
        without = np.array([i if i % 2 else -1 for i in asked])
        at = np.cumsum([0, *(len(vectors[i]) for i in asked)])
        rows = np.concatenate([np.arange(ptr[i], ptr[i + 1]) for i in asked])
        for i, skip, (got, s) in zip(asked, without, index.search_all(at, terms[rows], weights[rows], 12, without)):
            every = sorted((-round(sum(w * v.get(t, 0.0) for t, w in vectors[i].items()), 12), j) for j, v in enumerate(vectors) if j != skip)
            want = [(j, -x) for x, j in every if x < 0][:12]
            assert np.allclose(s, [x for _, x in want], rtol=0, atol=1e-9)
            assert {j for j, x in want if x > want[-1][1] + 1e-9} <= set(got.tolist()) if want else not len(got)


def test_whole_scores_against_brute_force(spark):
    """Terms, weights, neighbours, votes: all from plain counts of words; calibration is the module's own."""
    rng = random.Random(12)
    words = [f"wort{i}" for i in range(120)] + ["Äpfel", "x2"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 40)) + (["dolt"] * rng.randint(1, 3) if i % 5 == 0 else [])) for i in range(150)]
    texts[30] = texts[31] = texts[0] + " end"
    labels = {i: int(i % 5 == 0) for i in range(90)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = train(spark, df, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
    bag = [Counter(re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))) for t in texts]
    order = sorted(labels, key=lambda i: (-labels[i], i))
    counted = [i for k, i in enumerate(order) if not any(len(bag[i].keys() & bag[j].keys()) >= 0.8 * len(bag[i].keys() | bag[j].keys()) for j in order[:k])]
    n, bad = len(counted), sum(labels[i] for i in counted)
    weight = {}
    for t in {t for i in labels for t in bag[i]}:
        if sum(t in bag[i] for i in labels) < 2:
            continue
        d, b = sum(t in bag[i] for i in counted), sum(labels[i] for i in counted if t in bag[i])
        under = d * (n - d) * bad * (n - bad)
        chi2 = (b * (n - bad) - (d - b) * bad) ** 2 * n / under if under else 0.0
        weight[t] = (np.log(151 / (1 + sum(t in x for x in bag))) + 1) * chi2 / (chi2 + 30)

    def vector(x):
        v = {t: c * weight[t] for t, c in x.items() if weight.get(t)}
        size = sum(y * y for y in v.values()) ** 0.5
        return {t: y / size for t, y in v.items()}

    vectors = [vector(x) for x in bag]
    bare = [labels[i] for i in order if not vectors[i]]
    base = sum(labels.values()) / len(labels)
    base = min(base, sum(bare) / len(bare)) if bare else base
    got = {r["doc_id"]: r for r in score(spark, df, model).collect()}
    for i, q in enumerate(vectors):
        similar = sorted(((sum(w * vectors[j].get(t, 0.0) for t, w in q.items()), -k, j) for k, j in enumerate(order)), reverse=True)
        near = [(s, j) for s, _, j in similar if s > 0][: toxicity.NEIGHBOURS]
        vote = (sum(s * s * labels[j] for s, j in near) + 0.5 * base) / (sum(s * s for s, _ in near) + 0.5)
        vote = min(max(vote, 1e-4), 1 - 1e-4)
        want = 1 / (1 + np.exp(-(model.slope * np.log(vote / (1 - vote)) + model.shift)))
        assert abs(got[i]["score"] - want) < 1e-6, i
        assert np.allclose([e["similarity"] for e in got[i]["evidence"]], [s for s, _ in near], atol=1e-9)


def test_bags_and_copies():
    ptr, hashes, tf = bags(pa.array(["A-b é1_c a", "", "c", "é1 B"]))
    assert ptr.tolist() == [0, 4, 4, 5, 7] and sorted(tf[:4].tolist()) == [1, 1, 1, 2]
    assert set(hashes[5:].tolist()) < set(hashes[:4].tolist()) and hashes[4] in hashes[:4]
    texts = ["one two three four five six seven eight nine ten", "one two three four five six seven eight nine ten eleven", "one two three nothing else", "", ""]
    ptr, hashes, _ = bags(pa.array(texts))
    got = first_copies([hashes[a:b] for a, b in zip(ptr, ptr[1:])], toxicity.least_shingles(pa.array(texts)).view(np.int64))
    assert got.tolist() == [True, False, True, True, False]


def test_query_columns(spark):
    rows = op7_toxicity_neighbours(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert len(rows) == docs
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)


def test_held_out_examples_and_edges(spark):
    rng = random.Random(8)
    clean = [f"wort{i}" for i in range(400)]
    rude = ["dolt", "oaf", "clod", "boor"]
    docs, labels = [], []
    for i in range(900):
        bad = i % 4 == 0
        words = rng.choices(clean, k=60) + (rng.sample(rude, 2) if bad else [])
        rng.shuffle(words)
        docs.append((i, " ".join(words), "x"))
        labels.append((i, int(bad)))
    docs += [(1000, None, "x"), (1001, "", "x"), (None, "an OAF and a Clod!", "x"), (5, "twice", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = train(spark, df, lab.filter("doc_id % 3 <> 1"))
    got = {r["doc_id"]: r for r in score(spark, df.filter("doc_id is null or doc_id <> 5"), model).collect()}
    for i, bad in labels:
        if i % 3 == 1 and i != 5:
            assert (got[i]["score"] >= 0.7) == bool(bad), i
    assert got[None]["score"] >= 0.7 and got[None]["evidence"][0]["toxic"] == 1
    assert got[1000]["score"] < 0.3 and got[1001]["score"] == got[1000]["score"] and not got[1000]["evidence"]
    assert score(spark, df.limit(0), model).count() == 0
    bare = train(spark, df, lab.limit(0))
    assert {r["score"] for r in score(spark, df, bare).collect()} == {next(iter(score(spark, df, bare).take(1)))["score"]}


def test_few_examples_give_terms(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choices([f"wort{k}" for k in range(400)], k=60) + (["dolt", "oaf"] if i % 8 == 0 else []))) for i in range(96)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = train(spark, df, spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(26)], "doc_id long, toxic int"))
    assert set(bags(pa.array(["dolt oaf"]))[1].tolist()) <= set(model.terms.tolist())
    got = {r["doc_id"]: r for r in score(spark, df, model).collect()}
    bad, good = ([got[i]["score"] for i in range(26, 96) if (i % 8 == 0) == b] for b in (True, False))
    assert min(bad) > np.quantile(good, 0.9) and all(got[i]["evidence"] for i in range(32, 96, 8))
