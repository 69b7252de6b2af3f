import numpy as np

from quillspark.llm.neighbours import RERANK, op1_additive_quantisation, search


def brute(vecs, k):
    out = {}
    for q, v in vecs:
        if q % 10 == 0:
            d = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), i) for i, w in vecs if i != q)
            out[q] = d[:k]
    return out


def test_recall_and_ties_against_brute_force(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16))
    vecs = [(i, [float(x) for x in np.float32(centres[i % 12] + rng.normal(size=16) * 0.4)]) for i in range(600)]
    vecs += [(1000 + i, vecs[0][1]) for i in range(40)]
    rows = [(i, v) for i, v in vecs] + [(2000, None), (2010, [0.0] * 16), (2020, [float("nan")] * 16), (2030, [1.0, None] + [0.0] * 14), (2040, [1.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in search(spark, df, df.filter("vec_id % 10 = 0"), 10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    want = brute(vecs, 10)
    assert got.keys() == want.keys()
    hits = 0
    for q, near in want.items():
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert [(s, i) for _, s, i in mine] == sorted((s, i) for _, s, i in mine)
        hits += len({i for _, i in near} & {i for _, _, i in mine})
    assert hits >= 0.95 * 10 * len(want)
    assert [i for _, _, i in sorted(got[0])] == list(range(1000, 1010))


def test_empty_and_single(spark):
    df = spark.createDataFrame([(100, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert search(spark, df, df, 3).count() == 0
    assert search(spark, df.limit(0), df.limit(0), 3).count() == 0


def test_encoding_is_near_and_norms_are_those_of_the_sums():
    from quillspark.llm.neighbours import fit

    x = np.random.default_rng(2).normal(size=(400, 8))
    books = fit(x, 4, 16)
    codes, norm = books.encode(x)
    sums = sum(books.words[m][codes[:, m]] for m in range(4))
    assert np.allclose((sums * sums).sum(1), norm)
    assert ((x - sums) ** 2).sum() < 0.3 * (x * x).sum()
    wide, _ = books.encode(x, 16)
    narrow, _ = books.encode(x, 1)
    error = lambda c: ((x - sum(books.words[m][c[:, m]] for m in range(4))) ** 2).sum()
    assert error(wide) <= error(narrow)


def test_recall_where_few_rows_are_ranked_exactly(spark):
    """6,000 vectors without structure, 60 of them ranked exactly: the codes have to find the neighbours."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    for books, codes in ((10, 64), (6, 300)):  # one and two bytes a code
        got = {}
        for r in search(spark, df, df.filter("vec_id % 100 = 0"), 10, rerank=60, books=books, codes=codes).collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        hits = 0
        for q in range(0, 6000, 100):
            d = ((x - x[q]) ** 2).sum(1)
            d[q] = np.inf
            hits += len(got[q] & set(np.argsort(d)[:10].tolist()))
        assert hits >= 0.9 * 600, (books, hits)
    assert RERANK < 600


def test_query_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = op1_additive_quantisation(spark, "/root/testdata/sf0.01").collect()
    hits = 0
    for q in ids[ids % 100 == 0]:
        mine = sorted(r for r in got if r["query_id"] == q)
        assert [r["rank"] for r in mine] == list(range(1, 11))
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        d[ids == q] = np.inf
        hits += len({r["vec_id"] for r in mine} & set(ids[np.lexsort((ids, d))[:10]].tolist()))
        assert all(abs(r["score"] - d[ids == r["vec_id"]][0]) < 1e-9 for r in mine)
    assert hits >= 0.95 * 10 * (ids % 100 == 0).sum()


def test_two_steps_find_what_one_does(spark):
    """25 partitions: a bound from a fifth of the rows comes first; one partition: all rows at once."""
    from quillspark.llm.neighbours import candidates, fit

    x = np.random.default_rng(9).normal(size=(3000, 8))
    books = fit(x, 6, 32)
    codes, norm = books.encode(x)
    index = spark.createDataFrame([(i, c.tobytes(), float(n)) for i, (c, n) in enumerate(zip(codes, norm))], "vec_id long, codes binary, norm double")
    qid = np.arange(0, 3000, 100)
    for rerank in (20, 1000):  # the fifth has fewer than 1,000 rows, so nothing is bounded
        one, two = ({tuple(r) for r in candidates(index.repartition(n), books, qid, x[qid], rerank).collect()} for n in (1, 25))
        assert one == two and len(one) == rerank * len(qid)
    assert candidates(index.limit(0).repartition(25), books, qid, x[qid], 20).count() == 0


def test_least_of_the_vectors_of_one_id_asks(spark):
    rows = [(1, [3.0, 0.0]), (1, [1.0, 9.0]), (1, [1.0, 2.0]), (2, [1.0, 3.0]), (3, [1.0, 7.0]), (4, [3.0, 1.0])]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "vec_id long, embedding array<double>").repartition(3)
        got = search(spark, df, df.filter("vec_id = 1"), 3).orderBy("rank").collect()
        assert [(r["vec_id"], round(r["score"], 6)) for r in got] == [(2, 1.0), (4, round(5**0.5, 6)), (3, 5.0)]


def test_queries_of_three_blocks(spark, monkeypatch):
    """The candidates of each block are a table of their own."""
    from quillspark.llm import neighbours

    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 12)
    x = np.random.default_rng(11).normal(size=(400, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in search(spark, df, df.filter("vec_id % 10 = 0"), 5, books=4, codes=16).collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert got.keys() == set(range(0, 400, 10))
    for q, near in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        assert [i for _, i in sorted(near)] == np.argsort(d)[:5].tolist()


def test_no_nearest_row_is_missed_where_codes_say_little(spark, monkeypatch):
    """A tight cluster that one codeword stands for, few rows far out, ties, and rows of the query's own id: exactly what all pairs give."""
    from quillspark.llm import neighbours

    monkeypatch.setattr(neighbours, "ROW_BLOCK", 300)
    rng = np.random.default_rng(12)
    x = np.concatenate([3 + rng.normal(size=(900, 8)) * 1e-5, rng.normal(size=(900, 8)), rng.normal(size=(20, 8)) * 1e6, rng.integers(0, 2, (300, 8)) + 0.5])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(50, (x[50] + 1e-7 * j).tolist()) for j in range(1, 15)] + [(5000 + i, x[i].tolist()) for i in range(0, 900, 60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    for parts in (1, 12):
        got = {}
        for r in search(spark, df.repartition(parts), df.filter("vec_id % 50 = 0"), 10, rerank=15, books=3, codes=8).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
        assert got.keys() == {i for i in ids.tolist() if i % 50 == 0}
        for q, mine in got.items():
            own = min(x[ids == q].tolist())
            d = np.sqrt(((x - own) ** 2).sum(1))
            order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
            assert [(s, i) for _, s, i in sorted(mine)] == [(d[i], ids[i]) for i in order]
