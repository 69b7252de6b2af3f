import hashlib
import random

import duckdb
import numpy as np

from quillspark.llm import lloyd

SF = "/root/testdata/sf0.001"


def brute(rows, k, rounds, dimensions):
    """The same with Python's integers."""
    kept = [(i, [int(np.floor(float(x) * 256)) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, vs in groups.items():
            centroids[n] = [sum(x) // len(vs) for x in zip(*vs)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = {}
    for _, n, d in found:
        inertia[n] = inertia.get(n, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), digest[n]) for i, n, d in found), key=repr)


def test_against_plain_integers(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(300)]
    rows += [(1, rows[1][1]), (1, rows[2][1]), (None, rows[3][1]), (400, None), (401, [0.1] * 5), (402, [float("nan")] + [0.1] * 5), (403, [None] + [0.1] * 5), (404, [float("inf")] + [0.0] * 5), (405, [0.0] * 6), (406, [])]
    rows += [(1000 + i, [0.5] * 6) for i in range(200)]  # copies, and ties among them
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, cluster int").repartition(5)
    for k, rounds in ((7, 3), (1, 1), (600, 2), (7, 0)):
        got = sorted((tuple(r) for r in lloyd.lloyd(spark, df, k, rounds, 6).collect()), key=repr)
        assert got == brute(rows, k, rounds, 6), (k, rounds)


def test_empty_and_huge(spark):
    df = spark.createDataFrame([(1, [1e300, -1e300]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert lloyd.lloyd(spark, df.limit(0), 3, 2, 2).count() == 0
    got = {r["vec_id"]: r for r in lloyd.lloyd(spark, df, 1, 0, 2).collect()}
    far = next(r["distance"] for r in got.values() if r["distance"])
    assert far == 2 * lloyd.REACH**2 and {r["inertia"] for r in got.values()} == {far}


def test_query_gives_what_the_sql_gives(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    names = "vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256"
    want = sorted(c.execute(f"SELECT {names} FROM ({lloyd.OP12_SQL})").fetchall())
    assert sorted(tuple(r) for r in lloyd.op12_lloyd(spark, SF).collect()) == want
