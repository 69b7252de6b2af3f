import os
import random

from quillspark.llm.repeats import remove_repeats


def brute(rows, window):
    first, words = {}, []
    for d, t in rows:
        words.append((d, (t or "").encode().split()))
    for d, w in words:
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, (d, s)), (d, s))
    out = []
    for d, w in words:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (d, s):
                gone |= set(range(s, s + window))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(1)
    vocab = ["a", "b", "é", "中文", "word", "x,", "the"] + [f"v{i}" for i in range(40)]
    passages = [" ".join(rng.choices(vocab, k=rng.randint(20, 60))) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choices(vocab, k=rng.randint(1, 60))))
        rows.append((rng.randint(0, 10**6) * 200 + i, rng.choice([" ", "\n", " \t"]).join(parts)))
    rows += [(5, "same " * 50), (6, "same " * 50), (7, rows[0][1]), (8, ""), (9, None), (10, " ".join(["p", "q"] * 30)), (11, rows[3][1] + " tail"), (-4, rows[3][1]), (12, "same " * 19)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, d string")
    got = sorted(tuple(r) for r in remove_repeats(spark, df).collect())
    assert got == brute(rows, 20)


def test_shared_and_null_ids_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text), (1, text), (1, text + " more of it"), (None, "z " * 25), (2, text), (2, "z " * 25)], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0), r["n_words"], r["n_removed"]) for r in remove_repeats(spark, df).collect())
    assert got == [(0, 25, 24), (1, 30, 0), (1, 30, 0), (1, 33, 0), (2, 25, 25), (2, 30, 30)] or got == [(0, 25, 25), (1, 30, 0), (1, 30, 0), (1, 33, 0), (2, 25, 25), (2, 30, 30)]
    assert remove_repeats(spark, df.limit(0)).count() == 0


def test_the_automaton_alone_locates_occurrences():
    """From one place of each phrase, and stale places, all occurrences in all documents of a shard are found."""
    import numpy as np
    import pyarrow as pa

    from quillspark.llm.repeats import Words, locate

    rng = random.Random(8)
    passage = [f"p{i}" for i in range(30)]
    docs = [[*rng.choices([f"w{i}" for i in range(900)], k=20), *passage, *rng.choices([f"w{i}" for i in range(900)], k=rng.randint(0, 20)), *passage] for _ in range(4)]
    w = Words(pa.array([" ".join(d) for d in docs]))
    phrase = int(w.grams[25].view(np.int64))  # p5 to p10, in the first document
    wanted = [(np.array([phrase, 12345]), np.array([25, 3]))] + [(np.array([phrase]), np.array([999]))] * 3
    want = {int(w.first[d]) + k for d, x in enumerate(docs) for k in range(len(x)) if x[k : k + 6] == passage[5:11]}
    assert len(want) == 8 and set(np.flatnonzero(locate(w, wanted)).tolist()) == want
    assert not locate(w, [(np.zeros(0, np.int64), np.zeros(0, np.int32))] * 4).any()


def test_documents_that_share_an_id(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, a), (1, b), (1, "x " * 5 + b), (2, "y " + a + " " + b), (3, b + " z " + a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in remove_repeats(spark, df).collect())
    assert got == [(1, 40, 0), (1, 40, 0), (1, 45, 0), (2, 81, 80), (3, 81, 80)] or got == [(1, 40, 0), (1, 40, 0), (1, 45, 40), (2, 81, 80), (3, 81, 80)]


def test_query_against_its_sql(spark):
    import duckdb

    from quillspark.llm.repeats import OP2_SQL, op2_repeated_phrases

    con = duckdb.connect()
    top = "/root/testdata/sf0.001/documents.parquet"
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{top}{'/*.parquet' if os.path.isdir(top) else ''}'")
    want = sorted(con.sql(f"SELECT doc_id, n_words, n_removed, kept_sha256 FROM ({OP2_SQL})").fetchall())
    got = sorted(tuple(r) for r in op2_repeated_phrases(spark, "/root/testdata/sf0.001").select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == want
