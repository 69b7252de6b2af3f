import random
import zlib

from quillspark.llm.sharding import histogram_sort, keyed, op8_histogram_sharding


def check(rows, got, shards, slack):
    want = sorted(((d if d is not None else -1), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["size"], r["text_crc32"]) for r in got) == want
    size = [0] * shards
    for s in range(shards):
        part = [r for r in got if r["shard"] == s]
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
        size[s] = sum(r["size"] for r in part)
    mean = sum(size) / shards
    assert max(abs(x - mean) for x in size) <= slack, size


def test_shards_are_even_and_copies_stand_together(spark):
    rng = random.Random(3)
    rows = [(i * 7, "x" * rng.randint(0, 400)) for i in range(1500)] + [(None, "n"), (3, None), (3, None)]
    df = spark.createDataFrame([(*r, "a") for r in rows], "doc_id long, text string, key string")
    got = histogram_sort(spark, df).collect()
    check(rows, got, 8, 3000)


def test_hot_group_is_cut_where_it_must_be(spark):
    rows = [(i, "same text") for i in range(900)] + [(1000 + i, f"other {i:05d}") for i in range(300)]
    got = histogram_sort(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(rows, got, 8, 30)
    where = sorted((r["doc_id"], r["shard"], r["slot"]) for r in got if r["doc_id"] < 1000)
    assert where == sorted(where, key=lambda x: (x[1], x[2]))


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert histogram_sort(spark, df).count() == 1 and histogram_sort(spark, df.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "a")] * 20, "doc_id long, text string")
    got = histogram_sort(spark, same).collect()
    assert len({(r["shard"], r["slot"]) for r in got}) == 20


def test_against_a_sort_of_all_rows(spark):
    """Shards and slots are those of one sort of all rows, cut where the bytes before come nearest to equal shares."""
    rng = random.Random(17)
    rows = [(rng.randrange(400), rng.choice(["", "a", "hot text " * 9, "x" * rng.randint(1, 600)])) for _ in range(1300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    every = sorted((r["key"], r["part"], r["size"], r["text_crc32"]) for r in keyed(df).collect())
    sizes = [r[2] for r in every]
    total, tolerance = sum(sizes), 0.005
    for piece in (10**6, 13):  # eight pieces a shard, and many more
        got = {}
        for r in histogram_sort(spark, df, tolerance=tolerance, piece=piece).collect():
            got.setdefault(r["shard"], []).append((r["slot"], r["doc_id"], r["size"], r["text_crc32"]))
        at = 0
        for s in range(8):
            part = sorted(got.get(s, []))
            assert [x[0] for x in part] == list(range(len(part)))
            assert [x[1:] for x in part] == [x[1:] for x in every[at : at + len(part)]]
            at += len(part)
            want = total * (s + 1) / 8
            # rows with one key and doc_id stay together
            edges = [sum(sizes[:i]) for i in range(len(every) + 1) if i in (0, len(every)) or every[i][:2] != every[i - 1][:2]]
            assert abs(sum(sizes[:at]) - want) <= max(tolerance * total / 8, min(abs(e - want) for e in edges)) + 1e-9
        assert at == len(every)


def test_query_columns(spark):
    rows = op8_histogram_sharding(spark, "/root/testdata/sf0.01").collect()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    check(docs, rows, 8, 0.01 * sum(r["size"] for r in rows) / 8 + max(r["size"] for r in rows))
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}
