import base64
import gzip
import hashlib
import os
import random

import duckdb
import pytest

from quillspark.llm import warc

SF = "/root/testdata/sf0.001"


def expected(rows, min_bytes=0):
    """page_id, bytes, digest, type and refers_to of each row, by a plain scan."""
    out, first = [], {}
    for page_id, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        payload = (html or "").encode()
        known = len(payload) >= min_bytes and payload in first
        out.append((page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if known else "response", first[payload] if known else None))
        first.setdefault(payload, page_id)
    return sorted(out, key=repr)


def read(spark, out):
    return sorted((tuple(r[:5]) for r in warc.read_archives(spark, out).collect()), key=repr)


def files(out):
    return {f: open(f"{out}/{f}", "rb").read() for f in sorted(os.listdir(out)) if f.endswith(".gz")}


ROWS = [(i, f"https://h{i % 5}.org/{i}", rng_text) for i, rng_text in enumerate(["<p>a</p>", None, "", "<p>a</p>", "ü" * 3000, "b\r\n\r\nc"] * 40)]
ROWS += [(7, "u", "<p>a</p>"), (7, "u", "<p>a</p>"), (None, None, "only null"), (None, "v", "only null"), (None, "", "<p>a</p>"), (-5, "x y\nz", "<p>a</p>"), (900, "w", "x" * 300_000)]


@pytest.mark.parametrize("shard_bytes, roll_bytes", [(1 << 24, 1 << 30), (9_000, 400), (300, 1)])
def test_written_and_read_back(spark, tmp_path, shard_bytes, roll_bytes):
    df = spark.createDataFrame([(*r, "x", 0) for r in ROWS], "page_id long, url string, html string, place string, shard int")
    out = f"{tmp_path}/a"
    warc.write_archives(spark, df, out, shard_bytes=shard_bytes, roll_bytes=roll_bytes)
    assert read(spark, out) == expected(ROWS)
    assert not [f for f in os.listdir(out) if f.startswith("_") and f != "_manifest"]
    # the same rows in other partitions give the same files
    again = f"{tmp_path}/b"
    warc.write_archives(spark, df.repartition(7, "html"), again, shard_bytes=shard_bytes, roll_bytes=roll_bytes)
    assert files(f"{tmp_path}/a") == files(again) and len(files(again)) >= (1 if shard_bytes > 1e6 else 8)
    with pytest.raises(FileExistsError):
        warc.write_archives(spark, df, out)


def test_files_are_sorted_and_whole(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    warc.write_archives(spark, df, f"{tmp_path}/a", shard_bytes=20_000, roll_bytes=3_000)
    ids = []
    for name, data in files(f"{tmp_path}/a").items():
        plain = gzip.decompress(data)  # standard readers take the members as one stream
        assert plain.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and f"WARC-Filename: {name}\r\n".encode() in plain
        ids += [int(x.split(b"\r\n")[0]) for x in plain.split(b"\r\nWARC-Page-Id: ")[1:]]
    assert ids == sorted(ids)
    back = {(r["page_id"], r["record_type"]): r for r in warc.read_archives(spark, f"{tmp_path}/a", payloads=True).collect()}
    assert bytes(back[(4, "response")]["payload"]) == ("ü" * 3000).encode() and bytes(back[(5, "response")]["payload"]) == b"b\r\n\r\nc"
    assert back[(9, "revisit")]["payload"] is None and back[(-5, "response")]["url"] == "x%20y%0Az"
    offset, file = back[(900, "response")]["offset"], back[(900, "response")]["file"]
    assert b"WARC-Page-Id: 900\r\n" in gzip.decompress(files(f"{tmp_path}/a")[file][offset:])


def test_least_size_of_revisits_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    warc.write_archives(spark, df, f"{tmp_path}/a", min_bytes=9)
    assert read(spark, f"{tmp_path}/a") == expected(ROWS, 9)
    warc.write_archives(spark, df.limit(0), f"{tmp_path}/b")
    assert warc.read_archives(spark, f"{tmp_path}/b").count() == 0


def test_damage_and_strangers(spark, tmp_path):
    """Files of lost attempts are not read; a changed file is an error."""
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    out = f"{tmp_path}/a"
    warc.write_archives(spark, df, out, shard_bytes=20_000)
    open(f"{out}/warc-99999-00000.warc.gz", "wb").write(b"left over")
    assert read(spark, out) == expected(ROWS)
    name = next(iter(files(out)))
    data = gzip.decompress(files(out)[name])
    open(f"{out}/{name}", "wb").write(gzip.compress(data.replace(b"<p>a</p>", b"<p>b</p>", 1)))
    with pytest.raises(Exception, match="digest|not as it was written|whole record"):
        read(spark, out)


def test_borders_deal_the_bytes_out():
    found = sorted(f"i{x:032x}" for x in random.Random(3).sample(range(10**6), 200))
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    from pyspark.sql import functions as F

    places = [f"i{x:032x}" for x in range(0, 10**6, 1777)] + found + ["n" + "0" * 32]
    for n in (0, 1, 63, 64, 65, 128, 200):
        got = spark.createDataFrame([(p,) for p in places], "place string").select("place", warc.shard_of(F.col("place"), found[:n]).alias("s")).collect()
        assert all(r["s"] == sum(b <= r["place"] for b in found[:n]) for r in got)


def test_query_gives_what_the_sql_gives(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = sorted(c.execute(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({warc.OP11_SQL})").fetchall(), key=repr)
    assert sorted((tuple(r) for r in warc.op11_warc_archives(spark, SF).collect()), key=repr) == want
