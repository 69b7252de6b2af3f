import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.llm.urls import OP4_SQL, judge, op4_host_reputation, registered


def test_rules_and_reputation(spark):
    rows = [
        (1, "http://A.Example.ORG/en/17?x=/es/"), (2, "http://example.org/es/"), (3, "http://x.org/de"), (4, "http://x.org"), (5, "http://x.com/fr/1"), (6, "http://x.com/de/1"),
        (7, None), (8, "no scheme"), (9, "http://notexample.org/es/1"), (10, "ftp://u@h.net:8/a#b"), (10, "ftp://u@h.net:8/a#b"), (None, "http://x.com?/fr/"),
    ]
    rows += [(100 + i, f"http://bad.com/de/{i}") for i in range(40)] + [(200 + i, f"http://good.com/fr/{i}") for i in range(40)] + [(300, "http://bad.com/en/"), (301, "http://good.com/en/")]
    df = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string")
    got = {}
    for r in judge(spark, df).collect():
        got.setdefault(r["page_id"], []).append((r["host"], r["path"], r["rule"], r["verdict"]))
    assert got[1] == [("a.example.org", "/en/17", "example.org/en/1", "block")]
    assert got[2][0][2:] == ("example.org/es/", "block") and got[3] == [("x.org", "/de", "org/", "allow")]
    assert got[4][0][:3] == ("x.org", "", None) and got[5][0][3] == "allow" and got[6][0][3] == "block"
    assert got[7][0][:3] == ("", "", None) == got[8][0][:3] and got[9][0][2:] == ("org/", "allow")
    assert len(got[10]) == 2 and got[10][0][:2] == ("u@h.net:8", "/a") and got[None][0][:2] == ("x.com", "")
    assert got[300][0][2:] == (None, "block") and got[301][0][2:] == (None, "allow")
    assert judge(spark, df.limit(0)).count() == 0


def test_given_outcomes(spark):
    df = spark.createDataFrame([(i, f"http://{'a' if i % 2 else 'b'}.net/{i}") for i in range(80)], "page_id long, url string")
    known = spark.createDataFrame([(i, i % 2) for i in range(60)], "page_id long, good int")
    got = {r["page_id"]: r["verdict"] for r in judge(spark, df, rules=(), outcomes=known).collect()}
    assert got[61] == "allow" and got[62] == "block"


def test_registered_domains(spark):
    want = {
        "a.b.example.com": ("example.com", "com"), "example.com": ("example.com", "com"), "com": ("com", "com"), "": ("", ""), "u@h.net:8": ("h.net", "net"), "a@b@www.x.co.uk.": ("x.co.uk", "co.uk"),
        "co.uk": ("co.uk", "co.uk"), "10.0.12.7:80": ("10.0.12.7", "10.0.12.7"), "[::1]:80": ("[::1]", "[::1]"), "x.com.:443": ("x.com", "com"), "a..b": (".b", "b"),
    }
    df = spark.createDataFrame([(h,) for h in want], "host string")
    assert {r[0]: (r[1], r[2]) for r in df.select("host", *registered(F.col("host"))).collect()} == want


def test_users_and_ports_share_a_domain(spark):
    df = spark.createDataFrame([(i, f"http://{'u@' if i % 2 else ''}x{i}.bad.net:{i}/") for i in range(90)] + [(100 + i, f"http://good{i}.org/") for i in range(90)], "page_id long, url string")
    known = spark.createDataFrame([(i, int(i >= 100)) for i in [*range(80), *range(100, 180)]], "page_id long, good int")
    got = {r["page_id"]: r["verdict"] for r in judge(spark, df, rules=(), outcomes=known).collect()}
    assert {got[i] for i in range(80, 90)} == {"block"} and {got[i] for i in range(180, 190)} == {"allow"}


@pytest.mark.parametrize("rows", ["given", "odd"])
def test_query_against_its_sql(spark, tmp_path, rows):
    sf = "/root/testdata/sf0.001"
    if rows == "odd":
        sf = str(tmp_path)
        urls = [None, "", "x", "://", "http://", "http://u@a.x.com:1/de/1", "http://b.x.com/fr/", "http://10.0.0.1:8/", "http://ü.co.uk/de/", "http://A.EXAMPLE.ORG./en/1", "http://a.b\n/x", "http://b.x.com./fr/2"] * 5
        spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").write.parquet(f"{sf}/pages.parquet")
    elif not os.path.isdir(sf):
        pytest.skip("needs the driver's tables")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf}/pages.parquet{'/*.parquet' if rows == 'odd' else ''}')")
    got = op4_host_reputation(spark, sf).select("page_id", "host", "path", "rule", "verdict").collect()
    want = c.execute(f"SELECT page_id, host, path, rule, verdict FROM ({OP4_SQL})").fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
