import pytest
from pyspark.sql import functions as F

from quillspark.operators import editions as E


def test_recovered_body(spark):
    html = '<div class="mod-heading brand"> What Stood Out </div> <div class="section-text"><p>a &amp; <b>b</b></p><p>c</p></div> </div><div class="term-word">甲</div> <div class="term-explanation">x</div><div class="signal-text"> s </div>'
    df = spark.createDataFrame([("k", html), ("none", "<p>x</p>")], "key string, html string")
    got = {(r["key"], r["field"]): r["value"] for r in E.body_fields(df).collect()}
    assert got == {("k", "what_stood_out"): "a & b\n\nc", ("k", "term_to_know_term"): "甲", ("k", "term_to_know_explanation"): "x", ("k", "signal"): "s"}


def test_windows_of_flags(spark):
    rows = [(i, f"2026-07-{d:02d}", True, 0.5, False) for i, d in enumerate((10, 11, 18, 19))] + [(9, "2026-07-18", True, 0.9, True)]
    df = spark.createDataFrame(rows, "id long, published_date string, is_significant boolean, relevance_score double, extraction_issue boolean")
    assert [r["id"] for r in E.recent_flagged(df, "2026-07-18").collect()] == [2, 1]


def test_manifest(spark):
    df = spark.createDataFrame([("a", "", None, ["home", "pw-post"]), ("b", "dither", "cc0", ["article"]), ("c", None, None, [])], "id string, treatment string, license string, routes array<string>")
    v = E.visual_fields(df).select("id", "treatment", "source_id", "focal", E.required_kinds(F.col("routes"), F.col("treatment")).alias("k")).orderBy("id").collect()
    assert [(r["treatment"], r["source_id"], r["k"]) for r in v] == [("veil", "SOURCE", ["duo-paper", "duo-navy"]), ("dither", "cc0", ["dither-ink"]), ("veil", "SOURCE", [])]
    assert df.select(E.derivative_name(F.col("id"), F.lit("duo-navy")).alias("n")).first()["n"] == "a-duo-navy.jpg"
    with pytest.raises(Exception, match="unknown derivative"):
        df.select(E.derivative_name(F.col("id"), F.lit("odd"))).collect()


def test_media(spark):
    kind = "array<struct<type:string,src:string,source_url:string,image_url:string>>"
    df = spark.createDataFrame([([("image", "../media/a.jpg", "", ""), ("image", "x/B.jpg", "", ""), ("note", "y/a.jpg", "", "")], "media/A.jpg"), ([("image", "q.jpg", "", "")], None)], f"media {kind}, cover string")
    body, cover = E.split_media(F.col("media"), F.col("cover"))
    got = df.select(F.transform(body, lambda m: m["src"]).alias("b"), cover["src"].alias("c")).collect()
    assert [(r["b"], r["c"]) for r in got] == [(["x/B.jpg", "y/a.jpg"], "../media/a.jpg"), (["q.jpg"], None)]
    assert [r[0] for r in spark.createDataFrame([(" MAP",), (None,)], "x string").select(E.media_label(F.col("x"))).collect()] == ["Map", "Visual Context"]


def test_candidates(spark):
    df = spark.createDataFrame([("p", 1, 0, 500, 900), ("p", 1, 1, 900, 500), ("p", 0, 0, 799, 900)], "key string, url_rank int, rank int, width int, height int")
    assert [(r["url_rank"], r["rank"]) for r in E.first_acceptable(df, "key").collect()] == [(1, 1)]
    rows = [("a blast", ""), ("map of x", "the border"), ("map of x", "y"), ("a logo", "z"), ("missile", "missile news"), ("missile", "peace"), ("calm", "")]
    got = spark.createDataFrame(rows, "t string, a string").select(E.image_reason(F.col("t"), F.col("a")).alias("r"))
    assert [r["r"] for r in got.collect()] == ["sensational", None, "map", "emblem", None, "weapon", None]
    s = spark.createDataFrame([("b", 7.0), ("a", 7.0), ("c", 5.0)], "title string, score double")
    assert E.best_image(s).first()["title"] == "a" and E.best_image(s, 9.0).count() == 0
    nan = float("nan")
    rows = [("k", "b", 7.0, 1), ("k", "a", 7.0, 3), ("k", "a", 7.0, 2), ("k", "z", nan, 0), ("low", "a", 5.9, 4), ("nan", "a", nan, 5), ("null", "a", None, 6), (None, None, 6.0, 7), (None, "a", 6.0, 8)] + [("hot", f"t{i}", 6.0 + i % 97, i) for i in range(4000)]
    s = spark.createDataFrame(rows, "key string, title string, score double, id long").repartition(7)
    best = {r["key"]: (r["title"], r["score"], r["id"]) for r in E.best_image(s, 6.0, "key").collect()}
    assert best == {"k": ("a", 7.0, 2), None: (None, 6.0, 7), "hot": min((f"t{i}", 102.0, i) for i in range(96, 4000, 97))}
    assert E.best_image(s, 6.0, "key").columns == s.columns and E.best_image(s.limit(0), 6.0, "key").count() == 0
    assert E.best_image(s.filter("key = 'nan' OR key = 'k'")).first()["score"] == 7.0
    hits = spark.createDataFrame([(0, "q0", ["x"]), (1, "q1", ["t"])], "n int, query string, titles array<string>")
    assert E.first_query(hits, "t").first()["query"] == "q1" and E.first_query(hits, "none").first()["query"] == "q0"


def test_small_rules(spark):
    df = spark.createDataFrame([(403, ""), (429, "slow down"), (500, "Billing hold"), (None, None)], "s int, m string")
    assert [r[0] for r in df.select(E.fatal_error(F.col("s"), F.col("m"))).collect()] == [True, False, True, False]
    rows = spark.createDataFrame([(True, None, None), (True, "t", " "), (True, "t", "s"), (False, None, None)], "passed_relevance boolean, title_english string, summary_english string")
    assert [r[0] for r in rows.select(E.retry_reason()).collect()] == ["no translation", "no summary", None, None]
    one = spark.createDataFrame([("", "b")], "x string, y string")
    assert one.select(E.fallback(("x", F.col("x")), ("y", F.col("y")), default="d").alias("v")).first()["v"].asDict() == {"value": "b", "source": "y"}
    with pytest.raises(ValueError):
        E.joined_context(one, one)
    assert E.joined_context(one, one.toDF("p", "q")).count() == 1
    j = spark.createDataFrame([('{"a": "x", "b": [1, "y"], "c": {"d": "z"}}',)], "j string")
    assert j.select(E.nested_strings(F.col("j"))).first()[0] == ["x", "y", "z"]
    a, b = spark.createDataFrame([("f", 2), ("g", 1), ("h", 1)], "name string, modified int"), spark.createDataFrame([("f", 1), ("g", 1)], "name string, modified int")
    assert sorted(r["name"] for r in E.to_copy(a, b).collect()) == ["f", "h"]
    assert one.select(E.messages("T: {y} {x}.", x=F.col("x"), y=F.col("y"))).first()[0] == "T: b ."
    e = spark.createDataFrame([("2026-05-09", 1, "Weekly: A", " d ", 1, 0), ("", None, "B", None, 1, 0)], "date string, issue_number int, title string, dek string, n_articles int, n_significant int")
    assert E.ticks(e).count() == 1 and tuple(E.latest(e, ["Weekly:"]).first()) == ("2026-05-09", "A", "d")
    assert [r["cover_image"] for r in E.cover_paths(e, "https://x").collect()] == ["../covers/2026-05-09.png", ""]
