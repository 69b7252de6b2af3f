import hashlib

import pytest
from pyspark.sql import functions as F

from quillspark.functions import dates as D
from quillspark.functions import text as T
from quillspark.functions import values as V
from quillspark.operators import quality, scoring
from quillspark.operators.articles import keyword_pass


def values(spark, rows, **columns):
    df = spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], ["x"] if not isinstance(rows[0], tuple) else [f"x{i}" for i in range(len(rows[0]))])
    return [tuple(r) for r in df.select(*(c.alias(n) for n, c in columns.items())).collect()]


def test_white_space_and_hashes(spark):
    rows = ["a　 b", " x\ty\n", "a\x1cb", "  ", "plain"]
    want = ["a b", "x y", "a b", "", "plain"]
    assert [r[0] for r in values(spark, rows, v=T.collapse(F.col("x")))] == want
    got = values(spark, [(" T　t ", "body  x")], h=T.content_hash(F.col("x0"), F.col("x1")))[0][0]
    assert got == hashlib.sha256(b"T t\nbody x").hexdigest()


def test_titles(spark):
    rows = ["【A】【B】 Title", "[x] [y]Title", "【only】", "No tag [kept]", "　【t】 Title　"]
    assert [r[0] for r in values(spark, rows, v=T.normal_title(F.col("x")))] == ["Title", "Title", "", "No tag [kept]", "Title"]
    assert [r[0] for r in values(spark, ["【a】", "Title"], v=T.title_hash(F.col("x")))] == ["", hashlib.sha1(b"Title").hexdigest()]


def test_urls(spark):
    rows = ["http://h.cn/yw_208727/1.html", "https://h.cn/fyr/2.html", "http://H.cn/odd/x/", "http://h.cn/1.html", "http://h.cn:80/a?b#c", "nothing"]
    got = values(spark, rows, s=T.url_section(F.col("x")), h=T.url_host(F.col("x")), p=T.section_priority(F.col("x")), c=T.canonical_url(F.col("x")))
    assert [g[2] for g in got] == [100, 50, 70, 50, 50, 50]
    assert got[2][0] == "odd" and got[4][1] == "h.cn:80" and got[2][3] == "http://h.cn/odd/x" and got[4][3] == "http://h.cn:80/a"


def test_excerpts(spark):
    long = "word " * 80
    got = values(spark, [long, "short", "a" * 400], e=T.excerpt(F.col("x")), c=T.capped(F.col("x"), 10))
    assert got[0][0].endswith("word...") and len(got[0][0]) <= 303 and got[1][0] == "short" and got[2][0] == "a" * 300 + "..."
    assert got[1][1] == "short" and got[2][1] == "aaaaaaa…"
    t = values(spark, [("", "orig"), (" En ", "o"), ("", "")], v=T.short_title(F.col("x0"), F.col("x1")))
    assert [r[0] for r in t] == ["orig", "En", "Untitled"]


def test_words(spark):
    got = values(spark, ["The PLA's war-games, and a drill!", ""], t=T.tokens(F.col("x")), n=T.word_count(F.col("x")))
    assert got[0] == (["pla's", "war-games", "drill"], 6) and got[1] == ([], 0)
    assert values(spark, ["One. Two! Three?", ""], s=F.size(T.sentences(F.col("x")))) == [(3,), (0,)]
    assert values(spark, ["<p>a &amp; b</p>x<p> c\n d</p>"], p=T.paragraphs(F.col("x"))) == [("a & b\n\nc d",)]
    assert values(spark, ["a<b> & <strong>c</strong>"], e=T.escape_html_keeping_emphasis(F.col("x"))) == [("a&lt;b&gt; &amp; <strong>c</strong>",)]
    assert values(spark, ["军事论 x", "abc"], c=T.leading_cjk(F.col("x"))) == [("军事",), ("",)]
    assert values(spark, ["Weekly: Title", "Title"], c=T.strip_first_prefix(F.col("x"), ["Weekly:", "Daily:"])) == [("Title",), ("Title",)]
    assert values(spark, ["a\nb {{x", "none"], c=T.first_line_with(F.col("x"), r"\{\{")) == [(2,), (None,)]


def test_keywords_match_inside_words(spark):
    rows = [("A new place", ""), ("newspaper", ""), ("the end", "军演开始"), ("nothing", "here")]
    assert [r[0] for r in values(spark, rows, v=keyword_pass(F.col("x0"), F.col("x1")))] == [True, True, True, False]


def test_dates(spark):
    rows = ["2026-05-07 10:00", "2026-13-45", "2026-5-7", "", " 2026-01-01x"]
    got = values(spark, rows, l=D.leading_iso(F.col("x")), s=F.date_format(D.strict(F.col("x")), "yyyy-MM-dd"))
    assert [g[0] for g in got] == ["2026-05-07", "2026-13-45", "", "", "2026-01-01"]
    assert [g[1] for g in got] == [None, None, "2026-05-07", None, None]
    assert [r[0] for r in values(spark, ["2026-05-07", "bad", ""], v=D.long_form(F.col("x")))] == ["7 May 2026", "bad", ""]
    week = [r[0] for r in values(spark, [f"2026-07-{d:02d}" for d in range(12, 20)], v=F.date_format(D.week_ending(F.col("x").cast("date")), "yyyy-MM-dd"))]
    assert week == ["2026-07-11"] + ["2026-07-18"] * 6 + ["2026-07-18"]
    assert values(spark, ["at 2026/5/7", "x"], v=D.slash_date(F.col("x"))) == [("2026-05-07",), ("",)]
    c = values(spark, [("2026-05-01", "2026-05-07"), ("2026-04-28", "2026-05-04"), ("2025-12-28", "2026-01-03"), ("2026-05-01", "2026-05-01")], v=D.coverage(F.col("x0"), F.col("x1")))
    assert [r[0] for r in c] == ["1–7 May 2026", "28 April – 4 May 2026", "28 December 2025 – 3 January 2026", "1 May 2026"]


def test_numbers_and_json(spark):
    assert values(spark, [16.5, 17.5], v=V.half_even(F.col("x"))) == [(16.0,), (18.0,)]
    assert values(spark, [-1.0, 0.5, 3.0], v=V.clamp01(F.col("x"))) == [(0.0,), (0.5,), (1.0,)]
    rows = ['```json\n{"score": 0.5, "why": "a\nb"}\n```', 'Sure: {"score": 1} ok', "no", '{"why": "x"}']
    got = values(spark, rows, v=V.reply_json(F.col("x"), "score double, why string")["score"])
    assert [g[0] for g in got] == [0.5, 1.0, None, None]
    with pytest.raises(KeyError):
        V.cost(F.lit(1), "unheard-of")


def test_categories(spark):
    df = spark.createDataFrame([(["nuclear", "taiwan"],), (["other"],), ([],)], "c array<string>")
    assert [tuple(r) for r in df.select(V.category_priority(F.col("c")), V.lead_category(F.col("c"))).collect()] == [(1, "taiwan"), (99, "other"), (99, "")]


def test_lint(spark):
    same = "One two three four five six seven eight"
    rows = [("t", "This article says so. It signals more."), ("t", "Unprecedented. A. B. C."), (same, same + " nine."), ("t", "Clean text."), ("t", "  "), ("t", "w " * 101)]
    got = [r[0] for r in values(spark, rows, v=quality.lint_summary(F.col("x0"), F.col("x1")))]
    assert got[0] == ["banned opener: this article", "crutch construction: it signals"]
    assert got[1] == ["banned phrase: unprecedented", "4 sentences (max 3)"]
    assert got[2] == ["summary opens by restating the headline"] and got[3] == [] and got[4] == ["empty summary"] and got[5] == ["101 words"]


def test_images(spark):
    rows = [("CC BY 4.0", ""), ("CC BY-NC 4.0", ""), ("Public domain", ""), ("", ""), ("fair use, public domain", "")]
    assert [r[0] for r in values(spark, rows, v=V.license_allowed(F.col("x0"), F.col("x1")))] == [True, False, True, False, False]
    s = values(spark, [("CC0", 1600, 900)], v=scoring.image_score(F.col("x0"), F.col("x1"), F.col("x2"), F.lit(7), F.lit(True), F.lit(False)))
    assert s == [(15.5,)]


def test_held_scores_keep_nulls(spark):
    from quillspark.functions import values as V

    df = spark.createDataFrame([(1, -0.5), (2, 0.25), (3, 7.0), (4, None)], "id int, x double")
    assert [r["y"] for r in df.select("id", V.clamp01(F.col("x")).alias("y")).orderBy("id").collect()] == [0.0, 0.25, 1.0, None]


def test_a_lint_works_its_summary_out_once(spark):
    """White space is collapsed once for all the phrases that are looked for."""
    df = spark.createDataFrame([("A title", "It  is\tnotable. Yes.")], "t string, s string").repartition(1)
    plan = df.select(F.explode(quality.lint_summary(F.col("t"), F.col("s"))))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("x1c-") == 1
