import json
import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import values
from quillspark.operators import analysis, articles, dedup, merge, quality, rollup, schedule, scoring
from quillspark.plans.versions import Store
from quillspark.plans import sinks
from quillspark.sources import pages, tables


def greedy(rows, stored=()):
    urls, hashes, kept = {u for u, _ in stored}, {h for _, h in stored}, []
    for o, u, h in rows:
        if u not in urls and h not in hashes:
            urls.add(u)
            hashes.add(h)
            kept.append(o)
    return kept


def kept(spark, rows, stored=()):
    batch = spark.createDataFrame(rows, "ord long, url string, content_hash string")
    there = spark.createDataFrame(list(stored), "url string, content_hash string")
    return sorted(r["ord"] for r in dedup.new_articles(batch, there).collect())


def test_greedy_dedup(spark):
    assert kept(spark, [(1, "u1", "h1"), (2, "u1", "h2"), (3, "u2", "h2")]) == [1, 3]
    assert kept(spark, [(1, "u1", "h1"), (2, "u2", "h1"), (3, "u2", "h3")]) == [1, 3]
    rng = random.Random(5)
    rows = [(i, f"u{rng.randrange(30)}", f"h{rng.randrange(30)}") for i in range(60)]
    stored = [("u3", "h9"), ("u4", "h1")]
    # a row that the store has registers nothing
    rest = [r for r in rows if r[1] not in {"u3", "u4"} and r[2] not in {"h9", "h1"}]
    assert kept(spark, rows, stored) == greedy(rest)


def test_reposts(spark):
    rows = [
        (1, "http://x/odd/a.html", "【图】 Same"), (2, "http://x/yw_208727/abc.html", "Same"), (3, "http://x/yw_208727/ab.html", "Same"),
        (4, "http://x/fyr/1.html", "【only】"), (5, "http://x/fyr/2.html", ""), (6, "http://x/fyr/3.html", "Other"),
    ]
    df = spark.createDataFrame(rows, "ord long, url string, title_original string")
    assert sorted(r["ord"] for r in dedup.drop_reposts(df).collect()) == [3, 4, 5, 6]
    assert sorted(r["ord"] for r in dedup.repost_losers(df).collect()) == [1, 2]


@pytest.mark.parametrize(
    "new, backlog, capacity, want",
    [(10, 0, 55, (10, 0)), (100, 100, 55, (39, 16)), (5, 100, 55, (5, 50)), (100, 3, 55, (52, 3)), (10, 5, 0, (0, 0)), (0, 2, 55, (0, 2))],
)
def test_quotas(new, backlog, capacity, want):
    assert schedule.quotas(new, backlog, capacity) == want


def test_queue_order(spark):
    new = spark.createDataFrame([(9, 1), (8, 2)], "id long, ord long")
    waiting = spark.createDataFrame([(3,), (9,)], "id long")
    rest = spark.createDataFrame([(1, False), (2, True), (3, True), (8, True)], "id long, live boolean")
    q, counts = schedule.analysis_queue(new, waiting, rest)
    assert [r["id"] for r in q.orderBy("position").collect()] == [9, 8, 3, 2, 1]
    assert counts == {"deferred_new": 0, "backlog_remaining": 0, "pre_cap": 5}


def art(spark, rows):
    return spark.createDataFrame(rows, "id long, published_date string, is_significant boolean, relevance_score double, categories array<string>, source_slug string, source_name string, extraction_issue boolean, title_english string, title_original string")


def test_rollups(spark):
    rows = [
        (1, "2026-07-18", False, 0.9, ["exercises"], "a", "A", False, "One", ""), (2, "2026-07-18", True, 0.1, ["personnel"], "a", "A", False, "Two", ""),
        (3, "2026-07-18", False, 0.9, ["taiwan"], "b", "B", False, "Three", ""), (4, "2026-07-12", False, 0.7, ["taiwan"], "b", "B", False, "Four", ""),
        (5, "2026-07-11", False, None, ["taiwan"], "b", None, False, "Five", ""), (6, "", False, 0.2, [], "b", "B", False, "Six", ""), (7, None, True, 0.2, [], "b", "B", False, "Seven", ""),
        (8, "2026-99-01", True, 0.2, [], "b", "B", False, "Eight", ""),
    ]
    df = art(spark, rows)
    assert [(r["id"], r["brief_rank"]) for r in rollup.daily_brief(df).orderBy("brief_rank").collect()] == [(2, 1), (3, 2), (1, 3)]
    assert {r["days"]: (r["total"], r["flagged"]) for r in rollup.window_stats(df).collect()} == {7: (4, 1), 30: (5, 1)}
    series = {str(r["day"]): r["total"] for r in rollup.daily_series(df, 9).collect()}
    assert len(series) == 9 and series["2026-07-18"] == 3 and series["2026-07-13"] == 0
    r = rollup.readout(rollup.daily_brief(df)).first()
    assert (r["kind"], r["n_clean"], r["n_flagged"], r["lead_title"], r["lead_category"], r["sole_source"]) == ("flagged", 3, 1, "Two", "personnel", None)
    assert rollup.readout(rollup.daily_brief(df).filter("false")).first()["kind"] == "empty"
    assert {str(w["week_ending"]): w["n_articles"] for w in rollup.weekly_stats(df).collect()} == {"2026-07-18": 3, "2026-07-11": 2}
    trail = rollup.source_trail(df, cap=3).orderBy("trail_rank").collect()
    assert [t["id"] for t in trail] == [2, 7, 8] and trail[0]["truncated"]
    assert rollup.window_stats(df.filter("false")).count() == 2


def test_labels_and_index(spark):
    df = spark.createDataFrame([("2026-05-09",), ("2026-05-16",), ("2026-05-30",)], "date string")
    got = [(r["issue_number"], r["previous"], r["gap_days"], r["on_time"]) for r in rollup.edition_index(df.withColumn("date", F.col("date").cast("date"))).orderBy("date").collect()]
    assert [(g[0], g[2], g[3]) for g in got] == [(1, None, True), (2, 7, True), (3, 14, False)]
    lab = spark.createDataFrame([("significant", 3), ("routine", 4)], "t string, d int").select(rollup.edition_label(F.col("t"), F.col("d")).alias("l"))
    assert [r["l"] for r in lab.collect()] == ["Thin week · significant", "Routine"]


MERGE = "id long, url string, passed_relevance boolean, analyzed_at string"


def test_three_way_merge(spark):
    base = spark.createDataFrame([(1, "a", None, None)], MERGE)
    origin = spark.createDataFrame([(1, "a", None, None), (2, "b", True, "t"), (3, "c", None, None), (4, "d", False, None)], MERGE)
    local = spark.createDataFrame([(1, "a", True, "t1"), (2, "x", None, None), (3, "b", True, "t9"), (5, "c", False, None), (9, "y", True, "t")], MERGE)
    merged = merge.three_way_merge(base, origin, local)
    assert sorted(tuple(r) for r in merged.collect()) == [(1, "a", True, "t1"), (2, "b", True, "t"), (3, "c", False, None), (4, "d", False, None), (5, "x", None, None), (6, "y", True, "t")]
    assert {r["violations"] for r in merge.gates(base, origin, local, merged).collect()} == {0}
    broken = {r["gate"]: r["violations"] for r in merge.gates(base, origin, local, merged.filter("url <> 'x'").withColumn("id", F.col("id") + 1)).collect()}
    assert broken["lost_from_local"] == 1 and broken["id_drift"] == 1
    links = spark.createDataFrame([(2, 7)], "article_id long, category_id long")
    assert merge.remap(links, merge.id_map(merged, local).select("local_id", "id"), "article_id").first()["article_id"] == 5
    with pytest.raises(ValueError):
        merge.check_columns(origin)


def test_upserts(spark):
    stored = spark.createDataFrame([(1, "a", 0.5), (2, "b", None)], "id long, url string, relevance_score double")
    changed = merge.update(stored, spark.createDataFrame([(2, 0.9), (1, None)], "id long, relevance_score double"), "id", ["relevance_score"])
    assert sorted(tuple(r) for r in changed.collect()) == [(1, "a", None), (2, "b", 0.9)]
    sources = spark.createDataFrame([(1, "s")], "id long, slug string")
    batch = spark.createDataFrame([(1, "a", "s"), (2, "c", "s"), (3, "c", "s"), (4, "d", "unknown"), (5, "e", "s")], "ord long, url string, source_slug string")
    assert sorted((r["url"], r["id"]) for r in merge.insert_articles(stored, batch, sources).collect()) == [("c", 3), ("e", 4)]
    links = spark.createDataFrame([(1, 1)], "article_id long, category_id long")
    cats = tables.categories(spark)
    done = spark.createDataFrame([(1, ["taiwan", "nuclear", "bogus"])], "id long, categories array<string>")
    assert [tuple(r) for r in merge.link_categories(links, done, cats).collect()] == [(1, 5)]
    a, b = merge.delete_cascade(stored, links, stored.filter("id = 1").select("id"))
    assert a.count() == 1 and b.count() == 0


def test_edition_rules(spark):
    trail = "array<struct<title:string,url:string,source:string,date:string,is_significant:boolean>>"
    fields = ", ".join(f"{f} string" for f in ("title", "dek", "opening_note", "what_stood_out", "why_it_matters", "what_was_routine", "term_to_know_term", "term_to_know_explanation", "what_im_watching_next", "edition_type"))
    schema = f"date string, file_date string, week_start string, week_ending string, issue_number int, n_articles int, n_significant int, source_trail {trail}, {fields}"
    good = [("t", "u", "s", "2026-05-10", True)]
    rows = [
        ("2026-05-16", "2026-05-16", "2026-05-10", "2026-05-16", 1, 3, 1, good, *["x"] * 9, "routine"),
        ("2026-05-23", "2026-05-22", "2026-05-18", "2026-05-23", 1, 0, 2, [("", "u", "s", "", False)], *["x"] * 8, " ", "other"),
    ]
    found = quality.edition_rules(spark.createDataFrame(rows, schema))
    got = {(r["rule"], r["key"]) for r in found.collect()}
    second = {"edition_date", "week_span", "flag_count", "trail_size", "trail_entry", "trail_undated", "trail_flag", "edition_type", "issue_unique", "issue_order", "required_field"}
    assert got == {(r, "2026-05-23") for r in second}
    assert quality.blocks(found) and not quality.blocks(found.filter("level = 'warning'"))


def test_prose_and_files(spark):
    e = spark.createDataFrame([("d", "a — b", "Moreover, x", "It is not one but two. It is not red but blue.")], "date string, title string, dek string, signal string")
    assert sorted(r["message"] for r in quality.prose_warnings(e, "date", ("title", "dek", "signal")).collect()) == ["dek: transition moreover", "signal: 2 times not X but Y", "title: dash"]
    files = spark.createDataFrame([("p", "a\n{{ x }}"), ("q", "fine")], "path string, value string")
    assert [(r["key"], r["message"]) for r in quality.unrendered(files).collect()] == [("p", "line 2")]


def test_pages(spark):
    html = '<html><head><title>T</title><meta property="og:image" content="http://i/a.jpg"></head><body><h2>Head</h2><p>too short</p><p>This paragraph is long enough to be kept here.</p><p class=c>x</p><a href="/x/1.html">2026-05-07 <b>link</b></a><img src="http://i/logo.png"><img src="http://i/b.jpg">2026-05-06</body></html>'
    df = spark.createDataFrame([(1, "http://h/a/", html), (2, "http://h/b", None), (3, "http://h/c", "<p>unclosed <a href=q>y")], "page_id long, url string, html string")
    got = pages.parse(df).collect()
    assert [(r["title_original"], r["text_original"], r["published_date"]) for r in got] == [("Head", "This paragraph is long enough to be kept here.", "2026-05-07")]
    assert pages.parse(df, content="c").first()["text_original"] == "x"
    links = pages.anchors(df)
    assert [(r["href"], r["text"]) for r in links.filter("page_id = 1").collect()] == [("http://h/x/1.html", "2026-05-07 link")]
    assert pages.listing(links, r"http://h/[^/]+/\d+\.html$", "2026-05-07").count() == 1
    assert [r["src"] for r in pages.page_images(df).orderBy("rank").collect()] == ["http://i/a.jpg", "http://i/b.jpg"]
    assert pages.decode("é".encode("latin-1"), "text/html; charset=latin-1") == "é" and pages.decode(b"\xff") == "�"


def test_editions(spark, tmp_path):
    (tmp_path / "2026-05-09.json").write_text(json.dumps({"date": "2026-05-09", "term_to_know": {"term": "甲", "term_translation": "A", "explanation": "e"}, "source_trail": [{"label": "L", "url": "http://h.cn/x"}, {"url": "http://h.cn/y"}]}))
    (tmp_path / "2026-05-16.json").write_text(json.dumps({"date": "2026-05-16", "term_to_know_term": "B", "term_to_know_explanation": "f", "source_trail": []}))
    (tmp_path / "2026-05-23.json").write_text("{broken")
    good, bad = tables.editions(spark, str(tmp_path))
    assert good.count() == 2 and [r["file_name"] for r in bad.collect()] == ["2026-05-23.json"]
    assert sorted((r["term"], r["explanation"]) for r in tables.flat_terms(good).collect()) == [("B", "f"), ("甲 A", "e")]
    assert [(r["title"], r["source"]) for r in tables.trail_rows(good).orderBy("n").collect()] == [("L", "Unknown"), ("h.cn", "Unknown")]


def stub():
    class Stub:
        def score(self, title, body):
            if title == "boom":
                raise ValueError("no reply")
            return (1.7 if "good" in body else 0.2), "why"

        def translate(self, title, body):
            return ("EN " + title, "" if title == "empty" else "EN " + body)

        def summarise(self, title, body):
            return "sum"

        def tag(self, title, body):
            return ["taiwan", "bogus"], False, "ignored"

    return Stub()


def test_staged_analysis(spark):
    df = spark.createDataFrame([(1, "a", "good"), (2, "b", "bad"), (3, "boom", "good"), (4, "empty", "good")], "id long, title_original string, text_original string")
    got = {r["id"]: r for r in analysis.analyse(df, stub()).collect()}
    assert got[1]["analysed"] and got[1]["relevance_score"] == 1.0 and got[1]["categories"] == ["taiwan"] and got[1]["significance_reasoning"] is None
    assert got[2]["passed_relevance"] is False and not got[2]["analysed"]
    assert got[3]["relevance_score"] is None and got[3]["error"] == "no reply" and not got[3]["fatal"]
    assert got[4]["passed_relevance"] and not got[4]["analysed"]
    assert analysis.outcome(0, 0, 0, False) == "idle" and analysis.outcome(2, 0, 2, False) == "failed" and analysis.outcome(2, 1, 1, True) == "aborted"
    with pytest.raises(RuntimeError):
        analysis.preflight(10**7, "large")


def test_sinks(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"))
    rows = spark.createDataFrame([(1, "a")], "id long, v string")
    sinks.seed(store, "t", rows, "id")
    sinks.seed(store, "t", spark.createDataFrame([(1, "z"), (2, "b")], "id long, v string"), "id")
    assert sorted(tuple(r) for r in store.read("t").collect()) == [(1, "a"), (2, "b")] and store.latest() == 2
    e = spark.createDataFrame([("2026-05-16", "A & B", "d"), ("2026-05-09", "C", None)], "date string, title string, dek string")
    feed = sinks.feed_entries(e, "https://x/").orderBy("rank").collect()
    assert feed[0]["date"] == "2026-05-16" and "A &amp; B" in feed[0]["entry"]
    urls = sinks.sitemap_urls("https://x/", [""], e, rows).orderBy("tier", "n").collect()
    assert [u["loc"] for u in urls] == ["https://x/", "https://x/editions/2026-05-09.html", "https://x/editions/2026-05-16.html", "https://x/articles/1.html"]
    assert sinks.run_log(spark, "a", "b", {"articles_new": 2}, ["x"]).first()["errors"] == '["x"]'


def test_sources(spark):
    found, errors = articles.collect_sources({"a": lambda: articles.empty_source(spark), "b": lambda: 1 / 0}, ["a", "b", "c"])
    assert found.count() == 0 and len(errors) == 2


def test_greedy_rounds_follow_chains(spark):
    chain = [(i, f"u{i // 2}", f"h{(i + 1) // 2}") for i in range(9)]
    assert kept(spark, chain) == greedy(chain)
    copies = [(i, "u1", "h1") for i in range(20)] + [(30 + i, f"v{i}", "h1") for i in range(20)] + [(60 + i, "v3", f"g{i}") for i in range(5)]
    assert kept(spark, copies) == greedy(copies)


def test_overlap_does_not_depend_on_the_join(spark):
    rng = random.Random(3)
    some = lambda n: " ".join(rng.choices(["common", "alpha", "beta", "gamma", "delta", "omega"], k=n))
    texts = spark.createDataFrame([(i, some(5)) for i in range(30)] + [(99, None), (98, "")], "doc_id long, text string")
    items = spark.createDataFrame([(i, some(3)) for i in range(8)], "item_id long, text string")
    got = [sorted(map(tuple, scoring.overlap_scores(texts, items, 3, limit).select("doc_id", "item_id", "overlap", "rank").collect())) for limit in (1000, 0)]
    assert got[0] == got[1]
    want = []
    for d, t in texts.collect():
        shared = sorted((-len(set((t or "").split()) & set(x.split())), i) for i, x in items.collect())
        want += [(d, i, -n, r + 1) for r, (n, i) in enumerate([s for s in shared if s[0]][:3])]
    assert got[0] == sorted(want)


def test_published_side(spark):
    rows = lambda xs: spark.createDataFrame(xs, "id long, url string")
    ours, theirs = rows([(1, "a"), (2, None), (2, None)]), rows([(1, "a"), (3, "c")])
    assert merge.published_side(ours, theirs, rows([(2, None), (1, "a"), (2, None)]).repartition(3)) == "a"
    assert merge.published_side(ours, theirs, theirs.select("url", "id")) == "b"
    for other in ([(1, "a"), (2, None)], [(1, "a"), (2, ""), (2, None)], []):
        with pytest.raises(ValueError):
            merge.published_side(ours, theirs, rows(other))
    assert merge.published_side(rows([]), theirs, rows([])) == "a"


def test_paths_and_sizes(spark):
    df = spark.createDataFrame([("a/b/c.html", "../../x/y.png"), ("a/b/c.html", "./y.png"), ("c.html", "x//y.png"), ("c.html", "../y.png")], "path string, ref string")
    assert [r[0] for r in df.select(quality.resolved(F.col("path"), F.col("ref"))).collect()] == ["x/y.png", "a/b/y.png", "x/y.png", "y.png"]
    sizes = spark.createDataFrame([(3200, 1001), (1600, 900), (1601, 900)], "w int, h int").select(values.resized(F.col("w"), F.col("h"), 1600).alias("s")).select("s.*")
    assert [tuple(r) for r in sizes.collect()] == [(1600, 500), (1600, 900), (1600, 899)]


def test_asset_rules_on_empty_tables(spark):
    manifest = spark.createDataFrame([], "id string, file string, source_page string, treatment string, match struct<article_urls:array<string>,routes:array<string>>")
    none = spark.createDataFrame([], "path string")
    pages = spark.createDataFrame([("a.html", None), ("b.html", '<i data-editorial-id="e1">')], "path string, value string")
    assert [(r["rule"], r["key"]) for r in quality.asset_rules(manifest, none, none, pages).collect()] == [("asset_unknown", "b.html:e1")]
