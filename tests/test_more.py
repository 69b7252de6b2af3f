import json

from pyspark.sql import functions as F

from quillspark import constants as C
from quillspark.operators import articles, editions, quality
from quillspark.sources import tables


def test_manifest_keeps_entries_whose_file_is_there(spark, tmp_path):
    """SRC-17: entries in their order; those without a file, or whose file is missing, go."""
    entries = [{"id": "a", "file": "x.jpg", "match": {"routes": ["cover"], "article_urls": ["u"]}}, {"id": "b"}, {"id": "c", "file": "gone.jpg"}, {"id": "d", "file": "y.jpg", "match": {"routes": ["cover"], "article_urls": ["u", "v"]}}]
    (tmp_path / "m.json").write_text(json.dumps(entries))
    there = spark.createDataFrame([("x.jpg",), ("y.jpg",), ("z.jpg",)], "path string")
    found = tables.manifest(spark, str(tmp_path / "m.json"), there)
    assert [r["id"] for r in found.orderBy("n").collect()] == ["a", "d"]
    urls = spark.createDataFrame([("u",), ("v",), ("w",), (None,)], "url string")
    assert sorted(tuple(r) for r in tables.match_manifest(found, urls, "cover").collect()) == [("u", "a"), ("v", "d")]
    assert tables.match_manifest(found, urls, "other").count() == 0


def test_constant_relations(spark):
    """SRC-23: the categories are those of the labels, with dense ids."""
    rows = tables.categories(spark).orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(1, len(C.CATEGORY_LABELS) + 1))
    assert {r["slug"]: r["display_name"] for r in rows} == dict(C.CATEGORY_LABELS)


def test_sidecars_are_written_and_read_back(spark, tmp_path):
    """SNK-12: an edition a date; written again they are replaced."""
    e = spark.createDataFrame([("2026-05-09", "A", None), ("2026-05-16", "B", 3)], "date string, title string, n_articles int")
    for df in (e, e.withColumn("title", F.concat("title", F.lit("!")))):
        editions.write_editions(df, str(tmp_path / "e"))
    back = spark.read.schema("title string, n_articles int, date string").json(str(tmp_path / "e"))
    assert sorted(tuple(r) for r in back.select("date", "title", "n_articles").collect()) == [("2026-05-09", "A!", None), ("2026-05-16", "B!", 3)]


def test_sets_of_ids(spark):
    """SET-3, SET-6: union without repeats, and whether one array lies in another."""
    df = spark.createDataFrame([([1, 2, 2], [2, 3]), ([], [1]), ([1], []), (None, [1])], "a array<int>, b array<int>")
    got = [tuple(r) for r in df.select(F.array_union("a", "b"), F.size(F.array_except("a", "b")) == 0).collect()]
    assert got == [([1, 2, 3], False), ([1], True), ([1], False), (None, None)]


def test_missing_index_is_found(spark):
    """DQ-1: no index, a blank one, and a good one."""
    e = spark.createDataFrame([], "date string, " + ", ".join(f"{c} string" for c in C.PROSE_FIELDS))
    for files, want in (([], True), ([("index.html", "  ")], True), ([("index.html", "<p>")], False)):
        found = quality.site_rules(spark.createDataFrame([*files, ("articles.json", "[]")], "path string, value string"), e)
        assert ("index" in {r["rule"] for r in found.collect()}) == want, files


def test_links_of_pages(spark):
    """DQ-3: every edition without a link on a page is found; names that overlap, null pages and dates, very long pages."""
    days = ["2026-05-02", "2026-05-09", "2026-05-16", "a/b.c"]
    e = spark.createDataFrame([(d, *["p"] * len(C.PROSE_FIELDS)) for d in [*days, None]], "date string, " + ", ".join(f"{c} string" for c in C.PROSE_FIELDS))
    pages = {
        "index.html": '<a href="editions/2026-05-02.html">editions/editions/2026-05-09.html editions/2026-05-16.htm</a>',
        "archive.html": "editions/" * 20_000 + "2026-05-16.html " + "x" * 100_000 + "editions/a/b.c.html\neditions/\n2026-05-02.html",
        "terms.html": None,
    }
    files = spark.createDataFrame([*pages.items(), ("articles.json", "[]")], "path string, value string")
    got = {r["key"] for r in quality.site_rules(files, e).filter("rule = 'unlinked' AND key IS NOT NULL").collect()}
    assert got == {f"{p}:{d}" for p in ("index.html", "archive.html", "terms.html", "feed.xml") for d in days if f"editions/{d}.html" not in (pages.get(p) or "")}
    assert got >= {"index.html:2026-05-16", "archive.html:2026-05-02", "terms.html:a/b.c"} and "archive.html:a/b.c" not in got


def test_stuck_rows_in_order(spark):
    """SRT-10: longest text first, ties by id, whatever order the rows come in."""
    rows = [(i, True, None if i % 2 else "", "x" * (i % 3 * 10), i) for i in range(9)] + [(20, True, "done", "x" * 99, 0), (21, False, None, "x" * 99, 0), (22, None, None, "x" * 99, 0)]
    df = spark.createDataFrame(rows, "id long, passed_relevance boolean, title_english string, text_original string, n int").repartition(4)
    want = sorted(range(9), key=lambda i: (-(i % 3), i))
    assert [r["id"] for r in articles.stuck(df).collect()] == want and [r["id"] for r in articles.stuck(df, 4).collect()] == want[:4]
    assert articles.stuck(df, 0).count() == 0
