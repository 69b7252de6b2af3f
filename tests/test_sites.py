import pytest

from quillspark.sources.sites import SITES, article, articles, listed, listings
from quillspark.sources.tree import Tree

DAY = "2026-05-07"


def test_tree_is_flat_and_tolerant():
    t = Tree("<div class='a b'><p>one<b> two</b><p>three <br>four</div><ul><li>x<li>y</ul></i><p>&amp;<script>no</script></p><!-- c -->")
    assert [t.tag[i] for i in range(len(t.tag))] == ["#document", "div", "p", "b", "p", "br", "ul", "li", "li", "p", "script"]
    assert [t.words(i) for i in t.find("p")] == ["onetwo", "threefour", "&"]
    assert [t.words(i) for i in t.find("li")] == ["x", "y"] and t.words(6, "\n") == "x\ny"
    assert list(t.above(3, 9)) == [2, 1, 0] and t.end[1] == 6 and t.end[0] == len(t.tag)
    assert t.first("div", "b", True) == 1 and t.first("div", "a b", True) == 1 and t.first("div", "a", False) == 1 and t.first("div", "c") == -1
    assert Tree(None).end == [1] and Tree("").words(0) == ""
    deep = Tree("<div>" * 5000 + "x")
    assert deep.words(4000) == "x" and deep.end[1] == 5001


LONG = "This paragraph has well over forty characters in it, surely."


@pytest.mark.parametrize("slug, html, want", [
    ("pla_daily", f"<h2> T </h2><h1>no</h1><ul class='row m-t-list'><p class='ueditor-text-p_display'>a</p><p>skip</p></ul><p>{LONG}</p><div class='container artichle-info'><p>发布：2026-05-06</p></div>", ("T", "a", "2026-05-06")),
    ("pla_daily", f"<h2> </h2><h1>H</h1><ul class='m-t-list'><li>{LONG}</li><li>b</li></ul><p>发布: 2026-05-05 2026-05-04</p>", ("H", f"{LONG}\nb", "2026-05-05")),
    ("pla_daily", f"<h1>H</h1><ul class='m-t-list'>short</ul><p>{LONG}</p><p>版权 {LONG}</p><p>short</p>2026-01-01", ("H", LONG, DAY)),
    ("mod_china", "<h1>T</h1><p class='ueditor-text-tushuo ueditor'>a long enough caption</p><p class='ueditor x'>a long enough text</p><p class='ueditor'>short</p>2026-05-01", ("T", "a long enough text", "2026-05-01")),
    ("mod_china", f"<h2>T</h2><p class='ueditor'>short</p><p>{LONG}</p>", ("T", "", DAY)),
    ("mod_china", f"<h1></h1><h2>T</h2><p>{LONG}</p><p>责任编辑 {LONG}</p>", ("T", LONG, DAY)),
    ("china_mil_online", f"<h1>China Military</h1><div class='article-header'><h1>T</h1></div><p class='ueditor'>more than ten</p><p>{LONG}</p><i>2026-01-01</i><div class='pub-info'><dl><dt>Time<dd>x<dd>2026-05-08 10:34:11</dl></div>", ("T", "more than ten", "2026-05-08")),
    ("china_mil_online", f"<h1>T</h1><p>{LONG}</p><p>thirty-one characters in all, no</p><a title='2026-02-02'>x</a>", ("T", LONG, "2026-02-02")),
    ("china_mil_online", "<h1>China Military</h1><p>x</p>", None),
    ("global_times_mil", f"<div class='article_title'>T</div><h1>H</h1><div class='article_content'><p class='picture'>{LONG} p</p><p class='picture x'>{LONG} q</p><p>{LONG}</p></div><div class='article_content'><p>{LONG} z</p></div><div class='source_time'>By A | 2026/5/7 18:37:07</div>", ("T", f"{LONG} q\n{LONG}", "2026-05-07")),
    ("global_times_mil", f"<h1>H</h1><div class='article_content'><p>short</p></div><p class='c'>{LONG} c</p><p>{LONG}</p>", ("H", LONG, DAY)),
    ("global_times_mil", "<p>no title</p>", None),
])
def test_pages_of_each_site(slug, html, want):
    assert article(SITES[slug], html, DAY) == want
    assert article(SITES[slug], None, DAY) is None and article(SITES[slug], "", DAY) is None


@pytest.mark.parametrize("slug, base, html, want", [
    ("pla_daily", "http://www.81.cn/yw/index.html", "<a href='1.html'>A 2026-05-07</a><a href='/yw/1.html'>2026-05-07</a><a href='2.html'>2026-05-06</a><a href='http://other.cn/yw/3.html'>2026-05-07</a><a href='x/y/4.html'>2026-05-07</a>", ["http://www.81.cn/yw/1.html"]),
    ("mod_china", "http://www.mod.gov.cn/gfbw/qwfb/index.html", "<a href='1.html'>x<b>2026-05-</b>07</a><a href='a/b/2.html'>2026-05-07</a><a href='/x/3.html'>2026-05-07</a>", ["http://www.mod.gov.cn/gfbw/qwfb/1.html", "http://www.mod.gov.cn/gfbw/qwfb/a/b/2.html"]),
    ("china_mil_online", "http://eng.chinamil.com.cn/a/index.html", "<a href='1.html'><div class='title'><h3>t</h3><small class='time'>2026-05-07 09:00</small></div></a><a href='2.html'><b><div class='title'><small class='time'>2026-05-07</small></div></b></a><a href='3.html'><div class='title'><small class='time'>on 2026-05-07</small></div></a><a href='4.html'><div class='title'>2026-05-07</div></a>", ["http://eng.chinamil.com.cn/a/1.html"]),
    ("global_times_mil", "https://www.globaltimes.cn/china/military/", "<ul><li><a href='/page/202605/1.shtml'>a</a><div class='source_time'>By X | 2026/5/7 1:00</div></li><li><a href='/page/202605/2.shtml'>b</a><div class='source_time'>2026/5/6</div></li></ul><div><a href='/page/202604/3.shtml'>c</a></div>", ["https://www.globaltimes.cn/page/202605/1.shtml"]),
    ("global_times_mil", "https://www.globaltimes.cn/china/military/", "<div><div><div><div><div><a href='/page/202605/5.shtml'>far from any date</a></div></div></div></div><div class='source_time'>2026/5/6</div></div>", ["https://www.globaltimes.cn/page/202605/5.shtml"]),
])
def test_listings_of_each_site(slug, base, html, want):
    assert listed(SITES[slug], base, html, DAY) == want
    assert listed(SITES[slug], base, None, DAY) == []


def test_tables(spark):
    rows = [("u", "<h1>T</h1>", "mod_china", DAY, 1), ("u", "<h1>T</h1>", "mod_china", DAY, 1), ("v", None, "mod_china", DAY, 2), ("w", "<h1>T</h1>", "unknown", DAY, 3), (None, "<h1>T</h1>", "pla_daily", DAY, 4)]
    df = spark.createDataFrame(rows, "url string, html string, source_slug string, day string, title_original int")
    assert sorted(tuple(r) for r in articles(df.filter("url IS NOT NULL")).collect()) == [("u", "mod_china", "T", "", DAY)] * 2
    assert articles(df).count() == 3 and articles(df.limit(0)).count() == 0
    pages = spark.createDataFrame([("http://www.81.cn/yw/index.html", f"<a href='1.html'>{DAY}</a>", "pla_daily", DAY)] * 2, "url string, html string, source_slug string, day string")
    assert [tuple(r) for r in listings(pages).collect()] == [("pla_daily", "http://www.81.cn/yw/1.html")]


def test_a_named_reference_needs_its_semicolon():
    """Titles that end inside a reference keep what is left of it."""
    from quillspark.sources.pages import _Walk

    html = '<h1>R&amp;D &amp;&amp &ampx; &foo; &lt;b&gt &#38; A & B&am</h1><p>Text of the page with &copy 2024 &apos;and&apos; more than forty characters.</p><a href="/x?a=1&copy=2&amp;b=3">l&amp</a>'
    title = "R&D &&amp &ampx; &foo; <b&gt & A & B&am"
    found = article(SITES["global_times_mil"], html, "2024-02-01")
    assert found == (title, "Text of the page with &copy 2024 'and' more than forty characters.", "2024-02-01")
    assert Tree(html).anchors()[0][:2] == ("/x?a=1&copy=2&b=3", "l&amp")
    walk = _Walk.of(html)
    assert walk.anchors == [("/x?a=1&copy=2&b=3", "l&amp")] and ("h1", "", title) in walk.blocks
