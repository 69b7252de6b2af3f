"""All queries over the driver's tables, with the DuckDB SQL that gives the same rows.

The tables stand in for a monitored collection: documents are articles, labels the gate
(quality; none: never scored) and the flag (toxic), pages the fetched HTML, events dated
activity. What documents lack is derived from doc_id by the rules of `articles` and ART.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import dates as D
from ..functions import text as T
from ..functions import values as V
from ..functions import variants
from ..operators import articles as A
from ..operators import dedup, editions, merge, quality, rollup, schedule, scoring
from ..session import shared_dir
from ..sources import pages as P
from ..sources import anchors, sites
from ..sources import tables as S
from ..streaming import nearcopies, rolling
from . import sinks
from .versions import Store

CATS = tuple(C.CATEGORY_LABELS)
SECTIONS = ("yw_208727", "bz_208549", "jw_208551", "fyr", "other")

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _iso(df: DataFrame) -> DataFrame:
    """Dates as ISO strings."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c, kind in df.dtypes if kind == "date"})


def _pick(values, index):
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def articles(spark: SparkSession, sf: str, text: bool = True) -> DataFrame:
    """Documents as articles."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    i = F.col("id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (i % 30).cast("int"))
    out = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("source_slug"), "lang", F.col("text").alias("text_original")).join(labels.withColumnRenamed("doc_id", "id"), "id", "left")
    out = out.select(
        "id", "source_slug", "lang", "text_original", F.split_part("text_original", F.lit("\n"), F.lit(1)).alias("title_original"),
        F.concat(F.lit("https://news.example.cn/"), _pick(SECTIONS, i % 5), F.lit("/"), i.cast("string"), F.lit(".html")).alias("url"),
        F.date_format(day, "yyyy-MM-dd").alias("published_date"), (F.col("quality") == 1).alias("passed_relevance"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("is_significant"), (i % 101 / 100.0).cast("double").alias("relevance_score"),
        F.when((F.col("quality") == 1) & (i % 3 != 0), F.date_format(day, "yyyy-MM-dd")).alias("analyzed_at"),
        F.array_distinct(F.array(_pick(CATS, i % 14), _pick(CATS, F.floor(i / 7) % 14))).alias("categories"), i.alias("ord"),
    )
    summary = F.col("text_original")
    out = out.withColumns({"title_english": F.col("title_original"), "summary_english": summary, "extraction_issue": A.extraction_issue(summary), "source_name": F.upper("source_slug")})
    return out if text else out.drop("text_original")


_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
ART = f"""
SELECT d.doc_id AS id, source AS source_slug, upper(source) AS source_name, lang, text AS text_original, split_part(text, chr(10), 1) AS title_original, split_part(text, chr(10), 1) AS title_english,
  'https://news.example.cn/' || {_LIST(SECTIONS)}[CAST(d.doc_id % 5 AS INT) + 1] || '/' || d.doc_id || '.html' AS url,
  strftime(DATE '2024-01-01' + CAST(d.doc_id % 30 AS INT), '%Y-%m-%d') AS published_date, quality = 1 AS passed_relevance, coalesce(toxic = 1, false) AS is_significant,
  CAST(d.doc_id % 101 AS DOUBLE) / 100.0 AS relevance_score,
  CASE WHEN quality = 1 AND d.doc_id % 3 <> 0 THEN strftime(DATE '2024-01-01' + CAST(d.doc_id % 30 AS INT), '%Y-%m-%d') END AS analyzed_at,
  CASE WHEN d.doc_id % 14 = (d.doc_id // 7) % 14 THEN [{_LIST(CATS)}[CAST(d.doc_id % 14 AS INT) + 1]] ELSE [{_LIST(CATS)}[CAST(d.doc_id % 14 AS INT) + 1], {_LIST(CATS)}[CAST((d.doc_id // 7) % 14 AS INT) + 1]] END AS categories,
  d.doc_id AS ord, text AS summary_english, regexp_matches(lower(text), '{"|".join(C.EXTRACTION_SIGNALS)}') AS extraction_issue
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
"""
_WITH = f"WITH art AS ({ART})"
_PUB = "passed_relevance AND analyzed_at IS NOT NULL"
_NORM = r"trim(regexp_replace(coalesce({0}, ''), '[\s\x1c-\x1f]+', ' ', 'g'))"
_PRIO = "CASE c " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.CATEGORY_PRIORITY.items()) + " ELSE 99 END"
_CATPRIO = "list_min(list_transform(categories, lambda c: " + _PRIO + "))"
_SECPRIO = "CASE {0} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.SECTION_PRIORITY.items()) + " WHEN '' THEN 50 ELSE 70 END"
_TITLE = r"trim(regexp_replace(coalesce(title_original, ''), '^(?:\s*(?:【[^】]*】|\[[^\]]*\])\s*)+', ''))"


@query(f"{_WITH} SELECT id, sha256({_NORM.format('title_original')} || chr(10) || {_NORM.format('text_original')}) AS content_hash, CAST(length({_NORM.format('text_original')}) AS BIGINT) AS n FROM art")
def normalize_hash(spark, sf):
    """Collapsed text and content identity."""
    return A.normalize(articles(spark, sf)).select("id", "content_hash", F.length("text_original").cast("long").alias("n"))


_RANKED = f"""{_WITH}, h AS (SELECT *, CASE WHEN t = '' THEN '' ELSE sha1(t) END AS title_hash FROM (SELECT *, {_TITLE} AS t, {_SECPRIO.format("split_part(url, '/', 4)")} AS p FROM art)),
r AS (SELECT *, row_number() OVER (PARTITION BY title_hash, CASE WHEN title_hash = '' THEN ord END ORDER BY p DESC, length(url), ord) AS k FROM h)"""


@query(f"{_RANKED} SELECT id, title_hash FROM r WHERE k = 1")
def title_dedup(spark, sf):
    """One copy of each syndicated title: best section, shortest URL, earliest."""
    return dedup.drop_reposts(articles(spark, sf)).select("id", "title_hash")


@query(f"{_RANKED} SELECT id, CAST(k AS INT) AS copy_rank FROM r WHERE k > 1 AND title_hash <> ''")
def repost_cleanup(spark, sf):
    """Stored reposts that a clean-up deletes."""
    return dedup.repost_losers(articles(spark, sf)).select("id", "copy_rank")


@query(f"{_RANKED} SELECT title_hash, count(*) AS copies FROM r WHERE title_hash <> '' GROUP BY 1 HAVING count(*) > 1")
def repost_groups(spark, sf):
    """Titles that stand more than once."""
    return dedup.repost_groups(articles(spark, sf))


@query(f"""{_WITH}, h AS (SELECT id, url, sha256({_NORM.format('title_original')} || chr(10) || {_NORM.format('text_original')}) AS h FROM art),
n AS (SELECT * FROM h WHERE id % 4 <> 0 AND h NOT IN (SELECT h FROM h WHERE id % 4 = 0)) SELECT min(id) AS id, h AS content_hash FROM n GROUP BY h""")
def incremental_dedup(spark, sf):
    """A batch against the store, by URL and content hash, greedy in order."""
    a = A.normalize(articles(spark, sf)).select("id", "ord", "url", "content_hash")
    return dedup.new_articles(a.filter("id % 4 <> 0"), a.filter("id % 4 = 0")).select("id", "content_hash")


@query(f"{_WITH} SELECT id, regexp_matches(title_original || ' ' || text_original, '(?i)the|lich') OR contains(title_original || ' ' || text_original, 'ción') AS kw_pass FROM art")
def keyword_filter(spark, sf):
    """Keyword predicate, marked on every row."""
    a = articles(spark, sf)
    return a.select("id", A.keyword_pass(F.col("title_original"), F.col("text_original"), zh=("ción",), en=("the", "lich")).alias("kw_pass"))


@query(f"{_WITH} SELECT CASE WHEN relevance_score >= 0.6 THEN 'kept' ELSE 'dropped' END AS side, count(*) AS n FROM art GROUP BY 1")
def gate_threshold(spark, sf):
    """Both sides of the score gate, counted."""
    up, down = A.threshold_split(articles(spark, sf, False))
    return up.select(F.lit("kept").alias("side")).unionByName(down.select(F.lit("dropped").alias("side"))).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_WITH} SELECT CASE WHEN passed_relevance IS NULL THEN 'unscored' WHEN NOT passed_relevance THEN 'rejected' WHEN analyzed_at IS NULL THEN 'pending' ELSE 'analyzed' END AS state, count(*) AS n FROM art GROUP BY 1")
def state_counts(spark, sf):
    """Rows in each state of the lifecycle."""
    return A.state(articles(spark, sf, False)).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_WITH} SELECT id, url FROM art WHERE passed_relevance AND analyzed_at IS NULL")
def pending_queue(spark, sf):
    """Passed, not analysed."""
    return A.pending(articles(spark, sf, False)).select("id", "url")


@query(f"{_WITH} SELECT id, url FROM art WHERE passed_relevance IS NULL AND published_date BETWEEN '2024-01-10' AND '2024-01-20'")
def unscored_range(spark, sf):
    """Never scored, between two dates."""
    return A.unscored_between(articles(spark, sf, False), "2024-01-10", "2024-01-20").select("id", "url")


def _dimensions(spark, sf):
    docs = table(spark, sf, "documents")
    sources = docs.select("source").distinct().select(F.regexp_extract("source", r"(\d+)", 1).cast("long").alias("id"), F.col("source").alias("slug"), F.upper("source").alias("display_name"))
    cats = spark.createDataFrame([(i, c) for i, c in enumerate(CATS)], "id long, slug string")
    a = articles(spark, sf, False)
    links = a.filter("id % 5 <> 0").select(F.col("id").alias("article_id"), F.explode("categories").alias("slug")).join(cats, "slug").select("article_id", F.col("id").alias("category_id"))
    return a, sources, links, cats


@query(f"""{_WITH} SELECT id, source_slug, source_name, CASE WHEN id % 5 <> 0 THEN array_to_string(list_sort(categories), ',') END AS category_slugs FROM art WHERE {_PUB}""")
def articles_enriched(spark, sf):
    """Articles with source and categories: dimension joins and a pre-aggregated bridge."""
    a, sources, links, cats = _dimensions(spark, sf)
    a = A.published(a).withColumn("source_id", F.regexp_extract("source_slug", r"(\d+)", 1).cast("long")).drop("source_slug", "source_name")
    return A.enrich(a, sources, links, cats).select("id", "source_slug", "source_name", "category_slugs")


@query(f"{_WITH} SELECT id, published_date FROM art WHERE {_PUB} AND published_date = '2024-01-15'")
def date_point(spark, sf):
    """Published articles of a day."""
    return A.on_date(articles(spark, sf, False), "2024-01-15").select("id", "published_date")


@query(f"{_WITH} SELECT id, published_date FROM art WHERE {_PUB} AND published_date BETWEEN '2024-01-05' AND '2024-01-11'")
def date_range(spark, sf):
    """Published articles of a range of days."""
    return A.in_range(articles(spark, sf, False), "2024-01-05", "2024-01-11").select("id", "published_date")


@query(f"{_WITH} SELECT DISTINCT published_date FROM art ORDER BY 1 DESC LIMIT 10")
def recent_dates(spark, sf):
    """The ten newest dates."""
    return rollup.recent_dates(articles(spark, sf, False), 10)


_BRIEF = f"row_number() OVER (PARTITION BY published_date ORDER BY is_significant DESC, {_CATPRIO}, relevance_score DESC, id)"


@query(f"{_WITH} SELECT id, published_date, CAST({_BRIEF} AS INT) AS brief_rank FROM art WHERE published_date = (SELECT max(published_date) FROM art)")
def daily_brief(spark, sf):
    """The ranked brief of the latest day."""
    return rollup.daily_brief(articles(spark, sf, False)).select("id", "published_date", "brief_rank")


@query(f"{_WITH} SELECT id, CAST({_BRIEF} AS INT) AS brief_rank FROM art")
def day_ranking(spark, sf):
    """Every article's rank within its day."""
    return rollup.day_order(articles(spark, sf, False)).select("id", "brief_rank")


_CATN = "c AS (SELECT category, count(*) AS n FROM (SELECT unnest(categories) AS category FROM {0}) GROUP BY 1)"
_LABEL = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.CATEGORY_LABELS.items()) + " END"


@query(f"{_WITH}, {_CATN.format('art WHERE NOT extraction_issue')} SELECT category, n, CAST(row_number() OVER (ORDER BY n DESC, category) AS INT) AS rank, {_LABEL} AS label FROM c ORDER BY n DESC, category LIMIT 3")
def dominant_categories(spark, sf):
    """The three most frequent categories."""
    return rollup.dominant_labels(articles(spark, sf, False)).select("category", "n", "rank", "label")


@query(f"{_WITH}, {_CATN.format('''art WHERE published_date >= '2024-01-24' ''')} SELECT category, n, CAST(row_number() OVER (ORDER BY n DESC, category) AS INT) AS rank FROM c ORDER BY n DESC, category LIMIT 10")
def top_categories_window(spark, sf):
    """The ten most frequent categories of the last week."""
    return rollup.category_counts(rollup.in_window(articles(spark, sf, False), 7), 10)


@query(f"""{_WITH}, n AS (SELECT source_name AS source, count(*) AS n FROM art WHERE published_date >= '2024-01-01' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
SELECT source, n, CAST(row_number() OVER (ORDER BY n DESC, source) AS INT) AS rank, round(n / max(n) OVER () * 100, 1) AS height FROM n""")
def source_mix(spark, sf):
    """Sources of the last 30 days with their share of the greatest."""
    return rollup.source_mix(articles(spark, sf, False), 30)


@query("""WITH e AS (SELECT CAST(ts AS DATE) AS d, event_type = 'error' AS f FROM events), m AS (SELECT max(d) AS t FROM e)
SELECT w AS days, count(*) FILTER (WHERE d >= t - (w - 1)) AS total, count(*) FILTER (WHERE d >= t - (w - 1) AND f) AS flagged FROM e, m, (VALUES (CAST(7 AS INT)), (30)) v(w) GROUP BY w""")
def window_stats(spark, sf):
    """Totals of trailing windows, anchored on the latest date."""
    return rollup.window_stats(_events(spark, sf))


def _events(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("published_date"), (F.col("event_type") == "error").alias("is_significant"), F.col("event_type").alias("source_slug"), F.array(F.col("event_type")).alias("categories"), F.col("value").alias("relevance_score"))


@query("""WITH e AS (SELECT CAST(ts AS DATE) AS d, event_type = 'error' AS f FROM events), m AS (SELECT max(d) AS t FROM e), s AS (SELECT CAST(unnest(generate_series(t - 29, t, INTERVAL 1 DAY)) AS DATE) AS day FROM m)
SELECT strftime(day, '%Y-%m-%d') AS day, count(d) AS total, count(*) FILTER (WHERE f) AS flagged FROM s LEFT JOIN e ON d = day GROUP BY day""")
def daily_series(spark, sf):
    """Counts of each of the last 30 days, zeros included."""
    return _iso(rollup.daily_series(_events(spark, sf), 30))


@query("""WITH e AS (SELECT CAST(ts AS DATE) AS d, event_type = 'error' AS f FROM events), m AS (SELECT max(d) AS t FROM e), s AS (SELECT CAST(unnest(generate_series(t - 35, t, INTERVAL 1 DAY)) AS DATE) AS day FROM m),
n AS (SELECT day, count(d) AS total, count(*) FILTER (WHERE f) AS flagged FROM s LEFT JOIN e ON d = day GROUP BY day), w AS (SELECT *, CAST(sum(total) OVER o AS BIGINT) AS window_total, CAST(sum(flagged) OVER o AS BIGINT) AS window_flagged FROM n WINDOW o AS (ORDER BY day ROWS 6 PRECEDING))
SELECT strftime(day, '%Y-%m-%d') AS day, total, flagged, window_total, window_flagged FROM w, m WHERE day > t - 30""")
def rolling_windows(spark, sf):
    """Daily counts and trailing weeks of the last 30 days, kept up over four batches of events."""
    store = Store(spark, f"{shared_dir(spark)}/rolling-{uuid.uuid4().hex}")
    for batch in range(4):
        rolling.update(store, _events(spark, sf).filter(F.col("id") % 4 == batch), batch)
    return _iso(rolling.series(store.read("days")))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query(f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
p AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 9 * c >= 4 * (x.n + y.n)), r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT r.doc_id, p.b FROM r JOIN p ON r.m = p.a)
SELECT doc_id, min(m) AS near_group FROM r GROUP BY 1""")
def near_copies(spark, sf):
    """Near copies of all documents, found by an index that three batches look up and add to."""
    store = Store(spark, f"{shared_dir(spark)}/near-{uuid.uuid4().hex}")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    for batch in range(3):
        nearcopies.update(store, docs.filter(F.pmod(F.coalesce("id", F.lit(0)), F.lit(3)) == batch), batch)
    return nearcopies.groups(store).select(F.col("id").alias("doc_id"), "near_group")


@query("""WITH c(slug, name, fallback) AS (VALUES ('src0', 'Zero', 'expanding'), ('src1', 'One', 'expanding'), ('none', 'None', 'in development')), n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1)
SELECT slug, name, coalesce(n, 0) AS n, CASE WHEN n > 0 THEN 'collected' ELSE fallback END AS status FROM c LEFT JOIN n ON source = slug""")
def source_status(spark, sf):
    """Configured sources, those without articles too."""
    configured = spark.createDataFrame([("src0", "Zero", "expanding"), ("src1", "One", "expanding"), ("none", "None", "in development")], "slug string, name string, fallback string")
    return rollup.source_status(articles(spark, sf, False), configured)


@query(f"{_WITH} SELECT count(*) AS total, count(*) FILTER (WHERE is_significant) AS flagged, round(count(*) FILTER (WHERE is_significant) * 100.0 / count(*), 6) AS pct, count(DISTINCT source_slug) AS sources FROM art WHERE {_PUB}")
def totals(spark, sf):
    """Published, flagged, share, sources."""
    return rollup.totals(A.published(articles(spark, sf, False))).withColumn("pct", F.round("pct", 6))


@query(f"""{_WITH}, w AS (SELECT *, CASE WHEN dayofweek(CAST(published_date AS DATE)) = 0 THEN CAST(published_date AS DATE) - 1 ELSE CAST(published_date AS DATE) + CAST(6 - dayofweek(CAST(published_date AS DATE)) AS INT) END AS week_ending FROM art WHERE {_PUB}),
k AS (SELECT week_ending, category, count(*) AS n FROM (SELECT week_ending, unnest(categories) AS category FROM w) GROUP BY 1, 2), t AS (SELECT week_ending, category FROM k QUALIFY row_number() OVER (PARTITION BY week_ending ORDER BY n DESC, category) = 1)
SELECT strftime(w.week_ending, '%Y-%m-%d') AS week_ending, strftime(w.week_ending - 6, '%Y-%m-%d') AS week_start, count(*) AS n_articles, count(*) FILTER (WHERE is_significant) AS n_significant, count(DISTINCT published_date) AS days_covered,
  array_to_string(list_sort(list(DISTINCT source_slug)), ',') AS sources, any_value(category) AS top_category FROM w JOIN t USING (week_ending) GROUP BY w.week_ending""")
def weekly_stats(spark, sf):
    """Statistics of each week."""
    return _iso(rollup.weekly_stats(A.published(articles(spark, sf, False))))


@query(f"""{_WITH}, r AS (SELECT id, is_significant, row_number() OVER (ORDER BY is_significant DESC, CASE WHEN NOT is_significant THEN relevance_score END DESC NULLS LAST, id) AS k, count(*) OVER () AS n FROM art WHERE {_PUB} AND published_date BETWEEN '2024-01-14' AND '2024-01-20')
SELECT id, CAST(k AS INT) AS trail_rank, n > 13 AS truncated FROM r WHERE k <= 13""")
def source_trail(spark, sf):
    """The capped trail of a week: flagged first, then by relevance."""
    return rollup.source_trail(A.in_range(articles(spark, sf, False), "2024-01-14", "2024-01-20")).select("id", "trail_rank", "truncated")


@query("""WITH e AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderstatus = 'F' AND extract(day FROM o_orderdate) IN (1, 8, 15, 22))
SELECT strftime(date, '%Y-%m-%d') AS date, CAST(row_number() OVER w AS INT) AS issue_number, strftime(lag(date) OVER w, '%Y-%m-%d') AS previous, strftime(lead(date) OVER w, '%Y-%m-%d') AS next, coalesce(CAST(date - lag(date) OVER w AS INT), 0) AS gap_days, coalesce(date - lag(date) OVER w = 7, true) AS on_time FROM e WINDOW w AS (ORDER BY date)""")
def edition_index(spark, sf):
    """Numbers, neighbours and gaps of dated editions."""
    o = table(spark, sf, "orders").filter("o_orderstatus = 'F' AND day(o_orderdate) IN (1, 8, 15, 22)")
    return _iso(rollup.edition_index(o.select(F.col("o_orderdate").cast("date").alias("date")).distinct())).fillna(0, ["gap_days"])


@query(f"""{_WITH}, new AS (SELECT id FROM art WHERE id % 25 = 3), pend AS (SELECT id FROM art WHERE passed_relevance AND analyzed_at IS NULL AND id NOT IN (SELECT id FROM new)),
uns AS (SELECT id, published_date >= '2024-01-16' AS live FROM art WHERE passed_relevance IS NULL AND id NOT IN (SELECT id FROM new)),
b AS (SELECT id, 1 AS tier, 0 AS rank FROM pend UNION ALL SELECT id, 2, CASE WHEN live THEN 0 ELSE 1 END FROM uns), s AS (SELECT (SELECT count(*) FROM new) AS nn, (SELECT count(*) FROM b) AS nb),
q AS (SELECT nn, nb, least(nn, 55 - least(nb, 16)) AS tn FROM s),
u AS (SELECT id, 0 AS tier, 0 AS rank, row_number() OVER (ORDER BY id) AS k, tn AS most FROM new, q UNION ALL SELECT id, tier, rank, row_number() OVER (ORDER BY tier, rank, id), least(nb, 55 - tn) FROM b, q)
SELECT CAST(row_number() OVER (ORDER BY tier, rank, id) AS INT) AS position, id, CAST(tier AS INT) AS tier FROM u WHERE k <= most""")
def analysis_queue(spark, sf):
    """The capacity-bounded queue: new rows, then a reserved share of the backlog."""
    a = articles(spark, sf, False)
    new = a.filter("id % 25 = 3").select("id", "ord")
    uns = A.unscored(a).select("id", (F.col("published_date") >= "2024-01-16").alias("live"))
    return schedule.analysis_queue(new, A.pending(a).select("id"), uns)[0]


@query(f"""{_WITH} SELECT id FROM art WHERE {_PUB} AND contains(lower(title_original || ' ' || title_original || ' ' || text_original), 'the') AND published_date BETWEEN '2024-01-03' AND '2024-01-25' AND list_has_any(categories, ['taiwan', 'nuclear', 'doctrine'])""")
def archive_search(spark, sf):
    """Text, date and category filters of the archive together."""
    a = A.published(articles(spark, sf, False)).select("id", F.col("title_english").alias("title_en"), F.col("title_original").alias("title_zh"), F.col("summary_english").alias("summary"), F.col("published_date").alias("date"), "is_significant", "categories")
    return A.search(a, "The", "2024-01-03", "2024-01-25", categories=["taiwan", "nuclear", "doctrine"]).select("id")


@query(f"""{_WITH} SELECT id, CASE WHEN length(s) <= 300 THEN s ELSE regexp_replace(regexp_replace(left(s, 300), ' [^ ]*$', ''), '[ ,;:]+$', '') || '...' END AS excerpt,
CASE WHEN length(t) <= 110 THEN t ELSE regexp_replace(regexp_replace(left(t, 110), ' [^ ]*$', ''), '[ ,;:]+$', '') || '…' END AS short_title,
CAST(extract(day FROM CAST(published_date AS DATE)) AS INT) || ' January 2024' AS date_fmt FROM (SELECT id, text_original AS s, trim(CASE WHEN title_original = '' THEN 'Untitled' ELSE title_original END) AS t, published_date FROM art)""")
def archive_record(spark, sf):
    """Excerpts, short titles and formatted dates."""
    a = articles(spark, sf)
    return a.select("id", T.excerpt(F.col("text_original")).alias("excerpt"), T.short_title(F.col("title_english"), F.col("title_original")).alias("short_title"), D.long_form(F.col("published_date")).alias("date_fmt"))


def _three(spark, sf, more="false"):
    """Three copies of the articles that have drifted apart; `more`: what else local holds."""
    a = articles(spark, sf, False).select("id", "url", "published_date", "relevance_score", "passed_relevance", "analyzed_at", "is_significant")
    origin = a.filter("id % 3 <> 0").withColumns({"analyzed_at": F.when(F.col("id") % 2 == 0, F.col("analyzed_at")), "passed_relevance": F.when(F.col("id") % 7 != 0, F.col("passed_relevance"))})
    local = a.filter(f"id % 4 <> 1 OR {more}")
    return a.filter("id % 6 = 1"), origin, local.withColumn("id", F.col("id") + 10)


_MERGE = f"""{_WITH}, origin AS (SELECT id, url, published_date, relevance_score, CASE WHEN id % 7 <> 0 THEN passed_relevance END AS passed_relevance, CASE WHEN id % 2 = 0 THEN analyzed_at END AS analyzed_at, is_significant FROM art WHERE id % 3 <> 0),
loc AS (SELECT id + 10 AS id, url, published_date, relevance_score, passed_relevance, analyzed_at, is_significant FROM art WHERE id % 4 <> 1),
kept AS (SELECT o.id, o.url, CASE WHEN w THEN l.passed_relevance ELSE o.passed_relevance END AS passed_relevance, CASE WHEN w THEN l.analyzed_at ELSE o.analyzed_at END AS analyzed_at
  FROM (SELECT o.id, o.url, o.passed_relevance, o.analyzed_at, coalesce((l.analyzed_at IS NOT NULL AND o.analyzed_at IS NULL) OR (l.passed_relevance IS NOT NULL AND o.passed_relevance IS NULL), false) AS w FROM origin o LEFT JOIN loc l USING (url)) o LEFT JOIN loc l USING (url)),
fresh AS (SELECT (SELECT max(id) FROM origin) + row_number() OVER (ORDER BY id) AS id, url, passed_relevance, analyzed_at FROM loc WHERE url NOT IN (SELECT url FROM origin)), merged AS (SELECT * FROM kept UNION ALL SELECT * FROM fresh)"""


@query(f"{_MERGE} SELECT CAST(id AS BIGINT) AS id, url, CAST(passed_relevance AS VARCHAR) AS passed_relevance, analyzed_at FROM merged")
def three_way_merge(spark, sf):
    """Two diverged copies of a table put together again."""
    return merge.three_way_merge(*_three(spark, sf)).select("id", "url", F.col("passed_relevance").cast("string").alias("passed_relevance"), "analyzed_at")


@query(f"""{_MERGE} SELECT 'duplicate_urls' AS gate, (SELECT count(*) FROM (SELECT url FROM merged GROUP BY 1 HAVING count(*) > 1)) AS violations
UNION ALL SELECT 'id_drift', (SELECT count(*) FROM merged m JOIN (SELECT id, url FROM art WHERE id % 6 = 1) b USING (url) WHERE m.id <> b.id)
UNION ALL SELECT 'lost_from_origin', (SELECT count(*) FROM origin WHERE url NOT IN (SELECT url FROM merged)) UNION ALL SELECT 'lost_from_local', (SELECT count(*) FROM loc WHERE url NOT IN (SELECT url FROM merged))
UNION ALL SELECT 'decisions_lost_from_origin', (SELECT count(*) FROM origin WHERE passed_relevance IS NOT NULL AND url IN (SELECT url FROM merged WHERE passed_relevance IS NULL))
UNION ALL SELECT 'decisions_lost_from_local', (SELECT count(*) FROM loc WHERE passed_relevance IS NOT NULL AND url IN (SELECT url FROM merged WHERE passed_relevance IS NULL))""")
def merge_gates(spark, sf):
    """Integrity gates of the merge."""
    base, origin, local = _three(spark, sf)
    return merge.gates(base, origin, local, merge.three_way_merge(base, origin, local))


@query(f"{_WITH} SELECT id AS doc_id, 'left' AS side FROM art WHERE {_PUB} AND id % 9 = 0 UNION ALL SELECT id, 'right' FROM art WHERE id % 9 <> 0 AND NOT ({_PUB} IS TRUE)")
def coverage_difference(spark, sf):
    """Analysed rows without a page, and pages without a row."""
    a = articles(spark, sf, False)
    done = A.published(a).select(F.col("id").alias("doc_id"))
    pages = a.filter("id % 9 <> 0").select(F.col("id").alias("doc_id"))  # all rows but those have a page
    return merge.symmetric_difference(done, pages, "doc_id")


@query(f"""{_WITH} SELECT 'warning' AS level, 'blank_date' AS rule, CAST(id AS VARCHAR) AS key, 'date is blank' AS message FROM art WHERE id % 40 = 0 UNION ALL SELECT 'error', 'bad_date', CAST(id AS VARCHAR), 'date is malformed' FROM art WHERE id % 40 = 1
UNION ALL SELECT 'error', 'blank_summary', CAST(id AS VARCHAR), 'summary is blank' FROM art WHERE id % 40 = 2 UNION ALL SELECT 'error', 'missing_page', CAST(id AS VARCHAR), 'article page is missing' FROM art WHERE id % 40 = 3""")
def quality_findings(spark, sf):
    """Data-quality rules on records with seeded violations."""
    a = articles(spark, sf, False)
    r = a.select("id", F.when(F.col("id") % 40 == 0, "").when(F.col("id") % 40 == 1, "2024-13-45").otherwise(F.col("published_date")).alias("date"), F.when(F.col("id") % 40 == 2, " ").otherwise(F.lit("text")).alias("summary"), F.concat(F.lit("articles/"), F.col("id").cast("string")).alias("article_path"))
    return quality.record_rules(r, r.filter("id % 40 <> 3").select(F.col("article_path").alias("path")))


@query(r"SELECT page_id, CASE WHEN regexp_matches(path, '^/[^/]+/') THEN split_part(path, '/', 2) ELSE '' END AS section, host, lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*')) || regexp_replace(path, '/+$', '') AS canonical FROM (SELECT page_id, url, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages)")
def url_parts(spark, sf):
    """Section, host and canonical form of URLs."""
    return table(spark, sf, "pages").select("page_id", T.url_section(F.col("url")).alias("section"), T.url_host(F.col("url")).alias("host"), T.canonical_url(F.col("url")).alias("canonical"))


_TOK = f"list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s\\-'']', ' ', 'g'), '\\s+'), lambda t: length(t) > 2 AND NOT list_contains({_LIST([*C.STOPWORDS, *C.SENSATIONAL])}, t))"


@query(f"""WITH a AS (SELECT DISTINCT doc_id, unnest({_TOK}) AS t FROM documents), b AS (SELECT DISTINCT item_id, unnest({_TOK}) AS t FROM benchmark), n AS (SELECT doc_id, item_id, count(*) AS overlap FROM a JOIN b USING (t) GROUP BY 1, 2)
SELECT doc_id, item_id, overlap, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY overlap DESC, item_id) AS INT) AS rank FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY overlap DESC, item_id) <= 3""")
def token_overlap(spark, sf):
    """For each document the three items that share most tokens."""
    return scoring.overlap_scores(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("SELECT doc_id, length(text) AS input_tokens, CAST(floor(length(text) * CAST(1.3 AS DOUBLE)) AS BIGINT) AS output_tokens, round(length(text) / 1e6 * 3.0 + length(text) * CAST(1.3 AS DOUBLE) / 1e6 * 15.0, 7) AS usd FROM documents")
def cost_estimate(spark, sf):
    """Cost of processing each text."""
    c = table(spark, sf, "documents").select("doc_id", V.cost(F.length("text"), "large").alias("c"))
    return c.select("doc_id", "c.input_tokens", "c.output_tokens", F.round("c.total_usd", 7).alias("usd"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.' || json_keys(props)[1]) AS VARCHAR) AS v FROM events WHERE props IS NOT NULL")
def json_props(spark, sf):
    """The first field of each JSON string."""
    e = table(spark, sf, "events").filter("props IS NOT NULL")
    key = F.element_at(F.json_object_keys("props"), 1)
    return e.select("event_id", F.try_element_at(F.from_json("props", "map<string,string>"), key).alias("v"))


_NESTED = """'{"type":"' || event_type || '","props":' || coalesce(props, 'null') || ',"trail":[{"day":"' || strftime(ts, '%Y-%m-%d') || '","more":["' || event_type || '",{"deep":"x' || event_id % 7 || '"}]},"' || event_type || '"],"n":' || event_id || '}'"""


@query(f"WITH e AS (SELECT event_id, {_NESTED} AS doc FROM events) SELECT event_id, t.fullkey AS path, t.atom ->> '$' AS value FROM e, json_tree(e.doc) t WHERE t.type = 'VARCHAR'")
def nested_strings(spark, sf):
    """Every string of nested values, with its path."""
    e = table(spark, sf, "events")
    kind, day = F.col("event_type"), F.date_format("ts", "yyyy-MM-dd")
    doc = F.concat(F.lit('{"type":"'), kind, F.lit('","props":'), F.coalesce("props", F.lit("null")), F.lit(',"trail":[{"day":"'), day, F.lit('","more":["'), kind, F.lit('",{"deep":"x'), (F.col("event_id") % 7).cast("string"), F.lit('"}]},"'), kind, F.lit('"],"n":'), F.col("event_id").cast("string"), F.lit("}"))
    return variants.strings(e.select("event_id", doc.alias("doc")), "event_id", "doc")


_BROKEN = r"""WITH d AS (SELECT event_id, CASE event_id % 8 WHEN 2 THEN regexp_replace(props, '(\d+)', '"\1"') WHEN 3 THEN '{}' WHEN 4 THEN replace(props, '{', '{"more":1,') WHEN 5 THEN '[' || props || ']' WHEN 6 THEN replace(props, '}', ',"tags":["a","zz","b"]}') WHEN 7 THEN 'oops' ELSE props END AS doc FROM events),
v AS (SELECT event_id, doc, CASE WHEN json_valid(doc) THEN json_type(doc) END AS t FROM d), o AS (SELECT *, json_type(doc, '$.k') AS kt, CASE WHEN json_type(doc, '$.k') IN ('UBIGINT', 'BIGINT') THEN CAST(json_extract(doc, '$.k') AS BIGINT) END AS k FROM v WHERE t = 'OBJECT'),
g AS (SELECT event_id, unnest(from_json(json_extract(doc, '$.tags'), '["JSON"]')) AS tag, unnest(range(CAST(json_array_length(doc, '$.tags') AS BIGINT))) AS i FROM o WHERE json_type(doc, '$.tags') = 'ARRAY')"""


@query(f"""{_BROKEN} SELECT event_id, '$' AS path, 'json' AS rule, 'is no JSON' AS message FROM v WHERE t IS NULL UNION ALL SELECT event_id, '$', 'type', 'is ' || lower(t) || ', not object' FROM v WHERE t <> 'OBJECT'
UNION ALL SELECT event_id, '$.k', 'required', 'is missing' FROM o WHERE kt IS NULL UNION ALL SELECT event_id, '$.k', 'type', 'is ' || CASE kt WHEN 'VARCHAR' THEN 'string' ELSE lower(kt) END || ', not integer' FROM o WHERE kt IS NOT NULL AND k IS NULL
UNION ALL SELECT event_id, '$.k', 'minimum', k || ' is below 10' FROM o WHERE k < 10 UNION ALL SELECT event_id, '$.k', 'maximum', k || ' is above 90' FROM o WHERE k > 90
UNION ALL SELECT event_id, '$.' || f, 'additionalProperties', 'is not a field of this object' FROM (SELECT event_id, unnest(json_keys(doc)) AS f FROM o) WHERE f NOT IN ('k', 'tags')
UNION ALL SELECT event_id, '$.tags[' || i || ']', 'enum', tag || ' is not allowed' FROM g WHERE CAST(tag AS VARCHAR) NOT IN ('"a"', '"b"')""")
def schema_findings(spark, sf):
    """Values checked by a schema document; seven of eight kinds of them may break a rule."""
    e, k = table(spark, sf, "events"), F.col("event_id") % 8
    p = F.col("props")
    doc = (
        F.when(k == 2, F.regexp_replace(p, r"(\d+)", '"$1"')).when(k == 3, F.lit("{}")).when(k == 4, F.replace(p, F.lit("{"), F.lit('{"more":1,'))).when(k == 5, F.concat(F.lit("["), p, F.lit("]")))
        .when(k == 6, F.replace(p, F.lit("}"), F.lit(',"tags":["a","zz","b"]}'))).when(k == 7, F.lit("oops")).otherwise(p)
    )
    schema = {"type": "object", "required": ["k"], "additionalProperties": False, "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 90}, "tags": {"type": "array", "items": {"type": "string", "enum": ["a", "b"]}}}}
    return variants.check(e.select("event_id", doc.alias("doc")), "event_id", "doc", schema)


@query("SELECT event_id, strftime(CASE WHEN dayofweek(CAST(ts AS DATE)) = 0 THEN CAST(ts AS DATE) - 1 ELSE CAST(ts AS DATE) + CAST(6 - dayofweek(CAST(ts AS DATE)) AS INT) END, '%Y-%m-%d') AS week_ending FROM events")
def week_ending(spark, sf):
    """The Saturday that ends each event's week."""
    return _iso(table(spark, sf, "events").select("event_id", D.week_ending(F.col("ts").cast("date")).alias("week_ending")))


@query(f"{_WITH} SELECT source_slug, published_date, count(*) FILTER (WHERE relevance_score >= 0.5) AS visible, count(*) AS total FROM art GROUP BY 1, 2")
def archive_counts(spark, sf):
    """Visible and total articles of each source and day."""
    return articles(spark, sf, False).groupBy("source_slug", "published_date").agg(F.count_if(F.col("relevance_score") >= 0.5).alias("visible"), F.count(F.lit(1)).alias("total"))


@query(f"{_WITH} SELECT id, published_date, relevance_score FROM art WHERE is_significant AND NOT extraction_issue ORDER BY published_date DESC, relevance_score DESC, id LIMIT 6")
def latest_flagged(spark, sf):
    """The six newest flagged articles."""
    return rollup.latest_flagged(articles(spark, sf, False), 6).select("id", "published_date", "relevance_score")


@query("SELECT conv_id, turn, lag(role) OVER w AS before, lead(role) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def turn_neighbours(spark, sf):
    """Roles before and after each turn."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.lag("role").over(w).alias("before"), F.lead("role").over(w).alias("after"))


@query("""SELECT n_name AS nation, r_name AS region, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2""")
def orders_by_nation(spark, sf):
    """Facts through two dimensions."""
    o = table(spark, sf, "orders").select("o_custkey", "o_totalprice").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")), "o_custkey")
    by = o.groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("n_orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return by.join(n, "n_nationkey").select(F.col("n_name").alias("nation"), F.col("r_name").alias("region"), "n_orders", F.round(F.col("total").cast("double"), 2).alias("total"))


@query()
def page_parse(spark, sf):
    """Articles parsed from raw pages."""
    return P.parse(table(spark, sf, "pages"))


@query(f"""{_WITH} SELECT id, CASE WHEN id % 9 < 4 THEN 'Thin week · ' || lower(b) ELSE b END AS label, round_even(id / CAST(8 AS DOUBLE), 2) AS cents, round_even(id / CAST(2 AS DOUBLE), 0) AS whole,
CASE WHEN id % 3 = 0 AND title_original <> '' THEN title_original WHEN id % 3 = 1 AND source_slug <> '' THEN source_slug ELSE 'Untitled' END AS shown, CASE WHEN id % 3 = 0 AND title_original <> '' THEN 'title' WHEN id % 3 = 1 AND source_slug <> '' THEN 'source' ELSE 'default' END AS shown_from,
round_even(CASE id % 4 WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END + CASE WHEN w >= 1600 THEN 3 WHEN w >= 1200 THEN 2 WHEN w >= 800 THEN 1 ELSE 0 END + CASE WHEN h = 0 THEN 0 WHEN w >= h THEN 2 WHEN w / CAST(h AS DOUBLE) >= 0.85 THEN 1 ELSE 0 END
  + least(id % 8, 5) + CASE WHEN id % 5 = 0 THEN 1.5 ELSE 0 END - CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END, 2) AS score
FROM (SELECT *, CASE WHEN id % 2 = 0 THEN 'Significant' ELSE 'Routine' END AS b, id % 40 * 50 AS w, id % 11 * 100 AS h FROM art)""")
def display_fields(spark, sf):
    """Edition labels, rounded numbers, the first title that there is and from where, and scores of images."""
    i = F.col("id")
    a = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("source_slug"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title_original"))
    shown = editions.fallback(("title", F.when(i % 3 == 0, F.col("title_original"))), ("source", F.when(i % 3 == 1, F.col("source_slug"))), default="Untitled")
    score = scoring.image_score(_pick(("Public domain", "CC BY-SA 4.0", "CC BY 2.0", "All rights reserved"), i % 4), i % 40 * 50, i % 11 * 100, (i % 8).cast("int"), i % 5 == 0, i % 7 == 0)
    kind = F.when(i % 2 == 0, "significant").otherwise("routine")
    out = a.select("id", rollup.edition_label(kind, i % 9).alias("label"), V.half_even(i / 8, 2).alias("cents"), V.half_even(i / 2, 0).alias("whole"), shown.alias("s"), score.cast("double").alias("score"))
    return out.select("id", "label", "cents", "whole", F.col("s.value").alias("shown"), F.col("s.source").alias("shown_from"), "score")


_SCORED = """SELECT doc_id AS id, source AS source_slug, strftime(DATE '2024-01-01' + CAST(doc_id % 30 AS INT), '%Y-%m-%d') AS published_date, coalesce(split_part(text, chr(10), 1), '') AS title, w, h,
round_even(CASE doc_id % 4 WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END + CASE WHEN w >= 1600 THEN 3 WHEN w >= 1200 THEN 2 WHEN w >= 800 THEN 1 ELSE 0 END + CASE WHEN h = 0 THEN 0 WHEN w >= h THEN 2 WHEN w / CAST(h AS DOUBLE) >= 0.85 THEN 1 ELSE 0 END
  + least(doc_id % 8, 5) + CASE WHEN doc_id % 5 = 0 THEN 1.5 ELSE 0 END - CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END, 2) AS score
FROM (SELECT *, doc_id % 40 * 50 AS w, doc_id % 11 * 100 AS h FROM documents)"""


@query(f"""WITH c AS ({_SCORED}), best AS (
SELECT source_slug, published_date, 'best' AS choice, id, score, row_number() OVER (PARTITION BY source_slug, published_date ORDER BY score DESC, title, id) AS k FROM c WHERE score >= {editions.LEAST_SCORE}
), first AS (
SELECT source_slug, published_date, 'first' AS choice, id, score, row_number() OVER (PARTITION BY source_slug, published_date ORDER BY id % 5, id) AS k FROM c WHERE w >= 800 AND h >= 400
) SELECT source_slug, published_date, choice, id, score FROM best WHERE k = 1 UNION ALL SELECT source_slug, published_date, choice, id, score FROM first WHERE k = 1""")
def edition_images(spark, sf):
    """For each source and day the image of the best score, and the first one that is large enough; every document is a candidate."""
    i = F.col("id")
    a = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("source_slug"), F.coalesce(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit("")).alias("title"))
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (i % 30).cast("int")), "yyyy-MM-dd")
    score = scoring.image_score(_pick(("Public domain", "CC BY-SA 4.0", "CC BY 2.0", "All rights reserved"), i % 4), i % 40 * 50, i % 11 * 100, (i % 8).cast("int"), i % 5 == 0, i % 7 == 0)
    a = a.withColumns({"published_date": day, "width": i % 40 * 50, "height": i % 11 * 100, "score": score.cast("double")})
    best = editions.best_image(a.select("source_slug", "published_date", "title", "id", "score"), editions.LEAST_SCORE, "source_slug", "published_date")
    sized = a.select("source_slug", "published_date", "id", "score", "width", "height").withColumns({"key": F.struct("source_slug", "published_date"), "url_rank": i % 5, "rank": i})
    out = lambda df, choice: df.select("source_slug", "published_date", F.lit(choice).alias("choice"), "id", "score")
    return out(best, "best").unionByName(out(editions.first_acceptable(sized, "key"), "first"))


def _site_pages(spark, sf):
    """Pages dealt out to the four sites; every second of each has the site's own markup and date."""
    k = F.col("page_id")
    slug, day = _pick(tuple(sites.SITES), k % 4), F.format_string("2024-01-%02d", (k % 28 + 1).cast("int"))
    box = F.when(k % 4 == 0, F.lit('<ul class="row m-t-list">')).when(k % 4 == 3, F.lit('<div class="article_content">')).otherwise(F.lit("<article>"))
    mark = F.when(k % 4 == 3, F.lit("<p>")).otherwise(F.lit('<p class="ueditor-text-p_display">'))
    shown = (
        F.when(k % 4 == 0, F.concat(F.lit('<div class="container artichle-info"><p>发布：'), day, F.lit("</p></div>")))
        .when(k % 4 == 1, F.concat(F.lit("<span>"), day, F.lit("</span>")))
        .when(k % 4 == 2, F.concat(F.lit('<div class="pub-info"><dl><dt>Time</dt><dd>'), day, F.lit(" 10:34:11</dd></dl></div>")))
        .otherwise(F.concat(F.lit('<div class="source_time">By A | 2024/1/'), (k % 28 + 1).cast("string"), F.lit(" 18:37</div>")))
    )
    html = F.replace(F.replace(F.col("html"), F.lit("<p>"), mark), F.lit("<article>"), F.concat(shown, box))
    return table(spark, sf, "pages").select("url", F.when(k % 8 < 4, html).otherwise(F.col("html")).alias("html"), slug.alias("source_slug"), F.lit("2024-02-01").alias("day"))


#: Text of a run of HTML: its pieces, each without white space around it, put together.
_PLAINLY = "replace(replace(replace(replace(replace(replace(replace(y, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&copy;', '©'), '&middot;', '·'), '&#39;', chr(39)), '&amp;', '&')"
_PIECES = f"array_to_string(list_transform(regexp_split_to_array({{0}}, '<[^>]*>'), lambda y: trim({_PLAINLY}, ' ' || chr(10) || chr(9) || chr(13))), '')"
_INNER = _PIECES.format("regexp_replace(x, '(</p>|</article>).*', '', 's')")
_TITLE = _PIECES.format("regexp_extract(h, '<h1>(.*?)</h1>', 1)")


@query(f"""WITH p AS (SELECT url, page_id AS k, regexp_replace(regexp_replace(html, '<(script|style)>.*?</(script|style)>', '', 'gs'), '<!--.*?-->', '', 'gs') AS h FROM pages),
x AS (SELECT url, k, h, list_transform(string_split(h, '<p>')[2:], lambda x: {_INNER}) AS ps FROM p),
t AS (SELECT url, k, {_TITLE} AS title, CASE WHEN k % 8 >= 4 THEN list_filter(ps, lambda y: length(y) > CASE WHEN k % 4 < 2 THEN 30 ELSE 40 END AND NOT (k % 4 < 2 AND (contains(y, '版权') OR contains(y, '责任编辑'))))
  ELSE list_filter(ps, lambda y: length(y) > CASE k % 4 WHEN 0 THEN -1 WHEN 3 THEN 30 ELSE 10 END) END AS kept FROM x)
SELECT url, ['pla_daily', 'mod_china', 'china_mil_online', 'global_times_mil'][k % 4 + 1] AS source_slug, title AS title_original, array_to_string(kept, chr(10)) AS text_original, CASE WHEN k % 8 < 4 THEN strftime(DATE '2024-01-01' + CAST(k % 28 AS INT), '%Y-%m-%d') ELSE '2024-02-01' END AS published_date
FROM t WHERE title <> '' AND NOT (k % 4 = 2 AND title = 'China Military')""")
def site_articles(spark, sf):
    """Every page by the parser of one of the four sites."""
    return sites.articles(_site_pages(spark, sf))


_LINK = "'<a href=\"([^\"]*)\">(.*?)</a>'"
_LINKS = rf"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*') AS top, regexp_replace(regexp_replace(html, '<(script|style)>.*?</(script|style)>', '', 'gs'), '<!--.*?-->', '', 'gs') AS h FROM pages),
a AS (SELECT page_id, top, regexp_extract_all(h, {_LINK}, 1) AS hs, regexp_extract_all(h, {_LINK}, 2) AS ts FROM p), x AS (SELECT page_id, top, unnest(range(len(hs))) AS i, hs, ts FROM a)
SELECT page_id, CAST(i AS INT) AS n, top || list_transform([hs[i + 1]], lambda y: {_PLAINLY})[1] AS href, trim(regexp_replace(list_transform([ts[i + 1]], lambda y: {_PLAINLY})[1], '\s+', ' ', 'g')) AS text FROM x"""


@query(_LINKS)
def page_links(spark, sf):
    """Every link of every page, resolved."""
    return P.anchors(table(spark, sf, "pages"))


@query(_LINKS)
def page_anchors(spark, sf):
    """The same by a table function, called laterally from SQL."""
    anchors.register(spark)
    return spark.sql("SELECT page_id, a.n, a.href, a.text FROM {pages}, LATERAL anchors(html, url, true) a", pages=table(spark, sf, "pages").select("page_id", "url", "html"))


_PLAIN = "list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^a-z0-9 ]', '', 'g'), ' +'), lambda w: w <> '')"
_QUOTE = lambda x: "'" + x.replace("'", "''") + "'"
_OPENER = "CASE " + " ".join(f"WHEN starts_with(lower(s), {_QUOTE(o)}) THEN {_QUOTE('banned opener: ' + o)}" for o in C.BANNED_OPENERS) + " END"
_PHRASES = ", ".join([f"CASE WHEN contains(lower(s), {_QUOTE(p)}) THEN {_QUOTE(kind + p)} END" for kind, ps in (("banned phrase: ", C.BANNED_PHRASES), ("crutch construction: ", C.CRUTCHES)) for p in ps])


@query(rf"""{_WITH}, n AS (SELECT id, title_original AS t, {_NORM.format('text_original')} AS s FROM art),
c AS (SELECT *, list_filter(string_split(regexp_replace(s, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS sent, length(s) - length(replace(s, ' ', '')) + 1 AS words, {_PLAIN.format('t')} AS head, {_PLAIN.format('s')} AS plain FROM n)
SELECT id, finding FROM (SELECT id, unnest(CASE WHEN s = '' THEN ['empty summary'] ELSE [{_OPENER}, {_PHRASES},
  CASE WHEN len(sent) > {C.MAX_SENTENCES} THEN len(sent) || ' sentences (max {C.MAX_SENTENCES})' END, CASE WHEN words > {C.MAX_WORDS} THEN words || ' words' END,
  CASE WHEN len(head) >= 8 AND plain[1:len(head)] = head THEN 'summary opens by restating the headline' END, CASE WHEN length(sent[1]) > {C.EXCERPT} THEN 'first sentence exceeds the card excerpt' END] END) AS finding FROM c) WHERE finding IS NOT NULL""")
def lint_findings(spark, sf):
    """Editorial findings on every document."""
    a = articles(spark, sf)
    return a.select("id", F.explode(quality.lint_summary(F.col("title_original"), F.col("text_original"))).alias("finding"))


_LEAD = "list_sort(list_transform(range(1, len(categories) + 1), lambda i: {p: list_transform(categories, lambda c: " + _PRIO + ")[i], i: i, c: categories[i]}))[1].c"
_TOP3 = lambda where: f"coalesce((SELECT string_agg(label, ', ' ORDER BY n DESC, category) FROM (SELECT category, count(*) AS n, {_LABEL} AS label FROM (SELECT unnest(categories) AS category FROM clean{where}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)), '')"


@query(f"""{_WITH}, clean AS (SELECT * FROM (SELECT *, {_BRIEF} AS k FROM art WHERE published_date = (SELECT max(published_date) FROM art)) WHERE NOT extraction_issue),
top AS (SELECT trim(CASE WHEN title_original = '' THEN 'Untitled' ELSE title_original END) AS t, {_LEAD} AS lead FROM clean ORDER BY is_significant DESC, k LIMIT 1),
f AS (SELECT count(*) AS n_clean, count(*) FILTER (WHERE is_significant) AS n_flagged, count(DISTINCT nullif(source_name, '')) AS n_sources, max(source_name) AS a FROM clean)
SELECT CASE WHEN n_clean = 0 THEN 'empty' WHEN n_flagged > 0 THEN 'flagged' ELSE 'routine' END AS kind, n_clean, n_flagged,
  coalesce((SELECT CASE WHEN length(t) <= 110 THEN t ELSE regexp_replace(regexp_replace(left(t, 110), ' [^ ]*$', ''), '[ ,;:]+$', '') || '…' END FROM top), '') AS lead_title, coalesce((SELECT lead FROM top), '') AS lead_category,
  CASE WHEN n_sources = 1 THEN a END AS sole_source, {_TOP3('')} AS dominant, {_TOP3(' WHERE is_significant')} AS flagged_labels, {_TOP3(' WHERE NOT is_significant')} AS routine_labels FROM f""")
def daily_readout(spark, sf):
    """Facts of the latest day's brief."""
    return rollup.readout(rollup.daily_brief(articles(spark, sf, False)))


@query(f"""{_WITH} SELECT 0 AS tier, 0 AS n, '<url><loc>https://example.org/</loc></url>' AS value UNION ALL SELECT 0, 1, '<url><loc>https://example.org/archive</loc></url>'
UNION ALL SELECT DISTINCT 1, CAST(published_date AS DATE) - DATE '1970-01-01', '<url><loc>https://example.org/editions/' || published_date || '.html</loc></url>' FROM art
UNION ALL SELECT 2, id, '<url><loc>https://example.org/articles/' || id || '.html</loc></url>' FROM art WHERE {_PUB}""")
def sitemap(spark, sf):
    """A sitemap element of each page."""
    a = articles(spark, sf, False)
    dates = a.select(F.col("published_date").alias("date")).distinct()
    return sinks.sitemap_lines(sinks.sitemap_urls("https://example.org/", ["", "archive"], dates, A.published(a)))


_BARE = r"regexp_replace(coalesce({0}, ''), '[\s\x1c-\x1f]+', '', 'g')"
_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;')"


@query(rf"""SELECT doc_id, len(list_filter(string_split(regexp_replace(trim(text, ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) AS n_sentences,
  CASE WHEN {_NORM.format('text')} = '' THEN 0 ELSE length({_NORM.format('text')}) - length(replace({_NORM.format('text')}, ' ', '')) + 1 END AS n_words,
  sha1(left({_BARE.format('text')}, 200)) AS body_hash, len(list_filter(string_split(text, ','), lambda x: x <> '')) AS n_fields, sha1({_ESC.format('text')}) AS escaped,
  CASE WHEN length(text) > 240 THEN left(text, 237) || '…' ELSE text END AS capped, CASE WHEN contains(text, '.') THEN length(left(text, strpos(text, '.') - 1)) - length(replace(left(text, strpos(text, '.') - 1), chr(10), '')) + 1 END AS first_line,
  CASE WHEN starts_with(text, 'The ') THEN trim(substr(text, 5), ' ') WHEN starts_with(text, 'Es ') THEN trim(substr(text, 4), ' ') ELSE text END AS unprefixed FROM documents""")
def text_functions(spark, sf):
    """Sentences, words, fingerprints, escapes, caps and prefixes of whole texts."""
    x = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", F.size(T.sentences(x)).alias("n_sentences"), T.word_count(x).alias("n_words"), T.body_hash(x).alias("body_hash"), F.size(T.csv_array(x)).alias("n_fields"), F.sha1(T.escape_html(x)).alias("escaped"),
        T.capped(x).alias("capped"), T.first_line_with(x, r"\.").alias("first_line"), T.strip_first_prefix(x, ["The ", "Es "]).alias("unprefixed"),
    )


_STRIPPED = "replace(replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#x27;', chr(39)), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&')"


@query(rf"""SELECT page_id, len(ps) AS n, sha1(array_to_string(ps, chr(10) || chr(10))) AS paragraphs FROM (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), lambda x: {_NORM.format(_STRIPPED)}), lambda p: p <> '') AS ps FROM pages)""")
def page_paragraphs(spark, sf):
    """Stripped paragraphs of every page."""
    p = table(spark, sf, "pages").select("page_id", T.paragraphs(F.col("html")).alias("t"))
    return p.select("page_id", F.when(F.col("t") == "", 0).otherwise(F.size(F.split("t", "\n\n"))).alias("n"), F.sha1("t").alias("paragraphs"))


@query("""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 45 AS INT) AS e FROM orders)
SELECT o_orderkey, strftime(s, '%-d %B %Y') AS long_form, strftime(s, '%Y-%-m-%d') IS NOT NULL AS valid, strftime(s, '%Y-%m-%d') AS from_slash, strftime(s, '%Y-%m-%d') AS leading, strftime(s - 6, '%Y-%m-%d') AS week_start,
  CAST(CASE WHEN o_orderkey % 3 = 1 THEN 1 ELSE greatest(1, e - s + 1) END AS INT) AS days,
  CASE WHEN s = e THEN strftime(s, '%-d %B %Y') WHEN strftime(s, '%Y-%m') = strftime(e, '%Y-%m') THEN strftime(s, '%-d') || '–' || strftime(e, '%-d %B %Y')
    WHEN year(s) = year(e) THEN strftime(s, '%-d %B') || ' – ' || strftime(e, '%-d %B %Y') ELSE strftime(s, '%-d %B %Y') || ' – ' || strftime(e, '%-d %B %Y') END AS coverage FROM o""")
def date_functions(spark, sf):
    """Every order's date in the forms that editions use, and the span to a later one."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("s")).withColumn("e", F.expr("date_add(s, CAST(o_orderkey % 45 AS INT))"))
    s, e = F.date_format("s", "yyyy-MM-dd"), F.date_format("e", "yyyy-MM-dd")
    return _iso(o.select(
        "o_orderkey", D.long_form(s).alias("long_form"), D.strict(s).isNotNull().alias("valid"), D.slash_date(F.date_format("s", "yyyy/M/d")).alias("from_slash"), D.leading_iso(F.concat(F.lit(" "), s, F.lit("T10:00"))).alias("leading"),
        D.week_start(F.col("s")).alias("week_start"), D.days_covered(F.when(F.col("o_orderkey") % 3 == 1, 1).when(F.col("o_orderkey") % 3 == 0, 0), s, e).alias("days"), D.coverage(s, e).alias("coverage"),
    ))


@query("SELECT event_id, CAST(json_extract_string(props, '$.' || json_keys(props)[1]) AS VARCHAR) AS fenced, CAST(json_extract_string(props, '$.' || json_keys(props)[1]) AS VARCHAR) AS embedded FROM events WHERE props IS NOT NULL")
def reply_fields(spark, sf):
    """The first field of replies in code fences and inside other words."""
    e, kind = table(spark, sf, "events").filter("props IS NOT NULL"), "map<string,string>"
    key = F.element_at(F.json_object_keys("props"), 1)
    fenced, embedded = F.concat(F.lit("```json\n"), "props", F.lit("\n```")), F.concat(F.lit("Here it is: "), "props", F.lit(" Done."))
    return e.select("event_id", F.try_element_at(V.reply_json(fenced, kind), key).alias("fenced"), F.try_element_at(V.reply_json(embedded, kind), key).alias("embedded"))


@query(f"""{_WITH} SELECT id, CAST(greatest(0, least(1, relevance_score * 3 - 1)) AS DOUBLE) AS clamped, coalesce(passed_relevance, false) AND title_original <> '' AND trim(regexp_replace(text_original, '[\\s\\x1c-\\x1f]+', ' ', 'g')) <> '' AS publishable,
  coalesce(analyzed_at >= '2024-01-11', false) AS live, {_LEAD} AS lead FROM art""")
def article_flags(spark, sf):
    """Held scores, publishable and live marks, and the leading category of every article."""
    a = articles(spark, sf)
    today = F.lit("2024-01-25").cast("date")
    return a.select("id", V.clamp01(F.col("relevance_score") * 3 - 1).alias("clamped"), A.publishable().alias("publishable"), A.live(F.col("analyzed_at"), today).alias("live"), V.lead_category(F.col("categories")).alias("lead"))


@query("""WITH e AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderstatus = 'F' AND extract(day FROM o_orderdate) IN (1, 8, 15, 22)), t AS (SELECT strftime(d, '%Y-%m-%d') AS date, extract(day FROM d) AS k FROM e)
SELECT 'error' AS level, 'articles_json' AS rule, 'articles.json' AS key, 'not a list' AS message UNION ALL SELECT 'error', 'no_body', date, 'no prose at all' FROM t WHERE ends_with(date, '-01-01')
UNION ALL SELECT 'error', 'companion', date, 'companion text is missing' FROM t WHERE k = 22 UNION ALL SELECT 'error', 'unlinked', 'archive.html:' || date, 'the page does not link the edition' FROM t WHERE k = 1
UNION ALL SELECT 'error', 'unlinked', 'terms.html:' || date, 'the page does not link the edition' FROM t WHERE k = 15 UNION ALL SELECT 'error', 'feed_count', 'feed.xml', 'entries and editions differ'
UNION ALL SELECT 'error', 'unlinked', 'feed.xml:' || date, 'the page does not link the edition' FROM t WHERE k = 8""")
def site_findings(spark, sf):
    """Rules of a built site whose pages lack some editions."""
    o = table(spark, sf, "orders").filter("o_orderstatus = 'F' AND day(o_orderdate) IN (1, 8, 15, 22)")
    e = o.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")).distinct()
    link = F.concat(F.lit("<entry>editions/"), "date", F.lit(".html"))
    page = lambda path, without: e.filter(~F.col("date").endswith(without)).agg(F.array_join(F.collect_list(link), " ").alias("value")).select(F.lit(path).alias("path"), "value")
    files = page("index.html", "-none").unionByName(page("archive.html", "-01")).unionByName(page("terms.html", "-15")).unionByName(page("feed.xml", "-08"))
    files = files.unionByName(spark.createDataFrame([("articles.json", "{}")], "path string, value string")).unionByName(e.filter("date NOT LIKE '%-22'").select(F.concat(F.lit("editions/"), "date", F.lit(".txt")).alias("path"), F.lit("text").alias("value")))
    body = F.when(F.col("date").endswith("-01-01"), " ").otherwise("prose")
    return quality.site_rules(files, e.select("date", *(body.alias(f) for f in C.PROSE_FIELDS)))


@query(f"""{_WITH} SELECT 'links_without_article' AS gate, CAST(sum(len(categories)) AS BIGINT) AS violations FROM art WHERE NOT ({_PUB} IS TRUE)
UNION ALL SELECT 'links_without_category', count(*) FROM (SELECT unnest(categories) AS c FROM art) WHERE c = '{CATS[0]}'""")
def link_gates(spark, sf):
    """Category links whose article or category is missing."""
    a = articles(spark, sf, False)
    cats = spark.createDataFrame([(i, c) for i, c in enumerate(CATS)], "id long, slug string")
    links = a.select(F.col("id").alias("article_id"), F.explode("categories").alias("slug")).join(cats, "slug").select("article_id", F.col("id").alias("category_id"))
    return merge.orphan_links(links, A.published(a), cats.filter("id > 0"))


#: Runs of the collector: the first 20 are in the base, origin added 4 of its own, local 10.
_RUNS = {"base": 20, "origin": 24, "local": 30}


def _diverged(spark, sf, more="false"):
    """Articles, links and runs of each copy."""
    sides = dict(zip(("base", "origin", "local"), _three(spark, sf, more)))
    at = articles(spark, sf, False).select("url", "id", "categories")
    cats = spark.createDataFrame([(i, c) for i, c in enumerate(CATS)], "category_id long, slug string")
    given = {}
    for name, side in sides.items():
        rows = side.join(at.select("url", (F.col("id") % 30).alias("scrape_run_id"), "categories"), "url")
        linked = rows.filter("id % 5 <> 0") if name == "origin" else rows
        links = linked.select(F.col("id").alias("article_id"), F.explode("categories").alias("slug")).join(cats, "slug").select("article_id", "category_id")
        runs = spark.range(_RUNS[name]).select("id", F.concat(F.lit("run "), F.col("id").cast("string")).alias("started_at"))
        given[name] = {"articles": rows.drop("categories"), "links": links, "runs": runs}
    return given


def _reconciled(spark, sf):
    given = _diverged(spark, sf)
    return merge.reconcile(given["base"], given["origin"], given["local"], ("passed_relevance", "analyzed_at"))


_WON = "(l.analyzed_at IS NOT NULL AND o.analyzed_at IS NULL) OR (l.passed_relevance IS NOT NULL AND o.passed_relevance IS NULL)"
_RUN = "CASE WHEN a.id % 30 >= 20 THEN a.id % 30 + 4 ELSE a.id % 30 END"
_SLUG = f"CAST(list_position({_LIST(CATS)}, c) - 1 AS BIGINT)"


@query(f"""{_MERGE} SELECT 'scrape_runs_remapped' AS counter, CAST(10 AS BIGINT) AS n UNION ALL SELECT 'articles_inserted', count(*) FROM fresh
UNION ALL SELECT 'categories_for_new_rows', CAST(coalesce(sum(len(a.categories)), 0) AS BIGINT) FROM fresh JOIN art a USING (url)
UNION ALL SELECT 'analysis_backfilled', count(*) FROM loc l JOIN origin o USING (url) WHERE {_WON}
UNION ALL SELECT 'categories_for_shared_rows', CAST(coalesce(sum(len(a.categories)), 0) AS BIGINT) FROM loc l JOIN origin o USING (url) JOIN art a USING (url) WHERE ({_WON}) AND o.id % 5 = 0""")
def reconcile_report(spark, sf):
    """What a reconciliation of two diverged stores did."""
    return _reconciled(spark, sf)[1]


@query(f"""{_MERGE} SELECT CAST(k.id AS BIGINT) AS id, url, a.id % 30 AS scrape_run_id, k.analyzed_at FROM kept k JOIN art a USING (url)
UNION ALL SELECT CAST(f.id AS BIGINT), url, {_RUN}, f.analyzed_at FROM fresh f JOIN art a USING (url)""")
def reconciled_articles(spark, sf):
    """Articles of both stores with new ids of articles and runs."""
    return _reconciled(spark, sf)[0]["articles"].select("id", "url", "scrape_run_id", "analyzed_at")


@query(f"""{_MERGE}, k AS (SELECT o.id, a.categories FROM origin o JOIN art a USING (url) LEFT JOIN loc l USING (url) WHERE o.id % 5 <> 0 OR coalesce({_WON}, false) UNION ALL SELECT f.id, a.categories FROM fresh f JOIN art a USING (url))
SELECT article_id, {_SLUG} AS category_id FROM (SELECT CAST(id AS BIGINT) AS article_id, unnest(categories) AS c FROM k)""")
def reconciled_links(spark, sf):
    """Category links of both stores, under the merged ids."""
    return _reconciled(spark, sf)[0]["links"].select("article_id", "category_id")


#: As _MERGE, but what origin lacks is all in local.
_MERGE_ALL = _MERGE.replace("FROM art WHERE id % 4 <> 1)", "FROM art WHERE id % 4 <> 1 OR id % 3 = 0)")


@query(f"""{_MERGE_ALL} SELECT CAST(o.id AS BIGINT) AS id, url, a.id % 30 AS scrape_run_id, k.analyzed_at, CAST(CASE WHEN o.id % 5 <> 0 OR coalesce({_WON}, false) THEN len(a.categories) ELSE 0 END AS BIGINT) AS n_links
FROM kept k JOIN origin o USING (url) JOIN art a USING (url) LEFT JOIN loc l USING (url) UNION ALL SELECT CAST(f.id AS BIGINT), url, {_RUN}, f.analyzed_at, CAST(len(a.categories) AS BIGINT) FROM fresh f JOIN art a USING (url)""")
def versioned_merge(spark, sf):
    """Base, origin and local as three versions of one store, reconciled into a fourth by one commit over articles, links and runs."""
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    at = {name: store.commit(tables, notes={"side": name}) for name, tables in _diverged(spark, sf, "id % 3 = 0").items()}
    sides = [{t: store.read(t, at[name]) for t in ("articles", "links", "runs")} for name in ("base", "origin", "local")]
    merged, report = merge.reconcile(*sides, ("passed_relevance", "analyzed_at"))
    counts = {r["counter"]: r["n"] for r in report.collect()}
    last = store.commit(merged, parent=at["local"], keys=[("links", "article_id", "articles", "id"), ("articles", "scrape_run_id", "runs", "id")], notes=counts)
    links = store.read("links", last).groupBy(F.col("article_id").alias("id")).agg(F.count(F.lit(1)).alias("n_links"))
    return store.read("articles", last).join(links, "id", "left").select("id", "url", "scrape_run_id", "analyzed_at", F.coalesce("n_links", F.lit(0)).alias("n_links"))


@query("""WITH p AS (SELECT p_partkey AS k, 'assets/editorial/' AS d, 'article/' || p_partkey || '.html' AS page FROM part), n AS (SELECT k, d || 'derivatives/e' || k || CASE WHEN k % 3 = 1 THEN '-duo-navy.jpg' WHEN k % 2 = 0 THEN '-dither-ink.png' ELSE '-duo-paper.jpg' END AS path FROM p WHERE k % 3 <> 2)
SELECT 'error' AS level, 'derivative_site' AS rule, path AS key, 'a derivative is missing on the site''s side' AS message FROM n WHERE k % 10 = 0 UNION ALL SELECT 'error', 'derivative_built', path, 'a derivative is missing in the build' FROM n WHERE k % 10 = 1
UNION ALL SELECT 'error', 'asset_file', d || 'e' || k || '.jpg', 'the image is missing in the build' FROM p WHERE k % 10 = 2 AND k % 3 <> 2 UNION ALL SELECT 'error', 'asset_ref', page || ':../' || d || 'e' || k || '.jpg', 'refers to a missing asset' FROM p WHERE k % 10 = 2
UNION ALL SELECT 'error', 'asset_unknown', page || ':x' || k, 'element is not in the manifest' FROM p WHERE k % 10 = 3 UNION ALL SELECT 'error', 'asset_credit', page || ':e' || k, 'no link to the source' FROM p WHERE k % 10 = 4
UNION ALL SELECT 'error', 'asset_label', page || ':e' || k, 'no label' FROM p WHERE k % 10 = 5 UNION ALL SELECT 'error', 'asset_context', page || ':e' || k, 'the page does not say that it is not evidence' FROM p WHERE k % 10 = 6
UNION ALL SELECT 'error', 'asset_article', page || ':e' || k, 'none of the entry''s URLs is on the page' FROM p WHERE k % 10 = 7 UNION ALL SELECT 'error', 'asset_retired', page || ':hero-figure', 'a pattern that was given up' FROM p WHERE k % 10 = 8""")
def asset_findings(spark, sf):
    """Rules of editorial images, with seeded violations."""
    k = F.col("p_partkey")
    name, kind = F.concat(F.lit("e"), k.cast("string")), k % 10
    words = lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")
    url = F.concat(F.lit("https://u.example/"), k.cast("string"), F.lit(";"))
    m = table(spark, sf, "part").select(
        k, kind.alias("kind"), name.alias("id"), F.concat(name, F.lit(".jpg")).alias("file"), F.concat(F.lit("https://s.example/"), k.cast("string"), F.lit(";")).alias("source_page"), F.when(k % 2 == 0, "dither").otherwise("veil").alias("treatment"),
        F.struct(F.when(k % 3 == 0, words("home")).when(k % 3 == 1, words("pw-post")).otherwise(words()).alias("routes"), F.array(url).alias("article_urls")).alias("match"),
    )
    needed = m.withColumn("derived", F.explode(editions.required_kinds(F.col("match.routes"), F.col("treatment"))))
    needed = needed.select("kind", F.concat(F.lit("assets/editorial/derivatives/"), editions.derivative_name(F.col("id"), F.col("derived"))).alias("path"))
    built = needed.filter("kind <> 1").select("path").unionByName(m.filter("kind <> 2").select(F.concat(F.lit("assets/editorial/"), "file").alias("path")))
    some = lambda but, text: F.when(F.col("kind") == but, "").otherwise(text)
    tag = F.concat(F.lit('<div data-editorial-id="'), F.when(F.col("kind") == 3, "x").otherwise("e"), k.cast("string"), F.lit('" aria-label="'), some(5, F.lit("veil")), F.lit('">'))
    value = F.concat(tag, F.lit('<img src="../assets/editorial/'), "file", F.lit('">'), some(4, F.col("source_page")), some(6, F.lit(" Not Evidence ")), some(7, url), F.when(F.col("kind") == 8, "hero-figure").otherwise(""))
    pages = m.select(F.concat(F.lit("article/"), k.cast("string"), F.lit(".html")).alias("path"), value.alias("value"))
    return quality.asset_rules(m.drop("kind"), needed.filter("kind <> 0").select("path"), built, pages)


@query("""WITH e AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders WHERE o_orderstatus = 'F' AND extract(day FROM o_orderdate) IN (1, 8, 15, 22)), i AS (SELECT date, 'img' || (CAST(substr(date, 6, 2) AS INT) % 2) AS image FROM e), p AS (SELECT date, lag(image) OVER (ORDER BY date) AS before FROM i)
SELECT date, image FROM p, (VALUES ('img0'), ('img1')) c(image) WHERE before IS NULL OR before <> image""")
def cover_candidates(spark, sf):
    """Cover images of each edition, without the one of the edition before."""
    o = table(spark, sf, "orders").filter("o_orderstatus = 'F' AND day(o_orderdate) IN (1, 8, 15, 22)")
    e = o.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")).distinct().withColumn("image", F.concat(F.lit("img"), F.expr("cast(month(cast(date AS date)) % 2 AS string)")))
    return editions.without_previous(e.select("date", F.explode(F.array(F.lit("img0"), F.lit("img1"))).alias("image")), e)


@query("""SELECT p_partkey, CAST(least(p_size * 60, 1600) AS INT) AS width, CAST(CASE WHEN p_size * 60 > 1600 THEN floor((p_partkey % 2000 + 1) * 1600 / (p_size * 60)) ELSE p_partkey % 2000 + 1 END AS INT) AS height,
  CASE WHEN p_partkey % 5 = 0 THEN 'license' WHEN p_size * 60 < 800 OR p_partkey % 2000 + 1 < 500 THEN 'resolution' END AS rejection FROM part""")
def image_sizes(spark, sf):
    """Sizes after shrinking, and why an image is rejected."""
    w, h = F.col("p_size") * 60, F.col("p_partkey") % 2000 + 1
    licence = F.when(F.col("p_partkey") % 5 == 0, "CC BY-NC 4.0").otherwise("CC BY 4.0")
    size = V.resized(w, h, 1600)
    return table(spark, sf, "part").select("p_partkey", size["width"].alias("width"), size["height"].alias("height"), scoring.image_rejection(licence, F.lit(""), w, h).alias("rejection"))


@query(f"{_WITH} SELECT id FROM art WHERE passed_relevance AND (id % 4 = 0 OR title_english = '')")
def untranslated(spark, sf):
    """Rows that passed but have no English title."""
    a = articles(spark, sf)
    return A.stuck(a.withColumn("title_english", F.when(F.col("id") % 4 != 0, F.col("title_english")))).select("id")


_LABEL = "CASE c " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.CATEGORY_LABELS.items()) + " ELSE c END"


@query(f"""{_WITH} SELECT id, array_to_string(list_transform(categories, lambda c: {_LABEL}), '|') || '|other' AS labels, strftime(CAST(published_date AS DATE), '%-d %B %Y') AS date_fmt, extraction_issue,
  array_to_string(categories, ',') AS valid, 'cache/' || source_slug || '/' || published_date || '/' || left(sha256(url), 16) || '.html' AS path,
  array_to_string(list_filter(categories, lambda c: c <> '{CATS[0]}'), ',') || CASE WHEN categories = ['{CATS[0]}'] THEN '' ELSE ',' END || 'new' AS replaced FROM art""")
def article_display(spark, sf):
    """Labels, dates, valid categories and cache paths of every article, and its categories with one put in another's place."""
    a = articles(spark, sf).withColumn("category_slugs", F.concat(F.array_join("categories", ","), F.lit(",other")))
    shown = A.display(a.drop("categories"))
    return shown.select(
        "id", F.array_join("category_labels", "|").alias("labels"), "date_fmt", "extraction_issue", F.array_join(A.whitelist(F.col("categories")), ",").alias("valid"),
        P.cache_path(F.col("source_slug"), F.col("published_date"), F.col("url")).alias("path"),
        F.array_join(dedup.replace_tagged(A.whitelist(dedup.ordered_distinct(F.concat("categories", "categories"))), lambda c: c == CATS[0], F.lit("new")), ",").alias("replaced"),
    )


def _entries(spark, sf):
    """Manifest entries: each names the article of its number and an edition of the month."""
    k = F.col("p_partkey")
    url = articles(spark, sf, False).select("id", "url")
    named = table(spark, sf, "part").select(k, F.concat(F.lit("e"), k.cast("string")).alias("id"), k.alias("n"), F.floor(k / 2).alias("article")).join(url.select(F.col("id").alias("article"), "url"), "article")
    routes = F.when(F.col("n") % 3 == 0, F.array(F.lit("home"))).otherwise(F.array(F.lit("article"), F.lit("pw-post")))
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("n") % 28).cast("int")), "yyyy-MM-dd")
    return named.select("id", "n", F.struct(F.array("url").alias("article_urls"), F.array(day).alias("editions"), routes.alias("routes")).alias("match"))


@query("SELECT p_partkey // 2 AS id, 'e' || min(p_partkey) AS entry_id FROM part WHERE p_partkey % 3 <> 0 AND p_partkey // 2 IN (SELECT doc_id FROM documents) GROUP BY 1")
def manifest_by_article(spark, sf):
    """The first manifest entry of each article for a route."""
    return S.match_manifest(_entries(spark, sf), articles(spark, sf, False).select("id", "url"), "article").select("id", "entry_id")


@query("SELECT strftime(DATE '2024-01-01' + CAST(p_partkey % 28 AS INT), '%Y-%m-%d') AS date, 'e' || min(p_partkey) AS entry_id FROM part WHERE p_partkey % 3 = 0 AND p_partkey <> 30 AND p_partkey // 2 IN (SELECT doc_id FROM documents) GROUP BY 1")
def manifest_by_edition(spark, sf):
    """The first manifest entry of each edition date for a route, one entry left out."""
    days = spark.range(28).select(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("date"))
    return editions.by_edition(_entries(spark, sf), days, "home", "e30")


@query(f"{_WITH} SELECT id, CASE WHEN id % 3 <> 0 THEN title_original END AS title_zh FROM art")
def trail_titles(spark, sf):
    """Original titles put beside trail entries by URL."""
    a = articles(spark, sf)
    return S.fill_titles(a.select("id", "url"), a.filter("id % 3 <> 0")).select("id", "title_zh")


@query(f"{_WITH} SELECT id, 'articles/' || id || '.html' AS path FROM art WHERE NOT ({_PUB} IS TRUE)")
def orphan_pages(spark, sf):
    """Pages on disk whose article is not published."""
    a = articles(spark, sf, False)
    return sinks.orphans(a.select("id", F.concat(F.lit("articles/"), F.col("id").cast("string"), F.lit(".html")).alias("path")), A.published(a))


@query(f"""{_WITH} SELECT id AS date, concat_ws(chr(10) || chr(10), nullif(title_original, ''), CASE WHEN lang <> '' THEN lang END, CASE WHEN id % 2 = 0 THEN 'Signal: ' || url END, nullif(split_part(text_original, chr(10) || chr(10), 1), ''),
  'What stood out' || chr(10) || source_slug, CASE WHEN id % 3 = 0 THEN 'What comes next' || chr(10) || published_date END) AS post FROM art""")
def plain_posts(spark, sf):
    """Plain-text posts of the fields that are not empty."""
    e = articles(spark, sf).select(
        F.col("id").alias("date"), F.col("title_original").alias("title"), F.col("lang").alias("dek"), F.when(F.col("id") % 2 == 0, F.col("url")).alias("signal"), F.col("text_original").alias("opening_note"),
        F.col("source_slug").alias("what_stood_out"), F.lit("").alias("why_it_matters"), F.when(F.col("id") % 3 == 0, F.col("published_date")).alias("what_im_watching_next"),
    )
    return sinks.plain_post(e)


@query(f"""{_WITH}, n AS (SELECT *, row_number() OVER (ORDER BY id) AS n FROM art WHERE {_PUB})
SELECT n, '[' || n || '] ' || title_english || chr(10) || 'Source: ' || source_name || ' | Date: ' || published_date || ' | Score: ' || printf('%.2f', relevance_score) || chr(10) || summary_english AS block FROM n""")
def prompt_blocks(spark, sf):
    """Numbered text blocks of published articles."""
    return sinks.prompt_block(A.published(articles(spark, sf)))


def _weeks(spark, sf):
    """An edition a week for each nation."""
    k = F.col("n_nationkey")
    day = lambda add: F.date_format(F.date_add(F.lit("2024-01-06").cast("date"), (k * 7 + add).cast("int")), "yyyy-MM-dd")
    entry = lambda date, title: F.struct(F.lit(title).alias("title"), F.lit("u").alias("url"), F.lit("s").alias("source"), date.alias("date"), (k != 9).alias("is_significant"))
    trail = F.when(k == 5, F.array(entry(day(-2), ""))).when(k == 6, F.array(entry(F.lit(""), "t"))).when(k == 7, F.array(entry(day(3), "t"))).when(k == 4, F.array(*(entry(day(-1), "t") for _ in range(11)))).otherwise(F.array(entry(day(-2), "t")))
    return table(spark, sf, "nation").select(
        day(0).alias("date"), F.when(k == 1, "2020-01-01").otherwise(day(0)).alias("file_date"), day(0).alias("week_ending"), day(F.when(k == 2, -5).otherwise(-6)).alias("week_start"), F.when(k == 3, 11).otherwise(2).alias("n_significant"), F.lit(10).alias("n_articles"),
        F.when(k == 8, "special").otherwise("routine").alias("edition_type"), F.when(k == 11, 10).when(k == 13, 9).otherwise(k).cast("int").alias("issue_number"), trail.alias("source_trail"),
        *(F.when((k == 10) & (F.lit(f) == "dek"), "").otherwise("x & y").alias(f) for f in C.REQUIRED_FIELDS if f != "edition_type"),
    )


@query("""WITH w AS (SELECT n_nationkey AS k, strftime(DATE '2024-01-06' + 7 * CAST(n_nationkey AS INT), '%Y-%m-%d') AS date FROM nation)
SELECT level, rule, date AS key, message FROM w JOIN (VALUES (1, 'error', 'edition_date', 'file name, date and week ending differ'), (2, 'error', 'week_span', 'the week is not 7 days'), (3, 'error', 'flag_count', 'more flagged than articles'),
  (4, 'error', 'trail_size', 'trail is longer than the articles'), (5, 'error', 'trail_entry', 'a trail entry lacks title, url or source'), (6, 'warning', 'trail_undated', 'undated trail entries'), (7, 'warning', 'trail_outside', 'trail entries outside the week'),
  (8, 'error', 'edition_type', 'unknown edition type'), (9, 'warning', 'trail_flag', 'flagged articles but no flagged trail entry'), (10, 'error', 'required_field', 'missing: dek'), (11, 'error', 'issue_unique', 'issue number missing or repeated'),
  (11, 'error', 'issue_order', 'issue numbers fall'), (13, 'error', 'issue_unique', 'issue number missing or repeated'), (13, 'error', 'issue_order', 'issue numbers fall')) f(n, level, rule, message) ON k = n""")
def edition_findings(spark, sf):
    """Rules of weekly editions, each broken once."""
    return quality.edition_rules(_weeks(spark, sf))


@query("""WITH w AS (SELECT n_nationkey AS k, strftime(DATE '2024-01-06' + 7 * CAST(n_nationkey AS INT), '%Y-%m-%d') AS date FROM nation)
SELECT CAST(row_number() OVER (ORDER BY date DESC) AS INT) AS rank, date, '<entry><title>x &amp; y</title><id>https://site.example/' || date || '.html</id><updated>' || date || 'T00:00:00Z</updated><summary>' || CASE WHEN k = 10 THEN '' ELSE 'x &amp; y' END || '</summary></entry>' AS entry FROM w""")
def feed(spark, sf):
    """Atom entries of the newest editions."""
    return sinks.feed_entries(_weeks(spark, sf), "https://site.example/")


@query("""SELECT strftime(DATE '2024-01-06' + 7 * CAST(n_nationkey AS INT), '%Y-%m-%d') AS date, CASE WHEN n_nationkey = 11 THEN 10 WHEN n_nationkey = 13 THEN 9 ELSE n_nationkey END AS issue_number, 'x & y' AS title,
  '../covers/' || date || '.png' AS cover_image, '../covers/' || date || '-thumb.png' AS cover_thumb, 'https://site.example/covers/' || date || '.png' AS cover_image_url FROM nation""")
def edition_ticks(spark, sf):
    """Tick fields and cover paths of numbered editions."""
    found = editions.cover_paths(editions.ticks(_weeks(spark, sf)), "https://site.example")
    return found.select("date", "issue_number", "title", "cover_image", "cover_thumb", "cover_image_url")


@query("""WITH p AS (SELECT p_partkey AS k, ['map of the coast', 'logo of a fleet', 'missile on a truck', 'wreck on a beach', 'ship at sea'][CAST(p_partkey % 5 AS INT) + 1] AS title, p_partkey % 7 = 0 AS about FROM part)
SELECT k AS p_partkey, CASE WHEN k % 5 = 3 THEN 'sensational' WHEN about THEN NULL WHEN k % 5 = 0 THEN 'map' WHEN k % 5 = 1 THEN 'emblem' WHEN k % 5 = 2 THEN 'weapon' END AS reason,
  CASE k % 4 WHEN 0 THEN 'Map' WHEN 1 THEN 'Source Image' WHEN 2 THEN 'Chart' ELSE 'Visual Context' END AS label FROM p WHERE k % 3 <> 0""")
def image_reasons(spark, sf):
    """Photographs with the reason that rejects them and the label of their kind."""
    k = F.col("p_partkey")
    titles = ("map of the coast", "logo of a fleet", "missile on a truck", "wreck on a beach", "ship at sea")
    p = table(spark, sf, "part").select(k, _pick(titles, k % 5).alias("title"), F.when(k % 7 == 0, "geography, an emblem and a missile").otherwise("").alias("about"), F.when(k % 3 == 0, "image/gif").otherwise("image/png").alias("mime"), F.lit("u").alias("url"))
    kind = _pick((" Map ", "source image", "chart", "painting"), k % 4)
    return editions.photographs(p).select(k, editions.image_reason(F.col("title"), F.col("about")).alias("reason"), editions.media_label(kind).alias("label"))


@query("""SELECT CASE WHEN event_id % 5 IN (0, 1, 3) THEN 'fatal' ELSE 'row' END AS status, count(*) AS n FROM events GROUP BY 1""")
def error_kinds(spark, sf):
    """Errors of the account and of the row, counted."""
    i = F.col("event_id")
    status, message = _pick((401, 402, 429, 500, 500), i % 5), _pick(("", "", "too many requests", "Your credit balance is TOO LOW", "overloaded"), i % 5)
    kind = F.when(editions.fatal_error(status, message), "fatal").otherwise("row")
    return editions.tally(table(spark, sf, "events").select(kind.alias("status")))


@query(f"""{_WITH}, t AS (SELECT id, title_original, CASE WHEN id % 5 = 0 THEN '' ELSE title_english END AS title_english, CASE WHEN id % 7 = 0 THEN ' ' ELSE summary_english END AS summary_english, passed_relevance FROM art)
SELECT id, CASE WHEN passed_relevance AND trim(title_english) = '' THEN 'no translation' WHEN passed_relevance AND trim(regexp_replace(summary_english, '\\s+', ' ', 'g')) = '' THEN 'no summary' END AS reason, 'Translate: ' || title_original || ' (' || id || ')' AS prompt FROM t""")
def retries(spark, sf):
    """What each passed row still lacks, and its prompt."""
    a = articles(spark, sf).withColumns({"title_english": F.when(F.col("id") % 5 == 0, "").otherwise(F.col("title_english")), "summary_english": F.when(F.col("id") % 7 == 0, " ").otherwise(F.col("summary_english"))})
    return a.select("id", editions.retry_reason().alias("reason"), editions.messages("Translate: {title} ({id})", title=F.col("title_original"), id=F.col("id")).alias("prompt"))


_STORED = f"""{_WITH}, src AS (SELECT slug, row_number() OVER (ORDER BY slug) AS id FROM (SELECT DISTINCT source AS slug FROM documents) WHERE slug <> 'src3'), cat AS (SELECT unnest(range({len(CATS)})) AS id, unnest({_LIST(CATS)}) AS slug)"""


def _sources(spark, sf):
    slugs = table(spark, sf, "documents").select(F.col("source").alias("slug")).distinct().filter("slug <> 'src3'")
    return slugs.withColumn("id", F.row_number().over(Window.orderBy("slug")))  # sources are few


@query(f"""{_STORED} SELECT (SELECT max(id) FROM art WHERE id % 4 = 0) + row_number() OVER (ORDER BY ord) AS id, url, src.id AS source_id FROM art JOIN src ON slug = source_slug WHERE art.id % 4 <> 0""")
def inserted_articles(spark, sf):
    """New articles of known sources under ids above the stored ones."""
    a = articles(spark, sf, False)
    batch = a.filter("id % 2 = 0").drop("id").unionByName(a.filter("id % 4 <> 0").drop("id"))  # some are stored already
    found = merge.insert_articles(a.filter("id % 4 = 0"), batch.dropDuplicates(["ord"]), _sources(spark, sf))
    return found.select("id", "url", F.col("source_id").cast("long").alias("source_id"))


@query(f"""{_WITH} SELECT id, CASE WHEN id % 3 = 0 THEN CASE WHEN id % 2 = 0 THEN 0.5 END ELSE relevance_score END AS relevance_score, CASE WHEN id % 3 = 0 THEN id % 2 = 0 ELSE passed_relevance END AS passed_relevance FROM art""")
def updated_relevance(spark, sf):
    """Gate fields set anew by key, nulls too."""
    a = articles(spark, sf, False).select("id", "relevance_score", "passed_relevance")
    even = F.col("id") % 2 == 0
    changes = a.filter("id % 3 = 0").select("id", F.when(even, F.lit(0.5)).alias("relevance_score"), even.alias("passed_relevance"))
    return merge.update(a, changes, "id", ["relevance_score", "passed_relevance"])


def _links(spark, sf, a):
    cats = spark.createDataFrame([(i, c) for i, c in enumerate(CATS)], "id long, slug string")
    return a.select(F.col("id").alias("article_id"), F.explode("categories").alias("slug")).join(cats.withColumnRenamed("id", "category_id"), "slug").select("article_id", "category_id"), cats


@query(f"""{_STORED} SELECT art.id AS article_id, cat.id AS category_id, CASE WHEN art.id % 3 = 0 THEN 'added' ELSE 'left' END AS how FROM art JOIN cat ON list_contains(categories, cat.slug) WHERE art.id % 3 = 0 OR art.id % 10 <> 1""")
def category_links(spark, sf):
    """Links added to analysed articles, and links left when articles go."""
    a = articles(spark, sf, False)
    stored, cats = _links(spark, sf, a.filter("id % 3 <> 0"))
    added = merge.link_categories(stored, a.withColumn("categories", F.array_append("categories", F.lit("unheard_of"))), cats)
    _, left = merge.delete_cascade(a, stored, a.filter("id % 10 = 1").select("id"))
    return added.withColumn("how", F.lit("added")).unionByName(left.withColumn("how", F.lit("left")))


@query(f"""{_WITH} SELECT id AS edition, n, CASE n WHEN 0 THEN coalesce(nullif(title_original, ''), 'news.example.cn') ELSE 'news.example.cn' END AS title, url, CASE n WHEN 0 THEN source_slug ELSE 'Unknown' END AS source, CASE n WHEN 0 THEN published_date ELSE '' END AS date, n = 0 AND is_significant AS is_significant
FROM art, (VALUES (CAST(0 AS INT)), (CAST(1 AS INT))) v(n)""")
def trail_entries(spark, sf):
    """Trail entries of every shape as rows."""
    entry = lambda title, source, date, flag: F.struct(title.alias("title"), F.lit("").alias("label"), F.lit("").alias("title_zh"), F.col("url"), source.alias("source"), date.alias("date"), flag.alias("is_significant"))
    none = F.lit(None).cast("string")
    both = F.array(entry(F.col("title_original"), F.col("source_slug"), F.col("published_date"), F.col("is_significant")), entry(none, F.lit(""), none, F.lit(None).cast("boolean")))
    return S.trail_rows(articles(spark, sf).select(F.col("id").alias("date"), both.alias("source_trail")))
