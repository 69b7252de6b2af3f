"""Normalising, filtering and enriching articles."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import dates as D
from ..functions import text as T
from ..functions import values as V

def published(df: DataFrame) -> DataFrame:
    """Rows that passed the gate and were analysed."""
    return df.filter(F.col("passed_relevance") & F.col("analyzed_at").isNotNull())


def collect_sources(readers: dict[str, Callable[[], DataFrame]], wanted: list[str]) -> tuple[DataFrame | None, list[str]]:
    """Union of the wanted sources; an unknown or failing one is reported, the rest go on."""
    found, errors = [], []
    for slug in wanted:
        if slug not in readers:
            errors.append(f"unknown source: {slug}")
            continue
        try:
            found.append(readers[slug]())
        except Exception as e:  # noqa: BLE001 one source must not end the batch
            errors.append(f"{slug}: {e}")
    return (reduce(lambda a, b: a.unionByName(b), found) if found else None), errors


def normalize(raw: DataFrame) -> DataFrame:
    """Collapsed title and text, the date's leading ISO part, and the content hash."""
    title, text = T.collapse(F.col("title_original")), T.collapse(F.col("text_original"))
    return raw.withColumns({"title_original": title, "text_original": text, "published_date": D.leading_iso(F.col("published_date")), "content_hash": T.content_hash(title, text)})


def keyword_pass(title: Column, text: Column, zh=C.KEYWORDS_ZH, en=C.KEYWORDS_EN) -> Column:
    """Title and text hold a keyword: zh as it stands, en in any case, inside words too."""
    blob = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit("")))
    quoted = lambda ks: "|".join(rf"\Q{k}\E" for k in ks)
    tests = [blob.rlike(quoted(zh))] if zh else []
    tests += [blob.rlike("(?i)" + quoted(en))] if en else []
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def keyword_split(df: DataFrame, **keywords) -> tuple[DataFrame, DataFrame]:
    """Rows that pass the keyword test, and the others with score 0 and a reason."""
    marked = df.withColumn("kw_pass", keyword_pass(F.col("title_original"), F.col("text_original"), **keywords))
    rejected = marked.filter(~F.col("kw_pass")).withColumns({"relevance_score": F.lit(0.0), "relevance_reasoning": F.lit("no keyword match"), "passed_relevance": F.lit(False)})
    return marked.filter("kw_pass").drop("kw_pass"), rejected.drop("kw_pass")


def threshold_split(df: DataFrame, threshold: float = C.THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Scores of at least the threshold, and scores below; null is in neither."""
    return df.filter(F.col("relevance_score") >= threshold), df.filter(F.col("relevance_score") < threshold)


def pending(df: DataFrame) -> DataFrame:
    """Passed, not yet analysed."""
    return df.filter(F.col("passed_relevance") & F.col("analyzed_at").isNull())


def unscored(df: DataFrame) -> DataFrame:
    """Never gated."""
    return df.filter(F.col("passed_relevance").isNull())


def state(df: DataFrame) -> DataFrame:
    """With the lifecycle state of each row: unscored, rejected, pending or analyzed."""
    s = F.when(F.col("passed_relevance").isNull(), "unscored").when(~F.col("passed_relevance"), "rejected").when(F.col("analyzed_at").isNull(), "pending").otherwise("analyzed")
    return df.withColumn("state", s)


def stuck(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Passed but without an English title, longest text first."""
    out = df.filter(F.col("passed_relevance") & (T.blank_to(F.col("title_english")) == "")).orderBy(F.desc(F.length("text_original")), "id")
    return out.limit(limit) if limit is not None else out


def unscored_between(df: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Unscored rows, by optional inclusive bounds of the date."""
    out = unscored(df)
    if since:
        out = out.filter(F.col("published_date") >= since)
    return out.filter(F.col("published_date") <= until) if until else out


def on_date(df: DataFrame, day: str) -> DataFrame:
    return published(df).filter(F.col("published_date") == day)


def in_range(df: DataFrame, first: str, last: str) -> DataFrame:
    return published(df).filter(F.col("published_date").between(first, last))


def extraction_issue(summary: Column) -> Column:
    """The summary tells that extraction failed."""
    return F.coalesce(F.lower(summary).rlike("|".join(C.EXTRACTION_SIGNALS)), F.lit(False))


def publishable() -> Column:
    """Gate passed, with an English title and a summary that isn't blank."""
    return F.coalesce(F.col("passed_relevance"), F.lit(False)) & (T.blank_to(F.col("title_english")) != "") & (T.strip(F.coalesce("summary_english", F.lit(""))) != "")


def live(scraped_at: Column, today: Column, days: int = C.LIVE_DAYS) -> Column:
    """Scraped on or after the cutoff; null is not."""
    return F.coalesce(F.left(scraped_at, F.lit(10)) >= F.date_format(F.date_sub(today, days), "yyyy-MM-dd"), F.lit(False))


def enrich(articles: DataFrame, sources: DataFrame, links: DataFrame, categories: DataFrame) -> DataFrame:
    """Articles with their source's name and slug and the sorted list of category slugs (null if none).

    The bridge is aggregated before the join, so articles are not multiplied; sources and
    categories are small dimensions that the planner broadcasts by their size.
    """
    slugs = links.join(categories.select(F.col("id").alias("category_id"), "slug"), "category_id").groupBy("article_id").agg(F.array_join(F.sort_array(F.collect_set("slug")), ",").alias("category_slugs"))
    named = articles.join(sources.select(F.col("id").alias("source_id"), F.col("slug").alias("source_slug"), F.col("display_name").alias("source_name")), "source_id")
    return named.join(slugs.withColumnRenamed("article_id", "id"), "id", "left")


def display(df: DataFrame) -> DataFrame:
    """With categories as an array and their labels, the formatted date, and the extraction flag."""
    cats = T.csv_array(F.col("category_slugs"))
    return df.withColumns({
        "categories": cats,
        "category_labels": F.transform(cats, lambda c: V.lookup(C.CATEGORY_LABELS, c, c)),
        "date_fmt": D.long_form(F.col("published_date")),
        "extraction_issue": extraction_issue(F.col("summary_english")),
    })


def record(df: DataFrame) -> DataFrame:
    """The published record of an article: 16 fields, nulls as empty strings."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return df.select(
        "id", text("title_english").alias("title_en"), text("title_original").alias("title_zh"), text("summary_english").alias("summary"),
        text("published_date").alias("date"), "date_fmt", text("source_name").alias("source"), text("source_slug").alias("source_slug"),
        "categories", "category_labels", "is_significant", text("significance_reasoning").alias("significance_reason"),
        F.bround("relevance_score", 2).alias("relevance_score"), text("url").alias("url"),
        F.concat(F.lit("articles/"), F.col("id").cast("string"), F.lit(".html")).alias("article_path"), "extraction_issue",
    )


def search(df: DataFrame, query: str = "", first: str | None = None, last: str | None = None, flagged: bool = False, categories: list[str] = ()) -> DataFrame:
    """Records whose titles and summary hold the query, within dates, flagged if asked, with any of the categories (none: all)."""
    blob = F.lower(F.concat_ws(" ", "title_en", "title_zh", "summary"))
    out = df.filter(F.contains(blob, F.lit(query.lower()))) if query else df
    if first:
        out = out.filter(F.col("date") >= first)
    if last:
        out = out.filter(F.col("date") <= last)
    if flagged:
        out = out.filter("is_significant")
    return out.filter(F.arrays_overlap("categories", F.array(*map(F.lit, categories)))) if categories else out


def whitelist(categories: Column, valid=tuple(C.CATEGORY_LABELS)) -> Column:
    """Only categories of the taxonomy, in order."""
    return F.filter(categories, lambda c: c.isin(*valid))


def empty_source(spark: SparkSession) -> DataFrame:
    """A source that has nothing yet."""
    return spark.createDataFrame([], "url string, source_slug string, title_original string, text_original string, published_date string")
