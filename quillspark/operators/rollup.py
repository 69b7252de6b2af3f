"""Daily and weekly rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import dates as D
from ..functions import text as T
from ..functions import values as V


def latest_day(df: DataFrame) -> DataFrame:
    """One row: the greatest valid date. Missing and invalid dates never count as the latest."""
    return df.agg(F.max(D.strict(F.col("published_date"))).alias("today"))


def _brief_keys() -> list[Column]:
    return [F.desc("is_significant"), V.category_priority(F.col("categories")), F.desc(F.coalesce("relevance_score", F.lit(0.0))), F.col("id")]


def daily_brief(df: DataFrame) -> DataFrame:
    """Rows of the latest day with brief_rank: flagged first, then by category priority, then relevance."""
    day = latest_day(df).select(F.date_format("today", "yyyy-MM-dd").alias("published_date"))
    return df.join(F.broadcast(day), "published_date").withColumn("brief_rank", F.row_number().over(Window.partitionBy("published_date").orderBy(*_brief_keys())))


def day_order(df: DataFrame) -> DataFrame:
    """Every row with its rank within its day; rows without a date are left out."""
    return df.filter(T.blank_to(F.col("published_date")) != "").withColumn("brief_rank", F.row_number().over(Window.partitionBy("published_date").orderBy(*_brief_keys())))


def category_counts(df: DataFrame, k: int | None = None) -> DataFrame:
    """category, n and rank by frequency; ties go to the name."""
    n = df.select(F.explode("categories").alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    top = n.orderBy(F.desc("n"), "category").limit(k) if k else n
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "category")))


def dominant_labels(df: DataFrame, k: int = 3) -> DataFrame:
    """Labels of the k most frequent categories, extraction issues left out."""
    return category_counts(df.filter("NOT extraction_issue"), k).withColumn("label", V.lookup(C.CATEGORY_LABELS, F.col("category"), F.col("category")))


def in_window(df: DataFrame, days: int) -> DataFrame:
    """Rows of the last `days` days up to the latest date, that day included."""
    day = D.strict(F.col("published_date"))
    return df.withColumn("_d", day).join(F.broadcast(latest_day(df)), F.col("_d").between(F.date_sub("today", days - 1), F.col("today"))).drop("_d", "today")


def window_stats(df: DataFrame, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """days, total and flagged of each trailing window."""
    day = df.select(D.strict(F.col("published_date")).alias("d"), "is_significant").crossJoin(F.broadcast(latest_day(df)))  # one row
    aggs = [F.struct(F.lit(w).alias("days"), F.count_if(F.col("d") >= F.date_sub("today", w - 1)).alias("total"), F.count_if((F.col("d") >= F.date_sub("today", w - 1)) & F.col("is_significant")).alias("flagged")) for w in windows]
    return day.agg(*(a.alias(f"w{i}") for i, a in enumerate(aggs))).select(F.inline(F.array(*(F.col(f"w{i}") for i in range(len(windows))))))


def daily_series(df: DataFrame, days: int = 30) -> DataFrame:
    """day, total and flagged of each of the last days, zeros included."""
    spine = latest_day(df).select(F.explode(F.sequence(F.date_sub("today", days - 1), F.col("today"))).alias("day"))
    n = df.groupBy(D.strict(F.col("published_date")).alias("day")).agg(F.count(F.lit(1)).alias("total"), F.count_if("is_significant").alias("flagged"))
    return spine.join(n, "day", "left").select("day", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("flagged", F.lit(0)).alias("flagged"))


def source_mix(df: DataFrame, days: int = 30, k: int = 10) -> DataFrame:
    """source, n, rank and share of the most frequent one, in the trailing window."""
    n = in_window(df, days).groupBy(F.coalesce("source_name", F.lit("Unknown")).alias("source")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(k)
    every = Window.orderBy(F.desc("n"), "source")
    return n.withColumn("rank", F.row_number().over(every)).withColumn("height", F.round(F.col("n") / F.max("n").over(Window.partitionBy()) * 100, 1))


def source_status(df: DataFrame, configured: DataFrame) -> DataFrame:
    """Every configured source with its count, or its fallback status."""
    n = df.groupBy("source_slug").agg(F.count(F.lit(1)).alias("n"))
    out = configured.join(n, configured["slug"] == n["source_slug"], "left")
    return out.select("slug", "name", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.coalesce("n", F.lit(0)) > 0, "collected").otherwise(F.col("fallback")).alias("status"))


def totals(df: DataFrame) -> DataFrame:
    """Total, flagged, percentage flagged, distinct sources."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if("is_significant").alias("flagged"), F.try_divide(F.count_if("is_significant") * F.lit(100.0), F.count(F.lit(1))).alias("pct"), F.countDistinct("source_slug").alias("sources"))


def recent_dates(df: DataFrame, k: int = 30) -> DataFrame:
    return df.filter(T.blank_to(F.col("published_date")) != "").select("published_date").distinct().orderBy(F.desc("published_date")).limit(k)


def readout(df: DataFrame) -> DataFrame:
    """One row on a day's brief (with brief_rank): its kind, counts, lead, sole source, and labels by frequency.

    kind: empty (nothing clean), flagged (a flagged item) or routine. The lead is the first by rank,
    of flagged items if there are any.
    """
    clean = df.filter("NOT extraction_issue")
    facts = clean.agg(
        F.count(F.lit(1)).alias("n_clean"), F.count_if("is_significant").alias("n_flagged"),
        F.min(F.struct(~F.col("is_significant"), "brief_rank", T.short_title(F.col("title_english"), F.col("title_original")).alias("title"), V.lead_category(F.col("categories")).alias("lead"))).alias("top"),
        F.countDistinct(F.nullif("source_name", F.lit(""))).alias("n_sources"), F.max("source_name").alias("a_source"),
    )
    labels = lambda part, name: part.agg(F.lit(1).alias("_k")) if part is None else dominant_labels(part).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]), ", ").alias(name))  # noqa: E731  at most three rows
    out = facts.crossJoin(F.broadcast(labels(clean, "dominant"))).crossJoin(F.broadcast(labels(clean.filter("is_significant"), "flagged_labels"))).crossJoin(F.broadcast(labels(clean.filter("NOT is_significant"), "routine_labels")))
    return out.select(
        F.when(F.col("n_clean") == 0, "empty").when(F.col("n_flagged") > 0, "flagged").otherwise("routine").alias("kind"), "n_clean", "n_flagged",
        F.coalesce("top.title", F.lit("")).alias("lead_title"), F.coalesce("top.lead", F.lit("")).alias("lead_category"),
        F.when(F.col("n_sources") == 1, F.col("a_source")).alias("sole_source"), "dominant", "flagged_labels", "routine_labels",
    )


def weekly_stats(df: DataFrame) -> DataFrame:
    """One row per week ending (Saturday): totals, distinct days and sources, most frequent category."""
    week = df.withColumn("week_ending", D.week_ending(D.strict(F.col("published_date")))).filter("week_ending IS NOT NULL")
    facts = week.groupBy("week_ending").agg(
        F.count(F.lit(1)).alias("n_articles"), F.count_if("is_significant").alias("n_significant"),
        F.countDistinct("published_date").alias("days_covered"), F.array_join(F.sort_array(F.collect_set("source_slug")), ",").alias("sources"),
    )
    cats = week.select("week_ending", F.explode("categories").alias("category")).groupBy("week_ending", "category").agg(F.count(F.lit(1)).alias("n"))
    top = cats.groupBy("week_ending").agg(F.min(F.struct((-F.col("n")).alias("m"), "category")).alias("k")).select("week_ending", F.col("k.category").alias("top_category"))
    return facts.join(top, "week_ending", "left").withColumn("week_start", D.week_start(F.col("week_ending")))


def source_trail(df: DataFrame, cap: int = C.TRAIL_CAP, by: str | None = None, order: str = "id") -> DataFrame:
    """trail_rank and truncated: flagged rows in their order, then routine ones by relevance, at most `cap` (of each `by`)."""
    keys = [F.desc("is_significant"), F.when(~F.col("is_significant"), F.coalesce("relevance_score", F.lit(0.0))).desc(), F.col(order)]
    part = Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))
    n = (df.groupBy(by) if by else df.groupBy()).agg(F.count(F.lit(1)).alias("_n"))
    ranked = df.withColumn("trail_rank", F.row_number().over(part.orderBy(*keys))).filter(F.col("trail_rank") <= cap)
    joined = ranked.join(n, by) if by else ranked.crossJoin(F.broadcast(n))  # n is one row
    return joined.withColumn("truncated", F.col("_n") > cap).drop("_n")


def edition_index(editions: DataFrame) -> DataFrame:
    """Editions by date with number, previous and next date, gap in days, and whether the gap is a week."""
    by = Window.orderBy("date")
    gap = F.datediff("date", F.lag("date").over(by))
    return editions.withColumns({"issue_number": F.row_number().over(by), "previous": F.lag("date").over(by), "next": F.lead("date").over(by), "gap_days": gap}).withColumn("on_time", F.coalesce(F.col("gap_days") == 7, F.lit(True)))


def edition_label(edition_type: Column, days: Column) -> Column:
    base = F.when(edition_type == "significant", "Significant").otherwise("Routine")
    return F.when(days < 4, F.concat(F.lit("Thin week · "), F.lower(base))).otherwise(base)


def latest_flagged(df: DataFrame, k: int = 3) -> DataFrame:
    """The k newest flagged rows without extraction issues."""
    return df.filter("is_significant AND NOT extraction_issue").orderBy(F.desc("published_date"), F.desc("relevance_score"), "id").limit(k)
