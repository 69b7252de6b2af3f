"""Outputs: records, feeds, sitemaps, upserts by rewriting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..operators.merge import next_ids
from .versions import Store


def write_records(records: DataFrame, path: str, partitions: int | None = None) -> None:
    """Records as JSON lines."""
    (records.coalesce(partitions) if partitions else records).write.mode("overwrite").json(path)


def seed(store: Store, table: str, rows: DataFrame, key: str) -> int:
    """Create the table, or append the rows whose key it lacks."""
    if not store.has(table):
        return store.commit({table: rows})
    return store.commit(append={table: rows.join(store.read(table).select(key), key, "left_anti").select(*rows.columns)})


def run_log(spark: SparkSession, started: str, completed: str, counters: dict[str, int], errors: list[str], status: str = "completed") -> DataFrame:
    """One row on a run, errors as a JSON array."""
    row = spark.createDataFrame([(started, completed, errors, status)], "started_at string, completed_at string, errors array<string>, status string")
    return row.withColumn("errors", F.to_json("errors")).withColumns({k: F.lit(v).cast("long") for k, v in counters.items()})


def sitemap_urls(base: str, fixed: list[str], editions: DataFrame, articles: DataFrame) -> DataFrame:
    """tier, n and loc: fixed pages, then editions by date, then articles by id."""
    spark = articles.sparkSession
    one = spark.createDataFrame([(0, i, base + p) for i, p in enumerate(fixed)], "tier int, n long, loc string")
    two = editions.select(F.lit(1).alias("tier"), F.unix_date(D.strict(F.col("date"))).cast("long").alias("n"), F.concat(F.lit(base + "editions/"), "date", F.lit(".html")).alias("loc"))
    three = articles.select(F.lit(2).alias("tier"), F.col("id").alias("n"), F.concat(F.lit(base + "articles/"), F.col("id").cast("string"), F.lit(".html")).alias("loc"))
    return one.unionByName(two).unionByName(three)


def sitemap_lines(urls: DataFrame) -> DataFrame:
    """An element a row; writers put head and tail around them."""
    return urls.select("tier", "n", F.concat(F.lit("<url><loc>"), T.escape_html(F.col("loc")), F.lit("</loc></url>")).alias("value"))


def feed_entries(editions: DataFrame, base: str, k: int = 50) -> DataFrame:
    """The newest editions as Atom entries; times come from the data, never from the clock."""
    newest = editions.orderBy(F.desc("date")).limit(k)
    entry = F.concat(
        F.lit("<entry><title>"), T.escape_html(F.coalesce("title", F.lit(""))), F.lit("</title><id>" + base), F.col("date"), F.lit(".html</id><updated>"), F.col("date"),
        F.lit("T00:00:00Z</updated><summary>"), T.escape_html(F.coalesce("dek", F.lit(""))), F.lit("</summary></entry>"),
    )
    return newest.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("date")))).select("rank", "date", entry.alias("entry"))


def orphans(files: DataFrame, table: DataFrame) -> DataFrame:
    """Files (id, path) whose id the table lacks: to be deleted."""
    return files.join(table.select("id"), "id", "left_anti")


def plain_post(e: DataFrame) -> DataFrame:
    """date and a plain-text post of the fields that are not empty."""
    part = lambda head, c: F.when(T.blank_to(F.col(c)) != "", F.concat(F.lit(head), F.col(c)))
    fields = [part("", "title"), part("", "dek"), part("Signal: ", "signal"), F.nullif(F.split_part("opening_note", F.lit("\n\n"), F.lit(1)), F.lit("")), part("What stood out\n", "what_stood_out"), part("Why it matters\n", "why_it_matters"), part("What comes next\n", "what_im_watching_next")]
    return e.select("date", F.concat_ws("\n\n", *fields).alias("post"))


def prompt_block(df: DataFrame) -> DataFrame:
    """n (from 1) and a text block of each article, in order of id; numbers are dealt inside ranges of ids, so no task sees all rows."""
    n = F.col("n")
    numbered = next_ids(df, df.select(F.lit(0).cast("long").alias("n")).limit(0), "id", "n")
    return numbered.select("n", F.format_string("[%d] %s\nSource: %s | Date: %s | Score: %.2f\n%s", n, F.coalesce("title_english", F.lit("")), F.coalesce("source_name", F.lit("")), F.coalesce("published_date", F.lit("")), F.coalesce("relevance_score", F.lit(0.0)), F.coalesce("summary_english", F.lit(""))).alias("block"))
