"""Readers of editions, manifests and stored tables, and constant relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C

TRAIL = "array<struct<title:string,label:string,title_zh:string,url:string,source:string,date:string,is_significant:boolean>>"
#: Every shape that editions have had.
EDITION = (
    "date string, week_ending string, week_start string, issue_number int, title string, dek string, signal string, opening_note string, what_stood_out string, "
    "why_it_matters string, what_was_routine string, term_to_know_term string, term_to_know_explanation string, term_to_know struct<term:string,term_translation:string,explanation:string>, "
    f"what_im_watching_next string, n_articles int, n_significant int, days_covered int, edition_type string, edition_label string, source_trail {TRAIL}, sources_seen array<string>, "
    "author_name string, author_title string, author_bio string, author_links map<string,string>, cover_image string, cover_thumb string, cover_image_url string, "
    "media_items array<struct<type:string,src:string,alt:string,caption:string,credit:string,license:string,source_url:string,image_url:string,auto_selected:boolean>>, _corrupt_record string"
)


def editions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Readable editions with file_name and file_date (those without a date are left out), and file_name and date of files that are not."""
    raw = spark.read.schema(EDITION).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    raw = raw.withColumn("file_name", F.col("_metadata.file_name")).withColumn("file_date", F.regexp_extract("file_name", r"(\d{4}-\d{2}-\d{2})\.json$", 1))
    return raw.filter("_corrupt_record IS NULL AND date IS NOT NULL").drop("_corrupt_record"), raw.filter("_corrupt_record IS NOT NULL").select("file_name", "date")


def flat_terms(e: DataFrame) -> DataFrame:
    """The glossary term of each edition, from either shape; editions without one are left out."""
    term = F.coalesce(F.nullif("term_to_know_term", F.lit("")), F.concat_ws(" ", "term_to_know.term", "term_to_know.term_translation"))
    return e.select("date", term.alias("term"), F.coalesce(F.nullif("term_to_know_explanation", F.lit("")), F.col("term_to_know.explanation"), F.lit("")).alias("explanation")).filter("trim(term) <> ''")


def trail_rows(e: DataFrame, source: str = "Unknown") -> DataFrame:
    """One row per trail entry: its title, else its label, else its host."""
    rows = e.select("date", F.posexplode("source_trail").alias("n", "t"))
    host = F.regexp_extract("t.url", r"://([^/?#]*)", 1)
    some = lambda *cs: F.coalesce(*(F.nullif(c, F.lit("")) for c in cs))
    return rows.select(F.col("date").alias("edition"), "n", some(F.col("t.title"), F.col("t.label"), host).alias("title"), F.col("t.url").alias("url"), F.coalesce(some(F.col("t.source")), F.lit(source)).alias("source"), F.coalesce("t.date", F.lit("")).alias("date"), F.coalesce("t.is_significant", F.lit(False)).alias("is_significant"))


def fill_titles(trail: DataFrame, known: DataFrame) -> DataFrame:
    """Trail rows with the original title of the article of exactly that url."""
    return trail.join(known.select("url", F.col("title_original").alias("title_zh")), "url", "left")


def manifest(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """Manifest entries whose file (path) exists, with their place in the list."""
    schema = "id string, file string, alt string, placement string, treatment string, match struct<article_urls:array<string>,categories:array<string>,threads:array<string>,editions:array<string>,routes:array<string>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("n", F.monotonically_increasing_id())
    return raw.filter("file IS NOT NULL").join(files.select(F.col("path").alias("file")), "file", "left_semi")


def match_manifest(entries: DataFrame, articles: DataFrame, route: str) -> DataFrame:
    """For each article (url) the first entry for the route that names it."""
    named = entries.filter(F.array_contains("match.routes", route)).select("id", "n", F.explode("match.article_urls").alias("url"))
    first = named.groupBy("url").agg(F.min_by("id", "n").alias("entry_id"))
    return articles.join(first, "url")


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i + 1, s, t) for i, (s, t) in enumerate(C.CATEGORY_LABELS.items())], "id long, slug string, display_name string")
