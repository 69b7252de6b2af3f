"""Upserts, cascades, the three-way keyed merge and its gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

ANALYSIS = ("relevance_score", "relevance_reasoning", "passed_relevance", "title_english", "text_english", "summary_english", "analyzed_at", "is_significant", "significance_reasoning", "model_id", "prompt_version")


def next_ids(rows: DataFrame, taken: DataFrame, order: str, column: str = "id") -> DataFrame:
    """rows with ids above the greatest taken, dense, in order.

    Numbers are given inside range partitions and shifted by the counts of those before, so
    no single task sees all rows. The ranged rows are written first: a lost executor cannot
    deal them out anew after they are counted.
    """
    top = taken.agg(F.coalesce(F.max(column), F.lit(0))).first()[0]
    spread = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id())
    spread = cut(spread)
    counts = {r["_part"]: r["n"] for r in spread.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    start, before = {}, top
    for p in sorted(counts):
        start[p], before = before, before + counts[p]
    if not start:
        return rows.withColumn(column, F.lit(None).cast("long"))
    base = F.create_map(*(F.lit(x) for kv in start.items() for x in kv))
    number = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return spread.withColumn(column, (F.element_at(base, F.col("_part")) + number).cast("long")).drop("_part")


def insert_articles(stored: DataFrame, batch: DataFrame, sources: DataFrame, order: str = "ord") -> DataFrame:
    """Rows to append: known sources only, URLs not stored, one per URL, with new ids."""
    known = batch.join(sources.select(F.col("slug").alias("source_slug"), F.col("id").alias("source_id")), "source_slug")
    fresh = known.join(stored.select("url"), "url", "left_anti")
    first = fresh.groupBy("url").agg(F.min(order).alias(order))
    return next_ids(fresh.join(first, ["url", order], "left_semi"), stored, order)


def update(stored: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """stored with the columns of changes where the key is there; a null change is a change."""
    new = changes.select(key, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_hit"))
    joined = stored.join(new, key, "left")
    return joined.select(*(F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in stored.columns))


def link_categories(links: DataFrame, analysed: DataFrame, categories: DataFrame) -> DataFrame:
    """Links to add: (article_id, category_id) of known slugs that are not there yet."""
    asked = analysed.select(F.col("id").alias("article_id"), F.explode("categories").alias("slug")).join(categories.select("slug", F.col("id").alias("category_id")), "slug")
    return asked.select("article_id", "category_id").distinct().join(links, ["article_id", "category_id"], "left_anti")


def delete_cascade(articles: DataFrame, links: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the given ids."""
    return articles.join(ids, "id", "left_anti"), links.join(ids.select(F.col("id").alias("article_id")), "article_id", "left_anti")


def _decides(local: str, origin: str):
    analysed = F.col(f"{local}.analyzed_at").isNotNull() & F.col(f"{origin}.analyzed_at").isNull()
    decided = F.col(f"{local}.passed_relevance").isNotNull() & F.col(f"{origin}.passed_relevance").isNull()
    return analysed | decided


def _won(origin: DataFrame, local: DataFrame, columns: list[str]) -> DataFrame:
    """url, the ids on both sides and local's analysis of the rows where local is further on."""
    both = local.alias("l").join(origin.alias("o"), F.col("l.url") == F.col("o.url")).filter(_decides("l", "o"))
    return both.select(F.col("l.url").alias("url"), F.col("l.id").alias("local_id"), F.col("o.id").alias("origin_id"), *(F.col(f"l.{c}").alias(c) for c in columns))


def three_way_merge(base: DataFrame, origin: DataFrame, local: DataFrame, columns=ANALYSIS) -> DataFrame:
    """origin, with rows that only local has under new ids, and local's analysis where it is further on.

    Rows are matched by url. Local wins where it analysed and origin did not, or decided and
    origin did not. base serves the gates only.
    """
    columns = [c for c in columns if c in origin.columns]
    kept = update(origin, _won(origin, local, columns), "url", columns)
    fresh = local.join(origin.select("url"), "url", "left_anti").withColumnRenamed("id", "local_id")
    return kept.unionByName(next_ids(fresh, origin, "local_id").drop("local_id").select(*origin.columns))


def id_map(merged: DataFrame, local: DataFrame) -> DataFrame:
    """Local id to merged id."""
    return local.select("url", F.col("id").alias("local_id")).join(merged.select("url", "id"), "url").select("local_id", "id")


def remap(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """rows with the column's ids replaced where the mapping (old, new) knows them."""
    m = mapping.toDF("_old", "_new")
    return rows.join(m, rows[column] == m["_old"], "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def reconcile(base: dict[str, DataFrame], origin: dict[str, DataFrame], local: dict[str, DataFrame], columns=ANALYSIS) -> tuple[dict[str, DataFrame], DataFrame]:
    """The merged tables (articles, links, runs) and the report (counter, n).

    Runs that base lacks were written by local and get new ids above origin's; articles that
    only local has get new ids and the new id of their run; origin takes local's analysis
    where that is further on. Category links follow both kinds of articles. Every table keeps
    origin's columns.
    """
    check_columns(origin["articles"], columns)
    own = local["runs"].join(base["runs"].select("id"), "id", "left_anti").withColumn("local_id", F.col("id"))
    runs = cut(next_ids(own, origin["runs"], "local_id"))
    there, mine = origin["articles"], local["articles"]
    fresh = remap(mine.join(there.select("url"), "url", "left_anti"), runs.select("local_id", "id"), "scrape_run_id")
    fresh = cut(next_ids(fresh.withColumnRenamed("id", "local_id"), there, "local_id"))
    won = cut(_won(there, mine, list(columns)))

    def linked(ids: DataFrame) -> DataFrame:
        asked = local["links"].withColumnRenamed("article_id", "local_id").join(ids, "local_id").select(F.col("id").alias("article_id"), "category_id").distinct()
        return asked.join(origin["links"], ["article_id", "category_id"], "left_anti")

    for_new, for_shared = cut(linked(fresh.select("local_id", "id"))), cut(linked(won.select("local_id", F.col("origin_id").alias("id"))))
    merged = {
        "runs": origin["runs"].unionByName(runs.select(*origin["runs"].columns)),
        "articles": update(there, won, "url", list(columns)).unionByName(fresh.select(*there.columns)),
        "links": origin["links"].unionByName(for_new).unionByName(for_shared),
    }
    counted = {"scrape_runs_remapped": runs, "articles_inserted": fresh, "categories_for_new_rows": for_new, "analysis_backfilled": won, "categories_for_shared_rows": for_shared}
    report = reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("counter"), "n") for name, df in counted.items()])
    return merged, report


def fingerprint(table: DataFrame) -> tuple:
    """Rows and a sum over SHA-256 of the rows: equal for equal contents, in whatever order or files they lie."""
    digest = F.sha2(F.to_json(F.struct(*sorted(table.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    return tuple(table.agg(F.count(F.lit(1)), *parts).first())


def published_side(a: DataFrame, b: DataFrame, published: DataFrame) -> str:
    """Which of two tables is the published one, by content: "a" (also where both are) or "b"; an error if neither is.

    Ids of the published side are public, so a merge that cannot tell refuses.
    """
    wanted = fingerprint(published)
    for name, side in (("a", a), ("b", b)):
        if sorted(side.columns) == sorted(published.columns) and fingerprint(side) == wanted:
            return name
    raise ValueError("neither side is the published one")


def orphan_links(links: DataFrame, articles: DataFrame, categories: DataFrame) -> DataFrame:
    """gate, violations: links (article_id, category_id) whose article or category is not there."""
    lost = lambda key, df, name: links.join(df.select(F.col("id").alias(key)), key, "left_anti").agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("gate"), "violations")
    return lost("article_id", articles, "links_without_article").unionByName(lost("category_id", categories, "links_without_category"))


def gates(base: DataFrame, origin: DataFrame, local: DataFrame, merged: DataFrame) -> DataFrame:
    """gate and violations; a merge is sound if all are 0."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("gate"), "violations")
    decided = lambda df: df.filter("passed_relevance IS NOT NULL").select("url")
    undecided = merged.filter("passed_relevance IS NULL").select("url")
    parts = [
        count(merged.groupBy("url").count().filter("count > 1"), "duplicate_urls"),
        count(merged.alias("m").join(base.alias("b"), F.col("m.url") == F.col("b.url")).filter("m.id <> b.id"), "id_drift"),
        count(origin.join(merged.select("url"), "url", "left_anti"), "lost_from_origin"),
        count(local.join(merged.select("url"), "url", "left_anti"), "lost_from_local"),
        count(decided(origin).join(undecided, "url", "left_semi"), "decisions_lost_from_origin"),
        count(decided(local).join(undecided, "url", "left_semi"), "decisions_lost_from_local"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def symmetric_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, and which."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return left.join(right, key, "left_anti").withColumn("side", F.lit("left")).unionByName(right.join(left, key, "left_anti").withColumn("side", F.lit("right")))


def check_columns(df: DataFrame, needed=ANALYSIS) -> None:
    """Refuse tables that lack a column that the merge carries over."""
    if missing := [c for c in needed if c not in df.columns]:
        raise ValueError(f"columns missing: {', '.join(missing)}")
