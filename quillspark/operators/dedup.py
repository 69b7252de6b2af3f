"""Exact copies and syndicated reposts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut


def ranked_copies(df: DataFrame, order: str = "ord") -> DataFrame:
    """With title_hash and copy_rank: 1 is the copy to keep of all with one normal title.

    The copy of the best section wins, then the shortest URL, then the earliest. Rows without
    a title are each their own group.
    """
    hashed = df.withColumn("title_hash", T.title_hash(F.col("title_original"))).withColumn("_p", T.section_priority(F.col("url")))
    key = [F.col("title_hash"), F.when(F.col("title_hash") == "", F.col(order))]
    best = Window.partitionBy(*key).orderBy(F.desc("_p"), F.length("url"), order)
    return hashed.withColumn("copy_rank", F.row_number().over(best)).drop("_p")


def drop_reposts(df: DataFrame, order: str = "ord") -> DataFrame:
    """One row of each title. Only the best key is aggregated, so a title of many copies needs no sort."""
    hashed = df.withColumn("title_hash", T.title_hash(F.col("title_original")))
    titled = hashed.filter("title_hash <> ''")
    key = F.struct(-T.section_priority(F.col("url")), F.length("url"), F.col(order))
    best = titled.groupBy("title_hash").agg(F.min(key).alias("k")).select(F.col("k")[order].alias(order))
    return titled.join(best, order, "left_semi").unionByName(hashed.filter("title_hash = ''"))


def repost_groups(df: DataFrame) -> DataFrame:
    """title_hash and size of groups of more than one."""
    return df.withColumn("title_hash", T.title_hash(F.col("title_original"))).filter("title_hash <> ''").groupBy("title_hash").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def repost_losers(df: DataFrame, order: str = "ord") -> DataFrame:
    """Rows that a clean-up of stored reposts deletes."""
    return ranked_copies(df, order).filter("title_hash <> '' AND copy_rank > 1")


def new_articles(batch: DataFrame, stored: DataFrame, order: str = "ord") -> DataFrame:
    """Rows of the batch that are new by URL and by content hash, as a greedy scan in order keeps them.

    Rows that the store has go first: their keys keep out nothing that the store wouldn't.
    Rows whose URL and hash stand alone then pass at once. Only rows whose URLs and hashes
    conflict crosswise need rounds.
    """
    keys = batch.select(order, "url", "content_hash")
    fresh = cut(keys.join(stored.select("url").distinct(), "url", "left_anti").join(stored.select("content_hash").distinct(), "content_hash", "left_anti"))
    by_url = fresh.groupBy("url").agg(F.count(F.lit(1)).alias("_u"))
    by_hash = fresh.groupBy("content_hash").agg(F.count(F.lit(1)).alias("_h"))
    keyed = fresh.join(by_url, "url").join(by_hash, "content_hash")
    alone = keyed.filter("_u = 1 AND _h = 1").select(order)
    rest = keyed.filter("_u > 1 OR _h > 1").select(order, "url", "content_hash", "_u", "_h")
    # Where only hashes are shared, or only URLs, the first row of a group is the one that stays.
    sides = []
    for key, other in (("content_hash", "_u"), ("url", "_h")):
        sides.append(rest.groupBy(key).agg(F.min(order).alias(order), F.max(other).alias("_m"), F.count(F.lit(1)).alias("_n")).filter("_m = 1 AND _n > 1"))
    firsts = sides[0].select(order).unionByName(sides[1].select(order))
    mixed = rest.join(sides[0].select("content_hash"), "content_hash", "left_anti").join(sides[1].select("url"), "url", "left_anti")
    return batch.join(alone.unionByName(firsts).unionByName(_greedy(mixed, order)), order, "left_semi")


def _greedy(rows: DataFrame, order: str) -> DataFrame:
    """The orders that a greedy scan keeps, in rounds.

    A row that is first of all with its URL and of all with its hash stays, whatever comes
    later; what shares a key with it goes, and the next round looks at the rest. A round is
    two aggregations and joins, so no cluster of rows has to fit a task. Exact copies (both
    keys) are one row: the earliest.
    """
    left = cut(rows.groupBy("url", "content_hash").agg(F.min(order).alias(order)))
    kept = left.select(order).limit(0)
    while left.limit(1).count():
        for key in ("url", "content_hash"):
            left = left.join(left.groupBy(key).agg(F.min(order).alias(f"_{key}")), key)
        left = cut(left)
        now = left.filter((F.col("_url") == F.col(order)) & (F.col("_content_hash") == F.col(order)))
        kept = kept.unionByName(now.select(order))
        left = cut(left.select(order, "url", "content_hash").join(now.select("url"), "url", "left_anti").join(now.select("content_hash"), "content_hash", "left_anti"))
    return kept


def ordered_distinct(array_col):
    """First occurrences, in order."""
    return F.array_distinct(array_col)


def replace_tagged(array_col, is_old, new):
    """The array without items that is_old picks, and with the new one at its end."""
    return F.array_append(F.filter(array_col, lambda x: ~is_old(x)), new)
