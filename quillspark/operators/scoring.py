"""Scoring candidates against a text by shared tokens and properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V


def token_overlap(a: Column, b: Column) -> Column:
    """Distinct tokens that both arrays hold."""
    return F.size(F.array_intersect(a, b))


#: Token rows of the items up to which their index is broadcast, and the parts of a hot token beyond.
BROADCAST_ROWS, SALTS = 500_000, 32


def overlap_scores(texts: DataFrame, items: DataFrame, k: int = 3, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """For each text (doc_id, text) the k items (item_id, text) that share most distinct tokens, by an inverted index of the items.

    Only pairs that share a token meet. An index of bounded size goes to the texts, whose
    tokens then need no exchange; a larger one is joined by token and a part of the doc_ids,
    so that a common token is spread over many tasks. Ties go to the smaller item_id.
    """
    a = texts.select("doc_id", F.explode(F.array_distinct(T.without(T.tokens(F.col("text"))))).alias("token"))
    b = items.select("item_id", F.explode(F.array_distinct(T.without(T.tokens(F.col("text"))))).alias("token"))
    if b.limit(broadcast_rows + 1).count() <= broadcast_rows:
        met = a.join(F.broadcast(b), "token")
    else:
        salted = a.withColumn("_salt", F.pmod(F.hash("doc_id"), F.lit(SALTS)))
        met = salted.join(b.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["token", "_salt"])
    n = met.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("overlap"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("overlap"), "item_id"))
    return n.withColumn("rank", rank).filter(F.col("rank") <= k)


def image_score(label: Column, width: Column, height: Column, overlap: Column, institutional: Column, low_value: Column) -> Column:
    """Licence, size, shape and topic of an image as one score."""
    low = F.lower(label)
    licence = F.when(low.rlike("public domain|cc0"), 4).when(low.rlike("cc by-sa|cc-by-sa"), 2).when(low.rlike("cc by|cc-by"), 3).otherwise(0)
    size = F.when(width >= 1600, 3).when(width >= 1200, 2).when(width >= 800, 1).otherwise(0)
    shape = F.when(F.coalesce(height, F.lit(0)) == 0, 0).when(width >= height, 2).when(width / height >= 0.85, 1).otherwise(0)
    return F.bround(licence + size + shape + F.least(overlap, F.lit(5)) + F.when(institutional, 1.5).otherwise(0.0) - F.when(low_value, 1).otherwise(0), 2)


def image_rejection(short: Column, field: Column, width: Column, height: Column) -> Column:
    """The first rule that rejects an image: licence, then size; null if none does."""
    return F.when(~V.license_allowed(short, field), "license").when((width < 800) | (height < 500), "resolution")
