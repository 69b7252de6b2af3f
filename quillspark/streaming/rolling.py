"""Rolling windows that are kept up: a row for each day, to which every batch adds its own rows.

Counts of days add up, so a batch is aggregated by day and merged into the table of days; what
was counted before is never read again. Windows are anchored on the latest day of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..plans.versions import Store


def day_counts(rows: DataFrame) -> DataFrame:
    """day, total and flagged of rows (published_date, is_significant); rows without a valid date are left out."""
    day = rows.select(D.strict(F.col("published_date")).alias("day"), F.coalesce("is_significant", F.lit(False)).alias("flag"))
    return day.filter("day IS NOT NULL").groupBy("day").agg(F.count(F.lit(1)).alias("total"), F.count_if("flag").alias("flagged"))


def add(days: DataFrame | None, more: DataFrame) -> DataFrame:
    """Two tables of days as one."""
    both = more if days is None else days.unionByName(more)
    return both.groupBy("day").agg(F.sum("total").alias("total"), F.sum("flagged").alias("flagged"))


def update(store: Store, rows: DataFrame, batch: int, table: str = "days") -> int:
    """Add the rows of a batch to the table of days by one commit; a batch (numbers ascend) that was added before changes nothing."""
    if store.entry()["notes"].get(f"{table}_batch", -1) >= batch:
        return store.latest()
    there = store.read(table) if store.has(table) else None
    return store.commit({table: add(there, day_counts(rows))}, notes={f"{table}_batch": batch})


def anchor(days: DataFrame) -> DataFrame:
    """One row: the latest day."""
    return days.agg(F.max("day").alias("today"))


def window_totals(days: DataFrame, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """days, total and flagged of the trailing windows."""
    dated = days.crossJoin(F.broadcast(anchor(days)))  # one row
    inside = [F.col("day") >= F.date_sub("today", w - 1) for w in windows]
    sums = [F.struct(F.lit(w).alias("days"), F.coalesce(F.sum(F.when(i, F.col("total"))), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(i, F.col("flagged"))), F.lit(0)).alias("flagged")) for w, i in zip(windows, inside)]
    return dated.agg(F.array(*sums).alias("w")).select(F.inline("w"))


def series(days: DataFrame, length: int = 30, window: int = 7) -> DataFrame:
    """day, total and flagged of each of the last days, zeros included, and the totals of the window that ends with it."""
    spine = anchor(days).select(F.explode(F.sequence(F.date_sub("today", length + window - 2), F.col("today"))).alias("day"), "today")
    full = spine.join(days, "day", "left").select("day", "today", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("flagged", F.lit(0)).alias("flagged"))
    back = Window.orderBy("day").rowsBetween(1 - window, 0)  # a row for each of few days
    full = full.withColumns({"window_total": F.sum("total").over(back), "window_flagged": F.sum("flagged").over(back)})
    return full.filter(F.col("day") > F.date_sub("today", length)).select("day", "total", "flagged", "window_total", "window_flagged")
