"""The capacity-bounded queue of work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C


def quotas(n_new: int, n_backlog: int, capacity: int = C.CAPACITY, reserve: float = C.RESERVE) -> tuple[int, int]:
    """How many new and how many backlog rows a run takes: some places are kept for the backlog, and it takes what new rows leave."""
    held = 0 if not n_backlog else min(n_backlog, max(1, round(capacity * reserve)))
    new = min(n_new, max(0, capacity - held))
    return new, min(n_backlog, max(0, capacity - new))


def analysis_queue(new: DataFrame, pending: DataFrame, unscored: DataFrame, capacity: int = C.CAPACITY, reserve: float = C.RESERVE) -> tuple[DataFrame, dict[str, int]]:
    """position and id of the rows to work on, and counts of what waits.

    new: id, ord; pending: id; unscored: id, live. Order: new rows; then passed rows by id;
    then unscored ones, live before archived. Only as many rows as the capacity are sorted
    out of each tier.
    """
    waiting = pending.select("id").join(new.select("id"), "id", "left_anti").withColumns({"tier": F.lit(1), "rank": F.lit(0)})
    rest = unscored.join(new.select("id"), "id", "left_anti").join(pending.select("id"), "id", "left_anti")
    backlog = waiting.unionByName(rest.select("id", F.lit(2).alias("tier"), F.when(F.col("live"), 0).otherwise(1).alias("rank")))
    n_new, n_backlog = new.count(), backlog.count()
    take_new, take_old = quotas(n_new, n_backlog, capacity, reserve)
    first = new.orderBy("ord").limit(take_new).select("id", F.lit(0).alias("tier"), F.lit(0).alias("rank"), F.col("ord").cast("long").alias("at"))
    then = backlog.orderBy("tier", "rank", "id").limit(take_old).select("id", "tier", "rank", F.col("id").cast("long").alias("at"))
    from pyspark.sql import Window

    queue = first.unionByName(then).withColumn("position", F.row_number().over(Window.orderBy("tier", "rank", "at")))
    return queue.select("position", "id", "tier"), {"deferred_new": n_new - take_new, "backlog_remaining": n_backlog - take_old, "pre_cap": n_new + n_backlog}
