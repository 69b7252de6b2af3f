"""Sharding by histogram sort, under the law that shards hold nearly equal bytes.

Rows are ordered by (xxhash64 of the text, doc_id), so equal texts are neighbours.
Splitters come from exact counts: each round every partition counts the bytes and rows
below a set of probe keys, the driver narrows each splitter's interval, and new probes
are laid inside it, until every splitter's count is within the tolerance or its interval
holds a single key. The rows are then exchanged once, to fine partitions whose borders
are splitters too, where each takes its slot.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .work import Workspace

LOW, HIGH = -(1 << 63), (1 << 63) - 1
#: Probes for each open splitter in a round.
PROBES = 64
#: Rows of a piece, about: each is sorted in one task.
PIECE = 1_000_000


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, key."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)).alias("part"),
    )


def _below(keys: np.ndarray, parts: np.ndarray, probes: list[tuple[int, int]]) -> np.ndarray:
    """How many of the sorted probes each row's (key, part) reaches: its bucket."""
    pk = np.array([p[0] for p in probes], np.int64)
    pp = np.array([p[1] for p in probes], np.int64)
    out = np.searchsorted(pk, keys, side="left")
    ends = np.searchsorted(pk, keys, side="right")
    for k in np.unique(keys[out < ends]):
        a, b = np.searchsorted(pk, k, side="left"), np.searchsorted(pk, k, side="right")
        rows = keys == k
        out[rows] = a + np.searchsorted(pp[a:b], parts[rows], side="right")
    return out


def histogram(keys: DataFrame, probes: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows in each bucket between probes, exact over all partitions."""

    def count(batches):
        size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for b in batches:
            at = _below(b.column("key").to_numpy(), b.column("part").to_numpy(), probes)
            np.add.at(size, at, b.column("size").to_numpy())
            rows += np.bincount(at, minlength=len(rows))
        has = np.flatnonzero(rows)
        yield pa.record_batch([pa.array(has, pa.int32()), pa.array(size[has]), pa.array(rows[has])], ["bucket", "size", "rows"])

    found = keys.select("key", "part", "size").mapInArrow(count, "bucket int, size long, rows long").groupBy("bucket").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows"))
    size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for r in found.collect():  # as many rows as there are probes, at most
        size[r["bucket"]], rows[r["bucket"]] = r["size"], r["rows"]
    return size, rows


def _between(lo: tuple[int, int], hi: tuple[int, int], n: int) -> list[tuple[int, int]]:
    """Up to n probes strictly between lo and hi: by key, or by part where only one key is left."""
    if hi[0] - lo[0] >= 2:
        step = [lo[0] + (hi[0] - lo[0]) * i // (n + 1) for i in range(1, n + 1)]
        return [(k, LOW) for k in dict.fromkeys(step) if lo[0] < k <= hi[0] and lo < (k, LOW) < hi]
    if hi[0] - lo[0] == 1 and lo < (hi[0], LOW) < hi:
        return [(hi[0], LOW)]
    base, top = lo[1], hi[1] if hi[0] == lo[0] else HIGH
    step = [base + (top - base) * i // (n + 1) for i in range(1, n + 1)]
    return [(lo[0], p) for p in dict.fromkeys([*step, base + 1]) if lo < (lo[0], p) < hi]


def splitters(keys: DataFrame, cuts: int, tolerance: float, weight: str) -> tuple[list[tuple[int, int]], int]:
    """Keys below which i/(cuts+1) of the weight lies, within tolerance of one part; the number of rounds.

    weight: bytes or rows. A splitter whose interval can't be narrowed stays where it is
    nearest: one row, or rows with equal key and doc_id, stand there.
    """
    lo, hi = [(LOW, LOW)] * cuts, [(HIGH, HIGH)] * cuts
    near: list[tuple[float, tuple[int, int]]] = [(float("inf"), (HIGH, HIGH))] * cuts
    done, rounds = [False] * cuts, 0
    while not all(done):
        probes = sorted({p for i in range(cuts) if not done[i] for p in _between(lo[i], hi[i], PROBES if rounds else PROBES * cuts)})
        if not probes:
            break
        rounds += 1
        if rounds > 130:  # each round narrows every open interval; two 64-bit keys take no more
            raise RuntimeError("splitters did not settle")
        size, rows = histogram(keys, probes)
        weights = size if weight == "bytes" else rows
        total, upto = int(weights.sum()), np.cumsum(weights)[:-1]
        for i in range(cuts):
            if done[i]:
                continue
            want = total * (i + 1) / (cuts + 1)
            k = int(np.searchsorted(upto, want, side="right"))
            for j in (k - 1, k):
                if 0 <= j < len(probes):
                    near[i] = min(near[i], (abs(int(upto[j]) - want), probes[j]))
            lo[i] = max(lo[i], probes[k - 1]) if k else lo[i]
            hi[i] = min(hi[i], probes[k]) if k < len(probes) else hi[i]
            done[i] = near[i][0] <= tolerance * max(total, 1) / (cuts + 1) or rows[k] <= 1 or not _between(lo[i], hi[i], PROBES)
    found = [n[1] for n in near]
    for i in range(1, cuts):
        found[i] = max(found[i], found[i - 1])
    return found, rounds


def histogram_sort(spark: SparkSession, docs: DataFrame, shards: int = 8, tolerance: float = 0.005, piece: int = PIECE) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row.

    Shards hold equal bytes within `tolerance` of one shard each side, or as near as rows
    let them; slots count from 0 without gaps inside a shard, by (key, doc_id). Equal texts
    stand together and are only parted where a border must fall among them. A null text is
    empty; a null doc_id sorts first; repeated rows take slots of their own; an empty table
    gives an empty result. Other columns are not read, and texts are not exchanged: join the
    result with the documents to write the shards.
    """
    ws = Workspace(spark)
    keys = ws.table("keys", keyed(docs))
    outer, _ = splitters(keys, shards - 1, tolerance, "bytes")
    # pieces of about `piece` rows, eight to a shard at least
    fine = max(8, -(-keys.count() // (shards * piece)))
    inner, _ = splitters(keys, shards * fine - 1, 0.1, "rows")
    borders = sorted({*outer, *inner})
    _, rows = histogram(keys, borders)
    heads = np.array([0, *(bisect_left(borders, o) + 1 for o in outer)])
    shard_of = np.searchsorted(heads, np.arange(len(rows)), side="right") - 1
    # slots before each piece in its shard
    before = np.cumsum(rows) - rows
    before = before - before[np.minimum(heads, len(rows) - 1)][shard_of]

    def place(batches):
        for b in batches:
            at = _below(b.column("key").to_numpy(), b.column("part").to_numpy(), borders)
            yield pa.record_batch([*(b.column(c) for c in ("doc_id", "size", "text_crc32", "key", "part")), pa.array(at, pa.int32()), pa.array(shard_of[at], pa.int32()), pa.array(before[at], pa.int64())], ["doc_id", "size", "text_crc32", "key", "part", "piece", "shard", "before"])

    placed = keys.mapInArrow(place, "doc_id long, size long, text_crc32 long, key long, part long, piece int, shard int, before long")
    order = Window.partitionBy("piece").orderBy("key", "part", "size", "text_crc32")
    return placed.withColumn("slot", F.col("before") + F.row_number().over(order) - 1).select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))


def op8_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 of nearly equal bytes."""
    found = histogram_sort(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
