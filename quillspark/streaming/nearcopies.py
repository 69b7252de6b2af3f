"""Near copies over time: an index of MinHash keys that every batch looks up and adds to.

Two texts are near copies if their sets of five-word shingles have a Jaccard similarity of 0.8
or more, and groups are what such links join. The index keeps, for each distinct set of
shingles, its hashes and BANDS keys of ROWS minima; nothing that it has is signed again. A
batch is compared with the lists of its own keys alone. A pair of similarity 0.8 shares no key
with a chance of 7 in a million, a more similar one with less; every link is verified by the
sets themselves, whose shingles are 64-bit hashes.

The tables of the store: near_members (id, set), near_texts (set, n, hashes), near_keys (key,
set), near_groups (set, grp) of the sets that have links. A set is named by 128 bits of its
hashes, so equal texts are one set however often they come.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.versions import Store
from ..session import bounded, shared_dir

SHINGLE, BANDS, ROWS = 5, 30, 5
#: Sets whose hashes are fetched by one broadcast of their names (16 bytes each), and how many broadcasts there may be; more sets are joined.
BROADCAST_SETS, BROADCASTS = 200_000, 16

_RANDOM = np.random.default_rng(7)
_PLACES = _RANDOM.integers(0, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _RANDOM.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(text: Column) -> Column:
    """The hashes of the words of a text (between blanks and control blanks, A to Z as a to z), in order."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.transform(F.filter(F.split(low, "[ \\t-\\r]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def _has_words() -> Column:
    return F.coalesce(F.col("text").rlike("[^ \\t-\\r]"), F.lit(False))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of rows, one row after the other and ascending in each, and how many each has.

    words: the word hashes of all rows in turn, of which row i has counts[i], at least one. A
    row of fewer than five words has one shingle, of all its words.
    """
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = np.flatnonzero(place < np.maximum(counts - SHINGLE + 1, 1)[row])
    row, left = row[first], (counts[row] - place)[first]
    padded = np.concatenate([_mixed(words), np.zeros(SHINGLE, np.uint64)])
    h = np.zeros(len(first), np.uint64)
    for j in range(SHINGLE):
        h += np.where(left > j, padded[first + j], np.uint64(0)) * _PLACES[j]
    h = _mixed(h)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
    return h[new], np.bincount(row[new], minlength=len(counts))


def band_keys(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """BANDS keys of each row (rows x BANDS), from the sets as shingle_sets gives them."""
    starts = np.cumsum(counts) - counts
    keys = np.empty((len(counts), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(counts), band, np.uint64)
        for factor in _FACTORS[band]:
            key = _mixed(key * _PLACES[0] + np.minimum.reduceat(hashes * factor, starts))
        keys[:, band] = key
    return keys


def _sign(batches):
    for b in batches:
        if not b.num_rows:
            continue
        lists = b.column("words")
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        hashes, n = shingle_sets(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), counts)
        keys = band_keys(hashes, n)
        ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        names = [hashlib.md5(hashes[s:e].tobytes()).digest() for s, e in zip(ends[:-1], ends[1:])]
        yield pa.record_batch(
            [
                b.column("id"), pa.array(names, pa.binary()), pa.array(n.astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.view(np.int64))),
                pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), pa.array(keys.view(np.int64).ravel())),
            ],
            ["id", "set", "n", "hashes", "keys"],
        )


def signed(rows: DataFrame) -> DataFrame:
    """id, set, n, hashes and keys of the rows (id, text) that have words."""
    bounded(rows.sparkSession)
    words = rows.filter(_has_words()).select("id", word_hashes(F.col("text")).alias("words"))
    kind = rows.schema["id"].dataType.simpleString()
    return words.mapInArrow(_sign, f"id {kind}, set binary, n int, hashes array<long>, keys array<long>")


class _Tables:
    """Tables of one batch in the shared folder, until the batch is committed."""

    def __init__(self, spark):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/nearcopies-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.root}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{self.n}")

    def drop(self, n: int | None = None) -> None:
        """Delete the n-th table, or all; nothing may be read from them any more."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{n}" if n else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def components(tables: _Tables, edges: DataFrame) -> DataFrame:
    """node and root (the least node that it is joined with) of all nodes of the edges (a, b)."""
    both = tables.keep(edges.unionByName(edges.select(F.col("a").alias("b"), F.col("b").alias("a"))).distinct())
    roots = tables.keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        seen = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        lower = roots.join(seen, "node").select("node", F.col("root").alias("was"), F.least("root", "m").alias("via"))
        # the root's own root saves a step of every second one
        jumped = lower.join(roots.select(F.col("node").alias("via"), F.col("root").alias("far")), "via")
        found = tables.keep(jumped.select("node", "was", F.least("via", "far").alias("root")))
        roots = found.select("node", "root")
        if not found.filter("root <> was").limit(1).count():
            return roots


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b, more) whose sets have a similarity of 0.8 or more."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("set"))
    parts = -(-needed.distinct().count() // BROADCAST_SETS)
    if parts <= BROADCASTS:
        # the texts are filtered where they lie, by some of the names at a time; only what is needed is exchanged
        mine = lambda k: F.broadcast(needed.filter(F.pmod(F.xxhash64("set"), F.lit(parts)) == k).distinct())
        some = reduce(DataFrame.unionByName, [texts.join(mine(k), "set", "left_semi") for k in range(parts)]) if parts else texts.limit(0)
    else:
        some = texts.join(needed.distinct(), "set", "left_semi")
    side = lambda x: some.select(F.col("set").alias(x), F.col("n").alias(f"n_{x}"), F.col("hashes").alias(f"h_{x}"))
    both = pairs.join(side("a"), "a").filter("n_a * 5 >= n_other * 4 AND n_other * 5 >= n_a * 4").join(side("b"), "b")
    return both.filter(F.size(F.array_intersect("h_a", "h_b")) * 9 >= (F.col("n_a") + F.col("n_b")) * 4)


def _links(tables: _Tables, lists: DataFrame, texts: DataFrame) -> DataFrame | None:
    """node and root of the start labels that verified links of the lists join; None without a link.

    lists: key, set, n, fresh, start. Every pair of a list that has a fresh side and is not yet
    joined is compared once, in rounds: leaders of the list's groups are held against all its
    members and leave it, so what is joined already costs nothing more. A round has twice the
    leaders of the one before. Only lists whose texts stay apart need many comparisons.
    """
    roots, turn = None, 0
    while True:
        if roots is None:
            labelled = lists.withColumn("grp", F.col("start"))
        else:
            labelled = lists.join(roots.select(F.col("node").alias("start"), "root"), "start", "left").withColumn("grp", F.coalesce("root", "start")).drop("root")
        open_ = labelled.groupBy("key").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.max("fresh").alias("any")).filter("lo <> hi AND any").select("key")
        left = tables.keep(labelled.join(open_, "key", "left_semi"))
        if not left.limit(1).count():
            return roots
        part = F.pmod(F.xxhash64("grp", F.lit(turn)), F.lit(1 << min(turn, 20)))
        first = F.min(F.struct("set", "n", "fresh", "start", "grp"))
        leaders = left.groupBy("key", part.alias("part")).agg(first.alias("l")).select("key", *(F.col(f"l.{c}").alias(f"l_{c}") for c in ("set", "n", "fresh", "start", "grp")))
        met = left.join(leaders, "key").filter("grp <> l_grp AND (fresh OR l_fresh) AND n * 5 >= l_n * 4 AND l_n * 5 >= n * 4")
        # two lists may meet a pair from either side
        ahead = F.col("set") < F.col("l_set")
        one, other = F.struct("set", "n", "start"), F.struct(F.col("l_set").alias("set"), F.col("l_n").alias("n"), F.col("l_start").alias("start"))
        sides = met.select(F.when(ahead, one).otherwise(other).alias("p"), F.when(ahead, other).otherwise(one).alias("q")).distinct()
        pairs = sides.select(F.col("p.set").alias("a"), F.col("q.set").alias("b"), F.col("q.n").alias("n_other"), F.col("p.start").alias("x"), F.col("q.start").alias("y"))
        found = tables.keep(_similar(tables.keep(pairs), texts).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        if found.limit(1).count():
            if roots is not None:
                found = found.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
            roots = components(tables, found)
        lists = left.join(leaders.select("key", F.col("l_set").alias("set")), ["key", "set"], "left_anti").drop("grp")
        turn += 1


def update(store: Store, rows: DataFrame, batch: int) -> int:
    """Add a batch (id, text; other columns are not read) to the index by one commit; batches are numbered upwards, and one that was added before changes nothing.

    Null and empty texts are members without a set. Repeated rows count once; an id with
    several texts is a member for each.
    """
    if store.entry()["notes"].get("near_batch", -1) >= batch:
        return store.latest()
    parent, tables = store.latest(), _Tables(store.spark)
    there = store.has("near_texts", parent)
    rows = rows.select("id", "text")
    sets = tables.keep(signed(rows))
    wordless = rows.filter(~_has_words()).select("id", F.lit(None).cast("binary").alias("set"))
    members = tables.keep(sets.select("id", "set").unionByName(wordless).distinct())
    new = sets.select("set", "n", "hashes", "keys").dropDuplicates(["set"])
    if there:
        old_texts, old_keys, old_groups = (store.read(f"near_{t}", parent) for t in ("texts", "keys", "groups"))
        new = new.join(old_texts.select("set"), "set", "left_anti")
    new = tables.keep(new)
    tables.drop(1)  # the sets, of which new has what is new
    texts = new.select("set", "n", "hashes")
    keys = new.select(F.explode("keys").alias("key"), "set", "n")
    probed = keys.withColumn("fresh", F.lit(True)).withColumn("start", F.col("set"))
    if there:
        met = old_keys.join(keys.select("key").distinct(), "key", "left_semi").join(old_groups, "set", "left")
        probed = probed.unionByName(met.select("key", "set", "n", F.lit(False).alias("fresh"), F.coalesce("grp", "set").alias("start")))
    roots = _links(tables, probed, texts.unionByName(old_texts) if there else texts)
    groups = old_groups if there else store.spark.createDataFrame([], "set binary, grp binary")
    if roots is not None:
        moved = groups.join(roots.select(F.col("node").alias("grp"), "root"), "grp", "left").select("set", F.coalesce("root", "grp").alias("grp"))
        joined = roots.join(groups, roots.node == groups.set, "left_anti").select(F.col("node").alias("set"), F.col("root").alias("grp"))
        groups = moved.unionByName(joined)
    more = {"near_members": members, "near_texts": texts, "near_keys": keys}
    version = store.commit({"near_groups": groups}, parent=parent, append=more, notes={"near_batch": batch})
    tables.drop()
    return version


def groups(store: Store, version: int | None = None) -> DataFrame:
    """id and near_group (the smallest id of its near copies, itself included) of every member.

    A member without words is alone. An id with several texts has a row for each set of shingles.
    """
    members = store.read("near_members", version).distinct()
    labelled = members.filter("set IS NOT NULL").join(store.read("near_groups", version), "set", "left").select("id", F.coalesce("grp", "set").alias("grp"))
    first = labelled.groupBy("grp").agg(F.min("id").alias("near_group"))
    return labelled.join(first, "grp").select("id", "near_group").unionByName(members.filter("set IS NULL").select("id", F.col("id").alias("near_group")))
