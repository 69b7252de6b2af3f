"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most three bits share at least five of their eight
bytes, place for place. Lists of single bytes would hold 1/256 of all fingerprints each, so
the index lists fingerprints by three bytes and their places: of any five places, three lie
in the same half, so the eight triples inside the halves find every pair. For each pair of a
list the shared bytes are tallied, pairs below five are dropped, and the rest verified bit by
bit. Lists that grow long are split by two more shared bytes, and lists that are still long
look up all fingerprints within three bits of the remaining bytes instead of comparing pairs;
both find the same links. What leaves a list are edges of a spanning forest, never all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components, forest, one_of_each
from .work import Workspace, fill, slices, text_rows

SHINGLE, DISTANCE, SEED = 3, 3, 42
SHARED = 8 - DISTANCE
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
#: Lists longer than this are split by two further bytes; beyond the second, variants are looked up.
LONG, LONGER = 256, 6_000


def shingle_hashes(text: str | None, size: int = SHINGLE) -> list[int]:
    """XXH64 of every run of `size` words (A-Z lower-cased, one space between); of all words if fewer."""
    words = text.encode().lower().split() if text else []
    if not words:
        return []
    body, ends, at = b" ".join(words), [], -1
    for w in map(len, words):
        at += w + 1
        ends.append(at)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(body, SEED)]
    starts = [0, *(e + 1 for e in ends[:-size])]
    return [digest(body[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])]


def fingerprints(spark: SparkSession, docs: DataFrame, size: int = SHINGLE, node: bool = False) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) of every row; wordless texts have zero. With node also a hash of the text."""
    more = ["node"] if node else []

    def run(batches):
        for b in slices(batches):
            found = [shingle_hashes(t, size) for t in fill(b.column("text")).to_pylist()]
            count = np.array([len(x) for x in found])
            hashes = np.fromiter((h for x in found for h in x), np.uint64, int(count.sum()))
            out = np.zeros(len(found), np.uint64)
            has = np.flatnonzero(count)
            if len(has):
                bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)
                ones = np.add.reduceat(bits, np.cumsum(count)[has] - count[has], axis=0, dtype=np.int32)
                out[has] = np.packbits(2 * ones > count[has][:, None], axis=1).view(">u8").ravel()
            yield pa.record_batch([b.column("doc_id"), pa.array(out.view(np.int64)), *(b.column(c) for c in more)], ["doc_id", "fp", *more])

    rows = text_rows(docs).withColumn("node", F.xxhash64("text")) if node else text_rows(docs)
    return rows.mapInArrow(run, "doc_id long, fp long" + ", node long" * node)


def _byte(place: int):
    return F.shiftrightunsigned("fp", 56 - 8 * place).bitwiseAND(F.lit(255))


def _key(head: int, places) -> F.Column:
    """A long of the list's number and the bytes at the places."""
    key = F.lit(head).cast("long")
    for p in places:
        key = F.shiftleft(key, 8).bitwiseOR(_byte(p))
    return key


def _linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs with enough bytes in common, and then few enough bits apart."""
    apart = a ^ b
    tally = (apart.view(np.uint8).reshape(-1, 8) == 0).sum(1)
    near = np.flatnonzero(tally >= SHARED)
    return near[np.bitwise_count(apart[near]) <= DISTANCE]


def _variants(fp: np.ndarray, fixed: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a sorted list whose members share the bytes of the mask `fixed`: look up what differs by up to three other bits."""
    free = [np.uint64(1 << i) for i in range(64) if not fixed >> i & 1]
    a, b = [], []
    for n in range(1, DISTANCE + 1):
        for bits in combinations(free, n):
            other = fp ^ np.bitwise_or.reduce(np.array(bits, np.uint64))
            at = np.searchsorted(fp, other)
            hit = np.flatnonzero(fp[np.minimum(at, len(fp) - 1)] == other)
            hit = hit[fp[hit] < other[hit]]
            a.append(fp[hit])
            b.append(other[hit])
    return np.concatenate(a), np.concatenate(b)


def _list_links(keys: np.ndarray, fp: np.ndarray):
    """Forest edges of the links inside each run of equal keys; fp is sorted inside a run."""
    if not len(keys):
        return
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(new, len(keys)))
    end = np.repeat(new + sizes, sizes)
    short = np.repeat(sizes <= LONGER, sizes)
    for start, size in zip(new[sizes > LONGER], sizes[sizes > LONGER]):
        run = fp[start : start + size]
        same = ~np.bitwise_or.reduce(run ^ run[0])
        fixed = sum(0xFF << (8 * i) for i in range(8) if int(same) >> (8 * i) & 0xFF == 0xFF)
        if bin(fixed).count("1") >= 8 * SHARED:
            yield forest(*_variants(run, fixed))
        else:
            short[start : start + size] = True
    at, a, b, held, d = np.flatnonzero(short), [], [], 0, 0
    while len(at):
        d += 1
        at = at[at + d < end[at]]
        for lo in range(0, len(at), 1 << 20):
            i = at[lo : lo + (1 << 20)]
            link = i[_linked(fp[i], fp[i + d])]
            a.append(fp[link])
            b.append(fp[link + d])
            held += len(link)
        if held > 1 << 20:
            x, y = forest(np.concatenate(a), np.concatenate(b))
            a, b, held = [x], [y], len(x)
            if held > 1 << 19:
                yield x, y
                a, b, held = [], [], 0
    if a:
        x, y = forest(np.concatenate(a), np.concatenate(b))
        if len(x):
            yield x, y


def links(ws: Workspace, fps: DataFrame) -> DataFrame:
    """Edges a, b (fingerprints as longs) that connect all fingerprints linked by up to three bits.

    fps: distinct fp. Every link is found in some list; each list gives a spanning forest.
    """
    keyed = fps.select("fp", F.explode(F.array(*(_key(i, t) for i, t in enumerate(TRIPLES)))).alias("key"))
    counts = keyed.groupBy("key").count()
    long = counts.filter(F.col("count") > LONG).select("key", F.lit(True).alias("long"))
    some = keyed.join(counts.filter("count > 1").select("key"), "key", "left_semi").join(long, "key", "left")
    triple = F.shiftright("key", 24)
    finer = None
    for i, t in enumerate(TRIPLES):
        rest = [p for p in range(8) if p not in t]
        pairs = F.array(*(_key(64 + 16 * i + j, (*t, *two)) for j, two in enumerate(combinations(rest, 2))))
        finer = F.when(triple == i, pairs) if finer is None else finer.when(triple == i, pairs)
    lists = some.select("fp", F.explode(F.when(F.col("long"), finer).otherwise(F.array("key"))).alias("key"))

    def scan(batches):
        keys, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        held, parts = 0, []

        def flush(last: bool):
            nonlocal keys, fp, parts, held
            keys = np.concatenate([keys, *(p[0] for p in parts)])
            fp = np.concatenate([fp, *(p[1] for p in parts)])
            parts, held = [], 0
            cut = len(keys) if last else int(np.searchsorted(keys, keys[-1], side="left"))
            out = list(_list_links(keys[:cut], fp[:cut]))
            keys, fp = keys[cut:], fp[cut:]
            return out

        for b in batches:
            if b.num_rows:
                parts.append((b.column("key").to_numpy(), (b.column("fp").to_numpy() ^ np.int64(-(1 << 63))).view(np.uint64)))
                held += b.num_rows
            if held >= 1 << 17:
                for x, y in flush(False):
                    yield pa.record_batch([pa.array(_signed(x)), pa.array(_signed(y))], ["a", "b"])
        if held or len(keys):
            for x, y in flush(True):
                yield pa.record_batch([pa.array(_signed(x)), pa.array(_signed(y))], ["a", "b"])

    return lists.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(scan, "a long, b long")


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) ^ np.int64(-(1 << 63))


def groups(spark: SparkSession, docs: DataFrame, size: int = SHINGLE, node: bool = False) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach) of every row.

    With node also a hash of the text and root, a fingerprint that names the component: where
    rows of one doc_id lie in several components, their component_id may be the same.

    Null, empty and wordless texts have fingerprint zero and are linked like any other. Rows
    with null doc_id take no part: their component_id is null. Rows that share a doc_id all
    count, each with its own fingerprint. An empty table gives an empty result; other columns
    are not read.
    """
    ws = Workspace(spark)
    rows = ws.table("fingerprints", fingerprints(spark, docs, size, node))
    nodes = rows.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("least"))
    nodes = ws.table("nodes", nodes)
    roots = components(ws, links(ws, nodes.select("fp")))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = ws.table("named", named)
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    more = ["node", "root"] if node else []
    of = named.join(ids, "root").select("fp", "component_id", *more[1:])
    return rows.join(of, "fp", "left").select("doc_id", "fp", *more, F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(spark: SparkSession, docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The rows of docs, with their columns, of one text of each group: that of the smallest doc_id.

    Texts that share a doc_id are judged each for itself, and one of equal rows stays; rows
    without a doc_id all stay.
    """
    ws = Workspace(spark)
    found = groups(spark, docs, size, node=True).filter("doc_id IS NOT NULL")
    return one_of_each(ws, docs, ws.table("groups", found.select("doc_id", "node", "root")))


def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    found = groups(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
