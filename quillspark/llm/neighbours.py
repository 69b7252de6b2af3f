"""Approximate nearest neighbours by additive quantisation.

Codebooks span all dimensions: each is fitted to what the ones before leave over. A vector
is the sum of one codeword of each book, found by beam search, and kept as its codes and the
squared norm of that sum. A query's table of inner products with all codewords gives
||q - x||^2 up to the query's norm from one look-up per code. The RERANK rows that score best
so are ranked by the exact distance, and so is every row that its codes do not rule out: how far
a vector lies from its sum is kept too, and a row is left out only if the query's distance from
the sum, less that, is above the distance of the nearest found so far.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .work import Workspace

BOOKS, CODES, BEAM = 24, 256, 4
#: Rows that codebooks are fitted on, at most; every row is indexed.
SAMPLE = 16_384
#: Queries that are broadcast at a time, rows of a block, and candidates of a query that are ranked exactly.
QUERY_BLOCK, ROW_BLOCK, RERANK = 2_048, 16_384, 200
#: Square root of the partitions from which a bound is found before all rows are scored.
TWO_STEPS = 3
#: Share that distances by look-up tables and products are taken to be off by through rounding, at most.
OFF = 1e-9


@dataclass(frozen=True)
class Codebooks:
    words: np.ndarray  # books x codes x dimensions

    @property
    def shape(self):
        return self.words.shape

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows x books) and squared norms of the sums, by beam search over the books."""
        m, k, _ = self.shape
        n, rows = len(x), np.arange(len(x))[:, None]
        rest = x[:, None, :]  # what each path of the beam leaves over
        codes = np.zeros((n, 1, m), np.int64)
        error = (x * x).sum(1)[:, None]
        for b in range(m):
            c = self.words[b]
            flat = (error[:, :, None] - 2 * (rest @ c.T) + (c * c).sum(1)).reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(keep), (n, 1))
            parent, code = best // k, best % k
            error = flat[rows, best]
            codes = codes[rows, parent]
            codes[:, :, b] = code
            rest = rest[rows, parent] - c[code]
        win = error.argmin(1)
        total = x - rest[rows[:, 0], win]
        return codes[rows[:, 0], win].astype(code_type(k)), (total * total).sum(1)

    def gap(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """How far each vector is from the sum that its codes stand for."""
        rest = x - sum(book[codes[:, b]] for b, book in enumerate(self.words))
        return np.sqrt((rest * rest).sum(1))


def code_type(codes: int) -> type:
    return np.uint8 if codes <= 256 else np.uint16 if codes <= 65_536 else np.uint32


def fit(x: np.ndarray, books: int = BOOKS, codes: int = CODES, rounds: int = 5, seed: int = 5) -> Codebooks:
    """Residual k-means, one full-dimensional book after another."""
    rng, rest, words = np.random.default_rng(seed), x.astype(float).copy(), []
    for _ in range(books):
        k = min(codes, len(rest))
        c = rest[rng.choice(len(rest), k, replace=False)].copy()
        for _ in range(rounds):
            near = ((c * c).sum(1) - 2 * rest @ c.T).argmin(1)
            count = np.bincount(near, minlength=k)
            total = np.zeros_like(c)
            order = np.argsort(near, kind="stable")
            heads = np.flatnonzero(np.diff(near[order], prepend=-1))
            total[near[order][heads]] = np.add.reduceat(rest[order], heads)
            c[count > 0] = total[count > 0] / count[count > 0, None]
            c[count == 0] = rest[rng.choice(len(rest), int((count == 0).sum()))]
        near = ((c * c).sum(1) - 2 * rest @ c.T).argmin(1)
        rest -= c[near]
        words.append(np.concatenate([c, np.zeros((codes - k, x.shape[1]))]) if k < codes else c)
    return Codebooks(np.stack(words))


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and v (array of double) of rows whose vector has a direction: not null, not zero, all components finite."""
    v = F.col("embedding").cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))


def _matrix(column: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the usual number of dimensions, and which they are."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    fits = np.flatnonzero(sizes == dimensions)
    if len(fits) < len(sizes):
        column = column.take(pa.array(fits))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions), fits


def _blocks(batches, rows: int):
    """Arrow batches put together to blocks of about so many rows."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def distinct(ws: Workspace, rows: DataFrame, k: int) -> DataFrame:
    """row (a number), v, ids (the k + 1 smallest, ascending), vec_id (the least) and other (the least that is not it, else it) of every distinct vector.

    The k + 1 smallest of a vector are picked before rows are exchanged, so copies by the
    million send few rows; no query needs more of them.
    """
    few = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    ids = few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    least = F.col("ids")[0]
    other = F.coalesce(F.try_element_at(F.filter("ids", lambda x: x != least), F.lit(1)), least)
    return ws.table("distinct", ids.select(F.monotonically_increasing_id().alias("row"), least.alias("vec_id"), other.alias("other"), "v", "ids"))


def build(spark: SparkSession, ws: Workspace, rows: DataFrame, books: int = BOOKS, codes: int = CODES, sample: int = SAMPLE) -> tuple[Codebooks | None, int, DataFrame]:
    """Codebooks, dimensions and the index: row, vec_id, other, codes (binary), norm and gap (the distance from the sum that the codes stand for) of every row, and its vector v.

    Codebooks are fitted on the `sample` rows whose vec_id hashes lowest. Vectors of another
    number of dimensions than most of the sample have cannot be compared and take no part.
    """
    chosen = [r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()]
    if not chosen:
        return None, 0, rows.select("row", "vec_id", "other", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("norm"), F.lit(None).cast("double").alias("gap"), "v")
    dimensions = int(np.bincount([len(v) for v in chosen]).argmax())
    train = np.array([v for v in chosen if len(v) == dimensions])
    books_ = fit(train[np.lexsort(train.T)], books, codes)
    shared = spark.sparkContext.broadcast(books_)

    names = ("row", "vec_id", "other")

    def encode(batches):
        for b in batches:
            x, fits = _matrix(b.column("v"), dimensions)
            for at in range(0, len(x), 512):
                code, norm = shared.value.encode(x[at : at + 512])
                own = pa.array(fits[at : at + 512])
                made = [pa.array([c.tobytes() for c in code], pa.binary()), pa.array(norm), pa.array(shared.value.gap(x[at : at + 512], code))]
                yield pa.record_batch([*(b.column(c).take(own) for c in names), *made, b.column("v").take(own)], [*names, "codes", "norm", "gap", "v"])

    return books_, dimensions, ws.table("index", rows.select(*names, "v").mapInArrow(encode, "row long, vec_id long, other long, codes binary, norm double, gap double, v array<double>"))


def _look_up(books: Codebooks, q: np.ndarray, codes: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """||q - x||^2 - ||q||^2 of the sums that codes stand for (queries x rows)."""
    m, c, _ = books.shape
    table = (q @ books.words.reshape(m * c, -1).T).reshape(len(q), m, c)
    out = np.repeat(norm[None], len(q), 0)
    for b in range(m):
        out -= 2 * table[:, b, :][:, codes[:, b]]
    return out


def _scored(index: DataFrame, books: Codebooks, qid: np.ndarray, q: np.ndarray, rerank: int, bound: np.ndarray) -> DataFrame:
    """query_id, vec_id, score and n (the place by score) of each query's `rerank` best rows; tasks return none that score above the query's bound."""
    shared = index.sparkSession.sparkContext.broadcast((books, qid, q, bound))  # of bounded size

    def scan(batches):
        books_, qid, q, bound = shared.value
        ids, scores = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0))
        for b in _blocks(batches, ROW_BLOCK):
            codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), code_type(books_.shape[1])).reshape(b.num_rows, -1)
            own, norm = b.column("vec_id").to_numpy(), b.column("norm").to_numpy()
            near_ids, near = np.empty((len(q), min(rerank, len(own))), np.int64), np.empty((len(q), min(rerank, len(own))))
            for t in range(0, len(q), 64):
                score = _look_up(books_, q[t : t + 64], codes, norm)
                pick = np.argpartition(score, rerank - 1, axis=1)[:, :rerank] if rerank < len(own) else np.tile(np.arange(len(own)), (len(score), 1))
                near_ids[t : t + 64], near[t : t + 64] = own[pick], np.take_along_axis(score, pick, 1)
            ids, scores = np.concatenate([ids, near_ids], 1), np.concatenate([scores, near], 1)
            if ids.shape[1] > rerank:
                pick = np.argpartition(scores, rerank - 1, axis=1)[:, :rerank]
                ids, scores = np.take_along_axis(ids, pick, 1), np.take_along_axis(scores, pick, 1)
        for t in range(0, len(q) if ids.shape[1] else 0, 64):
            fit_ = scores[t : t + 64] <= bound[t : t + 64, None]
            yield pa.record_batch([pa.array(np.repeat(qid[t : t + 64], fit_.sum(1))), pa.array(ids[t : t + 64][fit_]), pa.array(scores[t : t + 64][fit_])], ["query_id", "vec_id", "score"])

    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = index.mapInArrow(scan, "query_id long, vec_id long, score double")
    return found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= rerank)


def candidates(index: DataFrame, books: Codebooks, qid: np.ndarray, q: np.ndarray, rerank: int) -> DataFrame:
    """query_id, vec_id: of each query the `rerank` rows of the index that the look-up tables score nearest.

    An index of P partitions takes two steps. One row in sqrt(P) is scored first, in about
    sqrt(P) tasks; the `rerank`-th best score among them is no better than that among all rows,
    so the pass over all rows returns only what reaches it. Both steps exchange about sqrt(P)
    times `rerank` rows a query in place of P times as many, and no row is lost by it.
    """
    bound = np.full(len(q), np.inf)
    parts = index.rdd.getNumPartitions()
    share = isqrt(parts)
    if share >= TWO_STEPS:
        some = index.filter(F.pmod(F.xxhash64("vec_id", F.lit("bound")), F.lit(share)) == 0).coalesce(-(-parts // share))
        place = {v: i for i, v in enumerate(qid.tolist())}
        for query, score in _scored(some, books, qid, q, rerank, bound).filter(F.col("n") == rerank).select("query_id", "score").collect():
            bound[place[query]] = score
    return _scored(index, books, qid, q, rerank, bound).select("query_id", "vec_id")


class _Nearest:
    """The k nearest rows of each query so far, ties to the smaller id, and the distance that no later one of them is beyond."""

    def __init__(self, qid: np.ndarray, q: np.ndarray, k: int, bound: np.ndarray):
        self.qid, self.q, self.k, self.bound, self.limit = qid, q, k, bound, bound.copy()
        self.apart, self.ids, self.rows = np.full((len(q), k), np.nan), np.full((len(q), k), np.iinfo(np.int64).max), np.zeros((len(q), k), np.int64)

    def _add(self, part: slice, query: np.ndarray, row: np.ndarray, block: dict) -> None:
        """Pairs of a query (numbered from the start of the part) and a row of the block, at their exact distance; the query's own id is none."""
        own = block["vec_id"][row]
        ids = np.where(own == self.qid[part][query], block["other"][row], own)
        at = np.flatnonzero(ids != self.qid[part][query])
        query, row, ids = query[at], row[at], ids[at]
        apart, n = np.sqrt(((block["v"][row] - self.q[part][query]) ** 2).sum(1)), len(self.ids[part])
        query = np.concatenate([np.repeat(np.arange(n), self.k), query])
        apart, ids, rows = (np.concatenate([old[part].ravel(), new]) for old, new in ((self.apart, apart), (self.ids, ids), (self.rows, block["row"][row])))
        order = np.lexsort((ids, apart, query))  # places that are not taken yet come last
        keep = order[np.searchsorted(query[order], np.arange(n))[:, None] + np.arange(self.k)]
        self.apart[part], self.ids[part], self.rows[part] = apart[keep], ids[keep], rows[keep]
        self.limit[part] = np.fmin(self.bound[part], self.apart[part][:, -1])

    def look_at(self, part: slice, books: Codebooks, block: dict, rerank: int) -> None:
        """Rank what the codes score best in a block, then all rows that they do not rule out."""
        q, x, norm, n = self.q[part], block["v"], block["norm"], len(block["v"])
        score = _look_up(books, q, block["codes"], norm)
        first = np.argpartition(score, rerank - 1, axis=1)[:, :rerank] if rerank < n else np.tile(np.arange(n), (len(q), 1))
        self._add(part, np.repeat(np.arange(len(q)), first.shape[1]), first.ravel(), block)
        if rerank >= n:
            return
        # what is no number rules nothing out
        qq, xx, limit = (q * q).sum(1)[:, None], (x * x).sum(1), self.limit[part][:, None] * (1 + OFF)
        left = ~(np.sqrt(np.maximum(score + qq - OFF * (norm + qq), 0)) - block["gap"] * (1 + OFF) > limit)
        np.put_along_axis(left, first, False, 1)
        some = np.flatnonzero(left.any(0))
        query, row = np.nonzero(left[:, some] & ~(xx[some] + qq - 2 * (q @ x[some].T) - OFF * (xx[some] + qq) > limit * limit))
        for at in range(0, len(row), ROW_BLOCK):
            self._add(part, query[at : at + ROW_BLOCK], some[row[at : at + ROW_BLOCK]], block)


def nearest(index: DataFrame, books: Codebooks, qid: np.ndarray, q: np.ndarray, k: int, rerank: int = RERANK) -> DataFrame:
    """query_id, row, score: the k rows at the least distance from each query that have another id than it, in double precision.

    As with `candidates`, an index of many partitions is asked in two steps: the k-th distance
    among one row in sqrt(P) is a bound for the pass over all rows.
    """

    def within(index: DataFrame, bound: np.ndarray) -> DataFrame:
        shared = index.sparkSession.sparkContext.broadcast((books, qid, q, bound))  # of bounded size

        def scan(batches):
            books_, qid, q, bound = shared.value
            found = _Nearest(qid, q, k, bound)
            for b in _blocks(batches, max(256, min(ROW_BLOCK, (1 << 21) // q.shape[1]))):
                block = {c: b.column(c).to_numpy() for c in ("row", "vec_id", "other", "norm", "gap")}
                block["codes"] = np.frombuffer(b"".join(b.column("codes").to_pylist()), code_type(books_.shape[1])).reshape(b.num_rows, -1)
                block["v"], _ = _matrix(b.column("v"), q.shape[1])
                for t in range(0, len(q), 64):
                    found.look_at(slice(t, t + 64), books_, block, rerank)
            for t in range(0, len(q), 64):
                part = slice(t, t + 64)
                fit_ = found.apart[part] <= bound[part, None]
                yield pa.record_batch([pa.array(np.repeat(qid[part], fit_.sum(1))), *(pa.array(a[part][fit_]) for a in (found.rows, found.ids, found.apart))], ["query_id", "row", "vec_id", "score"])

        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return index.mapInArrow(scan, "query_id long, row long, vec_id long, score double").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k)

    bound = np.full(len(q), np.inf)
    parts = index.rdd.getNumPartitions()
    share = isqrt(parts)
    if share >= TWO_STEPS:
        some = index.filter(F.pmod(F.xxhash64("vec_id", F.lit("bound")), F.lit(share)) == 0).coalesce(-(-parts // share))
        place = {v: i for i, v in enumerate(qid.tolist())}
        for query, score in within(some, bound).filter(F.col("n") == k).select("query_id", "score").collect():
            bound[place[query]] = score
    return within(index, bound).select("query_id", "row", "score")


def search(spark: SparkSession, embeddings: DataFrame, queries: DataFrame, k: int = 10, rerank: int = RERANK, books: int = BOOKS, codes: int = CODES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query among all other rows.

    queries: rows of embeddings. Queries are broadcast in blocks of about QUERY_BLOCK, and each
    block is held against the codes of all distinct vectors; the best `rerank` of a block of
    rows are ranked exactly, then all that their codes do not rule out, so no nearest row is
    missed. Distances are in double precision; ties go to the smaller vec_id. Unusable
    vectors (null, zero, with null or non-finite components, or of other dimensions than most)
    take no part; of rows that share a vec_id each counts, but none is its own neighbour, and
    the least of their vectors (component by component) is the one that asks.
    Empty tables give no rows; other columns are not read.
    """
    ws = Workspace(spark)
    rows = distinct(ws, usable(embeddings), k)
    books_, dimensions, index = build(spark, ws, rows, books, codes)
    if books_ is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = usable(queries).filter(F.size("v") == dimensions).groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = ws.table("queries", asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).cast("int")))
    found = None
    for block in range(blocks):  # each of bounded size
        part = sorted(asked.filter(F.col("block") == block).select("vec_id", "v").collect())
        if part:
            near = ws.table("near", nearest(index, books_, np.array([r[0] for r in part]), np.array([r[1] for r in part]), k, rerank))
            found = near if found is None else found.unionByName(near)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    pairs = found.join(rows.select("row", "ids"), "row").select("query_id", F.explode("ids").alias("vec_id"), "score").filter("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every vector whose vec_id is divisible by 100."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(spark, rows, rows.filter(F.col("vec_id") % 100 == 0), 10)
