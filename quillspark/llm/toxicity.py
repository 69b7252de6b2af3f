"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are all words that stand in two labelled examples or more. A term weighs its inverse
document frequency over the whole corpus, shrunken by how well it separates the classes; no
term is cut for that. Every example is indexed. They are a bounded sample, so their index is
broadcast and every document is scored against it. A search adds up the postings of the
terms that can matter most (those of very frequent terms lie as dense rows and are added up
for many documents at once), bounds what the others could add by the largest weight that each
block of examples holds, and scores the examples that reach the k-th similarity from their
own vectors, so the neighbours are exact. Similarity-weighted votes are calibrated on the
examples, each scored without itself.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import held_out, learnable, sample
from .work import Powers, mix, prepare, raw_bytes, slices, text_rows, word_hashes, words_of

#: Labelled examples of either class, neighbours, and examples in a block of the index.
EXAMPLES, NEIGHBOURS, BLOCK = 4_096, 24, 64
#: Examples that a term has to stand in, and the chi squared (one degree of freedom) at which its weight is
#: halved: words that stand in a few toxic examples by chance count little, at every number of examples.
LEAST_DF, SHRINK = 2, 30.0
THRESHOLD = 0.7
#: Weight of the vote for the base rate, in units of squared similarity.
BASE_VOTE = 0.5
#: Share of a query's greatest possible similarity that is left to the blocks' bounds.
BOUNDED = 0.01
#: Terms of one in so many examples have dense postings; documents that are searched at once; and what
#: single-precision sums may be off by (each is at most 1), which the choice of candidates allows for.
DENSE, TOGETHER, SLACK = 16, 128, 1e-5
#: Examples are near copies in the term statistics if their words' Jaccard similarity is at least this.
COPIES = 0.8

# bytes that are words after A-Z became a-z; all others become spaces
_TABLE = np.array([b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)], np.uint8)
_GAP = np.arange(256) == 0x20
_BYTES, _RUN = Powers(0x9E3779B97F4A7C15), Powers(0xC2B2AE3D27D4EB4F)


def bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each text's words begin (and the last end), the hashes of its distinct words, and their counts."""
    hashes, first = _word_rows(texts)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return np.searchsorted(doc[at], np.arange(len(first))), hashes[at], np.diff(np.append(at, len(hashes)))


def _word_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    body, starts = raw_bytes(texts)
    body = _TABLE[body]
    begin, end, first = words_of(body, starts, _GAP)
    return word_hashes(body, begin, end, _BYTES), first


def least_shingles(texts: pa.Array, n: int = 4) -> np.ndarray:
    """The least of n hashes over each text's runs of three words; near copies nearly always share one."""
    hashes, first = _word_rows(texts)
    out = np.zeros((len(first) - 1, n), np.uint64)
    up, _ = _RUN.get(3)
    padded = np.concatenate([hashes, np.zeros(2, np.uint64)])
    runs = mix(sum((padded[i : i + len(hashes)] * up[i] for i in range(3)), np.zeros(len(hashes), np.uint64)))
    count = np.diff(first)
    for d in np.flatnonzero(count):
        # runs that reach into the next text do not count; a text of fewer than three words is one run
        at = slice(first[d], first[d] + min(count[d], 2))
        own = runs[first[d] : first[d + 1] - 2] if count[d] >= 3 else mix((hashes[at] * up[: count[d]]).sum(keepdims=True))
        out[d] = [mix(own * np.uint64(2 * k + 1) + np.uint64(k)).min() for k in range(n)]
    return out


class BlockMaxIndex:
    """Postings of unit vectors by term, with the largest weight of each term in each block of examples."""

    def __init__(self, ptr: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_terms: int, block: int = BLOCK):
        """ptr, terms, weights: the vectors one after another; terms ascend in each."""
        self.n, self.n_terms, self.block = len(ptr) - 1, n_terms, block
        self.ptr, self.terms, self.weights = ptr, terms.astype(np.int32), weights
        owner = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(ptr))
        order = np.argsort(terms, kind="stable")  # examples ascend in each term
        self.at = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.owner, self.posting = owner[order], weights[order]
        # a block's postings of a term stand together: their largest weight is the block's bound
        head = np.flatnonzero(np.concatenate([[True], (np.diff(terms[order]) != 0) | (np.diff(self.owner // block) != 0)])) if len(order) else np.zeros(0, np.int64)
        self.block_at = np.searchsorted(terms[order][head], np.arange(n_terms + 1))
        self.block_of = self.owner[head] // block
        self.block_max = np.maximum.reduceat(self.posting, head) if len(head) else np.zeros(0)
        self.most = np.zeros(n_terms)
        np.maximum.at(self.most, terms, weights)
        self.query = np.zeros(n_terms)
        # postings of frequent terms as rows over all examples; the others keep theirs as lists
        often = np.flatnonzero(np.diff(self.at) * DENSE >= max(self.n, 1))
        self.dense_row = np.full(n_terms, -1, np.int32)
        self.dense_row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), self.n), np.float32)
        at, of = self._rows(self.at[often], self.at[often + 1])
        self.dense[of, self.owner[at]] = self.posting[at]

    @staticmethod
    def _rows(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of several runs, one after another, and which run each is of."""
        size = ends - starts
        of = np.repeat(np.arange(len(size)), size)
        return np.arange(len(of)) + np.repeat(starts - np.cumsum(size) + size, size), of

    def search_all(self, ptr: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, without: np.ndarray | None = None):
        """search() for vectors that lie one after another."""
        for lo in range(0, len(ptr) - 1, TOGETHER):
            ends = ptr[lo : lo + TOGETHER + 1]
            at = slice(int(ends[0]), int(ends[-1]))
            rows, of = self.dense_row[terms[at]], np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            asked = np.zeros((len(ends) - 1, len(self.dense)), np.float32)
            asked[of[rows >= 0], rows[rows >= 0]] = weights[at][rows >= 0]
            sums = asked @ self.dense
            for i, (a, b) in enumerate(zip(ends.tolist(), ends[1:].tolist())):
                yield self._search(terms[a:b], weights[a:b], sums[i], k, -1 if without is None else int(without[lo + i]))

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of greatest similarity above zero and those similarities, ties to the smaller index.

        terms ascend. What the terms of small bound could add is bounded by block; an example
        is left out only if it cannot reach the k-th similarity, so none that belongs is missed.
        """
        return next(self.search_all(np.array([0, len(terms)]), terms, weights, k, np.array([without])))

    def _search(self, terms, weights, dense, k, without):
        none = np.zeros(0, np.int64), np.zeros(0)
        if not len(terms) or not self.n:
            return none
        sparse = np.flatnonzero(self.dense_row[terms] < 0)
        bound = weights[sparse] * self.most[terms[sparse]]
        order = sparse[np.argsort(-bound, kind="stable")]
        rest = bound.sum() - np.cumsum(np.sort(bound)[::-1])
        m = int((rest > BOUNDED).sum()) + 1
        first, later = order[:m], order[m:]
        at, of = self._rows(self.at[terms[first]], self.at[terms[first] + 1])
        sums = dense + np.bincount(self.owner[at], self.posting[at] * weights[first][of], minlength=self.n)
        if without >= 0:
            sums[without] = 0
        least = np.partition(sums, -k)[-k] if self.n > k else 0.0
        most = sums
        if len(later):
            at, of = self._rows(self.block_at[terms[later]], self.block_at[terms[later] + 1])
            more = np.bincount(self.block_of[at], self.block_max[at] * weights[later][of], minlength=-(-self.n // self.block))
            most = sums + np.repeat(more, self.block)[: self.n]
        found = np.flatnonzero((most >= least - 2 * SLACK) & (most > 0))
        found = found[found != without]
        if not len(found):
            return none
        # the exact similarity, added up in the order of the example's terms, so equal vectors score alike
        at, of = self._rows(self.ptr[found], self.ptr[found + 1])
        self.query[terms] = weights
        exact = np.bincount(of, self.query[self.terms[at]] * self.weights[at], minlength=len(found))
        self.query[terms] = 0
        best = np.lexsort((found, -exact))[:k]
        best = best[exact[best] > 0]
        return found[best], exact[best]


@dataclass(frozen=True)
class Examples:
    """All that scoring needs; its size is bounded by the number and length of the examples."""

    terms: np.ndarray  # hashes of words, ascending
    idf: np.ndarray  # inverse document frequency with the shrunken class weight
    index: BlockMaxIndex
    ids: np.ndarray
    toxic: np.ndarray
    base: float
    slope: float = 1.0
    shift: float = 0.0

    def vectors(self, ptr: np.ndarray, hashes: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit TF-IDF vectors of bags: where each begins, its terms (ascending) and weights."""
        return unit_vectors(self.terms, self.idf, ptr, hashes, tf)

    def votes(self, ptr: np.ndarray, terms: np.ndarray, weights: np.ndarray, without: np.ndarray | None = None):
        """For each vector the share of squared similarity that votes toxic, the base rate voting too, and the neighbours."""
        for near, s in self.index.search_all(ptr, terms, weights, NEIGHBOURS, without):
            yield (float((s * s * self.toxic[near]).sum()) + BASE_VOTE * self.base) / (float((s * s).sum()) + BASE_VOTE), near, s

    def scores(self, ptr: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        for vote, near, s in self.votes(ptr, terms, weights):
            yield float(1 / (1 + np.exp(-(self.slope * _logit(vote) + self.shift)))), near, s


def known_terms(terms: np.ndarray, ptr: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each bag begins, the numbers of its known terms (ascending), and which of its hashes they are."""
    if not len(terms):
        return np.zeros(len(ptr), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    number = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
    known = np.flatnonzero(terms[number] == hashes)
    return np.searchsorted(known, ptr), number[known], known


def unit_vectors(terms: np.ndarray, idf: np.ndarray, ptr: np.ndarray, hashes: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start, number, known = known_terms(terms, ptr, hashes)
    weight = tf[known] * idf[number]
    some = np.flatnonzero(weight > 0)
    start, number, weight = np.searchsorted(some, start), number[some], weight[some]
    of = np.repeat(np.arange(len(ptr) - 1), np.diff(start))
    return start, number, weight / np.sqrt(np.bincount(of, weight * weight, minlength=len(ptr) - 1))[of]


def _logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return float(np.log(p / (1 - p)))


def _calibrate(votes: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Platt's slope and shift by Newton steps, lightly held to 1 and 0; the slope stays positive."""
    x = np.array([_logit(v) for v in votes])
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - labels) * x).sum() + (a - 1), (p - labels).sum() + 0.1 * b])
        w = p * (1 - p)
        h = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return (a, b) if a > 0.05 else (1.0, 0.0)


def first_copies(bag: list[np.ndarray], least: np.ndarray) -> np.ndarray:
    """Whether each example counts in the statistics: not, if it is a near copy of an earlier one that does.

    Examples that share a least shingle hash are compared by the exact similarity of their words.
    """
    counts = np.ones(len(bag), bool)
    kept: dict[tuple[int, int], list[int]] = {}
    for i, words in enumerate(bag):
        keys = list(enumerate(least[i].tolist()))
        for j in {j for k in keys for j in kept.get(k, ())}:
            both = len(np.intersect1d(words, bag[j], assume_unique=True))
            if both >= COPIES * (len(words) + len(bag[j]) - both):
                counts[i] = False
                break
        else:
            for k in keys:
                kept.setdefault(k, []).append(i)
    return counts


def class_weights(ptr: np.ndarray, hashes: np.ndarray, toxic: np.ndarray, counts: np.ndarray, least_df: int = LEAST_DF) -> tuple[np.ndarray, np.ndarray]:
    """Terms (word hashes of `least_df` examples or more, ascending), and each one's weight chi2 / (chi2 + SHRINK)."""
    of = np.repeat(np.arange(len(toxic)), np.diff(ptr))
    terms, number = np.unique(hashes, return_inverse=True)
    some = counts[of]
    df = np.bincount(number[some], minlength=len(terms)).astype(float)
    bad = np.bincount(number[some], toxic[of][some], minlength=len(terms))
    n, n_bad = int(counts.sum()), float(toxic[counts].sum())
    good, n_good = df - bad, n - n_bad
    under = df * (n - df) * n_bad * n_good
    chi2 = np.where(under > 0, (bad * n_good - good * n_bad) ** 2 * n / np.where(under > 0, under, 1), 0.0)
    often = np.bincount(number, minlength=len(terms)) >= least_df
    return terms[often], (chi2 / (chi2 + SHRINK))[often]


def document_frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[int, np.ndarray]:
    """Documents in all, and those with each of the given terms."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches):
        terms, n = shared.value, 0
        df = np.zeros(len(terms) + 1, np.int64)
        for b in slices(batches):
            ptr, hashes, _ = bags(b.column("text"))
            df += np.bincount(known_terms(terms, ptr, hashes)[1], minlength=len(df))
            n += b.num_rows
        df[-1] = n
        has = np.flatnonzero(df)
        yield pa.record_batch([pa.array(has.astype(np.int32)), pa.array(df[has])], ["term", "df"])

    rows = text_rows(docs).select("text").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    df = np.zeros(len(terms) + 1, np.int64)
    for r in rows.toLocalIterator():
        df[r["term"]] = r["df"]
    shared.destroy()
    return int(df[-1]), df[:-1]


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Examples:
    """Index at most `examples` labelled documents of either class.

    labels: doc_id and toxic, of rows that may be learnt from; null labels do not count, and
    of conflicting ones the greatest does. Of documents that share a doc_id the one whose text
    hashes least is the example. Of near copies among the examples one, the first by label
    (toxic first) and doc_id, counts in the weights of terms; all are indexed. Without labels
    of both classes all terms weigh nothing, and every text scores the base rate.
    """
    prepare(spark)
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    n, bad = known.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    base = bad / n if n else 0.0
    chosen = sample(known.filter("toxic = 1"), examples).unionByName(sample(known.filter("toxic = 0"), examples))

    def presence(batches):
        for b in slices(batches):
            ptr, hashes, tf = bags(b.column("text"))
            least = least_shingles(b.column("text"))
            cut = lambda x, kind: pa.array([x[i:j].astype(kind).tobytes() for i, j in zip(ptr, ptr[1:])], pa.binary())
            yield pa.record_batch(
                [b.column("doc_id"), b.column("toxic"), b.column("tie"), cut(hashes, np.uint64), cut(tf, np.int32), pa.array([x.tobytes() for x in least], pa.binary())],
                ["doc_id", "toxic", "tie", "words", "tf", "least"],
            )

    rows = text_rows(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "toxic").withColumn("tie", F.xxhash64("text"))
    # a bounded sample, as bytes, which stay small on the driver
    found = rows.mapInArrow(presence, "doc_id long, toxic int, tie long, words binary, tf binary, least binary").collect()
    found = sorted(found, key=lambda r: (-r["toxic"], r["doc_id"], r["tie"]))
    found = [r for i, r in enumerate(found) if not i or r["doc_id"] != found[i - 1]["doc_id"]]
    ids, toxic = np.array([r["doc_id"] for r in found], np.int64), np.array([r["toxic"] for r in found], float)
    ptr = np.cumsum([0, *(len(r["words"]) // 8 for r in found)])
    hashes, tf = (np.frombuffer(b"".join([r[c] for r in found]), kind) for c, kind in (("words", np.uint64), ("tf", np.int32)))
    least = np.frombuffer(b"".join([r["least"] for r in found]), np.int64).reshape(len(found), 4)
    del found
    bag = [hashes[i:j] for i, j in zip(ptr, ptr[1:])]
    terms, strength = class_weights(ptr, hashes, toxic, first_copies(bag, least))
    total, df = document_frequencies(docs, terms) if len(terms) else (0, np.zeros(0))
    idf = (np.log((1 + total) / (1 + df)) + 1) * strength
    start, number, weight = unit_vectors(terms, idf, ptr, hashes, tf)
    bare = start[1:] == start[:-1]
    bare_rate = toxic[bare].mean() if bare.any() else base
    index = BlockMaxIndex(start, number, weight, len(terms))
    model = Examples(terms, idf, index, ids, toxic, min(base, bare_rate))
    if len(ids) >= 20 and 0 < toxic.sum():
        votes = np.array([v for v, _, _ in model.votes(start, number, weight, np.arange(len(ids)))])
        slope, shift = _calibrate(votes, toxic)
        model = replace(model, slope=slope, shift=shift)
    return model


def score(spark: SparkSession, docs: DataFrame, model: Examples) -> DataFrame:
    """doc_id, score and evidence (labelled doc_id, similarity, toxic; nearest first) of every row.

    A null or empty text, or one without a word of any example, has no neighbours and scores
    the calibrated base rate. Rows with null or repeated doc_id each give a row; an empty table
    gives an empty result; other columns are not read.
    """
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # of bounded size

    def run(batches):
        m = shared.value
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))
        for b in slices(batches):
            scores, evidence = [], []
            for s, near, similar in m.scores(*m.vectors(*bags(b.column("text")))):
                scores.append(s)
                evidence.append([{"doc_id": int(m.ids[i]), "similarity": float(x), "toxic": int(m.toxic[i])} for i, x in zip(near, similar)])
            yield pa.record_batch([b.column("doc_id"), pa.array(scores, pa.float64()), pa.array(evidence, kind)], ["doc_id", "score", "evidence"])

    return text_rows(docs).mapInArrow(run, "doc_id long, score double, evidence array<struct<doc_id:long,similarity:double,toxic:int>>")


def op7_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt without the held-out labels."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = score(spark, docs, train(spark, docs, learnable(labels, 3, 1)))
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
