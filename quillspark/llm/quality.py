"""Quality classifier by positive-unlabelled learning.

A logistic model over dense text features minimises the non-negative unbiased risk

    prior * R(positives as 1) + max(0, R(unlabelled as 0) - prior * R(positives as 0)),

from trusted positives and unlabelled web text. The class prior is estimated from the two
alone: among the texts that a first model finds most like the positives nearly all are
positive, so there the unlabelled share over the positives' share is the prior. Negative
labels are never used, so labels need not be a fair sample of the web text. The fit uses
bounded samples; every document is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .features import NAMES, features
from .work import prepare, raw_bytes, slices, text_rows

#: Rows of each kind that a model is fitted on, at most.
POSITIVES, UNLABELLED = 8_192, 8_192
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return _expand((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logit(x))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _expand(z: np.ndarray) -> np.ndarray:
    """Intercept, clipped values and squares: a feature may be too low or too high."""
    z = np.clip(z, -4, 4)
    return np.concatenate([np.ones((len(z), 1)), z, z * z / 4], axis=1)


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 60, batch: int = 512, rate: float = 0.02, decay: float = 1e-4, seed: int = 7, floor: bool = True) -> Model:
    """Minimise the non-negative risk with Adam; when its unlabelled part falls below zero, that part is stepped back.

    Without `floor` the rows count as what they are, positive or unlabelled, half and half.
    """
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    p, u = _expand((positive - mean) / scale), _expand((unlabelled - mean) / scale)
    rng, w = np.random.default_rng(seed), np.zeros(p.shape[1])
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    steps = max(1, len(u) // batch)
    for epoch in range(epochs):
        lr = rate / (1 + epoch / 20)
        for _ in range(steps):
            a, b = p[rng.integers(len(p), size=min(batch, len(p)))], u[rng.integers(len(u), size=min(batch, len(u)))]
            za, zb = a @ w, b @ w
            sa, sb = _sigmoid(za), _sigmoid(zb)
            # logistic loss: log(1+exp(-z)) for label 1, log(1+exp(z)) for label 0
            negative = np.logaddexp(0, zb).mean() - prior * np.logaddexp(0, za).mean()
            g_neg = b.T @ sb / len(b) - floor * prior * (a.T @ sa) / len(a)
            g = prior * (a.T @ (sa - 1)) / len(a) + g_neg if negative >= 0 or not floor else -g_neg
            g = g + decay * w
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - lr * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, w, prior)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.25, sure: float = 1.0) -> float:
    """The share of positives among the unlabelled, from the two samples alone.

    A logistic model parts positives from unlabelled rows. For the rows above any bar the
    share of the unlabelled over that of the positives is the prior at least, and the prior
    where no negative gets above it; the least of these ratios over bars that `least` of the
    positives reach is taken, each with `sure` standard errors added, so that chance in one of
    many bars does not pull it down.
    """
    split = np.arange(len(positive)) % 2, np.arange(len(unlabelled)) % 2
    ratios = []
    for half in (0, 1):  # bars are set on rows that the model was not fitted on
        model = fit_nnpu(positive[split[0] == half], unlabelled[split[1] == half], 0.5, epochs=20, floor=False)
        p, u = (np.sort(model.logit(x[s != half])) for x, s in zip((positive, unlabelled), split))
        if not len(p) or not len(u):
            return 0.5
        bars = np.unique(p[: int(len(p) * (1 - least)) + 1])
        above_p, above_u = (1 - np.searchsorted(x, bars) / len(x) for x in (p, u))
        error = np.sqrt(above_u * (1 - above_u) / len(u) + (above_u / above_p) ** 2 * above_p * (1 - above_p) / len(p)) / above_p
        ratios.append(float((above_u / above_p + sure * error).min()))
    return min(0.99, max(0.01, float(np.mean(ratios))))


def learnable(labels: DataFrame, modulus: int, held_out: int) -> DataFrame:
    """Labels of rows that may be learnt from: crc32(doc_id as text) mod `modulus` is not `held_out`."""
    return labels.filter(F.crc32(F.col("doc_id").cast("string")) % modulus != held_out)


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == rest, F.lit(False))


def sample(rows: DataFrame, most: int) -> DataFrame:
    """At most `most` rows, the same on every run: those whose doc_id hashes lowest."""
    return rows.orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(most)


def feature_rows(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, x (array of features) and further columns."""

    def run(batches):
        for b in slices(batches):
            x = features(*raw_bytes(b.column("text")))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))
            yield pa.record_batch([b.column("doc_id"), flat, *(b.column(c) for c in more)], ["doc_id", "x", *more])

    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in more)
    return text_rows(docs, *more).mapInArrow(run, f"doc_id long, x array<double>{kinds}")


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Fit on at most `positives` documents of quality 1 and `unlabelled` documents without a label.

    labels: doc_id and quality, of rows that may be learnt from; null qualities count as no
    label, and of conflicting ones the least. Of rows that share a doc_id the one whose text
    hashes least is learnt from. Only quality 1 is learnt from; the prior comes from
    estimate_prior(). Without a positive or an unlabelled document the model gives every
    text one half.
    """
    prepare(spark)
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL")
    one = sample(known.filter("quality = 1").select("doc_id"), positives).withColumn("kind", F.lit(1))
    none = sample(ids.join(labels.filter("quality IS NOT NULL").select("doc_id"), "doc_id", "left_anti").distinct(), unlabelled).withColumn("kind", F.lit(0))
    chosen = one.unionByName(none)  # of bounded size
    # a row for each id, however often it stands, before anything comes to the driver
    text = F.coalesce(F.col("text"), F.lit(""))
    least = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "kind").agg(F.min(F.struct(F.xxhash64("text").alias("tie"), "text")).alias("r"))
    rows = feature_rows(least.select("doc_id", "kind", "r.text"), "kind").select("x", "kind").toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(NAMES))
    p, u = x[rows["kind"] == 1], x[rows["kind"] == 0]
    if not len(p) or not len(u):
        return Model(np.zeros(len(NAMES)), np.ones(len(NAMES)), np.zeros(2 * len(NAMES) + 1), 0.5)
    # rows arrive in no fixed order; the fit does not depend on it
    order = lambda a: a[np.lexsort(a.T)]
    p, u = order(p), order(u)
    return fit_nnpu(p, u, estimate_prior(p, u))


def score(spark: SparkSession, docs: DataFrame, model: Model, *more: str) -> DataFrame:
    """doc_id, score and the named columns of every row; a null text counts as empty. Repeated rows each give a row."""
    prepare(spark)

    more = [c for c in more if c.lower() not in ("doc_id", "score")]

    def run(batches):
        for b in slices(batches):
            s = model.score(features(*raw_bytes(b.column("text"))))
            yield pa.record_batch([b.column("doc_id"), pa.array(s), *(b.column(c) for c in more)], ["doc_id", "score", *more])

    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in more)
    return text_rows(docs, *more).mapInArrow(run, f"doc_id long, score double{kinds}")


def keep_good(spark: SparkSession, docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with their columns, that score at least `threshold`.

    Every row is judged by its text alone, a null text as an empty one; repeated rows alike;
    an empty table gives an empty result.
    """
    prepare(spark)
    at = docs.columns.index("text")

    def run(batches):
        for b in slices(batches):
            yield b.filter(pa.array(model.score(features(*raw_bytes(b.column(at)))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt without the held-out labels."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(spark, docs.select("doc_id", "text"), learnable(labels, 5, 0))
    found = score(spark, docs, model)
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
