"""Toxicity scores from confirmed toxic examples and unlabelled text: non-negative PU learning."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlens.llm.common import same, slices

#: The training sample: at most so many toxic and so many unlabelled documents, those with the
#: smallest hash of their id. What is learnt from is bounded; what is scored is not.
MAX_TOXIC, MAX_UNLABELLED = 3_000, 9_000
MIN_DOCS = 8  # documents of the sample that hold a word at least, to be a feature
FEATURES = 1_000  # words that differ most between the two parts of the sample ...
LEAST_Z = 4.0  # ... by so many standard errors at least
STEPS, RATE = 400, 0.1

_WORD = re.compile(r"[^\W\d_]+")


def word_keys(text: str) -> np.ndarray:
    """Sorted hashes of the distinct lower-cased words of a text."""
    digest = xxhash.xxh64_intdigest
    return np.sort(np.array([digest(w.encode()) for w in set(_WORD.findall(text.lower()))], np.uint64))


@dataclass
class Model:
    """A linear score over the presence of words."""

    keys: np.ndarray  # sorted word hashes
    weights: np.ndarray
    bias: float

    def margin(self, keys: np.ndarray) -> float:
        if not len(self.keys) or not len(keys):
            return self.bias
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.bias + float(self.weights[at[self.keys[at] == keys]].sum())

    def score(self, text: str) -> float:
        z = self.margin(word_keys(text))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


class _Rows:
    """Documents as rows of a sparse 0/1 matrix."""

    def __init__(self, docs: list[np.ndarray], keys: np.ndarray):
        hits = []
        for d in docs:
            at = np.minimum(np.searchsorted(keys, d), max(0, len(keys) - 1))
            hits.append(at[keys[at] == d] if len(keys) else at[:0])
        sizes = np.array([len(h) for h in hits], np.int64)
        self.n, self.width = len(docs), len(keys)
        self.row = np.repeat(np.arange(self.n), sizes)
        self.at = np.concatenate(hits) if hits else np.empty(0, np.int64)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.at], minlength=self.n)

    def gathered(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=g[self.row], minlength=self.width)


def select_words(toxic: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """Hashes of the words whose shares of toxic and unlabelled documents differ most, in standard errors."""
    def counted(docs: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
        own, n = np.unique(np.concatenate(docs), return_counts=True)
        out = np.zeros(len(keys))
        out[np.searchsorted(keys, own)] = n
        return out

    keys = np.unique(np.concatenate([*toxic, *unlabelled]))
    p, u = counted(toxic, keys), counted(unlabelled, keys)
    n_p, n_u = len(toxic), len(unlabelled)
    share = (p + u + 1) / (n_p + n_u + 2)
    z = np.abs(p / n_p - u / n_u) / np.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u))
    z[p + u < MIN_DOCS] = 0
    best = np.lexsort((keys, -z))[:FEATURES]
    return np.sort(keys[best[z[best] > LEAST_Z]])


def fit(toxic: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """Minimises the non-negative risk  prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]).

    l is the logistic loss. The second part estimates the risk on clean text from unlabelled text, corrected by
    the class prior; where the estimate falls below zero the fit has begun to learn the toxic examples by
    heart, and the step goes up that part instead of down.
    """
    if not toxic or not unlabelled:
        return Model(np.empty(0, np.uint64), np.empty(0), -30.0 if not toxic else 0.0)
    keys = select_words(toxic, unlabelled)
    P, U = _Rows(toxic, keys), _Rows(unlabelled, keys)
    w = np.zeros(len(keys) + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    decay = max(3e-4, 0.03 / P.n)  # few examples are trusted less

    def sigmoid(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def gradient(rows: _Rows, g: np.ndarray) -> np.ndarray:
        return np.append(rows.gathered(g), g.sum()) / rows.n

    for step in range(1, STEPS + 1):
        zp, zu = P.times(w) + w[-1] if P.width else np.full(P.n, w[-1]), U.times(w) + w[-1] if U.width else np.full(U.n, w[-1])
        sp, su = sigmoid(zp), sigmoid(zu)
        clean = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        negative = gradient(U, su) - prior * gradient(P, sp)
        if clean >= 0:
            slope = prior * gradient(P, sp - 1) + negative
        else:
            slope = -negative
        slope[:-1] += decay * w[:-1]
        m = 0.9 * m + 0.1 * slope
        v = 0.999 * v + 0.001 * slope**2
        rate = RATE * (1 - step / STEPS) + 1e-3
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(keys, w[:-1].copy(), float(w[-1]))


def held_out(doc_id: Column) -> Column:
    """A quarter of the ids, whose labels are never learnt from; a null id is not among them."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def _sample(documents: DataFrame, ids: DataFrame, most: int) -> list[np.ndarray]:
    """Word hashes of the distinct texts under the given ids, at most ``most`` texts, those with the smallest hash, however
    often an id repeats."""
    rows = documents.join(F.broadcast(ids), same(documents, ids, "doc_id"), "left_semi").select("doc_id", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            own = pa.array([xxhash.xxh64_intdigest(t.encode()) >> 1 for t in texts], pa.int64())
            keys = pa.array([word_keys(t).tobytes() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([own, keys], ["own", "keys"])

    found = rows.mapInArrow(read, "own long, keys binary").groupBy("own").agg(F.min("keys").alias("keys")).orderBy("own").limit(most).collect()
    return [np.frombuffer(bytes(r["keys"]), np.uint64) for r in sorted(found, key=lambda r: r["own"])]


def train(documents: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Learns from toxic rows of ``labels`` (doc_id, toxic) outside the held-out quarter and from documents
    whose labels are not looked at.

    The class prior is the share of toxic rows among those labels. An id with several labels is toxic if one
    of them says so; null labels are no labels. Ids and texts of the sample are at most ``max_toxic`` plus
    ``max_unlabelled``, whatever the size of the tables.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    n, positive = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).collect()[0]
    if not positive:
        return fit([], [], 0.0)
    order = F.xxhash64(F.lit("toxicity"), "doc_id")

    def first(ids: DataFrame, most: int) -> DataFrame:
        return ids.select("doc_id").orderBy(order, "doc_id").limit(most)

    toxic = _sample(documents, first(known.where("toxic = 1"), max_toxic), max_toxic)
    unlabelled = _sample(documents, first(documents.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))), max_unlabelled), max_unlabelled)
    return fit(toxic, unlabelled, min(0.9, max(0.001, positive / n)))


def score(documents: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; whole texts, no shuffle. Null and empty texts
    get the score of a text without known words."""
    rows = documents.select("doc_id", "text")
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            scores = [model.score(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = rows.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def score_toxicity(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Trains on ``labels`` and scores every row of ``documents``.

    Repeated rows and ids are scored alike. Without a toxic label to learn from every score is close to 0.
    An empty table gives an empty result; other columns are never read.
    """
    return score(documents, train(documents, labels), threshold)


def drop_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``documents`` that are scored below the threshold, columns unchanged, without a shuffle."""
    model = train(documents, labels)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t or "") for t in texts.to_pylist()], pa.float64())

    kept = documents.withColumn("__toxicity", scored(F.col("text"))).where(F.col("__toxicity") < threshold)
    return kept.select(*documents.columns)
