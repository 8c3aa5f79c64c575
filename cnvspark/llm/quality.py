"""Quality by random-indexing word vectors, pooled over a text, and a two-layer network in numpy.

Every word has a fixed sparse random index vector, made from its hash into a bounded number of buckets: words of one bucket
share it, which keeps what is gathered over the whole corpus bounded. A word's vector is the sum of the index vectors of
the words around it over the whole corpus, so words in like company have like vectors. A text is the mean of its
words' vectors. A network with one hidden layer maps it to a logit, and a temperature makes that a probability.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cnvspark.llm.common import single_threaded
from cnvspark.llm.labelled import training_rows

_PARTS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
DIM = 32
_NONZERO = 4


class _Ids(dict):
    """Word as written -> the buckets of its parts: letters in lower case, digits as one kind, marks as they are.
    A word in capitals gives a part that says so.
    """

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, word: str) -> tuple[int, ...]:
        parts = ["<number>" if p[0].isdigit() else p.lower() for p in _PARTS.findall(word)]
        if len(word) > 1 and word.isupper():
            parts.append("<capitals>")
        value = tuple(xxhash.xxh64_intdigest(p, 5) % self.buckets for p in parts)
        if len(self) > 500_000:
            self.clear()
        self[word] = value
        return value


@lru_cache(maxsize=4)
def _ids(buckets: int) -> _Ids:
    return _Ids(buckets)


def part_ids(text: str, buckets: int) -> np.ndarray:
    """The buckets of a text's parts in order; a word that comes again at once gives a part that says so."""
    words = text.split()
    repeat = (xxhash.xxh64_intdigest("<repeat>", 5) % buckets,)
    out: list[int] = []
    before = None
    of = _ids(buckets).__getitem__
    for w in words:
        out.extend(of(w) if w != before else repeat)
        before = w
    return np.array(out, np.int64)


@lru_cache(maxsize=4)
def index_vectors(buckets: int, dim: int = DIM, nonzero: int = _NONZERO, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the few non-zero entries of every bucket's index vector."""
    rng = np.random.default_rng(seed)
    places = np.argsort(rng.random((buckets, dim)), axis=1)[:, :nonzero]
    signs = rng.choice([-1, 1], (buckets, nonzero))
    return places, signs


def contexts(series: list[np.ndarray], buckets: int, reach: int) -> np.ndarray:
    """The summed index vectors of the parts within ``reach`` of each bucket's occurrences (buckets by dimensions)."""
    places, signs = index_vectors(buckets)
    gap = np.full(reach, -1)
    x = np.concatenate([y for s in series for y in (s, gap)]) if series else np.empty(0, np.int64)
    out = np.zeros(buckets * DIM)
    for d in range(1, reach + 1):
        for a, b in ((x[:-d], x[d:]), (x[d:], x[:-d])):
            ok = (a >= 0) & (b >= 0)
            pairs, n = np.unique(a[ok] * buckets + b[ok], return_counts=True)
            a_, b_ = pairs // buckets, pairs % buckets
            out += np.bincount((a_[:, None] * DIM + places[b_]).ravel(), (signs[b_] * n[:, None]).ravel(), buckets * DIM)
    return out.reshape(buckets, DIM)


def word_vectors(docs: DataFrame, *, text_col: str = "text", buckets: int = 1 << 13, reach: int = 2) -> np.ndarray:
    """Word vectors from all whole texts, scaled to length one (buckets by dimensions).

    Each task sums up what it has read and gives at most one row for each bucket; Spark adds these up. The result
    has a size that the two parameters fix, whatever the corpus, so it may come to the driver.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((buckets, DIM))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                total += contexts([part_ids(t or "", buckets) for t in batch.column(0).slice(at, 512).to_pylist()], buckets, reach)
        rows = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *(pa.array(total[rows, d].astype(np.int64)) for d in range(DIM))], ["bucket", *(f"v{d}" for d in range(DIM))])

    names = [f"v{d}" for d in range(DIM)]
    found = docs.select(docs[text_col].alias("text")).mapInArrow(gather, "bucket int, " + ", ".join(f"{n} long" for n in names))
    out = np.zeros((buckets, DIM))
    for bucket, *v in found.groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names)).toLocalIterator():
        out[bucket] = v
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(series: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
    """The mean vector of each text, and how long it is on a log scale; zeros for a text without parts."""
    out = np.zeros((len(series), vectors.shape[1] + 1), np.float32)
    lengths = np.array([len(s) for s in series])
    full = np.flatnonzero(lengths)
    if len(full):
        starts = np.concatenate([[0], np.cumsum(lengths[full])[:-1]])
        out[full, :-1] = np.add.reduceat(vectors[np.concatenate([series[i] for i in full])], starts) / lengths[full, None]
        out[full, -1] = np.log1p(lengths[full]) / 10
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class TwoLayers:
    """One hidden layer of rectified units, trained by Adam on cross-entropy; inputs are standardised."""

    def __init__(self, inputs: int, hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        self.p = {"W": rng.normal(0, np.sqrt(2 / inputs), (inputs, hidden)), "b": np.zeros(hidden), "o": rng.normal(0, np.sqrt(1 / hidden), hidden), "c": np.zeros(1)}
        self.mean, self.scale, self.temperature = np.zeros(inputs), np.ones(inputs), 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        p = self.p
        return np.maximum(((x - self.mean) / self.scale) @ p["W"] + p["b"], 0) @ p["o"] + p["c"][0]

    def fit(self, x: np.ndarray, y: np.ndarray, *, epochs: int = 60, batch: int = 64, rate: float = 0.005, decay: float = 1e-4, seed: int = 1) -> None:
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        z, rng, p, t = (x - self.mean) / self.scale, np.random.default_rng(seed), self.p, 0
        m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), batch):
                a, b = z[order[i : i + batch]], y[order[i : i + batch]]
                h = a @ p["W"] + p["b"]
                r = np.maximum(h, 0)
                d = (_sigmoid(r @ p["o"] + p["c"][0]) - b) / len(b)
                dh = d[:, None] * p["o"] * (h > 0)
                g = {"o": r.T @ d + decay * p["o"], "c": d.sum(keepdims=True), "W": a.T @ dh + decay * p["W"], "b": dh.sum(axis=0)}
                t += 1
                for k, x_ in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * x_
                    v[k] = 0.999 * v[k] + 0.001 * x_ * x_
                    p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Chooses the temperature of least cross-entropy on rows that the network was not fitted to."""
        z = self.logits(x)
        loss = lambda t: -np.mean(y * np.log(_sigmoid(z / t) + 1e-9) + (1 - y) * np.log(1 - _sigmoid(z / t) + 1e-9))
        self.temperature = float(min(np.geomspace(0.25, 8, 60), key=loss))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


class QualityModel:
    """Word vectors and a network; without labels of both classes the network is missing and every score is ``prior``."""

    def __init__(self, vectors: np.ndarray, net: TwoLayers | None, prior: float):
        self.vectors, self.net, self.prior = vectors, net, prior

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.net is None:
            return np.full(len(texts), self.prior)
        return self.net.probability(pooled([part_ids(t, len(self.vectors)) for t in texts], self.vectors))


def train(rows: list[tuple[str, int]], vectors: np.ndarray, *, hidden: int = 16, seed: int = 5) -> QualityModel:
    """Fits the network on four fifths of (text, label) and its temperature on the rest."""
    if len({y for _, y in rows}) < 2:
        return QualityModel(vectors, None, float(rows[0][1]) if rows else 0.5)
    single_threaded()
    x = pooled([part_ids(t, len(vectors)) for t, _ in rows], vectors)
    y = np.array([y for _, y in rows], float)
    order = np.random.default_rng(seed).permutation(len(y))
    rest, fitted = order[: len(y) // 5], order[len(y) // 5 :]
    net = TwoLayers(x.shape[1], hidden, seed)
    net.fit(x[fitted], y[fitted])
    if len(rest):
        net.calibrate(x[rest], y[rest])
    return QualityModel(vectors, net, float(y.mean()))


def fit_quality(docs: DataFrame, labels: DataFrame, *, per_class: int = 3000, longest: int = 20_000, **options) -> QualityModel:
    """Word vectors from all of ``docs``, the network from at most ``per_class`` labelled texts of each class of at most
    ``longest`` code points, never held-out rows.
    """
    vectors = word_vectors(docs, **options)
    return train(training_rows(docs, labels, "quality", per_class, longest), vectors)


def score_quality(docs: DataFrame, model: QualityModel, *, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """All rows of ``docs`` with the score of their whole text, between 0 and 1 (higher: better).

    A null text is empty; an empty one gets the score of a zero vector; equal texts score equal; an empty table
    gives no rows; a column named ``score_col`` is replaced and all others stay. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.drop(score_col)
    at, schema = rows.columns.index(text_col), rows.schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                scores = shared.value.scores([t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], [*part.schema.names, score_col])

    return rows.mapInArrow(score, StructType([*schema.fields, StructField(score_col, DoubleType())]))
