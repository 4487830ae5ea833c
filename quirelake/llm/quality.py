"""Quality scores: random-indexing word vectors, a two-layer network, calibrated by temperature."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm.remembered import Remembered

#: Words share this many vectors by hash, which bounds the table that is broadcast.
BUCKETS = 1 << 14
DIM = 32
#: Words to each side that are context, and nonzero places of a context's index vector.
REACH = 2
PLACES = 2
#: Labelled rows the network is fitted on, at most.
SAMPLE = 20_000
HIDDEN = 32
EPOCHS = 30
#: Share of the sample that sets the temperature.
CALIBRATION = 0.2
SEED = 9
#: Tokens handled at once.
BLOCK = 1 << 16
#: Chunks a worker remembers in each of two generations.
REMEMBERED = 1 << 17

_PARTS = re.compile(r"[^\W\d_]+|\d+|_+|[^\w\s]+")


def _bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % BUCKETS


_AGAIN, _CAPS, _NUMBER = (_bucket(f"\x00{mark}") for mark in ("again", "caps", "number"))


class _Chunks(Remembered):
    """Token buckets of a chunk between white space, as packed 16-bit numbers."""

    limit = REMEMBERED

    def fresh(self, chunk: str) -> bytes:
        out = []
        for part in _PARTS.findall(chunk):
            if part[0].isalpha():
                if len(part) > 1 and part.isupper():
                    out.append(_CAPS)
                out.append(_bucket(part.lower()))
            else:
                out.append(_NUMBER if part[0].isdigit() else _bucket(part))
        return array("H", out).tobytes()


@cache
def _known() -> _Chunks:
    return _Chunks()


def tokens(text: str) -> np.ndarray:
    """Buckets of the words and marks of a text; a token like the one or two before it reads "again"."""
    known = _known()
    ids = np.frombuffer(b"".join([known[c] for c in text.split()]), "<u2").astype(np.int64)
    again = np.zeros(len(ids), bool)
    for back in (1, 2):
        again[back:] |= ids[back:] == ids[:-back]
    ids[again] = _AGAIN
    return ids


@cache
def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the sparse index vector of each bucket."""
    draw = np.random.default_rng(SEED)
    return draw.integers(0, DIM, (PLACES, BUCKETS)), draw.choice([-1.0, 1.0], (PLACES, BUCKETS))


def context_sums(texts: Iterator[str]) -> np.ndarray:
    """For each bucket the sum of the index vectors of all words near its words."""
    places, signs = index_vectors()
    sums = np.zeros(BUCKETS * DIM)
    held: list[np.ndarray] = []
    size = 0
    gap = np.full(REACH, -1)

    def add() -> None:
        ids = np.concatenate(held)
        for reach in range(1, REACH + 1):
            left, right = ids[:-reach], ids[reach:]
            real = (left >= 0) & (right >= 0)
            left, right = left[real], right[real]
            for word, near in ((left, right), (right, left)):
                for k in range(PLACES):
                    sums[:] += np.bincount(word * DIM + places[k][near], signs[k][near], BUCKETS * DIM)

    for text in texts:
        ids = tokens(text)
        for at in range(0, len(ids), BLOCK):
            held += [ids[max(0, at - REACH) : at + BLOCK] if not at else ids[at : at + BLOCK], gap]
            size += min(BLOCK, len(ids) - at)
            if size >= 16 * BLOCK:
                add()
                held, size = [], 0
    if held:
        add()
    return sums.reshape(BUCKETS, DIM)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Random-indexing vectors of unit length, from all texts.

    Every partition sums its contexts; the sums are added per bucket. The result has
    ``BUCKETS`` rows whatever the corpus.
    """
    names = [f"d{k}" for k in range(DIM)]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = context_sums(t for batch in batches for t in batch.column(0).to_pylist() if t)
        rows = np.flatnonzero(sums.any(axis=1))
        columns = [pa.array(rows.astype(np.int32)), *(pa.array(sums[rows, k].astype(np.int64)) for k in range(DIM))]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", *names])

    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(of, "bucket int, " + ", ".join(f"{n} long" for n in names))
    total = parts.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    vectors = np.zeros((BUCKETS, DIM), np.float32)
    if len(total):
        found = total[names].to_numpy(np.float64)
        vectors[total["bucket"].to_numpy()] = found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)
    return vectors


def pooled(text: str, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of a text's word vectors, and the logarithm of its length."""
    ids = tokens(text)
    total, squares = np.zeros(DIM), np.zeros(DIM)
    for at in range(0, len(ids), BLOCK):
        counts = np.bincount(ids[at : at + BLOCK], minlength=1)
        seen = np.flatnonzero(counts)
        rows = vectors[seen].astype(np.float64)
        total += counts[seen] @ rows
        squares += counts[seen] @ (rows * rows)
    n = max(len(ids), 1)
    mean = total / n
    return np.concatenate([mean, np.sqrt(np.maximum(squares / n - mean * mean, 0)), [np.log1p(len(ids))]])


@dataclass
class Network:
    """Two layers over standardised inputs; ``temperature`` divides the output."""

    centre: np.ndarray
    scale: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    outer: np.ndarray
    outer_bias: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum(((x - self.centre) / self.scale) @ self.inner + self.inner_bias, 0)
        return hidden @ self.outer + self.outer_bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = SEED, rate: float = 3e-3, decay: float = 1e-4) -> Network:
    """Fit by Adam on a part of the rows, then the temperature on the rest.

    With no rows, or rows of one class, scores are that class's smoothed share.
    """
    draw = np.random.default_rng(seed)
    width = x.shape[1] if x.ndim == 2 else 2 * DIM + 1
    if len(y) < 10 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    order = draw.permutation(len(y))
    kept, held = order[int(CALIBRATION * len(y)) :], order[: int(CALIBRATION * len(y))]
    centre, scale = x[kept].mean(axis=0), np.maximum(x[kept].std(axis=0), 1e-6)
    net = Network(centre, scale, draw.normal(0, np.sqrt(2 / width), (width, hidden)), np.zeros(hidden), draw.normal(0, np.sqrt(1 / hidden), hidden), 0.0)
    values = [net.inner, net.inner_bias, net.outer, np.zeros(1)]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    inputs, step = (x - centre) / scale, 0
    for _ in range(epochs):
        for rows in np.array_split(draw.permutation(kept), max(1, len(kept) // 128)):
            step += 1
            before = inputs[rows] @ values[0] + values[1]
            active = np.maximum(before, 0)
            error = (1 / (1 + np.exp(-np.clip(active @ values[2] + values[3][0], -40, 40))) - y[rows]) / len(rows)
            back = np.outer(error, values[2]) * (before > 0)
            slopes = [inputs[rows].T @ back + decay * values[0], back.sum(axis=0), active.T @ error + decay * values[2], np.array([error.sum()])]
            for k, slope in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope * slope
                values[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    net.outer_bias = float(values[3][0])
    net.temperature = temperature(net.logits(x[held]), y[held])
    return net


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, between 0.25 and 8."""
    steps = np.exp(np.linspace(np.log(0.25), np.log(8), 141))
    sign = np.where(y > 0, -1.0, 1.0)
    return float(min(steps, key=lambda t: np.logaddexp(0, sign * logits / t).mean() if len(y) else abs(np.log(t))))


def labelled_sample(labels: DataFrame, rows: int = SAMPLE, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """``_id, label`` of at most ``rows`` documents to learn from, by the order of an id hash.

    Ids whose decimal text has CRC-32 2 modulo 4 are held out. Several labels of an
    id count as their rounded mean; null ids and labels are left out.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    each = usable.groupBy(F.col(id_col).alias("_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    return each.orderBy(F.xxhash64("_id"), "_id").limit(rows)


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> tuple[Broadcast, Broadcast]:
    """Word vectors from all documents and a network fitted on the labelled sample, broadcast."""
    context = docs.sparkSession.sparkContext
    vectors = context.broadcast(word_vectors(docs, text_col))

    @F.arrow_udf("array<double>")
    def pool(texts: pa.Array) -> pa.Array:
        return pa.array([pooled(t or "", vectors.value).tolist() for t in texts.to_pylist()], pa.list_(pa.float64()))

    # The sample has at most ``rows`` rows of two numbers, so it may be broadcast.
    # Of several rows of an id one text is learnt from, so the driver gets no more rows than that.
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(
        F.broadcast(labelled_sample(labels, rows)), F.col("doc_id") == F.col("_id"))
    each = chosen.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = sorted((r["doc_id"], tuple(r["x"]), r["label"]) for r in each.select("doc_id", pool("text").alias("x"), "label").collect())
    x = np.array([f[1] for f in found]).reshape(-1, 2 * DIM + 1)
    return vectors, context.broadcast(fit(x, np.array([f[2] for f in found], float)))


def score(text: Column, model: tuple[Broadcast, Broadcast]) -> Column:
    """The calibrated probability that a text is of good quality; a null text counts as empty."""
    vectors, network = model

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        rows = [pooled(t or "", vectors.value) for t in texts.to_pylist()]
        return pa.array(network.value.scores(np.array(rows)) if rows else np.zeros(0), pa.float64())

    return scored(text)


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, held_out, score, predicted``.

    Only the text decides a score, so equal texts score alike; null and empty texts
    get the score of no words. A null id is never learnt from and not held out.
    Of several rows of a labelled id one text is learnt from, the one of least hash.
    Without usable labels every score is one half. An empty table gives no rows; of
    the other columns none is read, whatever their names.
    """
    model = train(docs, labels, rows, id_col, text_col)
    out = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), score(F.col(text_col), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns."""
    return docs.where(score(F.col(text_col), train(docs, labels, rows, id_col, text_col)) >= threshold)
