"""Quality classifier: supervised subword embeddings, learned from labelled rows with numpy.

A document is the mean of learned vectors, one for each hashed word and each hashed character n-gram of its
words; a softmax over two classes gives the score. A word that repeats the one before it counts as the mark SAME, so that
repetition is learned whatever is repeated; and each text holds PAD copies of a padding feature, so that the few
words of a short text don't decide alone. Training sees at most SAMPLE labelled documents (those with the smallest hash
of doc_id, whole texts), so the driver's part is bounded; scoring reads every text in full. Since the output is linear in
the vectors, each hashed feature is folded into one number before it is broadcast: 2**BITS floats, whatever the input.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.llm.common import give_back, neutral, prepare, text_bytes

SAMPLE = 4000
BITS, DIM, GRAMS = 17, 8, (2, 3, 4)
EPOCHS, RATE, SEED = 12, 0.5, 7
SAME, PAD, PAD_ID = b"\x00=", 60, 0
#: Distinct words that a worker remembers between texts; beyond it starts afresh.
_CACHE = 200_000
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    """Words at ASCII white space; one that equals the word before it is SAME."""
    words = text.split()
    return [SAME if a == b else a for a, b in zip(words, chain((None,), words))]  # noqa: B905


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed ids of the words and of their character n-grams, and for each the number of the word it comes from."""
    data = np.frombuffer(b"".join(b"<%b>" % w for w in words), np.uint8).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner, ends = np.repeat(np.arange(len(words)), sizes), np.cumsum(sizes)
    left = ends[owner] - np.arange(len(data))
    ids = [np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) % ((1 << BITS) - 1) + 1]
    owners = [np.arange(len(words))]
    for n in GRAMS:
        key = np.full(max(0, len(data) - n + 1), n << 40, np.uint64)
        for k in range(n):
            key |= data[k : len(data) - n + 1 + k] << np.uint64(8 * k)
        inside = left[: len(key)] >= n
        ids.append((((key * _SPREAD) >> np.uint64(40)).astype(np.int64) % ((1 << BITS) - 1) + 1)[inside])
        owners.append(owner[: len(key)][inside])
    return np.concatenate(ids), np.concatenate(owners)


def shares_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A text's feature ids, and the share that each has of all its features."""
    counts = Counter(words_of(text))
    ids, owners = features(list(counts)) if counts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    weights = np.bincount(ids, np.fromiter(counts.values(), float, len(counts))[owners], minlength=1) if counts else np.zeros(1)
    weights[PAD_ID] = PAD
    found = np.flatnonzero(weights)
    return found, (weights[found] / weights.sum()).astype(np.float32)


def in_training(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3, isn't 1; rows without an id never train."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) != 1, F.lit(False))


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [shares_of(t) for t in batch.column("body").to_pylist()]
        ids, shares = pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), ids, shares], names=["doc_id", "label", "ids", "shares"])


def train(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature ids, shares, label) -> vectors of features, output matrix and bias of the softmax."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    steps, done = max(1, EPOCHS * len(rows)), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            ids, shares, label = rows[k]
            rate = RATE * (1 - done / steps)
            done += 1
            mine = vectors[ids]
            hidden = shares @ mine
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            back = out @ p
            out -= rate * np.outer(hidden, p)
            bias -= rate * 0.1 * p
            # a vector moves by its share of the mean; the factor makes up for how small single shares are
            vectors[ids] = mine - (rate * 30) * shares[:, None] * back
    return vectors, out, bias


def folded(vectors: np.ndarray, out: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, float]:
    """A weight for each feature, and the bias, of the log odds of label 1."""
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


class Model:
    """The folded weights, and a score of texts."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.known = weights, bias, {}

    def __getstate__(self):
        return (self.weights, self.bias)

    def __setstate__(self, state):
        self.__init__(*state)

    def _learn(self, words: list[bytes]) -> None:
        """Remember each word's sum of weights (real part) and number of features (imaginary part)."""
        ids, owners = features(words)
        sums, counts = np.bincount(owners, self.weights[ids], minlength=len(words)), np.bincount(owners, minlength=len(words))
        self.known.update(zip(words, (sums + 1j * counts).tolist(), strict=True))

    def scores(self, texts: list[bytes]) -> list[float]:
        if len(self.known) > _CACHE:
            self.known.clear()
        split = [words_of(t) for t in texts]
        if unseen := list(set().union(*split).difference(self.known)):
            self._learn(unseen)
        get, pad = self.known.__getitem__, PAD * float(self.weights[PAD_ID])
        totals = np.array([sum(map(get, words), 0j) for words in split], complex)
        return (1 / (1 + np.exp(-(self.bias + (totals.real + pad) / (totals.imag + PAD))))).tolist()


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from the labelled documents outside the held-out third; labels of a repeated id are averaged, and of its
    texts the one with the smallest hash is learned from, so that at most `sample` rows reach the driver.

    Without any usable label every text scores 0.5. Rows without id, quality or text don't train.
    """
    prepare(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter("quality is not null").filter(in_training())
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    chosen = texts.filter("text is not null").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"), F.min_by(text_bytes(), F.xxhash64("text")).alias("body"))
    got = chosen.mapInArrow(_examples, "doc_id long, label int, ids array<int>, shares array<float>").toArrow()
    rows = []
    for i in np.argsort(got.column("doc_id").to_numpy(), kind="stable"):
        ids = np.asarray(got.column("ids")[i].values, dtype=np.int64)
        if len(ids) > 1:  # more than padding
            rows.append((ids, np.asarray(got.column("shares")[i].values, dtype=np.float32), got.column("label")[i].as_py()))
    if not rows:
        return Model(np.zeros(1 << BITS, np.float32), 0.0)
    return Model(*folded(*train(rows)))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """docs with `text` -> the kept columns (default: all) and `score`; null and empty texts get the bias alone."""
    spark = docs.sparkSession
    prepare(spark)
    kept = docs.columns if keep is None else keep
    inner = [f"c{i}" for i in range(len(kept))]
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value
        for batch in batches:
            scores = mine.scores(batch.column("body").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*inner, "score"])
        mine.known.clear()  # the worker goes on to other tasks
        give_back()

    frame = docs.select(*(F.col(f"`{k}`").alias(n) for k, n in zip(kept, inner, strict=True)), text_bytes(docs["text"]).alias("body"))
    schema = frame.drop("body").schema.add("score", "double")
    return frame.mapInArrow(run, schema).select(*(F.col(n).alias(k) for k, n in zip(kept, inner, strict=True)), "score")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score 0.5 or more; columns are those of docs."""
    frame, restored = neutral(docs)
    model = fit(frame, labels)
    give_back()  # what training took; the driver lives on through the other stages
    return restored(score(frame, model).filter("score >= 0.5"))
