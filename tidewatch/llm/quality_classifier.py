"""Quality classification: random-indexing word vectors pooled per document, and a small network.

Word vectors: every word has a sparse ternary index vector, drawn from its hash, and so has every letter
shape. A word is kept in two hash buckets, so that words which share one rarely share the other; a
bucket's vector is the sum of the index vectors of its words' neighbours, and of their shapes, over all
documents, divided by the bucket's words, centred and scaled. Documents are pooled as the mean and the
spread of their words' vectors with the mean of their shapes, and a network of two layers, trained in
numpy, gives a probability calibrated by a temperature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import WordHashes, chunks, hash_share, held_out, map_arrow, map_chunks

#: Buckets that words are hashed to (two a word), those of shapes, and the size of vectors; all bound what is collected.
BUCKETS = 1 << 15
SHAPES = 1 << 12
SIZE = 48
#: Labelled documents that the network is fitted on at most.
TRAIN_DOCS = 20_000
HIDDEN = 32
#: Tasks whose word vectors are summed in one group.
TASKS_AT_ONCE = 256
#: Texts that are pooled at once; each word of them takes a vector of memory.
POOLED_ROWS = 96
THRESHOLD = 0.3

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

#: Classes of bytes in a word's shape: capital, small or non-ASCII letter, digit, other.
_SHAPES = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))


def shape(word: bytes) -> bytes:
    """The classes of the word's first two and last three bytes."""
    classes = word.translate(_SHAPES)
    return classes[:2] + b" " + classes[-3:]


class WordBuckets(dict):
    """word -> its two buckets and that of its shape as one number; forgets all beyond a bound."""

    def __init__(self) -> None:
        super().__init__()
        self.shapes = WordHashes(10_000)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        found = xxh64_intdigest(word.lower())
        self[word] = value = (found % BUCKETS * BUCKETS + (found >> 32) % BUCKETS) * SHAPES + self.shapes[shape(word)] % SHAPES
        return value


def _index_vectors(salt: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places and signs of each of n index vectors, by a fixed generator."""
    rng = np.random.default_rng(salt)
    return rng.integers(0, SIZE, (n, 2)), rng.choice([-1.0, 1.0], (n, 2)).astype(np.float32)


@dataclass
class Words:
    """The words of several texts, in order: buckets, shape, whether the word repeats the one before, and number of the text."""

    one: np.ndarray
    two: np.ndarray
    form: np.ndarray
    repeats: np.ndarray
    text: np.ndarray


class Reader:
    """Turns texts to words; holds the index vectors."""

    def __init__(self) -> None:
        self.buckets = WordBuckets()
        self.word_places, self.word_signs = _index_vectors(11, BUCKETS)
        self.form_places, self.form_signs = _index_vectors(12, SHAPES)
        self.form_index = np.zeros((SHAPES, SIZE), np.float32)
        for k in range(2):
            np.add.at(self.form_index, (np.arange(SHAPES), self.form_places[:, k]), self.form_signs[:, k])

    def read(self, texts: list[str | None]) -> Words:
        split = [(t or "").encode("utf-8", "replace").split() for t in texts]
        sizes = np.array([len(s) for s in split])
        every = np.fromiter((v for s in split for v in map(self.buckets.__getitem__, s)), np.int64, int(sizes.sum()))
        text = np.repeat(np.arange(len(texts)), sizes)
        word, form = every // SHAPES, every % SHAPES
        repeats = np.zeros(len(every), bool)
        if len(every) > 1:
            repeats[1:] = (word[1:] == word[:-1]) & (text[1:] == text[:-1])
        return Words(word // BUCKETS, word % BUCKETS, form, repeats, text)

    def context_sums(self, w: Words) -> np.ndarray:
        """For each bucket the sum of the index vectors of its words' neighbours and of their shapes: whole numbers."""
        near = np.flatnonzero(w.text[1:] == w.text[:-1])
        flat, signs = [], []
        for at, other in ((near, near + 1), (near + 1, near)):
            # A neighbour's index vector is that of its first bucket.
            for places, sign, kind in ((self.word_places, self.word_signs, w.one[other]), (self.form_places, self.form_signs, w.form[other])):
                for k in range(2):
                    for bucket in (w.one, w.two):
                        flat.append(bucket[at] * SIZE + places[kind, k])
                        signs.append(sign[kind, k])
        return np.bincount(np.concatenate(flat), np.concatenate(signs), BUCKETS * SIZE).reshape(BUCKETS, SIZE).astype(np.int64)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Vectors of all buckets from the neighbours of every word of every document.

    Each task adds up the whole texts it reads; sums of a bucket are added by Spark, so that what
    reaches the driver is one vector a bucket. Sums are whole numbers, the same in any order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        reader, total, count = Reader(), np.zeros((BUCKETS, SIZE), np.int64), np.zeros(BUCKETS, np.int64)
        for chunk in chunks(batches, 512):
            w = reader.read(chunk.column(0).to_pylist())
            if len(w.one) > 1:
                total += reader.context_sums(w)
            count += np.bincount(w.one, minlength=BUCKETS) + np.bincount(w.two, minlength=BUCKETS)
        used = np.flatnonzero(count)
        task = np.full(len(used), TaskContext.get().partitionId())
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(count[used], pa.int64()), pa.array([v.tobytes() for v in total[used].astype("<i4")], pa.binary()), pa.array(task, pa.int64())], names=["bucket", "n", "vector", "task"])

    def adder(kind: str):
        def add(batch: pa.Table) -> pa.Table:
            vectors = np.frombuffer(b"".join(batch.column("vector").to_pylist()), kind).reshape(-1, SIZE)
            used, inverse = np.unique(batch.column("bucket").to_numpy(), return_inverse=True)
            total, n = np.zeros((len(used), SIZE), np.int64), np.zeros(len(used), np.int64)
            np.add.at(total, inverse, vectors)
            np.add.at(n, inverse, batch.column("n").to_numpy())
            return pa.table({"bucket": pa.array(used, pa.int64()), "n": pa.array(n), "vector": pa.array([v.tobytes() for v in total], pa.binary())})

        return add

    # Groups of buckets: first those of TASKS_AT_ONCE tasks at most, then their sums.
    parts = map_arrow(docs.select("text"), run, "bucket long, n long, vector binary, task long").withColumn("g", F.col("bucket") % 64)
    lots = parts.groupBy("g", F.floor(F.col("task") / TASKS_AT_ONCE).alias("lot")).applyInArrow(adder("<i4"), "bucket long, n long, vector binary")
    rows = lots.groupBy((F.col("bucket") % 64).alias("g")).applyInArrow(adder("<i8"), "bucket long, n long, vector binary").collect()
    sums, n = np.zeros((BUCKETS, SIZE)), np.zeros(BUCKETS)
    for r in rows:
        sums[r["bucket"]], n[r["bucket"]] = np.frombuffer(r["vector"], "<i8"), r["n"]
    return scaled(sums, n)


def scaled(sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Vectors of buckets from their sums and words: means, centred and scaled over all words; zero for buckets without words."""
    weight = n[:, None] / max(1.0, n.sum())
    mean = sums / np.maximum(n, 1)[:, None]
    mean = mean - (weight * mean).sum(axis=0)
    mean /= np.sqrt((weight * mean * mean).sum(axis=0)) + 1e-6
    return np.where(n[:, None] > 0, mean, 0).astype(np.float32)


def pooled(reader: Reader, vectors: np.ndarray, texts: list[str | None]) -> np.ndarray:
    """Features of each text: mean and spread of its word vectors, mean of its shapes, repeats, length."""
    w = reader.read(texts)
    text = w.text
    n = np.bincount(text, minlength=len(texts)).astype(np.float32)
    safe = np.maximum(n, 1)[:, None]
    out = np.zeros((len(texts), 3 * SIZE + 3), np.float32)
    if len(text):
        starts = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        owners = text[starts]

        def mean(values: np.ndarray) -> np.ndarray:
            total = np.zeros((len(texts), SIZE), np.float32)
            total[owners] = np.add.reduceat(values, starts, axis=0)
            return total / safe

        seen = vectors[w.one]
        seen += vectors[w.two]
        out[:, :SIZE] = middle = mean(seen)
        np.square(seen, out=seen)
        out[:, SIZE : 2 * SIZE] = np.sqrt(np.maximum(mean(seen) - middle * middle, 0))
        out[:, 2 * SIZE : 3 * SIZE] = mean(reader.form_index[w.form])
        out[:, -3] = np.bincount(text, w.repeats, len(texts)) / safe[:, 0]
    out[:, -2] = np.log1p(n)
    out[:, -1] = n == 0
    return out


@dataclass
class Network:
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.centre) / self.scale @ self.first + self.first_bias)
        return hidden @ self.second + self.second_bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def gradient(values: list[np.ndarray], z: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Loss of rows z with labels y, and its slopes by first and second layer and their biases."""
    first, first_bias, second, second_bias = values
    hidden = np.tanh(z @ first + first_bias)
    p = 1 / (1 + np.exp(-np.clip(hidden @ second + second_bias, -30, 30)))
    loss = -np.mean(np.where(y > 0, np.log(p), np.log(1 - p))) + 0.5e-4 * np.sum(first * first)
    error = (p - y) / len(z)
    back = error[:, None] * second[None, :] * (1 - hidden * hidden)
    return float(loss), [z.T @ back + 1e-4 * first, back.sum(axis=0), hidden.T @ error, np.array([error.sum()])]


def train(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, rounds: int = 60, seed: int = 5) -> Network:
    """Adam on four fifths of the rows; the temperature is chosen on the rest."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    check, rest = order[: len(x) // 5], order[len(x) // 5 :]
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    net = Network(vectors, centre, scale, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), 0.0)
    z = ((x - centre) / scale).astype(np.float64)
    values = [net.first, net.first_bias, net.second, np.zeros(1)]
    mean, var, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    for _ in range(rounds):
        rng.shuffle(rest)
        for at in range(0, len(rest), 256):
            rows = rest[at : at + 256]
            _, slopes = gradient(values, z[rows], y[rows])
            step += 1
            for k, g in enumerate(slopes):
                mean[k] = 0.9 * mean[k] + 0.1 * g
                var[k] = 0.999 * var[k] + 0.001 * g * g
                values[k] -= 0.003 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.999**step)) + 1e-8)
    net.first, net.first_bias, net.second, net.second_bias = values[0], values[1], values[2], float(values[3][0])
    held = net.logits(x[check]) if len(check) else np.zeros(0)
    best = (np.inf, 1.0)
    for t in np.geomspace(0.25, 8, 26):
        p = np.clip(1 / (1 + np.exp(-np.clip(held / t, -30, 30))), 1e-6, 1 - 1e-6)
        loss = -np.mean(np.where(y[check] > 0, np.log(p), np.log(1 - p))) if len(check) else 0.0
        best = min(best, (float(loss), float(t)))
    net.temperature = best[1]
    return net


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Network | float:
    """A network from labels(doc_id, quality, ...) of ids that are not held out.

    At most about train_docs labelled documents are used, chosen by a hash of doc_id; of repeated
    labels of one id the larger counts, and of repeated rows of one id the one whose features come
    first. Word vectors are counted over all documents. Without both classes there is nothing to
    learn: then the share of label 1 (0.5 without labels) is returned.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = known.count()
    sample = known.where(hash_share(F.col("doc_id"), F.lit(train_docs / max(n, 1))))
    classes = {r["q"]: r["count"] for r in sample.groupBy((F.col("quality") > 0).alias("q")).count().collect()}
    if len(classes) < 2:
        return float(next(iter(classes), 0.5))
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(columns: dict[str, list], reader: Reader) -> dict[str, list]:
        return {"quality": columns["quality"], "x": [v.tobytes() for v in pooled(reader, shared.value, columns["text"])]}

    # The sample has at most about train_docs ids, so it can be broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", F.col("quality").cast("long").alias("quality"), "text")
    found = map_chunks(rows, lambda c, r: {"doc_id": c["doc_id"]} | features(c, r), "doc_id long, quality long, x binary", Reader, POOLED_ROWS)
    got = found.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("x").alias("x")).collect()
    got.sort(key=lambda r: r["doc_id"])
    y = np.array([r["quality"] > 0 for r in got], float)
    if len(set(y.tolist())) < 2:  # no document, or those of one class only
        return float(y.mean()) if len(y) else 0.5
    x = np.frombuffer(b"".join(r["x"] for r in got), np.float32).reshape(len(got), -1)
    return train(x, y, vectors)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, train_docs: int = TRAIN_DOCS, keep: bool = False) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs(doc_id, text, ...).

    Only texts enter a score. Null and empty texts are scored as texts without words; repeated rows
    are scored each; a null doc_id is not held out; texts of any length are read whole; other columns
    may have any names. An empty table gives no rows. With keep, the rows of docs with a score of at
    least threshold are returned with all their columns.
    """
    # Pickled by value, so workers need no copy of this package.
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(fit(docs, labels, train_docs)))

    def setup() -> tuple[Network | float, Reader]:
        return cloudpickle.loads(shared.value), Reader()

    def scores(texts: list[str | None], state: tuple[Network | float, Reader]) -> list[float]:
        net, reader = state
        return [net] * len(texts) if isinstance(net, float) else net.scores(pooled(reader, net.vectors, texts)).tolist()

    if keep:
        place = docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state = setup()
            for chunk in chunks(batches, POOLED_ROWS):
                yield chunk.filter(pa.array([s >= threshold for s in scores(chunk.column(place).to_pylist(), state)], pa.bool_()))

        return map_arrow(docs, run, docs.schema)

    def judge(columns: dict[str, list], state: tuple[Network | float, Reader]) -> dict[str, list]:
        got = scores(columns["text"], state)
        return {"doc_id": columns["doc_id"], "held_out": columns["held_out"], "score": got, "predicted": [int(s >= threshold) for s in got]}

    return map_chunks(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), judge, SCHEMA, setup, POOLED_ROWS)
