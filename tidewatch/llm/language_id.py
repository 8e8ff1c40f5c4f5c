"""Language identification with a string kernel.

Two texts' kernel value is the number of byte n-grams of 1 to 3 bytes (blended spectrum) present in
both, over the root of the product of their numbers. A few training texts are Nystroem landmarks: a
text's features are its kernel values with them times the inverse root of the landmarks' own kernel
matrix, and one-versus-rest kernel ridge regression is solved on these features. Scoring is two
matrix products a batch: presence matrix by landmark presence matrix, which is taken in blocks of
n-grams, so that every n-gram of a landmark counts whatever their number; then by the weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, held_out, map_chunks, stored

#: Bounds of the sample that the classifier is fitted on: training texts in all, landmarks of a
#: language and in all. Where there are more languages than landmarks, those with most texts are learned.
TRAIN_TEXTS = 4_000
LANDMARKS = 24
MOST_LANDMARKS = 1_600
#: N-grams of a block of the matrix product, and texts that are scored at once.
BLOCK_GRAMS = 1 << 14
SCORED_ROWS = 256
RIDGE = 1e-2

#: Parts that a language's rows are ordered in.
SALTS = 64
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def grams(text: str) -> np.ndarray:
    """Distinct n-grams of 1 to 3 bytes of the lower-cased text with one blank at both ends, as sorted codes."""
    raw = np.frombuffer(b" " + " ".join(text.lower().split()).encode("utf-8", "replace") + b" ", np.uint8).astype(np.int32)
    two = (raw[:-1] << 8 | raw[1:]) + (1 << 24)
    seen = np.unique(raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:])
    return np.concatenate([seen, np.unique(two), np.unique(raw) + (1 << 24) + (1 << 16)])


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


#: Codes of n-grams: three bytes, then two, then one.
CODES = (1 << 24) + (1 << 16) + (1 << 8)


@dataclass
class Landmarks:
    """The n-grams of the landmarks: sorted codes, and which landmarks have each (from starts[k] to starts[k + 1])."""

    vocabulary: np.ndarray
    starts: np.ndarray
    owners: np.ndarray
    sizes: np.ndarray  # n-grams of each landmark

    @classmethod
    def of(cls, found: list[np.ndarray]) -> Landmarks:
        codes = np.concatenate(found)
        owners = np.repeat(np.arange(len(found), dtype=np.int32), [len(c) for c in found])
        order = np.argsort(codes, kind="stable")
        vocabulary, starts = np.unique(codes[order], return_index=True)
        return cls(vocabulary, np.r_[starts, len(codes)], owners[order], np.array([len(c) for c in found], np.float32))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}  # not what is looked up with

    def places(self, codes: np.ndarray) -> np.ndarray:
        """Places in the vocabulary of the codes that it has."""
        if getattr(self, "_lookup", None) is None:
            self._lookup = np.full(CODES, -1, np.int32)
            self._lookup[self.vocabulary] = np.arange(len(self.vocabulary), dtype=np.int32)
        out = self._lookup[codes]
        return out[out >= 0]

    def block(self, k: int) -> np.ndarray:
        """Presence of a block of the vocabulary in each landmark; kept if there is one block only."""
        only = len(self.vocabulary) <= BLOCK_GRAMS
        if only and getattr(self, "_block", None) is not None:
            return self._block
        first, last = k * BLOCK_GRAMS, min(len(self.vocabulary), (k + 1) * BLOCK_GRAMS)
        out = np.zeros((last - first, len(self.sizes)), np.float32)
        rows = np.repeat(np.arange(last - first), np.diff(self.starts[first : last + 1]))
        out[rows, self.owners[self.starts[first] : self.starts[last]]] = 1
        if only:
            self._block = out
        return out

    def kernel(self, texts: list[np.ndarray]) -> np.ndarray:
        """Kernel values of texts, given as codes, with the landmarks."""
        places = [self.places(c) for c in texts]
        text = np.repeat(np.arange(len(texts)), [len(p) for p in places])
        place = np.concatenate([np.zeros(0, np.int32), *places])
        common = np.zeros((len(texts), len(self.sizes)), np.float32)
        for k in range(-(-len(self.vocabulary) // BLOCK_GRAMS)):
            here = place // BLOCK_GRAMS == k
            marks = self.block(k)
            presence = np.zeros((len(texts), len(marks)), np.float32)
            presence[text[here], place[here] - k * BLOCK_GRAMS] = 1
            common += presence @ marks
        sizes = np.array([max(1, len(c)) for c in texts], np.float32)
        return common / np.sqrt(sizes[:, None] * self.sizes[None, :])


@dataclass
class Model:
    languages: list[str]
    landmarks: Landmarks
    weights: np.ndarray  # landmarks x languages
    sharpness: float = 8.0

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        raw = self.landmarks.kernel([grams(t) for t in texts]) @ self.weights
        power = np.exp(self.sharpness * (raw - raw.max(axis=1, keepdims=True)))
        best = raw.argmax(axis=1)
        share = power[np.arange(len(raw)), best] / power.sum(axis=1)
        return [self.languages[b] for b in best], share.astype(float).tolist()


def solve(found: list[np.ndarray], target: np.ndarray, n_languages: int, each: int) -> tuple[Landmarks, np.ndarray]:
    """Landmarks (the first `each` texts of every language) and weights, from texts as codes and their languages' numbers."""
    chosen = np.concatenate([np.flatnonzero(target == k)[:each] for k in range(n_languages)])
    landmarks = Landmarks.of([found[i] for i in chosen])
    kernel = np.concatenate([landmarks.kernel(found[at : at + SCORED_ROWS]) for at in range(0, len(found), SCORED_ROWS)])
    own = kernel[chosen].astype(float)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = kernel @ root
    signs = np.where(target[:, None] == np.arange(n_languages)[None, :], 1.0, -1.0)
    weight = (len(target) / n_languages) / np.bincount(target, minlength=n_languages)[target]  # languages count alike
    left = features.T @ (features * weight[:, None]) + RIDGE * np.eye(features.shape[1])
    beta = np.linalg.solve(left, features.T @ (signs * weight[:, None]))
    return landmarks, (root @ beta).astype(np.float32)


def fit(docs: DataFrame, train_texts: int = TRAIN_TEXTS, landmarks: int = LANDMARKS, most_landmarks: int = MOST_LANDMARKS) -> Model | None:
    """A model from docs(doc_id, text, lang) whose id is not held out, or None without any to learn from.

    The sample takes about train_texts different rows at most, those of each language with the lowest
    hashes of doc_id and text (repeated rows count once), and at most most_landmarks landmarks. Each
    language that is learned has two texts (if there are) and a landmark; languages beyond
    most_landmarks, fewest texts last, are not learned.
    """
    mark = F.xxhash64("doc_id", "text")
    usable = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text", mark.alias("mark"))
    # Repeated rows have one mark, so a language made of them is learned like any other.
    marks = stored(usable.select("lang", "mark").distinct(), "marks")
    counts = marks.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_landmarks).collect()
    if not counts:
        discard(marks)
        return None
    each = max(2, train_texts // len(counts))
    learned = docs.sparkSession.createDataFrame([(r["lang"],) for r in counts], "lang string")
    lowest = marks.join(F.broadcast(learned), "lang").withColumn("salt", F.pmod("mark", F.lit(SALTS)))
    # First the lowest of each part of a language, then those of these.
    for keys in (["lang", "salt"], ["lang"]):
        lowest = lowest.withColumn("k", F.row_number().over(W.partitionBy(*keys).orderBy("mark"))).where(F.col("k") <= each)
    lowest = lowest.select("lang", "mark")
    # At most about train_texts marks (two a language at least).
    chosen = usable.join(F.broadcast(lowest), ["lang", "mark"]).select("mark", "lang", "text").dropDuplicates(["lang", "mark"])

    def codes(columns: dict[str, list]) -> dict[str, list]:
        return {"mark": columns["mark"], "lang": columns["lang"], "codes": [grams(t).astype("<i4").tobytes() for t in columns["text"]]}

    first = map_chunks(chosen, codes, "mark long, lang string, codes binary")
    got = sorted(first.select("mark", "lang", "codes").collect())
    discard(marks)
    languages = sorted({r["lang"] for r in got})
    place = {lang: k for k, lang in enumerate(languages)}
    target = np.array([place[r["lang"]] for r in got])
    marks, weights = solve([np.frombuffer(r["codes"], "<i4") for r in got], target, len(languages), max(1, min(landmarks, most_landmarks // len(languages))))
    return Model(languages, marks, weights)


def predict_language(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs(doc_id, text, lang, ...).

    `und` with score 0 for a null or letterless text, and for all where there is nothing to learn
    from. Repeated rows are predicted each; a null doc_id is not held out; texts of any length are
    read whole; other columns may have any names. Ties go to the language that is first in order. An
    empty table gives no rows.
    """
    model = model or fit(docs)
    # At most most_landmarks texts' n-grams; pickled by value, so workers need no copy of this package.
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))

    def predict(columns: dict[str, list], known: Model | None) -> dict[str, list]:
        texts = columns["text"]
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        places = [i for i, t in enumerate(texts) if known and has_letter(t)]
        if places:
            for i, name, value in zip(places, *known.predict([texts[i] for i in places]), strict=True):
                lang[i], score[i] = name, value
        return {"doc_id": columns["doc_id"], "held_out": columns["held_out"], "lang_pred": lang, "score": score}

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_chunks(rows, predict, SCHEMA, lambda: cloudpickle.loads(shared.value), SCORED_ROWS)
