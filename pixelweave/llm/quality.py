"""A quality classifier over random-indexing word vectors.

Every word, and every form of a word (its letters, digits and signs, runs shortened), has a row of a table by its hash, and so an index vector, sparse and
ternary; no vocabulary leaves any out. A row's vector is its index vector and the sum of its neighbours' in the labelled sample. A text is the mean of
its words' vectors and its forms', with the share of words that repeat the one before and its length. Two layers of a network
in numpy turn that into a logit; a temperature fitted on a part of the sample kept aside makes it a probability.
"""

from __future__ import annotations

import math
import operator
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from pixelweave.llm.common import filtered, held_out, in_blocks, table
from pixelweave.llm.labelled import SAMPLE, fitted, labelled_sample

#: Size of vectors, entries of an index vector other than 0, units of the hidden layer.
SIZE, ENTRIES, HIDDEN = 48, 4, 24
#: Rows of the tables of words and of forms; neighbours on either side.
WORDS, FORMS, REACH = 1 << 15, 1 << 12, 2
LIMIT = 0.5
#: Words that a worker keeps the rows of.
CACHE = 1 << 17
RUN = re.compile(r"(.)\1+", re.S)


def form_of(word: str) -> str:
    """Of the whole word: letters as X or x, digits as 0, other signs as they are; runs as one, but signs in a run of three or more twice."""
    spelled = "".join("X" if c.isupper() else "x" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return RUN.sub(lambda m: m[1] * (2 if m[1] not in "Xx0" else 1 + (m[1] == "X")), spelled)


def hashed(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


def index_vectors(rows: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each row's entries other than 0; a row more has signs of 0."""
    rng = np.random.default_rng(seed)
    places = np.argsort(rng.random((rows + 1, SIZE), np.float32), axis=1)[:, :ENTRIES].copy()
    signs = rng.choice((-1.0, 1.0), (rows + 1, ENTRIES))
    signs[rows] = 0
    return places, signs


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Vectors of words and forms, and the network."""

    def __init__(self, examples: list[tuple[int, str, int]], seed: int = 3):
        self.cache: dict[str, int] = {}
        tables = [(n, *index_vectors(n, seed), np.zeros((n + 1) * SIZE)) for seed, n in enumerate((WORDS, FORMS))]
        apart = [-1] * REACH  # between texts
        for begin in range(0, len(examples), 256):
            every = np.concatenate([np.array(apart, np.int64), *[np.append(self.rows(text.split()), apart) for _, text, _ in examples[begin : begin + 256]]])
            for (n, at, sign, around), rows in zip(tables, (every >> 20, every & 0xFFFFF)):
                rows = np.where(every < 0, n, rows)  # one row more than the table has, without entries
                for d in range(1, REACH + 1):  # an entry moves one place up for a neighbour on the right, down for one on the left
                    for own, other, turn in ((rows[:-d], rows[d:], 1), (rows[d:], rows[:-d], -1)):
                        for e in range(ENTRIES):
                            np.add.at(around, own * SIZE + (at[other, e] + turn) % SIZE, sign[other, e])
        for i, (n, at, sign, around) in enumerate(tables):
            around = around.reshape(n + 1, SIZE)[:n]
            around /= np.maximum(np.linalg.norm(around, axis=1, keepdims=True), 1e-9)
            np.add.at(around, (np.arange(n)[:, None], at[:n]), sign[:n] / math.sqrt(ENTRIES))
            tables[i] = around.astype(np.float32)
        self.word_vectors, self.form_vectors = tables
        self.net = None
        y = np.array([x[2] for x in examples], float)
        self.base = float((y.sum() + 0.5) / (len(y) + 1)) if len(y) else 0.5
        if len(y) and 0 < y.sum() < len(y):
            self.fit(np.array([self.features(text.split()) for _, text, _ in examples]), y, np.random.default_rng(seed))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    def rows(self, words: list[str]) -> np.ndarray:
        """Row of each word, and of its form in the lower 20 bits."""
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        out = np.fromiter((cache.get(w, -1) for w in words), np.int64, len(words))
        for i in np.flatnonzero(out < 0).tolist():
            w = words[i]
            cache[w] = out[i] = hashed(w) % WORDS << 20 | hashed(form_of(w)) % FORMS
        return out

    def features(self, words: list[str]) -> np.ndarray:
        out = np.zeros(2 * SIZE + 2, np.float32)
        if words:
            for begin in range(0, len(words), 1 << 16):
                rows = self.rows(words[begin : begin + (1 << 16)])
                out[:SIZE] += self.word_vectors[rows >> 20].sum(axis=0)
                out[SIZE : 2 * SIZE] += self.form_vectors[rows & 0xFFFFF].sum(axis=0)
            out[: 2 * SIZE] /= len(words)
            out[-2] = sum(map(operator.eq, words, words[1:])) / len(words)
        out[-1] = math.log1p(len(words)) / 10
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, epochs: int = 60, rate: float = 0.01) -> None:
        """Adam on the logistic loss, classes weighing alike half-way; the last fifth sets the temperature."""
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = (x - self.mean) / self.spread
        cut = max(1, len(y) * 4 // 5)
        weigh = np.where(y == 1, 1.0, math.sqrt(max(1.0, y.sum() / max(1.0, (1 - y).sum()))))
        net = [rng.normal(size=(x.shape[1], HIDDEN)) / math.sqrt(x.shape[1]), np.zeros(HIDDEN), rng.normal(size=HIDDEN) / math.sqrt(HIDDEN), np.zeros(1)]
        first, second, step = [np.zeros_like(p) for p in net], [np.zeros_like(p) for p in net], 0
        for _ in range(epochs):
            order = rng.permutation(cut)
            for i in range(0, cut, 128):
                at = order[i : i + 128]
                hidden = np.tanh(x[at] @ net[0] + net[1])
                error = (sigmoid(hidden @ net[2] + net[3]) - y[at]) * weigh[at] / len(at)
                back = np.outer(error, net[2]) * (1 - hidden**2)
                slopes = [x[at].T @ back + 1e-4 * net[0], back.sum(axis=0), hidden.T @ error + 1e-4 * net[2], np.array([error.sum()])]
                step += 1
                for p, g, m, v in zip(net, slopes, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.net, self.temperature = net, 1.0
        logits, truth = self.logits(x[cut:]), y[cut:]
        if len(truth):
            losses = {t: float(-np.mean(np.log(np.where(truth == 1, sigmoid(logits / t), sigmoid(-logits / t)) + 1e-12))) for t in np.geomspace(0.5, 8, 41)}
            self.temperature = min(losses, key=losses.get)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.net[0] + self.net[1]) @ self.net[2] + self.net[3]

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.net is None:
            return np.full(len(texts), self.base)
        x = np.array([self.features(t.split()) for t in texts]).reshape(len(texts), -1)
        return sigmoid(self.logits((x - self.mean) / self.spread) / self.temperature)


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE, label: str = "quality") -> DataFrame:
    """Scores every whole text for quality.

    One row per input row: the id column, score (0 to 1) and predicted (1 from 0.5 on). Vectors and network are fitted on ``most`` labelled rows
    at most, none of them held out. An empty or null text has the features of no words; where labels are missing or all alike, every score is
    their smoothed share of 1 (without any, 0.5). Very long texts are pooled whole. Repeated rows score alike; no rows give none; other columns are dropped.
    """
    given = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    model = fitted(labelled_sample(given, labels, label, most), Model)

    def work(columns: list[pa.Array]) -> list:
        scores = model().scores([x or "" for x in columns[1].to_pylist()])
        return [columns[0], scores, [int(x >= LIMIT) for x in scores]]

    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])
    return given.mapInArrow(in_blocks(work, schema, weigh=1), "doc_id long, score double, predicted int").withColumnRenamed("doc_id", id_col)


def kept(docs: DataFrame, labels: DataFrame, text_col: str = "text", most: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that score ``LIMIT`` or more, with all columns, whatever their names.

    Null and empty texts score as texts without words; repeated rows stay or go together; no rows give none. A classifier that can't be
    fitted, as labels are missing or all alike, keeps all.
    """
    model = fitted(labelled_sample(docs, labels, "quality", most, text_col), Model)
    return filtered(docs, text_col, lambda texts: [model().net is None or x >= LIMIT for x in model().scores(texts)])


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents."""
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", held_out().alias("held_out"), "score", "predicted")
