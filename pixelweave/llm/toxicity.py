"""Toxicity by nearest labelled examples.

All words are terms. A term weighs by its inverse document frequency and by how much oftener toxic examples hold it than chance would have it
(supervised term weighting). Examples and texts are TF-IDF vectors of length one. The inverted index knows the greatest weight that a frequent
term has in each block of examples: postings of rare terms are added up first; a block's bounds on what frequent terms can add then leave few examples to
finish, and none that could be among the nearest is left out, so that the nearest are exact. Their votes, weighted by distance, become a
chance by a logistic curve fitted on examples kept aside, and are its evidence.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm.common import filtered, held_out, in_blocks, table
from pixelweave.llm.labelled import SAMPLE, fitted, labelled_sample

#: Neighbours that vote, examples of a block.
K, BLOCK = 16, 64
LIMIT = 0.7
#: Of so many examples, one is kept aside for the curve while it is fitted.
ASIDE = 5
#: Terms whose block maxima and weights are held as matrices: those in one of ``OFTEN`` examples, the most frequent first. It is speed alone that depends on it.
FREQUENT, OFTEN = 256, 8
#: Cosine from which a text is taken for the example itself.
SAME = 1 - 1e-9
#: Words that a worker keeps the terms of.
CACHE = 1 << 17
#: ASCII other than letters and digits parts words.
PARTS = bytes(b if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(PARTS).split()


def ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each begin to before its end, one range after the other, and the ranges' sizes."""
    size = (end - begin).astype(np.int64)
    last = np.cumsum(size)
    return np.repeat(begin - (last - size), size) + np.arange(last[-1] if len(last) else 0), size


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's distinct words, ascending, and how often each stands."""
    own = Counter(words_of(text))
    keys = np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own))
    order = np.argsort(keys)
    return keys[order], np.fromiter(own.values(), np.int64, len(own))[order]


def logit(p: float) -> float:
    return math.log(p / (1 - p))


class Model:
    """Terms, block-max index of the examples (id, text, label), and the curve that makes votes a chance."""

    def __init__(self, examples: list[tuple[int, str, int]]):
        keys, times, words = [], [], np.zeros(len(examples), np.int64)
        for i, (_, text, _) in enumerate(examples):
            k, n = counted(text)
            words[i] = len(k)
            keys.append(k)
            times.append(n.astype(np.int32))
        ids = np.array([i for i, _, _ in examples], np.int64)
        labels = np.array([y for _, _, y in examples], float)
        bare = words == 0
        rate = (labels.sum() + 0.5) / (len(examples) + 1)
        self.none = float((labels[bare].sum() + rate) / (bare.sum() + 1)) if len(examples) else 0.0
        self.ids, self.labels, self.examples = ids[~bare], labels[~bare], int((~bare).sum())
        self.base, self.curve, self.keys = float(rate), (1.0, 0.0), np.zeros(0, np.uint64)
        if not self.examples:
            return
        every = np.concatenate(keys)
        keys.clear()
        times = np.concatenate(times)
        self.keys, at = np.unique(every, return_inverse=True)
        del every
        at, size = at.astype(np.int32), words[~bare]
        edges = np.append(0, np.cumsum(size))
        aside = np.arange(self.examples) % ASIDE == ASIDE - 1
        mark = self.labels
        if mark[aside].any() and mark[~aside].any() and not mark[aside].all() and not mark[~aside].all():
            own = np.repeat(~aside, size)
            self._index(at[own], times[own], size[~aside], mark[~aside])
            votes = []
            for i in np.flatnonzero(aside):
                row = slice(edges[i], edges[i + 1])
                known = self.idf[at[row]] > 0
                votes.append((logit(self._vote(at[row][known], times[row][known])[0]), mark[i]))
            self.examples, self.labels = len(mark), mark
            self.curve = fitted_curve(*map(np.array, zip(*votes)))
        self._index(at, times, size, mark)

    def _index(self, at: np.ndarray, times: np.ndarray, size: np.ndarray, labels: np.ndarray) -> None:
        """Postings and weights of examples with ``size`` distinct terms each."""
        n = self.examples = len(size)
        self.labels = labels
        doc = np.repeat(np.arange(n, dtype=np.min_scalar_type(n)), size)
        seen = np.bincount(at, minlength=len(self.keys)).astype(float)
        some = np.maximum(seen, 1)
        rate = self.base
        share = np.clip(np.bincount(at, weights=labels[doc], minlength=len(self.keys)) / some, 1e-12, 1 - 1e-12)
        # the log-likelihood ratio of so large a share of toxic examples against chance
        sure = seen * (share * np.log(share / rate) + (1 - share) * np.log((1 - share) / (1 - rate)))
        self.idf = np.where(seen > 0, np.log((n + 1) / some), 0) * (1 + np.sqrt(np.where(share > rate, np.maximum(sure, 0), 0)))
        order = np.argsort(at, kind="stable")
        self.docs, self.times = doc[order], times[order].astype(np.min_scalar_type(times.max()))
        del order
        self.starts = np.append(0, np.cumsum(seen.astype(np.int64)))
        self._weigh()

    def _weigh(self) -> None:
        """What follows from the postings: weights, and the frequent terms' matrices."""
        n, seen = self.examples, np.diff(self.starts)
        self.weights = 1 + np.log(self.times.astype(float))
        self.weights *= np.repeat(self.idf, seen)
        self.weights /= np.sqrt(np.bincount(self.docs, weights=self.weights**2, minlength=n))[self.docs]
        often = np.argsort(-seen, kind="stable")[:FREQUENT]
        often = often[seen[often] >= n / OFTEN]
        self.row = np.full(len(self.keys), -1, np.int32)
        self.row[often] = np.arange(len(often))
        blocks = -(-n // BLOCK)
        self.frequent = np.zeros((len(often), blocks * BLOCK))
        for i, t in enumerate(often):
            own = slice(self.starts[t], self.starts[t + 1])
            self.frequent[i, self.docs[own]] = self.weights[own]
        self.most = self.frequent.reshape(len(often), blocks, BLOCK).max(axis=2)
        self.cache: dict[bytes, int] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("weights", "frequent", "most", "row", "cache")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        if self.examples:
            self._weigh()

    def terms_of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Terms of a text that some example has, and how often each stands."""
        own = Counter(words_of(text))
        if not self.examples or not own:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(self.cache) > CACHE:
            self.cache.clear()
        get = self.cache.get
        at = np.fromiter((get(w, -2) for w in own), np.int64, len(own))
        new = np.flatnonzero(at == -2)
        if len(new):
            words = list(own)
            words = [words[i] for i in new.tolist()]
            keys = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
            place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            at[new] = np.where(self.keys[place] == keys, place, -1)
            self.cache.update(zip(words, at[new].tolist()))
        times = np.fromiter(own.values(), np.int64, len(own))
        known = at >= 0
        return at[known], times[known]

    def vector(self, at: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Weights of length one."""
        weight = (1 + np.log(times)) * self.idf[at]
        length = math.sqrt(weight @ weight)
        return weight / length if length else weight

    def nearest(self, at: np.ndarray, weight: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """Examples of the k greatest cosines above 0, nearest first, ties to the earlier example."""
        row = self.row[at]
        rare = row < 0
        rows, size = ranges(self.starts[at[rare]], self.starts[at[rare] + 1])
        scores = np.bincount(self.docs[rows], weights=self.weights[rows] * np.repeat(weight[rare], size), minlength=self.examples).astype(float)
        own, given = row[~rare], weight[~rare]
        if len(own):
            least = np.partition(scores, -k)[-k] if k < self.examples else 0.0
            bound = np.repeat(given @ self.most[own], BLOCK)[: self.examples]
            left = np.flatnonzero(scores + bound >= least - 1e-12)
            if 4 * len(left) > self.examples:
                scores += (given @ self.frequent[own])[: self.examples]
            else:
                scores[left] += given @ self.frequent[np.ix_(own, left)]
            scores = scores[left]
        else:
            left = np.arange(self.examples)
        if k < len(left):  # ties with the k-th stay
            high = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
            left, scores = left[high], scores[high]
        best = np.lexsort((left, -scores))[:k]
        best = best[scores[best] > 0]
        return left[best], scores[best]

    def _vote(self, at: np.ndarray, times: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        if not len(at):
            return self.base, np.zeros(0, np.int64), np.zeros(0)
        found, cosines = self.nearest(at, self.vector(at, times), K + 1)
        # one example with the very words may be the text's own row, and has no vote
        own = slice(1, None) if len(cosines) and cosines[0] >= SAME else slice(0, K)
        found, cosines = found[own], cosines[own]
        votes = 1 / (0.05 + 1 - np.minimum(cosines, 1.0))
        return float((votes @ self.labels[found] + self.base) / (votes.sum() + 1)), found, cosines

    def score(self, text: str) -> tuple[float, np.ndarray, np.ndarray]:
        """Chance of label 1, and the examples that voted with their cosines."""
        at, times = self.terms_of(text)
        if not len(at) and not text.encode("utf-8", "surrogatepass").translate(PARTS).split():
            return self.none, np.zeros(0, np.int64), np.zeros(0)
        share, found, cosines = self._vote(at, times)
        if not self.examples:
            return self.none, found, cosines
        slope, offset = self.curve
        return 1 / (1 + math.exp(-min(40.0, max(-40.0, slope * logit(share) + offset)))), found, cosines


def fitted_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of least loss, held back a little from steepness; Newton's steps."""
    wide = np.stack([x, np.ones(len(x))], axis=1)
    at, held = np.array([1.0, 0.0]), np.diag([0.1, 0.01])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(wide @ at, -40, 40)))
        step = np.linalg.solve((wide.T * np.maximum(p * (1 - p), 1e-9)) @ wide + held, wide.T @ (y - p) - held @ (at - [1.0, 0.0]))
        at = at + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(0.05, float(at[0])), float(at[1])


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE, label: str = "toxic") -> DataFrame:
    """Scores every whole text by its nearest labelled examples.

    One row per input row: the id column, score (0 to 1), predicted (1 from 0.7 on) and evidence (array of example's id, its label
    and cosine). The examples are ``most`` labelled rows at most, none of them held out; one with exactly the text's words has no vote. A text
    without words, an empty or null one too, gets the share of toxic examples among such texts; one whose words no example has gets what the curve
    makes of their share among all; both have no evidence. Without labels all scores are 0. Very long texts are searched whole. Repeated rows score alike;
    no rows give none; other columns are dropped.
    """
    given = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    model = fitted(labelled_sample(given, labels, label, most), Model)

    def work(columns: list[pa.Array]) -> list:
        held = model()
        found = [held.score(x or "") for x in columns[1].to_pylist()]
        evidence = [[{"id": int(held.ids[i]), "label": int(held.labels[i]), "cosine": float(c)} for i, c in zip(at, cosines)] for _, at, cosines in found]
        scores = [x[0] for x in found]
        return [columns[0], scores, [int(x >= LIMIT) for x in scores], evidence]

    kind = pa.list_(pa.struct([("id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("evidence", kind)])
    kinds = "doc_id long, score double, predicted int, evidence array<struct<id:bigint,label:int,cosine:double>>"
    return given.mapInArrow(in_blocks(work, schema, weigh=1), kinds).withColumnRenamed("doc_id", id_col)


def kept(docs: DataFrame, labels: DataFrame, text_col: str = "text", most: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that score less than ``LIMIT``, with all columns, whatever their names.

    Null and empty texts score as texts without words; repeated rows stay or go together; without labels all stay; no rows give none.
    """
    model = fitted(labelled_sample(docs, labels, "toxic", most, text_col), Model)
    return filtered(docs, text_col, lambda texts: [model().score(x)[0] < LIMIT for x in texts])


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents."""
    found = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted", F.size("evidence").alias("n_evidence"))
