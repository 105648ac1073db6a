"""Classifiers fitted on bounded samples of labelled rows."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.llm.common import held_out

#: Labelled rows that a classifier is fitted on, and bytes of their texts, at most.
SAMPLE, SAMPLE_BYTES = 8192, 64_000_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int = SAMPLE, text_col: str = "text") -> DataFrame:
    """(doc_id, text, mark, turn): the ``most`` labelled rows of least hash (``turn``) that aren't held out, in that order and one partition.

    Labels other than 0 and 1 count as none; of several for one id the largest holds. Null ids have no label, null texts are empty. At most
    ``most`` ids are broadcast.
    """
    marks = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("mark"))
    marks = marks.where(~held_out())
    known = docs.select("doc_id").join(marks, "doc_id").select("doc_id", "mark").distinct()
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    chosen = docs.sparkSession.createDataFrame([(x["doc_id"], int(x["mark"])) for x in drawn], "id long, mark int")
    own = docs.select("doc_id", F.col(text_col).alias("text"))
    found = own.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "mark", F.xxhash64("doc_id").alias("turn"))
    return found.orderBy("turn", "doc_id", "text").limit(most)


_held: dict[int, object] = {}


class Fitted:
    """A pickled model that each process reads when it first needs it; a process holds one at a time."""

    def __init__(self, data: bytes):
        self.data, self.key = data, xxhash.xxh64_intdigest(data)

    def __call__(self):
        if self.key not in _held:
            _held.clear()
            _held[self.key] = pickle.loads(self.data)
        return _held[self.key]


def fitted(sample: DataFrame, fit: Callable[[list[tuple[int, str, int]]], object]) -> Fitted:
    """What ``fit`` makes of the sample's (doc_id, text, label), computed in one task; only the pickled model comes to the driver.

    Rows beyond ``SAMPLE_BYTES`` of text are left out, the last in the sample's order first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [x for batch in batches for x in zip(*(batch.column(name).to_pylist() for name in ("turn", "doc_id", "text", "mark")))]
        rows.sort()
        room = SAMPLE_BYTES
        examples = []
        for _, doc_id, text, mark in rows:
            room -= len(text.encode("utf-8", "surrogatepass"))
            if room < 0:
                break
            examples.append((doc_id, text, mark))
        rows.clear()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(examples))], pa.binary())], ["model"])

    found = sample.coalesce(1).mapInArrow(run, "model binary").first()
    return Fitted(found["model"] if found else pickle.dumps(fit([])))
