"""Approximate nearest neighbours by multi-index hashing.

A rotation learned on a bounded sample (principal axes, then iterative quantisation) turns a vector into 64 signs. Codes
are cut into eight substrings, each with an index of its own. For a code within Hamming radius r, some substring lies within
r // 8 or one less of the query's (pigeonhole), so probing the substrings' neighbours finds every code within the radius; the
vectors found are ranked by their exact distance. The radius is what the sample's own neighbours need. Rows are
dealt into blocks by a hash, and so are queries; each cell of that grid builds its indexes and answers for its block, and the
best of all cells are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelweave.llm.common import table

BITS, PARTS = 64, 8
#: Vectors that the rotation and the radius are fitted on, at most.
SAMPLE = 4096
#: Share of the sample's neighbours that the radius takes in.
REACH = 0.985
BLOCK, QUERY_BLOCK = 32_768, 16_384
#: Bytes by how many bits they hold: those of at most k bits come first.
MASKS = np.array(sorted(range(256), key=lambda x: (x.bit_count(), x)), np.uint8)
UP_TO = [sum(1 for x in range(256) if x.bit_count() <= k) for k in range(9)]


class Coder:
    """Centre, rotation and radius."""

    def __init__(self, sample: np.ndarray, k: int, rounds: int = 30):
        n, dims = sample.shape
        self.centre = sample.mean(axis=0)
        centred = sample - self.centre
        _, axes = np.linalg.eigh(centred.T @ centred)
        axes = axes[:, ::-1][:, :BITS]
        if axes.shape[1] < BITS:
            axes = np.hstack([axes, np.zeros((dims, BITS - axes.shape[1]))])
        turn = np.linalg.qr(np.random.default_rng(0).normal(size=(BITS, BITS)))[0]
        projected = centred @ axes
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(projected @ turn > 0, 1.0, -1.0).T @ projected)
            turn = (u @ vt).T
        self.turn = axes @ turn
        self.radius = BITS
        if n > k:
            probes = sample[: 256]
            apart = (sample**2).sum(axis=1)[None] - 2 * probes @ sample.T
            apart[np.arange(len(probes)), np.arange(len(probes))] = np.inf
            near = np.argsort(apart, axis=1, kind="stable")[:, :k]
            words = self.codes(sample).view(np.uint64).reshape(-1)
            bits = np.bitwise_count(words[: len(probes), None] ^ words[near])
            self.radius = int(np.quantile(bits, REACH, method="higher"))

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """(n, 8) bytes."""
        return np.packbits((vectors - self.centre) @ self.turn > 0, axis=1)


class Index:
    """One table per substring: rows in order of its value, and where each value's rows begin."""

    def __init__(self, codes: np.ndarray):
        self.words = np.ascontiguousarray(codes).view(np.uint64).reshape(-1)
        self.rows = [np.argsort(codes[:, s], kind="stable") for s in range(PARTS)]
        self.edges = [np.concatenate([[0], np.cumsum(np.bincount(codes[:, s], minlength=256))]) for s in range(PARTS)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code differs from ``code`` in at most ``radius`` bits."""
        found = []
        for s in range(PARTS):
            reach = radius // PARTS - (s > radius % PARTS)
            if reach < 0:
                continue
            values = code[s] ^ MASKS[: UP_TO[min(reach, 8)]]
            begin = self.edges[s][values]
            size = self.edges[s][values.astype(np.int64) + 1] - begin
            last = np.cumsum(size)
            if last[-1]:
                found.append(self.rows[s][np.repeat(begin - (last - size), size) + np.arange(last[-1])])
        if not found:
            return np.zeros(0, np.int64)
        hit = np.zeros(len(self.words), bool)
        for rows in found:
            hit[rows] = True
        rows = np.flatnonzero(hit)
        return rows[np.bitwise_count(self.words[rows] ^ np.ascontiguousarray(code).view(np.uint64)[0]) <= radius]


def nearest(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, coder: Coder, k: int) -> tuple[list, list, list]:
    """Query ids, ids and distances of the k nearest found among ``vectors`` for each query, rows with its own id left out."""
    index, out = Index(coder.codes(vectors)), ([], [], [])
    for query_id, query, code in zip(query_ids, queries, coder.codes(queries)):
        radius, want = coder.radius, min(k, int((ids != query_id).sum()))
        while True:
            rows = index.within(code, radius)
            rows = rows[ids[rows] != query_id]
            if len(rows) >= want:
                break
            radius += 4
        if not want:
            continue
        apart = np.sqrt(((vectors[rows] - query) ** 2).sum(axis=1))
        if len(rows) > k:
            keep = apart <= np.partition(apart, k - 1)[k - 1]
            rows, apart = rows[keep], apart[keep]
        best = np.lexsort((ids[rows], apart))[:k]
        out[0].extend([query_id] * len(best))
        out[1].extend(ids[rows[best]])
        out[2].extend(apart[best])
    return out


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def neighbours(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows found, by Euclidean distance, for every row whose id is divisible by ``every``.

    Returns query_id, rank (from 1), vec_id, score: nearest first, ties to the smaller id. Vectors that are null, empty, zero or hold null or non-finite
    components, vectors of another than the most frequent length (of several, the largest), and rows with a null id take no part. Rows that share the query's
    id count as its own; of query rows that share an id, the least vector asks. With fewer than k candidates all come; no rows
    give none. Other columns are dropped. The sample is the ``SAMPLE`` rows of least hash: every row is indexed and every query answered.
    """
    v = F.col("v")
    sound = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v")).where(F.col("id").isNotNull() & v.isNotNull())
    rows = rows.where(sound)
    sizes = rows.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("id") % every == 0).cast("int")).alias("queries"))
    most = sizes.orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    kinds = "query_id long, vec_id long, score double"
    if not most:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, blocks, query_blocks = most[0]["dims"], -(-most[0]["n"] // BLOCK), max(1, -(-most[0]["queries"] // QUERY_BLOCK))
    rows = rows.where(F.size("v") == dims)
    sample = rows.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).collect()
    coder = Coder(np.array([x["v"] for x in sample], np.float64).reshape(-1, dims), k)
    asking = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    whole = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("i", block(blocks)).withColumn("j", whole(query_blocks))
    right = asking.withColumn("j", block(query_blocks)).withColumn("i", whole(blocks))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def cell(data: pa.Table, queries: pa.Table) -> pa.Table:
        if not data.num_rows or not queries.num_rows:
            return schema.empty_table()
        found = nearest(
            data.column("id").to_numpy(), _matrix(data.column("v"), dims), queries.column("id").to_numpy(), _matrix(queries.column("v"), dims), coder, k
        )
        return pa.table([pa.array(np.array(x), f.type) for x, f in zip(found, schema)], schema=schema)

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(cell, kinds)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth row of embeddings against all others."""
    return neighbours(table(spark, sf_dir, "embeddings"))
