"""A whole population of objects: which features to use, conditioning, principal axes and a layout."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns that tell which object it is or where, and beginnings of such names.
PLACES = frozenset("field position_label id x_um y_um intensity r label object_id tile_name".split())
PLACE_PREFIXES = ("bbox_", "centroid_", "weighted_centroid", "stage_", "bg_global_mean")
FEWEST = 10


def read_population(spark, path: str, ids: DataFrame | None = None, schema: str | None = None) -> DataFrame:
    """A population table from CSV with a header, narrowed to the ids given."""
    reader = spark.read.option("header", True)
    table = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path).withColumn("id", F.col("id").cast("string"))
    return table if ids is None else table.join(ids.select("id"), "id", "left_semi")


def finite(name: str):
    x = F.col(name).cast("double")
    return F.when(~(F.isnan(x) | (F.abs(x) == float("inf"))), x)


def measured_columns(table: DataFrame, enough: float = 0.5) -> list[str]:
    """Names, sorted, of numbers that aren't places, are finite often enough and vary; found in one pass."""
    names = sorted(f.name for f in table.schema if isinstance(f.dataType, T.NumericType) and f.name not in PLACES and not f.name.startswith(PLACE_PREFIXES))
    if not names:
        return []
    parts = [x for n in names for x in (F.avg(finite(n).isNotNull().cast("double")).alias(f"{n}|share"), (F.max(finite(n)) - F.min(finite(n))).alias(f"{n}|range"))]
    found = table.agg(*parts).first().asDict()
    return [n for n in names if (found[f"{n}|share"] or 0) >= enough and (found[f"{n}|range"] or 0) > 0]


def imputed(table: DataFrame, names: list[str]) -> DataFrame:
    """Missing and infinite values become the median of the others."""
    middle = table.agg(*[F.percentile(finite(n), 0.5).alias(n) for n in names]).first().asDict()
    return table.withColumns({n: F.coalesce(finite(n), F.lit(middle[n])) for n in names})


def scaled(table: DataFrame, names: list[str]) -> DataFrame:
    """Imputed, then centred on the median and divided by the quartiles' distance; where that is 0 by the spread, where that is 0 by 1."""
    full = imputed(table, names)
    parts = [x for n in names for x in (F.percentile(n, [0.25, 0.5, 0.75]).alias(f"{n}|q"), F.stddev_pop(n).alias(f"{n}|s"))]
    found = full.agg(*parts).first().asDict()
    out = {}
    for n in names:
        low, middle, high = found[f"{n}|q"]
        by = (high - low) or found[f"{n}|s"] or 1.0
        out[n] = (F.col(n) - F.lit(middle)) / F.lit(by)
    return full.withColumns(out)


def covariance(table: DataFrame, names: list[str]) -> np.ndarray:
    """Covariance matrix from one aggregation; what comes to the driver grows with the features, not with the rows."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    row = table.agg(*[F.covar_samp(a, b).alias(f"{a}|{b}") for a, b in pairs]).first()
    out, at = np.zeros((len(names), len(names))), {n: i for i, n in enumerate(names)}
    for (a, b), x in zip(pairs, row):
        out[at[a], at[b]] = out[at[b], at[a]] = x or 0.0
    return out


def principal_axes(table: DataFrame, names: list[str], n: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions as columns, shares of the variance, and means. Each direction's largest entry is positive."""
    matrix = covariance(table, names)
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(-values, kind="stable")[: min(n, len(names))]
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    mean = table.agg(*[F.avg(x).alias(x) for x in names]).first()
    return vectors, values / max(np.trace(matrix), 1e-300), np.array(list(mean), float)


def reduce(table: DataFrame, id_col: str = "id", enough: float = 0.5, n: int = 2) -> tuple[DataFrame, dict]:
    """(id, pca_1, pca_2 ...) of every object, and features, shares and the strongest features of the first two axes."""
    if table.limit(FEWEST).count() < FEWEST:
        raise ValueError(f"at least {FEWEST} objects are needed")
    names = measured_columns(table, enough)
    if not names:
        raise ValueError("no feature can be used")
    even = scaled(table, names)
    axes, shares, mean = principal_axes(even, names, max(50, n))
    if axes.shape[1] < 2:  # one feature: the second axis is zero
        axes, shares = np.hstack([axes, np.zeros((len(names), 1))]), np.append(shares, 0.0)
    def along(i: int):
        return sum(((F.col(x) - float(m)) * float(w) for x, m, w in zip(names, mean, axes[:, i])), F.lit(0.0))

    points = even.select(id_col, *[along(i).alias(f"pca_{i + 1}") for i in range(min(n, axes.shape[1]))])
    top = [[names[j] for j in sorted(range(len(names)), key=lambda j: (-abs(axes[j, i]), names[j]))[:5]] for i in range(2)]
    return points, {"features": names, "variance": shares.tolist(), "top": top}


def nearest_rows(queries: np.ndarray, x: np.ndarray, begin: int, k: int, tile: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``x`` and distances of the k nearest other rows of each query, which are the rows of ``x`` from ``begin``; ties to the earlier row."""
    n = len(queries)
    row, at, far = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    worst = np.full(n, np.inf)
    for first in range(0, len(x), tile):
        part = x[first : first + tile]
        d = np.sqrt(np.maximum(0, (queries**2).sum(1)[:, None] + (part**2).sum(1) - 2 * queries @ part.T))
        own = np.arange(max(begin, first), min(begin + n, first + len(part)))
        d[own - begin, own - first] = np.inf
        near = d < worst[:, None]
        if k < len(part) and near.sum() > 4 * k * n:  # rows beyond the tile's own k nearest can't be among them
            near &= d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        r, c = np.nonzero(near)
        row, at, far = np.concatenate([row, r]), np.concatenate([at, c + first]), np.concatenate([far, d[r, c]])
        order = np.lexsort((at, far, row))
        row, at, far = row[order], at[order], far[order]
        starts = np.searchsorted(row, np.arange(n))
        best = np.arange(len(row)) - starts[row] < k
        row, at, far = row[best], at[best], far[best]
        size = np.bincount(row, minlength=n)
        ends = np.cumsum(size)
        worst = np.where(size == k, far[ends - 1], np.inf)
    return at.reshape(n, k), far.reshape(n, k)


def neighbour_graph(spark, x: np.ndarray, k: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(near, far) of every row: the k nearest others and their distances. Blocks of rows are tasks, each against all rows."""
    n = len(x)
    near, far = np.zeros((n, k), np.int64), np.zeros((n, k))
    if not k:
        return near, far
    every = spark.sparkContext.broadcast(x)

    def search(batches):
        for pdf in batches:
            for begin in pdf["id"].tolist():
                at, d = nearest_rows(every.value[begin : begin + block], every.value, begin, k)
                yield pd.DataFrame({"begin": [begin], "near": [at.astype(np.int32).tobytes()], "far": [d.tobytes()]})

    tasks = min(-(-n // block), 4 * spark.sparkContext.defaultParallelism)
    for found in spark.range(0, n, block, tasks).mapInPandas(search, "begin long, near binary, far binary").collect():
        rows = slice(found["begin"], found["begin"] + block)
        near[rows] = np.frombuffer(found["near"], np.int32).reshape(-1, k)
        far[rows] = np.frombuffer(found["far"]).reshape(-1, k)
    every.unpersist()
    return near, far


def layout(points: DataFrame, names: list[str], id_col: str = "id", neighbours: int = 15, rounds: int = 200, seed: int = 0) -> DataFrame:
    """(id, x, y): a seeded layout that keeps neighbours near.

    The graph of nearest neighbours, of all points and exact, is made by the workers and weighed as fuzzy sets are; all points are pulled along it and
    pushed from random others by one kernel on the driver, which holds the points and their neighbours.
    """
    chosen = points.select(id_col, *names).orderBy(F.xxhash64(id_col), id_col).toPandas()
    x = chosen[names].to_numpy(float)
    n = len(x)
    k = min(neighbours, n - 1)
    rng = np.random.default_rng(seed)
    near, far = neighbour_graph(points.sparkSession, x, k)
    weight = np.exp(-(far - far[:, :1]) / (far.mean(axis=1, keepdims=True) + 1e-9)) if k else far
    spread = x - x.mean(axis=0)
    _, _, vt = np.linalg.svd(spread, full_matrices=False)
    y = spread @ vt[:2].T if x.shape[1] > 1 else np.hstack([spread, rng.normal(size=(n, 1))])
    y = 10 * y / (np.abs(y).max() + 1e-9) + rng.normal(scale=1e-4, size=y.shape)
    for step in range(rounds):
        rate = 1 - step / rounds
        for j in range(k):
            delta = y[near[:, j]] - y
            d2 = (delta**2).sum(axis=1, keepdims=True)
            y += rate * 0.5 * weight[:, j : j + 1] * delta * np.minimum(1, d2 / (1 + d2)) / max(1, k) * 4
        other = rng.integers(0, n, n)
        delta = y - y[other]
        d2 = (delta**2).sum(axis=1, keepdims=True)
        y += rate * np.clip(delta / ((0.1 + d2) * (1 + d2)), -1, 1)
    out = pd.DataFrame({id_col: chosen[id_col], "x": y[:, 0], "y": y[:, 1]})
    kind = points.schema[id_col].dataType.simpleString()
    return points.sparkSession.createDataFrame(out, f"{id_col} {kind}, x double, y double")
