"""Mixing sources to target weights by balanced sampling with the cube method.

A source's target divided by its size says how often each of its documents is taken: whole times for certain,
and once more with the fraction that is left. The cube method settles the fractions: probabilities of a group of
documents move along the null-space of the constraints (sum of probabilities, sum of words), up or down at random so
that each document's expectation holds, until some reach 0 or 1. Two constraints leave at most two documents of a group
open. Groups are buckets of bounded size within a source; what they leave open meets in fewer buckets, and so
on, until one group per source is left, where a dozen documents are settled together (the landing).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelweave.llm.common import WORD, cut, free_name, table

#: Shares of the sources by code point of their names, repeating; most times that a document is taken.
WEIGHTS, MOST = (5, 2, 1), 3
#: Documents of a group that is settled at once.
GROUP = 4096
#: Documents of a source that the landing settles beside the one or two that flights leave.
LAST = 12
TINY = 1e-9


def uniform(seed: int, *, _m: int = (1 << 64) - 1) -> float:
    """A number in (0, 1) that follows from an integer (splitmix64)."""
    z = (seed + 0x9E3779B97F4A7C15) & _m
    z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & _m
    z = ((z ^ z >> 27) * 0x94D049BB133111EB) & _m
    return ((z ^ z >> 31) >> 11) / (1 << 53) + 2.0**-54


def flight(p: list[float], size: list[float], seed: int) -> list[float]:
    """Moves probabilities until at most two lie strictly between 0 and 1.

    Three open documents at a time: the null vector of the two constraints on them is a cross product. Sums of p and
    of p x size stay as they were.
    """
    p = list(p)
    held: list[int] = []
    for i in range(len(p)):
        if not TINY < p[i] < 1 - TINY:
            p[i] = float(round(p[i]))
            continue
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = held
        u = [size[c] - size[b], size[a] - size[c], size[b] - size[a]]
        if not any(u):
            u = [1.0, -1.0, 0.0]
        up = min((1 - p[k]) / x if x > 0 else p[k] / -x for k, x in zip(held, u) if x)
        down = min(p[k] / x if x > 0 else (1 - p[k]) / -x for k, x in zip(held, u) if x)
        move = up if uniform(seed * 1_000_003 + i) * (up + down) < down else -down
        for k, x in zip(held, u):
            p[k] += move * x
            if p[k] < TINY or p[k] > 1 - TINY:
                p[k] = float(round(p[k]))
        held = [k for k in held if 0 < p[k] < 1]
    return p


def landing(p: list[float], size: list[float], seed: int) -> list[float]:
    """Settles a source's last group.

    ``LAST`` documents, evenly spread over the sizes, wait while the others fly; they and the one or two that the flight
    leaves make the landing problem: of all outcomes, the one that keeps the words best, then the count.
    """
    n = len(p)
    wait = sorted({round((k + 0.5) * n / LAST - 0.5) for k in range(min(LAST, n))}) if n else []
    waiting = set(wait)
    rest = [i for i in range(n) if i not in waiting]
    goal, count = sum(x * s for x, s in zip(p, size)), sum(p)
    flown = flight([p[i] for i in rest], [size[i] for i in rest], seed)
    p = list(p)
    for i, x in zip(rest, flown):
        p[i] = x
    held = [i for i in range(n) if (i in waiting or 0 < p[i] < 1) and TINY < p[i] < 1 - TINY]
    p = [x if i in held else float(round(x)) for i, x in enumerate(p)]
    have, taken = sum(x * s for x, s in zip(p, size) if x == 1), p.count(1.0)
    outcomes = (np.arange(1 << len(held))[:, None] >> np.arange(len(held)) & 1).astype(np.float64)
    words = np.abs(have + outcomes @ np.array([size[i] for i in held]) - goal)
    best = outcomes[np.lexsort((np.abs(taken + outcomes.sum(axis=1) - count), words))[0]]
    for i, x in zip(held, best.tolist()):
        p[i] = x
    return p


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size, n_docs, target from rows (source, size).

    Sources by code point, null last, take the weights in turn and share the sum of all sizes; the excess of those above
    ``most`` times their size goes to the others by weight until none is above. In order of that bound over the weight the first
    ones are capped, so running sums find the level. What meets in one task is one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    by = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    every = Window.partitionBy()
    return (
        per.withColumn("weight", weight)
        .withColumn("bound", most * F.col("source_size").cast("double"))
        .withColumn("all", F.sum(F.col("source_size")).over(every).cast("double"))
        .withColumn("capped", F.coalesce(F.sum("bound").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("all") - F.col("capped")) / F.col("open"))
        .withColumn("stays", F.when(F.col("level") * F.col("weight") <= F.col("bound"), F.col("level")))
        # the level at the first source that it does not cap holds for all that follow
        .withColumn("level", F.first("stays", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("target", F.when(F.col("level").isNull(), F.col("bound")).otherwise(F.least("bound", F.col("level") * F.col("weight"))))
        .select("source", "source_size", "n_docs", "target")
    )


def moved(rows: pd.DataFrame) -> pd.DataFrame:
    """One group, settled as far as can be: wholly if it is its source's only one. Long documents come first, so that short ones stay open."""
    rows = rows.sort_values(["size", "h", "key", "n"], ascending=[False, True, True, True], kind="stable")
    buckets = int(rows["buckets"].iloc[0])
    begin = (int(rows["h"].iloc[0]) ^ buckets) & ((1 << 63) - 1)
    rows["p"] = (landing if buckets == 1 else flight)(rows["p"].tolist(), rows["size"].tolist(), begin)
    return rows[["key", "source", "n", "size", "p", "buckets"]]


def settle(fractions: DataFrame, largest: int, group: int = GROUP, seed: int = 7) -> DataFrame:
    """(key, source, n, size, p, n_docs) to (key, source, n, p): each p becomes 0 or 1, level by level."""
    done, open_ = None, fractions.withColumn("buckets", F.ceil(F.col("n_docs") / group)).drop("n_docs")
    kinds, most = "key string, source string, n long, size double, p double, buckets long", math.ceil(largest / group)
    while True:
        settled = (
            open_.withColumn("bucket", F.pmod(F.xxhash64("key", "n", F.lit(seed)), F.col("buckets")))
            .withColumn("h", F.xxhash64("key", "n", F.lit(seed + 1)))
            .groupBy("source", "bucket")
            .applyInPandas(moved, kinds)
        )
        if most == 1:
            return settled if done is None else done.unionByName(settled)
        settled = cut(settled)
        whole = settled.where("p = 0 or p = 1")
        done = whole if done is None else done.unionByName(whole)
        open_ = settled.where("p > 0 and p < 1").withColumn("buckets", F.ceil(F.col("buckets") * 4 / group))
        most = math.ceil(4 * most / group)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, most: float = MOST, group: int = GROUP) -> DataFrame:
    """How often a mix with target weights takes each document.

    One row per input row: the id column, source, size (words; null or empty text: 0), source_size, target, copies and taken (words, repeats
    counted). Sizes of 0 are taken as others are. A source of size 0 has target 0. Rows that share an id are told apart by a running
    number in order of their sizes, so reruns agree; an empty table gives no rows; other columns are dropped. The dozen documents per source that are settled
together at the landing are chosen so that the source's total comes nearest to its target: inclusion probabilities hold for all others. A source of any
    size is split into groups of ``group`` documents by a hash of the id.
    """
    rows = docs.select(
        docs[id_col].alias("id"),
        docs[source_col].cast("string").alias("source"),
        F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    rows = cut(rows)  # texts are read once
    goals = source_targets(rows, weights, most)
    goals = cut(goals)
    largest = goals.agg(F.max("n_docs")).first()[0]
    same = Window.partitionBy("source", "id").orderBy("size")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = (
        rows.withColumn("n", F.row_number().over(same).cast("long"))
        .withColumn("key", F.coalesce(F.col("id").cast("string"), F.lit("\u0000")))
        .join(goals.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .withColumn("whole", F.floor(rate + F.lit(TINY)))
        .withColumn("p", F.greatest(F.lit(0.0), rate - F.col("whole")))
        .select("id", "key", "n", "source", "size", "source_size", "target", "n_docs", "whole", "p")
    )
    if not largest:
        extra = rows.select("key", "source", "n", "p")
    else:
        extra = settle(rows.select("key", "source", "n", F.col("size").cast("double").alias("size"), "p", "n_docs"), largest, group)
    extra = extra.select(F.col("key").alias("k"), F.col("source").alias("s"), F.col("n").alias("m"), F.col("p").alias("extra"))
    copies = (F.col("whole") + F.col("extra")).cast("long")
    return rows.join(extra, (F.col("key") == F.col("k")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("n") == F.col("m"))).select(
        F.col("id").alias(id_col), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def resampled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Each row of ``docs`` as many times as the mix takes it, with all columns.

    Rows that share an id and a source meet their numbers of copies in order of their sizes. Null and empty texts have a size of 0 and are taken as
    others are; very long ones are counted whole; no rows give none.
    """
    taken = cut(mixed(docs, id_col, text_col, source_col).select(F.col(id_col).alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("copies").alias("_copies")))
    rows, columns = docs, docs.columns
    turn, copy = free_name(columns, "_turn"), free_name(columns, "_copy")
    repeated = taken.groupBy("_id", "_source").count().where("count > 1").limit(1).count() > 0
    if repeated:
        taken = taken.withColumn("_place", F.row_number().over(Window.partitionBy("_id", "_source").orderBy("_size", "_copies")))
        size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0))
        rows = docs.withColumn(turn, F.row_number().over(Window.partitionBy(id_col, source_col).orderBy(size)))
    same = F.col("t._id").eqNullSafe(F.col(f"d.{id_col}")) & F.col("t._source").eqNullSafe(F.col(f"d.{source_col}").cast("string"))
    if repeated:
        same = same & (F.col(f"d.{turn}") == F.col("t._place"))
    joined = rows.alias("d").join(taken.alias("t"), same).where(F.col("t._copies") > 0)
    out = joined.select("d.*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("t._copies"))).alias(copy))
    return out.select(*[F.col(f"`{c}`") for c in columns])


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    return mixed(table(spark, sf_dir, "documents"))
