"""Images as relations: long pixels and masks, the selection of planes, and scenes made by formula.

pixels(image_id, r, c, v) and, for stacks, also t, ch and z; masks(image_id, r, c, label) hold no label 0.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Size of the scenes.
HEIGHT, WIDTH = 40, 48
#: Rows of pixels that a task makes at about.
TASK_PIXELS = 1 << 18


def bounded(index: int, size: int, axis: str) -> int:
    """A position on an axis, counted from the end if negative."""
    if not -size <= index < size:
        raise IndexError(f"{axis} index {index} is outside an axis of {size}")
    return index % size


def z_index(z: int | str | None, size: int) -> int:
    """A plane of the z axis: the middle one by default."""
    if z in (None, "mid"):
        return size // 2
    return bounded(int(z), size, "z")


def is_projection(z: int | str | None) -> bool:
    return z in ("max", "mean")


def select_plane(pixels: DataFrame, t: int = 0, ch: int = 0, z: int | str | None = "mid") -> DataFrame:
    """One plane of every image: an exact position on t and ch, and a position or projection on z.

    Axes that the relation lacks are ignored. Sizes of the axes are taken per image, so that negative positions and the middle plane are too.
    """
    out = pixels
    keys = [k for k in ("t", "ch") if k in pixels.columns]
    # sizes are joined by the image alone: a position that were part of the key would have all pixels dealt anew by it
    of_image = lambda size: pixels.groupBy("image_id").agg(size.alias("_at"))
    for key, at in (("t", t), ("ch", ch)):
        if key in keys:
            if at >= 0:
                out = out.where(F.col(key) == at)
            else:
                out = out.join(of_image(F.max(key) + 1 + at), "image_id").where(F.col(key) - F.col("_at") == 0).drop("_at")
    if "z" not in pixels.columns:
        return out.select("image_id", "r", "c", "v")
    if is_projection(z):
        return project(out, z)
    if z not in (None, "mid") and int(z) >= 0:
        return out.where(F.col("z") == int(z)).select("image_id", "r", "c", "v")
    middle = F.floor((F.max("z") + 1) / 2).cast("int") if z in (None, "mid") else F.max("z") + 1 + int(z)
    return out.join(of_image(middle), "image_id").where(F.col("z") - F.col("_at") == 0).select("image_id", "r", "c", "v")


def project(pixels: DataFrame, mode: str, whole_numbers: bool = True) -> DataFrame:
    """Greatest or mean value over z; means of whole numbers are rounded half to even."""
    value = F.max("v") if mode == "max" else F.avg("v")
    if mode == "mean" and whole_numbers:
        value = F.rint(value)
    return pixels.groupBy("image_id", "r", "c").agg(value.alias("v"))


def resolve_channel(channels: DataFrame, wanted: str) -> DataFrame:
    """(image_id, idx) of a channel: by name whatever the case, else by number. channels(image_id, idx, name)."""
    asked = wanted.strip().lower()
    rank = F.when(F.lower("name") == asked, 0).when(F.col("idx").cast("string") == asked, 1)
    best = Window.partitionBy("image_id").orderBy(rank, "idx")
    return channels.where(rank.isNotNull()).withColumn("n", F.row_number().over(best)).where("n = 1").select("image_id", "idx")


def first_channels(channels: Sequence[int] | None, count: int) -> list[int]:
    """Channels that are segmented: the first three by default, never none or more than three."""
    chosen = list(range(min(3, count))) if channels is None else [bounded(i, count, "channel") for i in channels]
    if not 1 <= len(chosen) <= 3:
        raise ValueError("between one and three channels are segmented")
    return chosen


def extra_channels(base: DataFrame, *more: DataFrame) -> DataFrame:
    """Channels appended after those of ``base``, in order; all relations have a column ch."""
    out, shift = base, base.agg(F.max("ch")).first()[0] + 1
    for x in more:
        last = x.agg(F.max("ch")).first()[0]
        out = out.unionByName(x.withColumn("ch", (F.col("ch") + shift).cast(base.schema["ch"].dataType)))
        shift += (last or 0) + 1
    return out


#: Metres of the units of length.
METRES = {"m": 1.0, "cm": 1e-2, "mm": 1e-3, "um": 1e-6, "µm": 1e-6, "nm": 1e-9, "pm": 1e-12, "å": 1e-10}


def in_micrometres(value: Column, unit: Column) -> Column:
    """A length in µm; null for a unit that isn't known."""
    table = F.create_map(*[F.lit(x) for pair in METRES.items() for x in pair])
    return value * (F.try_element_at(table, F.lower(F.trim(unit))) / F.lit(1e-6))


# ---- scenes


def dealt(images: DataFrame, each: int) -> DataFrame:
    """images(image_id ...) that become ``each`` rows apiece, dealt by image: about ``TASK_PIXELS`` rows to a task, and work for every core where there are images enough.

    A few bytes per image tell nothing of what comes of them, so that the number of tasks is given and not left to Spark. Whatever is keyed by the image, or by it and more, then
    finds its rows in place, joins by pixel too: for these the session is told that rows dealt by a part of a join's keys needn't be dealt again.
    """
    spark = images.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    cores = spark.sparkContext.defaultParallelism
    n = images.count()
    return images.repartition(max(1, -(-n * each // TASK_PIXELS), min(n, 2 * cores)), "image_id")


def axis(spark: SparkSession, name: str, size: int) -> DataFrame:
    return F.broadcast(spark.range(size).select(F.col("id").cast("int").alias(name)))


def grid(images: DataFrame, key: str, height: int = HEIGHT, width: int = WIDTH, **more: int) -> DataFrame:
    """(image_id, r, c ...): a row per pixel of every image, for each position on further axes given by their sizes.

    Axes are joined: exploded arrays count as one row in Spark's estimates, by which pixels would be broadcast.
    """
    sizes = {"r": height, "c": width, **more}
    out = dealt(images.select(F.col(key).cast("long").alias("image_id")), math.prod(sizes.values()))
    for name, size in sizes.items():
        out = out.crossJoin(axis(images.sparkSession, name, size))
    return out


def scene(images: DataFrame, key: str) -> DataFrame:
    """pixels with values of a formula in whole numbers, one image per row of ``images``."""
    k, r, c = F.col("image_id"), F.col("r"), F.col("c")
    v = (r * 7 + c * 13 + k * 29 + (r * c) % 17 * 11 + F.when(hit(k, r, c), 300).otherwise(0)) % 1021
    return grid(images, key).withColumn("v", v.cast("double"))


def scene_masks(images: DataFrame, key: str) -> DataFrame:
    """masks of the same scene: discs around the middles of cells of 10 by 12 pixels, some cells empty."""
    k, r, c = F.col("image_id"), F.col("r"), F.col("c")
    label = (F.floor(r / 10) * 4 + F.floor(c / 12) + 1).cast("int")
    return grid(images, key).where(hit(k, r, c)).withColumn("label", label)


def hit(k: Column, r: Column, c: Column) -> Column:
    i, j = F.floor(r / 10), F.floor(c / 12)
    far = (r - (i * 10 + 5)) * (r - (i * 10 + 5)) + (c - (j * 12 + 6)) * (c - (j * 12 + 6))
    radius = 2 + (k + i + j) % 4
    return ((k + i * 3 + j) % 5 != 0) & (far <= radius * radius)


def stack(images: DataFrame, key: str, depth: int = 5, channels: int = 2) -> DataFrame:
    """pixels with t, ch and z: small planes of 12 by 14."""
    rows = grid(images, key, 12, 14, z=depth, ch=channels)
    k, r, c, zz, q = (F.col(x) for x in ("image_id", "r", "c", "z", "ch"))
    return rows.withColumn("t", F.lit(0)).withColumn("v", ((r * 5 + c * 3 + zz * 17 * (r + 1) + q * 31 + k) % 257).cast("double"))


#: The same in SQL, for checks against another engine.
SQL_GRID = f"""
g AS (SELECT CAST(s_suppkey AS BIGINT) AS image_id, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c
  FROM supplier, range({HEIGHT}) AS a(r), range({WIDTH}) AS b(c)),
h AS (SELECT *, r // 10 AS i, c // 12 AS j FROM g),
d AS (SELECT *, ((image_id + i * 3 + j) % 5 <> 0
  AND (r - i * 10 - 5) * (r - i * 10 - 5) + (c - j * 12 - 6) * (c - j * 12 - 6) <= (2 + (image_id + i + j) % 4) * (2 + (image_id + i + j) % 4)) AS hit FROM h),
pixels AS (SELECT image_id, r, c, CAST((r * 7 + c * 13 + image_id * 29 + (r * c) % 17 * 11 + CASE WHEN hit THEN 300 ELSE 0 END) % 1021 AS DOUBLE) AS v FROM d),
masks AS (SELECT image_id, r, c, CAST(i * 4 + j + 1 AS INTEGER) AS label FROM d WHERE hit),
px AS (SELECT m.image_id, m.label, m.r, m.c, p.v FROM masks m JOIN pixels p USING (image_id, r, c))
"""
SQL_STACK = """
stack AS (SELECT CAST(s_suppkey AS BIGINT) AS image_id, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, CAST(z AS INTEGER) AS z, CAST(ch AS INTEGER) AS ch,
  CAST((r * 5 + c * 3 + z * 17 * (r + 1) + ch * 31 + s_suppkey) % 257 AS DOUBLE) AS v
  FROM supplier, range(12) AS a(r), range(14) AS b(c), range(5) AS e(z), range(2) AS f(ch))
"""


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey")
