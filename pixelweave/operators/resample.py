"""Images made smaller and larger, as joins with weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def smaller(size: int, binning: float) -> int:
    """Size after binning: rounded half to even, one at least."""
    return max(1, round(size / binning))


def weights(spark, size: int, target: int, old: str, new: str, weight: str) -> DataFrame:
    """How much each of ``size`` pixels adds to each of ``target``: overlaps, as shares of the new pixel."""
    rows, step = [], size / target
    for i in range(target):
        begin, end = i * step, (i + 1) * step
        for j in range(int(begin), min(size, int(-(-end // 1)))):
            overlap = min(end, j + 1) - max(begin, j)
            if overlap > 1e-12:
                rows.append((j, i, overlap / step))
    return spark.createDataFrame(rows, f"{old} int, {new} int, {weight} double")


def box_downsample(pixels: DataFrame, height: int, width: int, binning: float) -> DataFrame:
    """Means over boxes, edges in part; the tables of weights have a few rows per row and column of an image."""
    spark = pixels.sparkSession
    down, across = weights(spark, height, smaller(height, binning), "r", "r2", "wr"), weights(spark, width, smaller(width, binning), "c", "c2", "wc")
    both = pixels.join(F.broadcast(down), "r").join(F.broadcast(across), "c")
    return both.groupBy("image_id", "r2", "c2").agg(F.sum(F.col("v") * F.col("wr") * F.col("wc")).alias("v")).withColumnsRenamed({"r2": "r", "c2": "c"})


def nearest_upsample(masks: DataFrame, small: tuple[int, int], large: tuple[int, int]) -> DataFrame:
    """Labels at a larger size: each pixel takes the one at its place times the sizes' ratio, rounded down."""
    spark = masks.sparkSession

    def places(n: int, m: int, old: str, new: str) -> DataFrame:
        return spark.createDataFrame([(min(i * n // m, n - 1), i) for i in range(m)], f"{old} int, {new} int")

    out = masks.join(F.broadcast(places(small[0], large[0], "r", "r2")), "r").join(F.broadcast(places(small[1], large[1], "c", "c2")), "c")
    return out.select("image_id", F.col("r2").alias("r"), F.col("c2").alias("c"), "label")


def middle_crop(pixels: DataFrame, size: tuple[int, int], wanted: tuple[int, int]) -> DataFrame:
    """The middle part of every image, counted from 0."""
    top, left = (size[0] - wanted[0]) // 2, (size[1] - wanted[1]) // 2
    inside = F.col("r").between(top, top + wanted[0] - 1) & F.col("c").between(left, left + wanted[1] - 1)
    return pixels.where(inside).withColumn("r", F.col("r") - top).withColumn("c", F.col("c") - left)


def bilinear_zoom(pixels: DataFrame, size: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """Values at another size, linear between neighbours, first and last pixels kept in place."""
    spark = pixels.sparkSession

    def parts(n: int, m: int, old: str, new: str, w: str) -> DataFrame:
        rows = []
        for i in range(m):
            at = i * (n - 1) / (m - 1) if m > 1 else 0.0
            low = min(int(at), n - 1)
            rows += [(j, i, x) for j, x in ((low, 1 - (at - low)), (min(low + 1, n - 1), at - low)) if x > 0]
        return spark.createDataFrame(rows, f"{old} int, {new} int, {w} double")

    if size == target:
        return pixels
    both = pixels.join(F.broadcast(parts(size[0], target[0], "r", "r2", "wr")), "r").join(F.broadcast(parts(size[1], target[1], "c", "c2", "wc")), "c")
    return both.groupBy("image_id", "r2", "c2").agg(F.sum(F.col("v") * F.col("wr") * F.col("wc")).alias("v")).withColumnsRenamed({"r2": "r", "c2": "c"})


def dilate(masks: DataFrame, offsets: list[tuple[int, int]], height: int, width: int) -> DataFrame:
    """Pixels within reach of a label, the smallest label where several are."""
    steps = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in offsets])
    moved = masks.withColumn("o", F.explode(steps)).select("image_id", (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"), "label")
    return moved.where(F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1)).groupBy("image_id", "r", "c").agg(F.min("label").alias("label"))


def laplacian(pixels: DataFrame) -> DataFrame:
    """Sum of the four neighbours less four times the pixel; edges count as their own neighbours."""
    from pyspark.sql import Window

    along, across = Window.partitionBy("image_id", "r").orderBy("c"), Window.partitionBy("image_id", "c").orderBy("r")
    around = [f("v").over(w) for f in (F.lag, F.lead) for w in (along, across)]
    total = sum((F.coalesce(x, F.col("v")) for x in around[1:]), F.coalesce(around[0], F.col("v")))
    return pixels.select("image_id", "r", "c", (total - 4 * F.col("v")).alias("v"))


def fill_holes_step(outside: DataFrame, free: DataFrame) -> DataFrame:
    """Free pixels that touch ``outside``: one step of a flood from the border."""
    steps = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))])
    moved = outside.withColumn("o", F.explode(steps)).select("image_id", (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c")).distinct()
    return free.join(moved, ["image_id", "r", "c"], "left_semi")
