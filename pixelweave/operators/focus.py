"""Focus through a stack: planes(stack_id, z, r, c, v) with heights(stack_id, z, z_um)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.operators import kernels

PLANE = ["stack_id", "z"]


def _ahead(planes: DataFrame, steps: int) -> DataFrame:
    along, across = Window.partitionBy(*PLANE, "r").orderBy("c"), Window.partitionBy(*PLANE, "c").orderBy("r")
    out = planes
    for i in range(1, steps + 1):
        out = out.withColumn(f"x{i}", F.lead("v", i).over(along)).withColumn(f"y{i}", F.lead("v", i).over(across))
    return out


def brenner(planes: DataFrame) -> DataFrame:
    """Mean square of differences two pixels apart, along rows and along columns, added."""
    d = lambda n: (F.col(n) - F.col("v")) * (F.col(n) - F.col("v"))
    return _ahead(planes, 2).groupBy(*PLANE).agg((F.avg(d("x2")) + F.avg(d("y2"))).alias("brenner"))


def vollath(planes: DataFrame) -> DataFrame:
    """Products with the next pixel less those with the one after it, over the pixels that have both; both axes added."""
    wide = _ahead(planes, 2)
    part = lambda n: F.avg(F.when(F.col(f"{n}2").isNotNull(), F.col("v") * F.col(f"{n}1") - F.col("v") * F.col(f"{n}2")))
    return wide.groupBy(*PLANE).agg((part("x") + part("y")).alias("vollath_f4"))


def bright(planes: DataFrame, percentile: float = 99.0) -> DataFrame:
    """Mean of the pixels at or above a percentile."""
    if not 0 <= percentile < 100:
        raise ValueError("the percentile lies between 0 and 100")
    edge = planes.groupBy(*PLANE).agg(F.percentile("v", percentile / 100).alias("edge"))
    return planes.join(edge, PLANE).where("v >= edge").groupBy(*PLANE).agg(F.avg("v").alias("intensity"))


def skip_of(n: Column, skip: int) -> Column:
    """Planes left out at either end: as asked, but never so many that none is left."""
    return F.least(F.lit(skip), F.greatest(F.lit(0), F.floor((n - 1) / 2))).cast("int")


def peak(curve: DataFrame, score: str, skip: int = 2, heights: DataFrame | None = None) -> DataFrame:
    """The sharpest plane of each stack and whether the curve has a peak there, refined by a parabola through the logarithms.

    (stack_id, best, found, refined[, z_um]). The first of equal scores holds. A peak has strictly lower neighbours on both sides and
    isn't at an end. Where a score isn't above 0 the parabola goes through the scores; without curvature, or at an end, the plane
    itself holds. Heights between planes are interpolated.
    """
    line = Window.partitionBy("stack_id").orderBy("z")
    whole = Window.partitionBy("stack_id")
    s = F.col(score)
    wide = (
        curve.withColumn("n", F.count(F.lit(1)).over(whole))
        .withColumn("i", F.row_number().over(line) - 1)
        .withColumn("before", F.lag(score).over(line))
        .withColumn("after", F.lead(score).over(line))
        .withColumn("skip", skip_of(F.col("n"), skip))
    )
    inside = (F.col("i") >= F.col("skip")) & (F.col("i") < F.col("n") - F.col("skip"))
    best = wide.where(inside).withColumn("rank", F.row_number().over(Window.partitionBy("stack_id").orderBy(F.desc(score), "i"))).where("rank = 1")
    ends = F.col("before").isNull() | F.col("after").isNull()
    logs = (s > 0) & (F.col("before") > 0) & (F.col("after") > 0)
    pick = lambda x: F.when(logs, F.ln(x)).otherwise(x)
    a, b, c = pick(F.col("before")), pick(s), pick(F.col("after"))
    bend = a - 2 * b + c
    refined = F.when(~ends & (bend < 0), F.col("i") + 0.5 * (a - c) / bend).otherwise(F.col("i").cast("double"))
    found = F.coalesce((F.col("before") < s) & (F.col("after") < s), F.lit(False))
    out = best.select("stack_id", F.col("i").alias("best"), found.alias("found"), refined.alias("refined"))
    return out if heights is None else at_height(out, heights)


def at_height(peaks: DataFrame, heights: DataFrame) -> DataFrame:
    """z_um at the refined place, between the planes on either side and never beyond the ends; null without a peak."""
    order = Window.partitionBy("stack_id").orderBy("z")
    h = heights.withColumn("i", F.row_number().over(order) - 1).select(F.col("stack_id").alias("s"), "i", "z_um", F.lead("z_um").over(order).alias("next_um"), F.count(F.lit(1)).over(Window.partitionBy("stack_id")).alias("n"))
    joined = peaks.join(h, F.col("stack_id") == F.col("s"))
    place = F.least(F.greatest(F.col("refined"), F.lit(0.0)), (F.col("n") - 1).cast("double"))
    joined = joined.withColumn("place", place).where(F.col("i") == F.floor("place"))
    z = F.col("z_um") + (F.col("place") - F.col("i")) * F.coalesce(F.col("next_um") - F.col("z_um"), F.lit(0.0))
    return joined.select("stack_id", "best", "found", "refined", F.when(F.col("found"), z).alias("z_um"))


def sharp_height(curve: DataFrame, score: str) -> DataFrame:
    """(stack_id, z_um, bracketed) for a registration: no planes are skipped, the parabola goes through the scores; at an end, not bracketed, the plane's own height.

    curve(stack_id, z, z_um, score).
    """
    line = Window.partitionBy("stack_id").orderBy("z")
    s = F.col(score)
    wide = curve.withColumn("a", F.lag(score).over(line)).withColumn("b", F.lead(score).over(line))
    wide = wide.withColumn("lower", F.lag("z_um").over(line)).withColumn("upper", F.lead("z_um").over(line))
    best = wide.withColumn("rank", F.row_number().over(Window.partitionBy("stack_id").orderBy(F.desc(score), "z"))).where("rank = 1")
    bend, step = F.col("a") - 2 * s + F.col("b"), (F.col("upper") - F.col("lower")) / 2
    inside = F.col("a").isNotNull() & F.col("b").isNotNull()
    z = F.when(inside & (bend < 0), F.col("z_um") + 0.5 * (F.col("a") - F.col("b")) / bend * step).otherwise(F.col("z_um"))
    return best.select("stack_id", z.alias("z_um"), inside.alias("bracketed"))


def dct_entropy(planes: DataFrame, height: int, width: int) -> DataFrame:
    """Entropy, in bits, of a plane's energy over the orthonormal cosine transform, the constant part left out. One group per plane, two matrix products."""
    kinds = {f.name: f.dataType.simpleString() for f in planes.schema}

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((height, width))
        a[rows["r"].to_numpy(), rows["c"].to_numpy()] = rows["v"].to_numpy()
        return pd.DataFrame({"stack_id": rows["stack_id"].iloc[:1], "z": rows["z"].iloc[:1], "dct_entropy": [kernels.dct_entropy(a)]})

    return planes.groupBy(*PLANE).applyInPandas(one, f"stack_id {kinds['stack_id']}, z {kinds['z']}, dct_entropy double")


def curves(planes: DataFrame, height: int, width: int, percentile: float = 99.0) -> DataFrame:
    """All measures of every plane, long: (stack_id, z, measure, score). Planes are ``height`` by ``width``."""
    wide = brenner(planes).join(vollath(planes), PLANE).join(bright(planes, percentile), PLANE).join(dct_entropy(planes, height, width), PLANE, "left")
    return wide.unpivot(PLANE, ["brenner", "vollath_f4", "intensity", "dct_entropy"], "measure", "score")
