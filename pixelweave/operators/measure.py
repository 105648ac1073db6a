"""Measures of objects, from pixels joined with masks: px(image_id, label, r, c, v).

Everything here is one grouped aggregation, or a few on the same key, so that Spark aggregates before it shuffles and a key's later
aggregations find their rows in place. Undefined values are null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.operators import kernels

KEY = ["image_id", "label"]


def of_objects(pixels: DataFrame, masks: DataFrame) -> DataFrame:
    """px: the pixels of objects."""
    return masks.join(pixels, ["image_id", "r", "c"]).select("image_id", "label", "r", "c", "v")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def base(px: DataFrame) -> DataFrame:
    """Size, place and intensity of each object."""
    mass = F.sum("v")
    return px.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("area"),
        F.min("r").alias("bbox_r0"),
        F.min("c").alias("bbox_c0"),
        (F.max("r") + 1).alias("bbox_r1"),
        (F.max("c") + 1).alias("bbox_c1"),
        F.avg("r").alias("centroid_r"),
        F.avg("c").alias("centroid_c"),
        ratio(F.sum(F.col("v") * F.col("r")), mass).alias("weighted_r"),
        ratio(F.sum(F.col("v") * F.col("c")), mass).alias("weighted_c"),
        F.avg("v").alias("mean"),
        F.min("v").alias("least"),
        F.max("v").alias("greatest"),
        F.stddev_pop("v").alias("spread"),
        F.median("v").alias("median"),
        F.sqrt(4 * F.count(F.lit(1)) / F.lit(math.pi)).alias("equivalent_diameter"),
        (F.count(F.lit(1)) / ((F.max("r") - F.min("r") + 1) * (F.max("c") - F.min("c") + 1))).alias("extent"),
    )


def axes(px: DataFrame) -> DataFrame:
    """Axis lengths, eccentricity and orientation from the second central moments.

    The inertia tensor has the moments of the pixels themselves; its eigenvalues give axes of 4 times their roots. The orientation is the angle between the
    rows' axis and the major axis, in (-pi/2, pi/2].
    """
    # sums of whole numbers are exact, so moments follow from them without a second pass
    n, r, c = F.col("n"), F.col("sr"), F.col("sc")
    sums = px.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("r").alias("sr"),
        F.sum("c").alias("sc"),
        F.sum(F.col("r") * F.col("r")).alias("srr"),
        F.sum(F.col("c") * F.col("c")).alias("scc"),
        F.sum(F.col("r") * F.col("c")).alias("src"),
    )
    central = sums.select(
        *KEY, ((n * F.col("scc") - c * c) / (n * n)).alias("a"), (-(n * F.col("src") - r * c) / (n * n)).alias("b"), ((n * F.col("srr") - r * r) / (n * n)).alias("d")
    )
    a, b, d = F.col("a"), F.col("b"), F.col("d")
    root = F.sqrt((a - d) * (a - d) + 4 * b * b)
    both = central.withColumn("l1", (a + d + root) / 2).withColumn("l2", F.greatest(F.lit(0.0), (a + d - root) / 2))
    turned = F.when(a == d, F.when(b < 0, math.pi / 4).otherwise(-math.pi / 4)).otherwise(0.5 * F.atan2(-2 * b, d - a))
    return both.select(
        *KEY,
        (4 * F.sqrt("l1")).alias("major_axis"),
        (4 * F.sqrt("l2")).alias("minor_axis"),
        F.when(F.col("l1") > 0, F.sqrt(1 - F.col("l2") / F.col("l1"))).otherwise(0.0).alias("eccentricity"),
        turned.alias("orientation"),
    )


def with_shape(height: int, width: int, at: Column, axis: str) -> Column:
    """A position mirrored at the image's edges, the edge itself repeated."""
    last = (height if axis == "r" else width) - 1
    return F.when(at < 0, -at - 1).when(at > last, 2 * last + 1 - at).otherwise(at)


def neighbours(masks: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """(image_id, label, r, c, dr, dc): each mask pixel's neighbours of the same label that exist."""
    steps = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in offsets])
    moved = masks.withColumn("o", F.explode(steps)).select("image_id", "label", (F.col("r") - F.col("o.dr")).alias("r"), (F.col("c") - F.col("o.dc")).alias("c"), F.col("o.dr").alias("dr"), F.col("o.dc").alias("dc"))
    return moved.join(masks, ["image_id", "label", "r", "c"])


def perimeter(masks: DataFrame) -> DataFrame:
    """Length of the border: pixels with a 4-neighbour outside, weighed by how their border neighbours lie.

    Of the border's 8 neighbours, those along an edge count 2 and those across a corner 10 in a code; codes 5, 7, 15, 17, 25, 27 weigh 1, codes 21 and 33
    sqrt 2, codes 13 and 23 (1 + sqrt 2) / 2, all others nothing.
    """
    four = [(0, 1), (0, -1), (1, 0), (-1, 0)]
    corners = [(1, 1), (1, -1), (-1, 1), (-1, -1)]
    inner = neighbours(masks, four).groupBy("image_id", "label", "r", "c").agg(F.count(F.lit(1)).alias("k")).where("k = 4")
    border = masks.select("image_id", "label", "r", "c").join(inner, ["image_id", "label", "r", "c"], "left_anti")
    near = neighbours(border, four + corners)
    weight = F.when((F.col("dr") == 0) | (F.col("dc") == 0), 2).otherwise(10)
    code = near.groupBy("image_id", "label", "r", "c").agg(F.sum(weight).alias("code"))
    code = border.join(code, ["image_id", "label", "r", "c"], "left").withColumn("code", 1 + F.coalesce("code", F.lit(0)))
    x = F.col("code")
    length = F.when(x.isin(5, 7, 15, 17, 25, 27), 1.0).when(x.isin(21, 33), math.sqrt(2)).when(x.isin(13, 23), (1 + math.sqrt(2)) / 2).otherwise(0.0)
    return code.groupBy(*KEY).agg(F.sum(length).alias("perimeter"))


def crofton(masks: DataFrame) -> DataFrame:
    """Perimeter by Crofton's formula in four directions: how often lines along each enter an object."""
    ways = [(0, 1, 1.0), (1, 0, 1.0), (1, 1, math.sqrt(0.5)), (1, -1, math.sqrt(0.5))]
    linked = neighbours(masks, [(a, b) for a, b, _ in ways]).groupBy(*KEY).agg(*[F.sum(F.when((F.col("dr") == a) & (F.col("dc") == b), 1).otherwise(0)).alias(f"w{i}") for i, (a, b, _) in enumerate(ways)])
    sizes = masks.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    both = sizes.join(linked, KEY, "left")
    total = sum((w * (F.col("n") - F.coalesce(f"w{i}", F.lit(0))) for i, (_, _, w) in enumerate(ways)), F.lit(0.0))
    return both.select(*KEY, (total * math.pi / 4).alias("perimeter_crofton"))


def derived(objects: DataFrame) -> DataFrame:
    """Ratios of columns that are there: circularity, aspect_ratio, orientation_deg, intensity_total, intensity_cv."""
    have, out = set(objects.columns), objects
    if {"area", "perimeter_crofton"} <= have:
        p = F.col("perimeter_crofton")
        out = out.withColumn("circularity", F.when(p > 0, 4 * math.pi * F.col("area") / (p * p)))
    if {"major_axis", "minor_axis"} <= have:
        out = out.withColumn("aspect_ratio", F.when(F.col("minor_axis") > 0, F.col("major_axis") / F.col("minor_axis")))
    if "orientation" in have:
        out = out.withColumn("orientation_deg", F.pmod(F.lit(90.0) - F.degrees("orientation"), F.lit(180.0)))
    if "mean" in have:
        out = out.withColumn("intensity_total", F.col("mean") * F.col("num_pixels" if "num_pixels" in have else "area"))
    if {"mean", "spread"} <= have:
        out = out.withColumn("intensity_cv", F.when(F.col("mean") > 0, F.col("spread") / F.col("mean")))
    return out


def by_channel(px: DataFrame, channels: list[int]) -> DataFrame:
    """mean, least, greatest, spread, median and total of px with a column ch, each with _c0, _c1 ...; the list of channels is given, so no pass is needed to find it."""
    of = {"mean": F.avg, "least": F.min, "greatest": F.max, "spread": F.stddev_pop, "median": F.median, "total": F.sum}
    return px.groupBy(*KEY).agg(*[f(F.when(F.col("ch") == i, F.col("v"))).alias(f"{name}_c{i}") for i in channels for name, f in of.items()])


def spaced(objects: DataFrame, spacing: tuple[float, float]) -> DataFrame:
    """Base measures of images with pixels of (height, width) µm: num_pixels beside an area in µm², centroids in µm."""
    dy, dx = spacing
    out = objects.withColumn("num_pixels", F.col("area")).withColumn("area", F.col("area") * F.lit(dy * dx))
    return out.withColumns({"centroid_r": F.col("centroid_r") * F.lit(dy), "centroid_c": F.col("centroid_c") * F.lit(dx), "equivalent_diameter": F.sqrt(4 * F.col("area") / F.lit(math.pi))})


def global_background(pixels: DataFrame, masks: DataFrame) -> DataFrame:
    """(image_id, bg_global_mean): mean of the pixels of no object; null for an image without any."""
    marked = pixels.join(masks.select("image_id", "r", "c", F.lit(1).alias("inside")), ["image_id", "r", "c"], "left")
    return marked.groupBy("image_id").agg(F.avg(F.when(F.col("inside").isNull(), F.col("v"))).alias("bg_global_mean"))


def local_background(pixels: DataFrame, masks: DataFrame, radius: int = 5) -> DataFrame:
    """(image_id, label, bg_local_mean): mean of the pixels of no object within ``radius`` of an object; its holes, filled first, aren't among them."""
    marked = pixels.join(masks.select("image_id", "r", "c", "label"), ["image_id", "r", "c"], "left")
    return kernels.local_backgrounds(marked, radius)


def against_local(objects: DataFrame) -> DataFrame:
    """Means and totals less, and over, the local background; a total is set over the background of one pixel."""
    bg, total = F.col("bg_local_mean"), F.col("mean") * F.col("area")
    return objects.select(
        *KEY,
        (F.col("mean") - bg).alias("mean_minus_local_bg"),
        F.when(bg > 0, F.col("mean") / bg).alias("mean_over_local_bg"),
        (total - bg * F.col("area")).alias("total_minus_local_bg"),
        F.when(bg > 0, total / bg).alias("total_over_local_bg"),
    )


def nearest(objects: DataFrame, k: int = 5) -> DataFrame:
    """(image_id, label, nn_distance, nn{k}_mean_distance): distance of the nearest other centroid, and the mean of the k nearest (of all, if fewer).

    Objects of one image are compared, so that the join's key is the image.
    """
    a = objects.select("image_id", "label", F.col("centroid_r").alias("y"), F.col("centroid_c").alias("x"))
    b = a.select("image_id", F.col("label").alias("other"), F.col("y").alias("y2"), F.col("x").alias("x2"))
    apart = F.sqrt((F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2")) + (F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")))
    pairs = a.join(b, "image_id").where("label <> other").withColumn("d", apart)
    ranked = pairs.withColumn("n", F.row_number().over(Window.partitionBy(*KEY).orderBy("d", "other"))).where(F.col("n") <= k)
    found = ranked.groupBy(*KEY).agg(F.min("d").alias("nn_distance"), F.avg("d").alias(f"nn{k}_mean_distance"))
    return a.select(*KEY).join(found, KEY, "left")


def counted(objects: DataFrame, radii: tuple[int, ...] = (5, 50, 250)) -> DataFrame:
    """(image_id, label, neighbours_within_R ...): how many other centroids of the image lie within each radius."""
    a = objects.select("image_id", "label", F.col("centroid_r").alias("y"), F.col("centroid_c").alias("x"))
    b = a.select("image_id", F.col("label").alias("other"), F.col("y").alias("y2"), F.col("x").alias("x2"))
    d2 = (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2")) + (F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2"))
    pairs = a.join(b, "image_id").withColumn("d2", d2)
    return pairs.groupBy(*KEY).agg(*[F.count(F.when((F.col("label") != F.col("other")) & (F.col("d2") <= n * n), 1)).alias(f"neighbours_within_{n}") for n in radii])


def within(points: DataFrame, radius: float, id_col: str = "id", image_col: str | None = None) -> DataFrame:
    """([image,] id, neighbours): how many other points (id, x, y) lie within ``radius``, itself left out; with ``image_col``, of the same image alone.

    A range join by buckets: a point meets the points of its cell and of the eight around it, which a grid of ``radius`` makes enough. Both sides are dealt by cell and
    sorted: a table's compressed size says little of its points, nine times as many on one side, and neither may be broadcast by it.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    image = F.col(image_col) if image_col else F.lit(0)
    left = points.select(image.alias("image"), F.col(id_col).alias("id"), "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    right = left.withColumn("o", F.explode(around)).select("image", F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"), (F.col("cx") + F.col("o.a")).alias("cx"), (F.col("cy") + F.col("o.b")).alias("cy"))
    near = (F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2")) <= radius * radius
    found = left.join(right.hint("merge"), ["image", "cx", "cy"]).where(near & (F.col("id") != F.col("id2"))).groupBy("image", "id").agg(F.count(F.lit(1)).alias("n"))
    out = left.select("image", "id").join(found.hint("merge"), ["image", "id"], "left")
    return out.select(*([F.col("image").alias(image_col)] if image_col else []), F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("neighbours"))


def gyration(px: DataFrame) -> DataFrame:
    """Radius of gyration, and the intensities' radial variance over that of an even object."""
    middle = px.groupBy(*KEY).agg(F.avg("r").alias("y"), F.avg("c").alias("x"))
    d2 = (F.col("r") - F.col("y")) * (F.col("r") - F.col("y")) + (F.col("c") - F.col("x")) * (F.col("c") - F.col("x"))
    sums = px.join(middle, KEY).withColumn("d2", d2).groupBy(*KEY).agg(F.avg("d2").alias("rg2"), F.sum(F.col("v") * F.col("d2")).alias("s"), F.avg("v").alias("m"), F.count(F.lit(1)).alias("n"))
    even = F.col("m") * F.col("n") * F.col("rg2")
    return sums.select(*KEY, F.sqrt("rg2").alias("radius_of_gyration"), F.when((F.col("rg2") > 0) & (F.col("m") > 0), F.col("s") / even).alias("intensity_radial_variance"))
