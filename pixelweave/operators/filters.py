"""Filters of labelled objects. Labels keep their numbers; what is dropped is reported, sorted."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["image_id", "label"]


def area_bounds(pixel_um2: float = 1.0, min_area: float | None = None, max_area: float | None = None, min_diameter: float | None = None, max_diameter: float | None = None) -> tuple[int | None, int | None]:
    """Bounds in pixels, of each side by area or by diameter: the lower one rounded up, the upper one down."""
    if min_area is not None and min_diameter is not None or max_area is not None and max_diameter is not None:
        raise ValueError("a bound is given by area or by diameter, not by both")

    def area(a: float | None, d: float | None) -> float | None:
        value = a if a is not None else None if d is None else math.pi * (d / 2) ** 2
        if value is not None and value < 0:
            raise ValueError("a bound can't be negative")
        return None if value is None else value / pixel_um2

    low, high = area(min_area, min_diameter), area(max_area, max_diameter)
    low, high = None if low is None else math.ceil(low), None if high is None else math.floor(high)
    if low is not None and high is not None and high < low:
        raise ValueError("the upper bound is below the lower one")
    return low, high


def area_bound_px(diameter_um: Column, pixel_um2: Column, upper: bool) -> Column:
    """The same as an expression, for bounds that are columns."""
    area = F.lit(math.pi) * (diameter_um / 2) * (diameter_um / 2) / pixel_um2
    return (F.floor(area) if upper else F.ceil(area)).cast("long")


def keep_labels(masks: DataFrame, keep: DataFrame) -> DataFrame:
    """The pixels of the labels in ``keep`` (image_id, label)."""
    return masks.join(keep.select(*KEY).distinct(), KEY, "left_semi")


def by_area(masks: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """Labels of an area within inclusive bounds, as (image_id, label); both None keep all."""
    if min(low or 0, high or 0) < 0 or low is not None and high is not None and high < low:
        raise ValueError("bounds must be positive, the upper one not below the lower one")
    sizes = masks.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    if low is not None:
        sizes = sizes.where(F.col("n") >= low)
    if high is not None:
        sizes = sizes.where(F.col("n") <= high)
    return sizes.select(*KEY)


def by_border(masks: DataFrame, margin: int, height: int, width: int) -> DataFrame:
    """Labels without a pixel in a band of ``margin`` pixels along the border, as (image_id, label)."""
    if margin < 0 or 2 * margin >= min(height, width):
        raise ValueError("the margin leaves nothing of the image")
    inside = F.col("r").between(margin, height - margin - 1) & F.col("c").between(margin, width - margin - 1)
    return masks.groupBy(*KEY).agg(F.min(inside).alias("clear")).where("clear").select(*KEY)


def dropped(masks: DataFrame, kept: DataFrame) -> DataFrame:
    """(image_id, labels): what ``kept`` left out, sorted; one row per image that lost any."""
    gone = masks.select(*KEY).distinct().join(kept.select(*KEY).distinct(), KEY, "left_anti")
    return gone.groupBy("image_id").agg(F.sort_array(F.collect_list("label")).alias("labels"))


def border_then_area(masks: DataFrame, margin: int, height: int, width: int, low: int | None, high: int | None) -> DataFrame:
    """Both filters, the border's first."""
    clear = keep_labels(masks, by_border(masks, margin, height, width)) if margin else masks
    return keep_labels(clear, by_area(clear, low, high))


def setting(given: Column, params: Column, key: str, default: Column) -> Column:
    """A setting from a map of what was given, if that names it (even with null), else from the pipeline's, else the default."""
    named = lambda m: F.coalesce(F.map_contains_key(m, key), F.lit(False))
    return F.when(named(given), F.try_element_at(given, F.lit(key))).when(named(params), F.try_element_at(params, F.lit(key))).otherwise(default)


def finite(value: Column) -> Column:
    """Null instead of NaN and the infinities."""
    return F.when(~(F.isnan(value) | (F.abs(value) == float("inf"))), value)
