"""Objects from pixels in one go: make smaller, detect, make larger again, drop by border and by area; detections are kept by their settings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.operators import filters, kernels, resample, table

#: What a kept detection holds.
RAW = "image_id long, r int, c int, label int"


@dataclass(frozen=True)
class Detection:
    """masks(image_id, r, c, label) after filters, the labels that they dropped per image, all masks, and the settings' identity."""

    masks: DataFrame
    dropped: DataFrame
    raw: DataFrame
    identity: str
    reused: bool

    def counts(self) -> DataFrame:
        """(image_id, n_raw_objects, n_objects) of images with any object."""
        number = lambda df, name: df.groupBy("image_id").agg(F.count_distinct("label").alias(name))
        both = number(self.raw, "n_raw_objects").join(number(self.masks, "n_objects"), "image_id", "left")
        return both.select("image_id", "n_raw_objects", F.coalesce("n_objects", F.lit(0)).alias("n_objects"))


def _kept(pixels: DataFrame, place: str) -> DataFrame | None:
    try:
        return pixels.sparkSession.read.schema(RAW).parquet(place)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def detected(
    pixels: DataFrame, height: int, width: int, settings: dict, find: Callable = kernels.find_nuclei, border: int | None = None, area: tuple[int | None, int | None] = (None, None), folder: str | None = None
) -> Detection:
    """Objects of every image(image_id, r, c, v) of a size.

    ``settings`` may hold segmentation_binning (images are averaged over squares of so many pixels before detection, labels are made larger again by their
    nearest pixel), diameter in pixels of the whole image, threshold, and what else a detector takes. Border first, then area: what an edge cuts
    looks smaller than it is. With a folder, masks before filters are kept there under the identity of the settings, and found again by it: filters aren't part
    of it, so they may change without another detection.
    """
    identity = table.identity(settings)
    place = f"{folder}/{identity}" if folder else None
    raw = _kept(pixels, place) if place else None
    reused = raw is not None
    if raw is None:
        binning = int(settings.get("segmentation_binning") or 1)
        given = {k: v for k, v in settings.items() if k in ("diameter", "threshold") and v is not None}
        small = (max(1, round(height / binning)), max(1, round(width / binning)))
        own = pixels
        if binning > 1:
            given["diameter"] = given["diameter"] / binning if "diameter" in given else None
            own = resample.box_downsample(pixels, height, width, binning)
        raw = kernels.segment(own, find, **{k: v for k, v in given.items() if v is not None})
        if binning > 1:
            raw = resample.nearest_upsample(raw, small, (height, width))
        raw = raw.select(F.col("image_id").cast("long"), F.col("r").cast("int"), F.col("c").cast("int"), F.col("label").cast("int"))
        if place:
            raw.write.mode("overwrite").parquet(place)
            raw = pixels.sparkSession.read.schema(RAW).parquet(place)
    masks = raw
    if border:
        masks = filters.keep_labels(masks, filters.by_border(masks, border, height, width))
    if area != (None, None):
        masks = filters.keep_labels(masks, filters.by_area(masks, *area))
    return Detection(masks, filters.dropped(raw, masks.select("image_id", "label").distinct()), raw, identity, reused)
