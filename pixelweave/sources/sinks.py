"""What the pipelines write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpoint(masks: DataFrame, raw: DataFrame, facts: dict, path: str) -> None:
    """Labels before and after filtering as Parquet by image, and one row of JSON with settings and digests."""
    for name, rows in (("masks", masks), ("raw_masks", raw)):
        rows.write.mode("overwrite").partitionBy("image_id").parquet(f"{path}/{name}")
    spark = masks.sparkSession
    values = {k: str(v) for k, v in sorted(facts.items())}
    spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).coalesce(1).write.mode("overwrite").json(f"{path}/detection")


def points_name(path: str, kind: str) -> str:
    """The name of a population's reduced table, from that of its objects."""
    stem = path.rsplit("/", 1)[-1].removesuffix(".csv").removesuffix("_objects")
    return f"{stem}_{kind}.csv"


def points(df: DataFrame, path: str) -> None:
    """id and coordinates as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)
