"""A Spark data source of image planes: format "image_planes".

Options: path (a TIFF file, or an OME-Zarr folder), level, series. One row per pixel: (image_id, t, ch, z, r, c, v). A partition is one plane, and filters that
fix t, ch or z leave out the partitions of other planes before anything is read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from pixelweave.sources.tiff import Tiff, ome_series, series_index
from pixelweave.sources.zarr import Store

SCHEMA = "image_id string, t int, ch int, z int, r int, c int, v double"


def is_zarr(path: str) -> bool:
    return os.path.isdir(path) and any(os.path.exists(f"{path}/{n}") for n in ("zarr.json", ".zattrs"))


def is_tiff(path: str) -> bool:
    return path.lower().endswith((".tif", ".tiff"))


def open_store(path: str) -> Store:
    def read(name: str) -> bytes | None:
        try:
            with open(os.path.join(path, name), "rb") as f:
                return f.read()
        except (FileNotFoundError, IsADirectoryError, NotADirectoryError):
            return None

    return Store(read, lambda: [os.path.relpath(os.path.join(d, f), path) for d, _, files in os.walk(path) for f in files])


def open_tiff(path: str) -> Tiff:
    def read(at: int, size: int) -> bytes:
        with open(path, "rb") as f:
            f.seek(at)
            return f.read(size)

    return Tiff(read)


def page_of(info: dict, first: int, t: int, c: int, z: int) -> int:
    """Number of a plane's page, by the order of axes that the description names."""
    at, step = first, 1
    for axis in info["order"][2:].lower():
        at += {"t": t, "c": c, "z": z}[axis] * step
        step *= info[f"size_{axis}"]
    return at


class Plane(InputPartition):
    def __init__(self, t: int, ch: int, z: int):
        self.t, self.ch, self.z = t, ch, z


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.level, self.series = options["path"], options.get("level", "0"), options.get("series")
        self.fixed: dict[str, int] = {}
        if is_zarr(self.path):
            store = open_store(self.path)
            shape = dict(zip(store.axes, store.array(self.level).shape))
            if shape.get("s", 1) > 1:
                raise ValueError("several samples a pixel aren't read")
            self.sizes = {"t": shape.get("t", 1), "ch": shape.get("c", 1), "z": shape.get("z", 1)}
        elif is_tiff(self.path):
            tiff = open_tiff(self.path)
            series = ome_series(tiff.description())
            if series:
                info = series[series_index(series, self.series)]
                self.sizes = {"t": info["size_t"], "ch": info["size_c"], "z": info["size_z"]}
            else:
                self.sizes = {"t": 1, "ch": 1, "z": len(tiff.pages)}
        else:
            raise ValueError(f"{self.path} is neither an OME-Zarr folder nor a TIFF file")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in self.sizes and f.value is not None:
                self.fixed[f.attribute[0]] = int(f.value)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        ways = [[self.fixed[k]] if k in self.fixed else range(n) for k, n in self.sizes.items()]
        return [Plane(t, ch, z) for t in ways[0] for ch in ways[1] for z in ways[2] if t < self.sizes["t"] and ch < self.sizes["ch"] and z < self.sizes["z"] and min(t, ch, z) >= 0]

    def load(self, p: Plane) -> np.ndarray:
        if is_zarr(self.path):
            store = open_store(self.path)
            at = {"t": p.t, "c": p.ch, "z": p.z}
            where = tuple(slice(None) if a in "yx" else slice(at.get(a, 0), at.get(a, 0) + 1) for a in store.axes)
            data = store.array(self.level).read(where)
            return data.reshape(data.shape[store.axes.index("y")], data.shape[store.axes.index("x")])
        tiff = open_tiff(self.path)
        series = ome_series(tiff.description())
        if not series:
            return tiff.plane(p.z)
        k = series_index(series, self.series)
        first = sum(s["size_t"] * s["size_c"] * s["size_z"] for s in series[:k])
        return tiff.plane(page_of(series[k], first, p.t, p.ch, p.z))

    def read(self, partition: Plane) -> Iterator[pa.RecordBatch]:
        data = self.load(partition)
        h, w = data.shape
        step = max(1, 65_536 // max(1, w))
        name = os.path.basename(self.path.rstrip("/"))
        for top in range(0, h, step):
            part = data[top : top + step]
            n = part.size
            r, c = np.divmod(np.arange(n, dtype=np.int32), w)
            ints = [np.full(n, x, np.int32) for x in (partition.t, partition.ch, partition.z)]
            columns = [pa.array([name] * n), *map(pa.array, ints), pa.array((r + top).astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(part.reshape(-1).astype(np.float64))]
            yield pa.RecordBatch.from_arrays(columns, names=["image_id", "t", "ch", "z", "r", "c", "v"])


class ImagePlanes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "image_planes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets it push filters down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ImagePlanes)


def heights(origin: float | None, spacing: float | None, planes: int) -> list[float] | None:
    """Height of every plane, from where the first is and how far they are apart."""
    return None if spacing is None else [(origin or 0.0) + i * spacing for i in range(planes)]


def digest(path: str) -> str:
    """SHA-256 of a file's bytes, or of a folder's files in order of their paths: name, a zero byte, contents."""
    from hashlib import sha256

    total = sha256()
    if os.path.isdir(path):
        for name in sorted(os.path.relpath(os.path.join(d, f), path) for d, _, files in os.walk(path) for f in files):
            total.update(name.encode() + b"\0")
            with open(os.path.join(path, name), "rb") as f:
                for block in iter(lambda: f.read(1 << 20), b""):
                    total.update(block)
        return total.hexdigest()
    with open(path, "rb") as f:
        for block in iter(lambda: f.read(1 << 20), b""):
            total.update(block)
    return total.hexdigest()
