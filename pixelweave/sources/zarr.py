"""Chunked arrays of OME-Zarr stores, versions 2 and 3, in numpy; only the chunks of a selection are read."""

from __future__ import annotations

import gzip
import itertools
import json
import zlib
from collections.abc import Callable

import numpy as np


class Missing(ValueError):
    """A folder that isn't an image; says what is below it."""


class Store:
    """Files below a folder through ``read(path) -> bytes or None`` and, to help with errors, ``names() -> paths``."""

    def __init__(self, read: Callable[[str], bytes | None], names: Callable[[], list[str]] = list):
        self.read, self.names = read, names
        self.loads = 0
        self.attributes = self._attributes("")
        ome = self.attributes.get("ome", self.attributes)
        scales = ome.get("multiscales")
        if not scales:
            kinds = [k for k in ("plate", "well", "bioformats2raw.layout") if k in ome]
            below = sorted({n.rsplit("/", 1)[0] for n in names() if n.endswith((".zattrs", "zarr.json")) and "/" in n})
            raise Missing(f"{' / '.join(kinds) or 'the folder'} holds no image itself; positions below: {below[:8]}")
        self.axes = [(a if isinstance(a, str) else a["name"]) for a in scales[0].get("axes", ["t", "c", "z", "y", "x"])]
        self.units = {a["name"]: a.get("unit") for a in scales[0].get("axes", []) if isinstance(a, dict)}
        self.levels = [d["path"] for d in scales[0]["datasets"]]
        self.scales = [next((t["scale"] for t in d.get("coordinateTransformations", []) if t["type"] == "scale"), None) for d in scales[0]["datasets"]]
        self.channels = [c.get("label", "") for c in ome.get("omero", {}).get("channels", [])]

    def _json(self, path: str) -> dict:
        data = self.read(path)
        return json.loads(data) if data else {}

    def _attributes(self, path: str) -> dict:
        pre = f"{path}/" if path else ""
        return self._json(f"{pre}.zattrs") or self._json(f"{pre}zarr.json").get("attributes", {})

    def level(self, wanted: int | str = 0) -> str:
        """A level by its place from the finest, counted from the end if negative, or by its name."""
        text = str(wanted)
        if text.lstrip("-").isdigit() and -len(self.levels) <= int(text) < len(self.levels):
            return self.levels[int(text)]
        if text in self.levels:
            return text
        raise ValueError(f"no level {wanted}; there are {self.levels}")

    def array(self, level: int | str = 0) -> Array:
        path = self.level(level)
        return Array(self, path, self._json(f"{path}/.zarray"), self._json(f"{path}/zarr.json"))


class Array:
    def __init__(self, store: Store, path: str, v2: dict, v3: dict):
        self.store, self.path = store, path
        if v2:
            self.shape, self.chunks, self.kind, self.fill = tuple(v2["shape"]), tuple(v2["chunks"]), np.dtype(v2["dtype"]), v2.get("fill_value") or 0
            self.codecs = [v2["compressor"]["id"]] if v2.get("compressor") else []
            self.prefix, self.between = "", v2.get("dimension_separator", ".")
        elif v3:
            self.shape, self.chunks = tuple(v3["shape"]), tuple(v3["chunk_grid"]["configuration"]["chunk_shape"])
            self.fill, codecs = v3.get("fill_value") or 0, v3["codecs"]
            little = next((c.get("configuration", {}).get("endian", "little") == "little" for c in codecs if c["name"] == "bytes"), True)
            self.kind = np.dtype(v3["data_type"]).newbyteorder("<" if little else ">")
            self.codecs = [c["name"] for c in codecs if c["name"] != "bytes"]
            key = v3.get("chunk_key_encoding", {"name": "default"})
            self.between = key.get("configuration", {}).get("separator", "/")
            self.prefix = f"c{self.between}" if key["name"] == "default" else ""
        else:
            raise Missing(f"no array at {path}")

    def _chunk(self, at: tuple[int, ...]) -> np.ndarray:
        data = self.store.read(f"{self.path}/{self.prefix}{self.between.join(map(str, at))}")
        self.store.loads += 1
        if data is None:
            return np.full(self.chunks, self.fill, self.kind)
        for codec in reversed(self.codecs):
            if codec == "zlib":
                data = zlib.decompress(data)
            elif codec == "gzip":
                data = gzip.decompress(data)
            elif codec == "zstd":
                import zstandard

                data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
            elif codec != "crc32c":
                raise ValueError(f"codec {codec} isn't read")
            else:
                data = data[:-4]
        return np.frombuffer(data, self.kind).reshape(self.chunks)

    def read(self, where: tuple[slice, ...]) -> np.ndarray:
        """The values of a box."""
        box = [s.indices(n)[:2] for s, n in zip(where, self.shape)]
        out = np.zeros([b - a for a, b in box], self.kind)
        for at in itertools.product(*[range(a // c, -(-b // c)) for (a, b), c in zip(box, self.chunks)]):
            part, source, target = self._chunk(at), [], []
            for i, ((a, b), c) in enumerate(zip(box, self.chunks)):
                low, high = max(a, at[i] * c), min(b, (at[i] + 1) * c)
                source.append(slice(low - at[i] * c, high - at[i] * c))
                target.append(slice(low - a, high - a))
            out[tuple(target)] = part[tuple(source)]
        return out
