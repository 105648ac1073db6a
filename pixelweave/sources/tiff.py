"""TIFF pages in numpy: strips or tiles, uncompressed or deflated, with the OME description if there is one."""

from __future__ import annotations

import struct
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Callable

import numpy as np

#: Fixed tags and sizes of field types.
WIDTH, HEIGHT, BITS, COMPRESSION, DESCRIPTION, OFFSETS, SAMPLES, ROWS, COUNTS, PREDICTOR, TILE_W, TILE_H, TILE_OFFSETS, TILE_COUNTS, FORMAT = (
    256, 257, 258, 259, 270, 273, 277, 278, 279, 317, 322, 323, 324, 325, 339,
)
SIZES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 13: ("I", 4), 16: ("Q", 8), 17: ("q", 8), 18: ("Q", 8)}


class Tiff:
    """The pages of a file that ``read(offset, size)`` gives the bytes of; each page's pixels are read when asked for."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        head = read(0, 16)
        if head[:2] not in (b"II", b"MM"):
            raise ValueError("not a TIFF file")
        self.order = "<" if head[:2] == b"II" else ">"
        magic = struct.unpack(self.order + "H", head[2:4])[0]
        if magic not in (42, 43):
            raise ValueError("not a TIFF file")
        self.big = magic == 43
        at = struct.unpack(self.order + ("Q" if self.big else "I"), head[8:16] if self.big else head[4:8])[0]
        self.pages: list[dict[int, tuple]] = []
        seen = set()
        while at and at not in seen:
            seen.add(at)
            page, at = self._directory(at)
            self.pages.append(page)

    def _directory(self, at: int) -> tuple[dict[int, tuple], int]:
        wide, entry, word = (8, 20, "Q") if self.big else (2, 12, "I")
        n = struct.unpack(self.order + ("Q" if self.big else "H"), self.read(at, wide))[0]
        block = self.read(at + wide, n * entry + (8 if self.big else 4))
        page = {}
        for i in range(n):
            raw = block[i * entry : (i + 1) * entry]
            tag, kind = struct.unpack(self.order + "HH", raw[:4])
            count = struct.unpack(self.order + word, raw[4 : 4 + (8 if self.big else 4)])[0]
            if kind not in SIZES:
                continue
            code, size = SIZES[kind]
            inline = raw[-(8 if self.big else 4) :]
            data = inline[: size * count] if size * count <= len(inline) else self.read(struct.unpack(self.order + word, inline)[0], size * count)
            page[tag] = (data.rstrip(b"\0"),) if code == "s" else struct.unpack(f"{self.order}{count * len(code)}{code[0]}", data)
        return page, struct.unpack(self.order + word, block[n * entry :])[0]

    def description(self) -> str:
        return self.pages[0].get(DESCRIPTION, (b"",))[0].decode("utf-8", "replace") if self.pages else ""

    def dtype(self, page: dict) -> np.dtype:
        bits, kind = page.get(BITS, (8,))[0], page.get(FORMAT, (1,))[0]
        return np.dtype(f"{self.order}{'u' if kind == 1 else 'i' if kind == 2 else 'f'}{bits // 8}")

    def plane(self, index: int, rows: tuple[int, int] | None = None, columns: tuple[int, int] | None = None) -> np.ndarray:
        """A page's pixels, or a window of them: only the strips and tiles that it touches are decoded."""
        page = self.pages[index]
        h, w, samples = page[HEIGHT][0], page[WIDTH][0], page.get(SAMPLES, (1,))[0]
        if samples > 1:
            raise ValueError("pages with several samples a pixel aren't read")
        (r0, r1), (c0, c1) = rows or (0, h), columns or (0, w)
        kind = self.dtype(page)
        tiled = TILE_OFFSETS in page
        th, tw = (page[TILE_H][0], page[TILE_W][0]) if tiled else (min(h, page.get(ROWS, (h,))[0]), w)
        offsets, counts = (page[TILE_OFFSETS], page[TILE_COUNTS]) if tiled else (page[OFFSETS], page[COUNTS])
        out, across = np.zeros((r1 - r0, c1 - c0), kind), -(-w // tw)
        for i in range(r0 // th, -(-r1 // th)):
            for j in range(c0 // tw, -(-c1 // tw)):
                k = i * across + j
                tall = th if tiled else min(th, h - i * th)
                part = self._decoded(page, self.read(offsets[k], counts[k]), kind, tall, tw)
                y0, y1, x0, x1 = max(r0, i * th), min(r1, i * th + tall, h), max(c0, j * tw), min(c1, (j + 1) * tw, w)
                out[y0 - r0 : y1 - r0, x0 - c0 : x1 - c0] = part[y0 - i * th : y1 - i * th, x0 - j * tw : x1 - j * tw]
        return out

    def _decoded(self, page: dict, data: bytes, kind: np.dtype, h: int, w: int) -> np.ndarray:
        how = page.get(COMPRESSION, (1,))[0]
        if how in (8, 32946):
            data = zlib.decompress(data)
        elif how != 1:
            raise ValueError(f"compression {how} isn't read")
        part = np.frombuffer(data, kind, h * w).reshape(h, w)
        if page.get(PREDICTOR, (1,))[0] == 2:
            part = np.cumsum(part, axis=1, dtype=kind)
        return part


def ome_series(description: str) -> list[dict]:
    """Sizes, order, pixel sizes and channel names of each image of an OME description; none if it can't be read."""
    try:
        root = ET.fromstring(description)
    except ET.ParseError:
        return []
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    out = []
    for image in (e for e in root if local(e) == "Image"):
        for pixels in (e for e in image if local(e) == "Pixels"):
            a = pixels.attrib
            out.append(
                {
                    "name": image.get("Name", ""),
                    "order": a.get("DimensionOrder", "XYZCT"),
                    **{f"size_{x.lower()}": int(a.get(f"Size{x}", 1)) for x in "XYZCT"},
                    **{f"pixel_{x.lower()}": (float(a[f"PhysicalSize{x}"]), a.get(f"PhysicalSize{x}Unit", "µm")) for x in "XYZ" if f"PhysicalSize{x}" in a},
                    "channels": [c.get("Name", "") for c in pixels if local(c) == "Channel"],
                    "origin": next(({x: float(p.get(f"Position{x}")) for x in "XYZ" if p.get(f"Position{x}") is not None} for p in pixels if local(p) == "Plane"), {}),
                }
            )
    return out


def series_index(series: list[dict], wanted: int | str | None) -> int:
    """Which image of a file: by number or name; a file with several needs one."""
    if wanted is None:
        if len(series) > 1:
            raise ValueError(f"the file holds several positions, name one of {[s['name'] for s in series][:8]}")
        return 0
    names = [s["name"] for s in series]
    if str(wanted) in names:
        return names.index(str(wanted))
    if str(wanted).lstrip("-").isdigit() and -len(series) <= int(wanted) < max(1, len(series)):
        return int(wanted) % max(1, len(series))
    raise ValueError(f"no position {wanted}; there are {names[:8]}")


def write(path: str, planes: np.ndarray, description: str = "", tile: int | None = None, deflate: bool = False) -> None:
    """A plain TIFF of planes (n, h, w), for tests and small exports."""
    n, h, w = planes.shape
    kind = planes.dtype.newbyteorder("<")
    body, at, pages = bytearray(), 8, []
    for k in range(n):
        parts = []
        if tile:
            padded = np.pad(planes[k], ((0, -h % tile), (0, -w % tile)))
            parts = [padded[i : i + tile, j : j + tile] for i in range(0, h, tile) for j in range(0, w, tile)]
        else:
            parts = [planes[k]]
        coded = [zlib.compress(p.astype(kind).tobytes()) if deflate else p.astype(kind).tobytes() for p in parts]
        offsets = []
        for c in coded:
            offsets.append(at)
            body += c
            at += len(c)
        pages.append((offsets, [len(c) for c in coded]))
    for k, (offsets, counts) in enumerate(pages):
        fmt = {"u": 1, "i": 2, "f": 3}[kind.kind]
        tags = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [kind.itemsize * 8]), (COMPRESSION, 3, [8 if deflate else 1]), (262, 3, [1]), (SAMPLES, 3, [1]), (FORMAT, 3, [fmt])]
        tags += [(TILE_W, 3, [tile]), (TILE_H, 3, [tile]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tile else [(OFFSETS, 4, offsets), (ROWS, 4, [h]), (COUNTS, 4, counts)]
        text = description.encode() + b"\0" if k == 0 and description else b""
        extra, rows = bytearray(), []
        directory_at = at + (-at % 2)
        body += b"\0" * (directory_at - at)
        m = len(tags) + bool(text)
        spill = directory_at + 2 + 12 * m + 4
        for tag, kind_, values in sorted(tags):
            data = struct.pack(f"<{len(values)}{SIZES[kind_][0]}", *values)
            rows.append((tag, kind_, len(values), data))
        if text:
            rows.append((DESCRIPTION, 2, len(text), text))
        out = bytearray(struct.pack("<H", m))
        for tag, kind_, count, data in sorted(rows):
            if len(data) <= 4:
                out += struct.pack("<HHI", tag, kind_, count) + data.ljust(4, b"\0")
            else:
                out += struct.pack("<HHII", tag, kind_, count, spill + len(extra))
                extra += data
        if k == 0:
            first = directory_at
        after = spill + len(extra)
        after += -after % 2
        out += struct.pack("<I", after if k < n - 1 else 0)
        body += out + extra
        at = 8 + len(body)
    with open(path, "wb") as f:
        f.write(b"II*\0" + struct.pack("<I", first) + body)
