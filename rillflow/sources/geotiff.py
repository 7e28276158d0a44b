"""A GeoTIFF codec in NumPy and its Spark source and sink.

Reads the first band of classic TIFF files: strips or tiles, uncompressed or deflated, integers and floats of 8 to 64
bits, horizontal or no predictor; writes one uncompressed Float32 or Float64 band. Georeference tags are kept verbatim.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# TIFF field types (bytes and struct letters) and tags.
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT = 317, 322, 323, 324, 325, 339
SCALE, TIEPOINT, MATRIX, GEO_KEYS, GEO_DOUBLES, GEO_ASCII, NODATA = 33550, 33922, 34264, 34735, 34736, 34737, 42113


@dataclass
class Raster:
    values: np.ndarray
    gt: tuple[float, ...] = (0.0, 1.0, 0.0, 0.0, 0.0, -1.0)
    projection: str = ""
    nodata: float | None = None
    geo_keys: tuple[int, ...] = ()
    geo_doubles: tuple[float, ...] = ()


def decode(data: bytes) -> Raster:
    end = {b"II": "<", b"MM": ">"}.get(data[:2])
    if end is None or struct.unpack_from(end + "H", data, 2)[0] != 42:
        raise ValueError("not a classic TIFF file")
    at = struct.unpack_from(end + "I", data, 4)[0]
    tags: dict[int, tuple] = {}
    for k in range(struct.unpack_from(end + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(end + "HHI", data, at + 2 + 12 * k)
        if kind not in TYPES:
            continue
        size, letter = TYPES[kind]
        where = at + 10 + 12 * k if size * n <= 4 else struct.unpack_from(end + "I", data, at + 10 + 12 * k)[0]
        tags[tag] = (data[where:where + n],) if kind == 2 else struct.unpack_from(f"{end}{n * len(letter)}{letter[0]}", data, where)
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    nx, ny, bands, planar = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(PLANAR, 1)
    if one(COMPRESSION, 1) not in (1, 8, 32946):
        raise ValueError(f"compression {one(COMPRESSION)} is not read")
    kind = np.dtype(f"{end}{ {1: 'u', 2: 'i', 3: 'f'}[one(FORMAT, 1)] }{one(BITS, 8) // 8}")
    tiled = TILES in tags
    w, h = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (nx, min(one(STRIP_ROWS, ny), ny))
    across = -(-nx // w)
    places, sizes = (tags[TILES], tags[TILE_BYTES]) if tiled else (tags[STRIPS], tags[STRIP_BYTES])
    per = bands if planar == 1 else 1
    out = np.empty((ny, nx), kind.newbyteorder("="))
    for k in range(across * -(-ny // h)):
        raw = data[places[k]:places[k] + sizes[k]]
        raw = raw if one(COMPRESSION, 1) == 1 else zlib.decompress(raw)
        y, x = k // across * h, k % across * w
        rows = h if tiled else min(h, ny - y)
        part = np.frombuffer(raw, kind, rows * w * per).reshape(rows, w, per)
        if one(PREDICTOR, 1) == 2:
            part = np.cumsum(part, axis=1, dtype=kind.newbyteorder("="))
        elif one(PREDICTOR, 1) != 1:
            raise ValueError("floating-point predictors are not read")
        out[y:y + rows, x:x + w] = part[:ny - y, :nx - x, 0]
    gt = (0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    if MATRIX in tags:
        m = tags[MATRIX]
        gt = (m[3], m[0], m[1], m[7], m[4], m[5])
    elif SCALE in tags and TIEPOINT in tags:
        (sx, sy), t = tags[SCALE][:2], tags[TIEPOINT]
        gt = (t[3] - t[0] * sx, sx, 0.0, t[4] + t[1] * sy, 0.0, -sy)
    text = lambda tag: tags[tag][0].split(b"\0")[0].decode("latin-1") if tag in tags else ""
    nodata = text(NODATA).strip()
    return Raster(out, tuple(map(float, gt)), text(GEO_ASCII), float(nodata) if nodata else None, tags.get(GEO_KEYS, ()), tags.get(GEO_DOUBLES, ()))


def encode(r: Raster, double: bool = False) -> bytes:
    a = np.ascontiguousarray(r.values, "<f8" if double else "<f4")
    ny, nx = a.shape
    rows = max(1, (1 << 16) // max(1, nx * a.itemsize))
    n = -(-ny // rows)
    sizes = [len(a[k * rows:(k + 1) * rows].tobytes()) for k in range(n)]
    fields: list[tuple[int, int, list]] = [
        (WIDTH, 4, [nx]), (HEIGHT, 4, [ny]), (BITS, 3, [a.itemsize * 8]), (COMPRESSION, 3, [1]), (PHOTOMETRIC, 3, [1]), (STRIPS, 4, [0] * n), (SAMPLES, 3, [1]),
        (STRIP_ROWS, 4, [rows]), (STRIP_BYTES, 4, sizes), (PLANAR, 3, [1]), (FORMAT, 3, [3])]
    if r.gt[2] or r.gt[4]:
        fields.append((MATRIX, 12, [r.gt[1], r.gt[2], 0, r.gt[0], r.gt[4], r.gt[5], 0, r.gt[3], 0, 0, 0, 0, 0, 0, 0, 1]))
    else:
        fields += [(SCALE, 12, [r.gt[1], -r.gt[5], 0.0]), (TIEPOINT, 12, [0.0, 0.0, 0.0, r.gt[0], r.gt[3], 0.0])]
    if r.geo_keys:
        fields.append((GEO_KEYS, 3, list(r.geo_keys)))
    if r.geo_doubles:
        fields.append((GEO_DOUBLES, 12, list(r.geo_doubles)))
    if r.projection:
        fields.append((GEO_ASCII, 2, [r.projection.encode("latin-1") + b"\0"]))
    if r.nodata is not None:
        fields.append((NODATA, 2, [f"{r.nodata:.17g}".encode() + b"\0"]))
    fields.sort(key=lambda f: f[0])

    def body(kind: int, v: list) -> tuple[int, bytes]:
        return (len(v[0]), v[0]) if kind == 2 else (len(v), struct.pack(f"<{len(v)}{TYPES[kind][1]}", *v))

    head = 8 + 2 + 12 * len(fields) + 4
    extra = sum(-(-len(b) // 2) * 2 for _, k, v in fields for _, b in [body(k, v)] if len(b) > 4)
    start = head + extra
    fields = [(t, k, [start + sum(sizes[:i]) for i in range(n)] if t == STRIPS else v) for t, k, v in fields]
    out, later, at = [struct.pack("<2sHIH", b"II", 42, 8, len(fields))], [], head
    for tag, kind, v in fields:
        count, b = body(kind, v)
        if len(b) <= 4:
            out.append(struct.pack("<HHI4s", tag, kind, count, b))
        else:
            out.append(struct.pack("<HHII", tag, kind, count, at))
            b += b"\0" * (len(b) % 2)
            later.append(b)
            at += len(b)
    return b"".join([*out, struct.pack("<I", 0), *later, a.tobytes()])


CELLS = "raster_id string, y int, x int, z double, ny int, nx int"
META = "raster_id string, ny int, nx int, gt array<double>, projection string, nodata double"


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def read_cells(spark: SparkSession, path: str, rows: int = 1024) -> DataFrame:
    """The cells of every file at ``path`` (a file, a folder's *.tif or a glob); raster_id is the file's name. A task decodes one file at a time."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for b in batches:
            for p, data in zip(b["path"], b["content"]):
                r = decode(data)
                ny, nx = r.values.shape
                for y in range(0, ny, rows):
                    part = r.values[y:y + rows].astype(float)
                    part = np.where(part == r.nodata, np.nan, part) if r.nodata is not None else part
                    yield pd.DataFrame({"raster_id": _name(p), "y": np.repeat(np.arange(y, y + len(part), dtype=np.int32), nx), "x": np.tile(np.arange(nx, dtype=np.int32), len(part)),
                                        "z": part.ravel(), "ny": np.int32(ny), "nx": np.int32(nx)})

    return files.mapInPandas(run, CELLS).withColumn("z", F.when(~F.isnan("z"), F.col("z")))


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    def run(batches):
        for b in batches:
            got = [(p, decode(d)) for p, d in zip(b["path"], b["content"])]
            yield pd.DataFrame([(_name(p), *r.values.shape, list(r.gt), r.projection, r.nodata) for p, r in got], columns=["raster_id", "ny", "nx", "gt", "projection", "nodata"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, META)


def encoded(cells: DataFrame, c: str = "z", gt: tuple[float, ...] = (0.0, 1.0, 0.0, 0.0, 0.0, -1.0), projection: str = "") -> DataFrame:
    """raster_id, content: one GeoTIFF a raster, NULL as NaN. A raster is held by one task, as its file is."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        a = np.full((int(part["ny"].iloc[0]), int(part["nx"].iloc[0])), np.nan)
        a[part["y"], part["x"]] = part[c].to_numpy(dtype=float, na_value=np.nan)
        return pd.DataFrame({"raster_id": [part["raster_id"].iloc[0]], "content": [encode(Raster(a, gt, projection))]})

    return cells.select("raster_id", "y", "x", F.col(c).cast("double").alias(c), "ny", "nx").groupBy("raster_id").applyInPandas(run, "raster_id string, content binary")


def write(cells: DataFrame, folder: str, c: str = "z", **reference) -> None:
    """Write <folder>/<raster_id>.tif for every raster; folder is on a file system that all workers mount."""
    def save(rows):
        import os

        os.makedirs(folder, exist_ok=True)
        for r in rows:
            with open(f"{folder}/.{r.raster_id}.part", "wb") as f:
                f.write(bytes(r.content))
            os.replace(f"{folder}/.{r.raster_id}.part", f"{folder}/{r.raster_id}.tif")

    encoded(cells, c, **reference).foreachPartition(save)
