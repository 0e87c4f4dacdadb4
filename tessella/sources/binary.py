"""Binary files: flex spectra and grey raster channels."""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_fields(text: bytes) -> dict[str, str]:
    """The ##$NAME= <value> lines of an acquisition file; a repeated name raises."""
    out: dict[str, str] = {}
    for line in text.decode("utf-8", "replace").replace("\r", "\n").split("\n"):
        if line.startswith("##$") and "=" in line:
            name, value = line[3:].split("=", 1)
            if name in out:
                raise ValueError(f"{name} appears more than once")
            value = value.strip()
            out[name] = value.removeprefix("<").removesuffix(">").strip()
    return out


def flex_spectrum(acqu: bytes, fid: bytes) -> tuple[np.ndarray, np.ndarray]:
    """m/z and counts of one time-of-flight acquisition; negative counts are zero.

    tof = ML2 + sqrt(1e12 / ML1) sqrt(m) + ML3 m is solved for m. High-precision and two-part
    calibrations, LIFT and other than time-of-flight spectra raise, as does a wrong size.
    """
    own = parse_fields(acqu)

    def number(name: str) -> float:
        value = float(own[name].replace(",", ".")) if name in own else math.nan
        if not math.isfinite(value):
            raise ValueError(f"{name} is missing or not a finite number")
        return value

    on = lambda name: name in own and number(name) != 0
    if own.get("HPClUse") == "yes" and all(number(n) > 0 for n in ("HPClBLo", "HPClBHi", "HPClOrd")):
        raise ValueError("high-precision calibration isn't supported")
    if "V1.0CTOF2CalibrationConstants" in own.get("NTBCal", ""):
        raise ValueError("two-part calibration isn't supported")
    if (on("Lift1") and on("Lift2")) or on("TLift") or own.get("SPType", "0") != "0":
        raise ValueError("only plain time-of-flight spectra are read")
    n, step, ml1, ml2, ml3 = int(number("TD")), number("DW"), number("ML1"), number("ML2"), number("ML3")
    if step <= 0 or ml1 <= 0 or number("NoSHOTS") <= 0:
        raise ValueError("DW, ML1 and NoSHOTS must be positive")
    if len(fid) != 4 * n:
        raise ValueError(f"{len(fid)} bytes for {n} points")
    counts = np.frombuffer(fid, "<i4" if number("BYTORDA") == 0 else ">i4")
    b, c = math.sqrt(1e12 / ml1), ml2 - (number("DELAY") + np.arange(n) * step)
    root = -2 * c / (b + np.sqrt(b * b - 4 * ml3 * c))
    return root * root, np.maximum(counts, 0).astype(float)


def read_flex(spark: SparkSession, path: str) -> DataFrame:
    """All acquisitions below a folder, each a folder with `acqu` and `fid`: folder, point, mz, intensity."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    files = files.where(name.isin("acqu", "fid")).withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
    both = files.groupBy("folder").agg(F.max(F.when(name == "acqu", F.col("content"))).alias("acqu"), F.max(F.when(name == "fid", F.col("content"))).alias("fid"))

    def run(it):
        for pdf in it:
            for folder, acqu, fid in zip(pdf["folder"], pdf["acqu"], pdf["fid"]):
                if acqu is None or fid is None:
                    raise ValueError(f"{folder} lacks acqu or fid")
                mz, intensity = flex_spectrum(bytes(acqu), bytes(fid))
                yield pd.DataFrame({"folder": folder, "point": np.arange(len(mz)), "mz": mz, "intensity": intensity})

    return both.mapInPandas(run, "folder string, point long, mz double, intensity double")


def grey_png(data: bytes) -> np.ndarray:
    """Rows of an 8- or 16-bit grey PNG that isn't interlaced; any other one raises."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG file")
    at, packed, head = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a chunk is damaged")
        head, packed = (struct.unpack(">IIBBBBB", body) if kind == b"IHDR" else head), packed + (body if kind == b"IDAT" else b"")
        at += 12 + size
    if head is None or head[2] not in (8, 16) or head[3] != 0 or head[6] != 0:
        raise ValueError("only plain grey PNGs of 8 or 16 bits are read")
    width, height, wide = head[0], head[1], head[2] // 8
    raw, line = np.frombuffer(zlib.decompress(packed), np.uint8), width * wide
    raw = raw.reshape(height, line + 1)
    out, above = np.zeros((height, line), np.uint8), np.zeros(line, np.int64)
    for y in range(height):
        rule, row = raw[y, 0], raw[y, 1:].astype(np.int64)
        if rule == 2:
            row = (row + above) & 255
        elif rule == 1:
            row = np.cumsum(row.reshape(-1, wide), axis=0).reshape(-1) & 255
        elif rule in (3, 4):
            for x in range(line):
                left, up, corner = (row[x - wide] if x >= wide else 0), above[x], (above[x - wide] if x >= wide else 0)
                if rule == 3:
                    row[x] = (row[x] + (left + up) // 2) & 255
                else:
                    p = left + up - corner
                    gaps = abs(p - left), abs(p - up), abs(p - corner)
                    row[x] = (row[x] + (left if gaps[0] <= gaps[1] and gaps[0] <= gaps[2] else up if gaps[1] <= gaps[2] else corner)) & 255
        elif rule:
            raise ValueError(f"unknown filter {rule}")
        out[y], above = row, row
    return out if wide == 1 else out.reshape(height, width, 2).astype(np.uint16) @ np.array([256, 1], np.uint16)


def iso_threshold(values: np.ndarray) -> float:
    """The threshold halfway between the means of what is at or below it and what is above, by steps
    from the overall mean; a constant channel's own value."""
    t = float(values.mean())
    for _ in range(1000):
        low, high = values[values <= t], values[values > t]
        if not len(low) or not len(high):
            return t
        new = (float(low.mean()) + float(high.mean())) / 2
        if abs(new - t) < 0.5:
            return new
        t = new
    return t


def sample_channel(cells: DataFrame, path: str, pixel: float, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """cells(image, idx, x, y) with `level`, the grey level at each centroid of the PNG <path>/<image>
    (null outside), and `positive`, whether it is above the image's own threshold."""
    spark = cells.sparkSession
    images = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("image"), "content")
    kind = cells.schema["image"].dataType.simpleString()

    def run(key, own: pd.DataFrame, file: pd.DataFrame) -> pd.DataFrame:
        out = own[["image", "idx"]].copy()
        if not len(file) or not len(own):
            return out.assign(level=np.nan, positive=None)
        raster = grey_png(bytes(file["content"].iloc[0]))
        x, y = (np.floor((own[c].to_numpy(float) - o) / pixel) for c, o in zip(("x", "y"), origin))
        held = (x >= 0) & (y >= 0) & (x < raster.shape[1]) & (y < raster.shape[0])
        level = np.full(len(own), np.nan)
        level[held] = raster[y[held].astype(int), x[held].astype(int)]
        cut = iso_threshold(raster.astype(float).ravel())
        return out.assign(level=level, positive=[bool(v > cut) if h else None for v, h in zip(level, held)])

    got = cells.groupBy("image").cogroup(images.groupBy("image")).applyInPandas(run, f"image {kind}, idx long, level double, positive boolean")
    return got.withColumn("level", F.when(~F.isnan("level"), F.col("level")))
