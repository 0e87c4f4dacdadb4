"""Spectra as text, arrays in NPY files, and circles as GeoJSON."""

from __future__ import annotations

import ast
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_spectra(spark: SparkSession, path: str) -> DataFrame:
    """Two-column text spectra: file, line, mz, intensity.

    Empty lines and those that start with # are skipped, as is a first line of names; a line that
    has no two numbers raises. Axes that don't increase are found by `unordered_spectra`.
    """
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    rows = rows.where("trim(text) <> '' and not startswith(trim(text), '#')").withColumn("part", F.split(F.trim("text"), r"[\s,;]+"))
    first = rows.groupBy("file").agg(F.min("line").alias("first"))
    number = lambda k: F.try_element_at("part", F.lit(k)).try_cast("double")
    rows = rows.join(first, "file").withColumn("mz", number(1)).withColumn("intensity", number(2))
    rows = rows.where(~((F.col("line") == F.col("first")) & F.col("mz").isNull()))
    bad = F.raise_error(F.concat(F.lit("no two numbers in line "), (F.col("line") + 1).cast("string"), F.lit(" of "), F.col("file"))).cast("double")
    good = F.col("mz").isNotNull() & F.col("intensity").isNotNull()
    return rows.select("file", (F.col("line") + 1).alias("line"), F.when(good, F.col("mz")).otherwise(bad).alias("mz"), "intensity")


def unordered_spectra(spectra: DataFrame) -> DataFrame:
    """Files whose m/z doesn't strictly increase, with the first such line."""
    from pyspark.sql.window import Window

    before = F.lag("mz").over(Window.partitionBy("file").orderBy("line"))
    return spectra.withColumn("before", before).where("mz <= before").groupBy("file").agg(F.min("line").alias("line"))


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """Two-dimensional float32 NPY files of versions 1 and 2, row-major: file, row, embedding."""

    def run(it):
        for pdf in it:
            for file, data in zip(pdf["path"], pdf["content"]):
                if data[:6] != b"\x93NUMPY" or data[6] not in (1, 2):
                    raise ValueError(f"{file} is no NPY file of version 1 or 2")
                at = 10 if data[6] == 1 else 12
                size = int.from_bytes(data[8:at], "little")
                head = ast.literal_eval(data[at : at + size].decode("latin-1"))
                if head["descr"] != "<f4" or head["fortran_order"] or len(head["shape"]) != 2:
                    raise ValueError(f"{file} holds no row-major matrix of float32")
                values = np.frombuffer(data, "<f4", math.prod(head["shape"]), at + size).reshape(head["shape"])
                for s in range(0, len(values), 4096):
                    yield pd.DataFrame({"file": file, "row": np.arange(s, min(s + 4096, len(values))), "embedding": list(values[s : s + 4096])})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, row long, embedding array<float>")


def circles(territories: DataFrame, radius: str, corners: int = 32) -> DataFrame:
    """GeoJSON features (a `value` column of text) of regular polygons around cx, cy; every column is a property."""
    at = [(math.cos(2 * math.pi * k / corners), math.sin(2 * math.pi * k / corners)) for k in [*range(corners), 0]]
    ring = F.array(*[F.array(F.col("cx") + F.col(radius) * a, F.col("cy") + F.col(radius) * b) for a, b in at])
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return territories.select(F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(*territories.columns).alias("properties"))).alias("value"))
