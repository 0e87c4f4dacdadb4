"""Result documents, curve and cell sinks with fixed schemas, requests, manifests and slide exports."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Version of result documents that is read and written.
VERSION = "0.5"
KINDS = ("marked_pattern", "multimodal", "marked_prepost", "multimodal_prepost")

#: Fixed column names and types of the tables that other programs read.
SCHEMAS = {
    "spectra": "k double not null, observed_power double not null, median_permutation_power double not null, whitened_power double not null, lower_global_envelope double, upper_global_envelope double",
    "mark_pair_covariance": "r_min_um double not null, r_max_um double not null, covariance double, lower_global_envelope double, upper_global_envelope double, pair_count long not null",
    "scale_energy": "band string not null, scale_um double not null, energy_fraction double not null, lower_global_envelope double, upper_global_envelope double",
    "fused_cells": "source_section string not null, source_cell_id string not null, x_um_registered double not null, y_um_registered double not null, mmr_mark tinyint, mmr_probability double, cell_type string, cell_type_probability double, same_section boolean not null, registration_error_um double, timepoint string not null, case_id string not null, protein string not null",
    "enrichment": "label_a string not null, label_b string not null, observed_edges long not null, expected_edges double not null, enrichment_ratio double, enrichment_ratio_unavailable_reason string, z_score double, z_score_unavailable_reason string, p_value double, q_value double",
    "cross_curves": "label_a string not null, label_b string not null, r_min_um double not null, r_max_um double not null, value double, lower_global_envelope double, upper_global_envelope double, count long not null, p_global double",
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """df's columns by name and in order, cast to the table's schema; extra ones go, a missing one or a
    null where none may be raises."""
    out = []
    for f in T.StructType.fromDDL(SCHEMAS[table]).fields:
        if f.name not in df.columns:
            raise ValueError(f"{table} lacks {f.name}")
        c = F.col(f.name).cast(f.dataType)
        if not f.nullable:
            c = F.when(c.isNull(), F.raise_error(F.lit(f"{table}.{f.name} is null")).cast(f.dataType)).otherwise(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def write_table(df: DataFrame, table: str, path: str, partition_by: Sequence[str] = ()) -> None:
    """One of SCHEMAS as Parquet; an existing result is an error. Keys that aren't part of the schema
    become partition folders."""
    keys = [F.col(c) for c in partition_by]
    fixed = conform(df, table)
    rows = df.select(*keys, *[F.col(c).cast(t) for c, t in fixed.dtypes]) if partition_by else fixed
    rows.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def write_document(result: DataFrame, kind: str, path: str) -> None:
    """Rows as one tagged JSON document a line: format_version, analysis kind and the row."""
    if kind not in KINDS:
        raise ValueError(f"{kind} is none of {KINDS}")
    row = F.struct(F.lit(kind).alias("kind"), F.struct(*result.columns).alias("result"))
    result.select(F.to_json(F.struct(F.lit(VERSION).alias("format_version"), row.alias("analysis"))).alias("value")).write.mode("errorifexists").text(path)


def read_document(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """The rows of documents of one kind; another version, another kind or malformed text raises."""
    text = spark.read.text(path)
    version, found = F.get_json_object("value", "$.format_version"), F.get_json_object("value", "$.analysis.kind")
    fault = F.when(version.isNull(), "no format_version").when(version != VERSION, F.concat(F.lit("unsupported version "), version)).when(found.isNull() | (found != kind), F.concat(F.lit("not a document of "), F.lit(kind)))
    good = F.when(fault.isNull(), F.col("value")).otherwise(F.raise_error(fault).cast("string"))
    whole = f"format_version string, analysis struct<kind: string, result: struct<{schema}>>"
    return text.select(F.from_json(good, whole, {"mode": "FAILFAST"}).alias("d")).select("d.analysis.result.*")


def write_features(df: DataFrame, path: str, id_col: str, metadata: dict) -> None:
    """A feature table: an id, numeric columns, and metadata that the file's schema carries."""
    wrong = [c for c, t in df.dtypes if c != id_col and t not in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    if wrong:
        raise ValueError(f"not numeric: {wrong}")
    note = {"features": json.dumps(metadata, sort_keys=True)}
    df.select(F.col(id_col).alias(id_col, metadata=note), *[c for c in df.columns if c != id_col]).write.mode("errorifexists").parquet(path)


def read_features(spark: SparkSession, path: str, id_col: str) -> tuple[DataFrame, dict]:
    df = spark.read.parquet(path)
    return df, json.loads(df.schema[id_col].metadata.get("features", "{}"))


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Cells of all files that a CSV manifest (id, cells) names, as one table with pattern_id: runs of
    many slides are one job over it."""
    rows = spark.read.csv(path, header=True, schema="id string, cells string", mode="FAILFAST")
    named = rows.groupBy("cells").agg(F.min("id").alias("pattern_id"), F.count(F.lit(1)).alias("n"))
    files = [r["cells"] for r in named.select("cells").collect()]  # a manifest lists slides
    cells = spark.read.csv(files, header=True, schema=schema, mode="FAILFAST").withColumn("_file", F.input_file_name())
    match = F.endswith(F.col("_file"), F.col("cells"))
    return cells.join(F.broadcast(named), match).drop("_file", "cells", "n")  # a row a slide


def read_sections(spark: SparkSession, he: str, ihc: str) -> DataFrame:
    """H&E classifier exports and stained cells as one table: section, cell_id, x, y, cell_type,
    probability, mark. Malformed rows fail."""
    read = lambda p, s: spark.read.csv(p, header=True, schema=s, mode="FAILFAST", enforceSchema=False)
    a = read(he, "cell_id string, x_centroid_um double, y_centroid_um double, predicted_class string, class_probability double")
    b = read(ihc, "cell_id string, x_um double, y_um double, mmr_mark int, mmr_probability double")
    none = lambda t: F.lit(None).cast(t)
    a = a.select(F.lit("he").alias("section"), "cell_id", F.col("x_centroid_um").alias("x"), F.col("y_centroid_um").alias("y"), F.col("predicted_class").alias("cell_type"), F.col("class_probability").alias("probability"), none("int").alias("mark"))
    return a.unionByName(b.select(F.lit("ihc").alias("section"), "cell_id", F.col("x_um").alias("x"), F.col("y_um").alias("y"), none("string").alias("cell_type"), F.col("mmr_probability").alias("probability"), F.col("mmr_mark").alias("mark")))


def read_request(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A census request of inline specimens -> cells(specimen, idx, x, y, label), groups(specimen,
    factor, level). Anything malformed fails."""
    cell = "array<struct<id: bigint, x_um: double, y_um: double, class: string>>"
    schema = f"source struct<kind: string, specimens: array<struct<id: string, groups: map<string, string>, cells: {cell}>>>"
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("d")).select(F.explode("d.source.specimens").alias("s"))
    cells = doc.select(F.col("s.id").alias("specimen"), F.explode("s.cells").alias("c")).select("specimen", F.col("c.id").alias("idx"), F.col("c.x_um").alias("x"), F.col("c.y_um").alias("y"), F.col("c.class").alias("label"))
    return cells, doc.select(F.col("s.id").alias("specimen"), F.explode("s.groups").alias("factor", "level"))


def read_qupath(spark: SparkSession, path: str) -> DataFrame:
    """Cell detections of a GeoJSON export: idx, x, y (mean of the outline's corners), label. Features
    that aren't polygons are left out."""
    geometry = "struct<type: string, coordinates: array<array<array<double>>>>"
    schema = f"features array<struct<geometry: {geometry}, properties: struct<classification: struct<name: string>>>>"
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("d"))
    f = doc.select(F.posexplode("d.features").alias("idx", "f")).where("f.geometry.type = 'Polygon'")
    ring = F.slice(F.col("f.geometry.coordinates")[0], 1, F.size(F.col("f.geometry.coordinates")[0]) - 1)  # the last corner is the first
    mean = lambda k: F.aggregate(F.transform(ring, lambda p: p[k]), F.lit(0.0), lambda a, v: a + v) / F.size(ring)
    return f.select(F.col("idx").cast("long").alias("idx"), mean(0).alias("x"), mean(1).alias("y"), F.col("f.properties.classification.name").alias("label"))


def read_intensity_pair(spark: SparkSession, intensities: str, regions: str) -> DataFrame:
    """Two CSV tables by object, intensities and regions with centroids, joined one to one: every
    object must be in both."""
    a = spark.read.csv(intensities, header=True, inferSchema=True)
    b = spark.read.csv(regions, header=True, inferSchema=True).withColumnsRenamed({"centroid-1": "x", "centroid-0": "y"})
    both = a.withColumn("_a", F.lit(1)).join(b.select("Object", "x", "y").withColumn("_b", F.lit(1)), "Object", "full")
    one = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.concat(F.lit("object in one table only: "), F.col("Object").cast("string"))).cast("int"))
    return both.withColumn("_one", one).where("_one is null").drop("_a", "_b", "_one")


def embedding_profile(spark: SparkSession, path: str, id_col: str, vector_col: str) -> DataFrame:
    """What a table of vectors holds: rows, distinct ids, null vectors, least and largest dimension,
    values that aren't finite, and a digest of all rows that no order changes."""
    df = spark.read.parquet(path)
    kind = df.schema[vector_col].dataType
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
        raise ValueError(f"{vector_col} holds no vectors but {kind.simpleString()}")
    v = F.col(vector_col)
    odd = F.size(F.filter(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    row = F.conv(F.substring(F.sha2(F.to_json(F.struct(F.col(id_col).cast("string").alias("i"), v.alias("v"))), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(id_col).alias("ids"), F.count(F.when(v.isNull(), 1)).alias("null_vectors"), F.min(F.size(v)).alias("least_dimension"), F.max(F.size(v)).alias("dimension"), F.sum(F.when(v.isNotNull(), odd).otherwise(0)).alias("not_finite"), F.sum(row).cast("string").alias("digest"))


def curve_figures(curves: DataFrame, by: str, axis: str, value: str, width: int = 320, height: int = 200, margin: int = 24) -> DataFrame:
    """One SVG figure of each unit's curve, points in order of the axis -> by, svg. A constant axis or
    value is drawn in the middle; points without a value are left out."""
    from pyspark.sql.window import Window

    own = Window.partitionBy(by)
    rows = curves.where(F.col(axis).isNotNull() & F.col(value).isNotNull()).select(by, F.col(axis).cast("double").alias("x"), F.col(value).cast("double").alias("y"))

    def place(c: str, size: int):
        low, high = F.min(c).over(own), F.max(c).over(own)
        return F.when(high > low, margin + (F.col(c) - low) / (high - low) * (size - 2 * margin)).otherwise(size / 2.0)

    at = rows.select(by, "x", F.round(place("x", width), 2).alias("px"), F.round(height - place("y", height), 2).alias("py"))
    points = F.array_sort(F.collect_list(F.struct("x", "px", "py")))
    path = F.array_join(F.transform(points, lambda p: F.concat(p["px"].cast("string"), F.lit(","), p["py"].cast("string"))), " ")
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><path d="M{margin},{margin} V{height - margin} H{width - margin}" fill="none" stroke="black"/><polyline fill="none" stroke="steelblue" points="'
    title = F.concat(F.lit('"><title>'), F.replace(F.replace(F.col(by).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</title></polyline></svg>"))
    return at.groupBy(by).agg(path.alias("_path")).select(by, F.concat(F.lit(head), F.col("_path"), title).alias("svg"))


def run_manifest(spark: SparkSession, parameters: dict, tables: dict[str, DataFrame]) -> str:
    """JSON of what a run was made with: versions, parameters, and each table's columns, rows and a
    digest of them that no order changes."""
    import platform

    out = {"format_version": VERSION, "spark": spark.version, "python": platform.python_version(), "parameters": parameters, "tables": {}}
    for name, df in sorted(tables.items()):
        row = F.conv(F.substring(F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10).cast("decimal(38,0)")
        r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row).cast("string").alias("d")).first()
        out["tables"][name] = {"columns": dict(df.dtypes), "rows": r["n"], "digest": r["d"]}
    return json.dumps(out, sort_keys=True, indent=1)
