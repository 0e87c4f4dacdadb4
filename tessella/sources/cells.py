"""Cell tables and observation windows from files, with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "cell_id string, x_um double, y_um double, mark tinyint, case_id string, timepoint string, protein string, valid_tumor boolean, valid_ihc boolean"
OPTIONAL = "internal_control_local string, artifact boolean, edge_artifact boolean, fold_artifact boolean, necrosis boolean, nonviable_therapy_effect boolean, slide_id string, qc_bin int, component_id bigint, mark_probability float, tumor_probability float, nucleus_area_um2 float"


def read_cells(spark: SparkSession, path: str, extra: str = "") -> DataFrame:
    """CSV (by header, malformed rows fail) or Parquet cells; missing required columns are an error."""
    schema = ", ".join(x for x in (CELLS, extra) if x)
    if path.split("?")[0].endswith((".csv", ".csv.gz")):
        return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", enforceSchema=False)
    df = spark.read.parquet(path)
    names = [c.split()[0] for c in schema.split(", ")]
    if missing := [c for c in names if c not in df.columns]:
        raise ValueError(f"columns missing: {missing}")
    return df.select(*names)


def read_window(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON Polygon, MultiPolygon, Feature or FeatureCollection of one feature (more are an error) -> one row per edge: polygon, ring, x1, y1, x2, y2."""
    return window_edges(spark.read.text(path, wholetext=True).withColumnRenamed("value", "json"))


def window_edges(documents: DataFrame) -> DataFrame:
    ring = "array<array<double>>"
    at = lambda p: F.get_json_object("json", p)
    several = F.raise_error(F.lit("a window is one feature, not several")).cast("string")
    feature = F.when(at("$.features[1]").isNotNull(), several).otherwise(F.coalesce(at("$.features[0].geometry"), at("$.geometry"), F.col("json")))
    shape = documents.select(feature.alias("g"))
    polygon = F.from_json(F.get_json_object("g", "$.coordinates"), f"array<{ring}>", {"mode": "PERMISSIVE"})
    multi = F.from_json(F.get_json_object("g", "$.coordinates"), f"array<array<{ring}>>", {"mode": "PERMISSIVE"})
    kind = F.get_json_object("g", "$.type")
    rows = shape.select(F.when(kind == "Polygon", F.array(polygon)).otherwise(multi).alias("m")).select(F.posexplode("m").alias("polygon", "rings")).select("polygon", F.posexplode("rings").alias("ring", "points"))
    e = rows.select("polygon", "ring", F.posexplode(F.slice("points", 2, F.size("points") - 1)).alias("k", "q"), "points")
    p = F.element_at("points", F.col("k") + 1)
    return e.select("polygon", "ring", p[0].alias("x1"), p[1].alias("y1"), F.col("q")[0].alias("x2"), F.col("q")[1].alias("y2"))


def in_window(points: DataFrame, edges: DataFrame, *by: str, most: int = 100_000) -> DataFrame:
    """points (by, x, y) with `inside` (closed; holes are outside but for their edge), `boundary_distance`
    and `signed_distance`, which is negative inside.

    A window is one array of its edges, broadcast as a single row; each point folds over it without
    a shuffle. A window of more than `most` edges raises.
    """
    size = F.count(F.lit(1))
    shape = edges.agg(F.when(size > most, F.raise_error(F.lit("the window has too many edges")).cast("int")).alias("_over"), F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_edges"))
    x, y = F.col("x"), F.col("y")

    def crosses(n, e):
        flat = F.when(e.y1 == e.y2, 1.0).otherwise(0.0)
        return n + (((e.y1 > y) != (e.y2 > y)) & (x < (e.x2 - e.x1) * (y - e.y1) / (e.y2 - e.y1 + flat) + e.x1)).cast("int")

    def nearer(d, e):
        ux, uy = e.x2 - e.x1, e.y2 - e.y1
        n2 = ux * ux + uy * uy
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - e.x1) * ux + (y - e.y1) * uy) / F.when(n2 > 0, n2).otherwise(1.0)))
        dx, dy = x - (e.x1 + t * ux), y - (e.y1 + t * uy)
        return F.least(d, dx * dx + dy * dy)

    met = points.select(*by, "x", "y").join(F.broadcast(shape)).where(F.col("_over").isNull())
    out = met.select(*by, "x", "y", F.sqrt(F.aggregate("_edges", F.lit(float("inf")), nearer)).alias("boundary_distance"), F.aggregate("_edges", F.lit(0), crosses).alias("_odd"))
    out = out.withColumn("inside", (F.col("_odd") % 2 == 1) | (F.col("boundary_distance") == 0)).drop("_odd")
    return out.withColumn("signed_distance", F.when(F.col("inside"), -F.col("boundary_distance")).otherwise(F.col("boundary_distance")))


def polygon_area(edges: DataFrame) -> DataFrame:
    """Area by the shoelace formula, first rings less the others, and perimeter."""
    ring = edges.groupBy("polygon", "ring").agg(F.abs(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2).alias("a"), F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("p"))
    return ring.agg(F.sum(F.when(F.col("ring") == 0, F.col("a")).otherwise(-F.col("a"))).alias("area"), F.sum("p").alias("perimeter"))


def affine(m: tuple[float, float, float, float, float, float], x: str = "x", y: str = "y") -> tuple[Column, Column]:
    return m[0] * F.col(x) + m[1] * F.col(y) + m[2], m[3] * F.col(x) + m[4] * F.col(y) + m[5]


def write_once(df: DataFrame, path: str) -> None:
    """A result directory; an existing one is an error."""
    df.write.mode("errorifexists").parquet(path)
