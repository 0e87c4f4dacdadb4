"""Sinks, documents, requests, exports, binary files and workflows."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella import workflow
from tessella.sources import binary, documents


def test_tables_have_their_schema(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5, 2.0, 1.0, 2.0, 9), (2, 1.0, 1.0, 1.0, 1.0, 9)], "slide int, k float, observed_power double, median_permutation_power double, whitened_power double, extra int").withColumns({"lower_global_envelope": F.lit(None).cast("double"), "upper_global_envelope": F.lit(3.0)})
    documents.write_table(rows, "spectra", str(tmp_path / "s"), ["slide"])
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.columns[-1] == "slide" and dict(back.dtypes)["k"] == "double" and "extra" not in back.columns and back.count() == 2
    with pytest.raises(Exception, match="already exists"):
        documents.write_table(rows, "spectra", str(tmp_path / "s"))
    with pytest.raises(ValueError, match="lacks"):
        documents.conform(rows.drop("k"), "spectra")
    with pytest.raises(Exception, match="k is null"):
        documents.conform(rows.withColumn("k", F.lit(None)), "spectra").collect()
    for t in documents.SCHEMAS:
        assert documents.conform(spark.createDataFrame([], documents.SCHEMAS[t]), t).count() == 0


def test_result_documents_by_version_and_kind(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.1 + 0.2, None), (2, 1e-300, "x")], "a int, b double, c string")
    documents.write_document(rows, "marked_pattern", str(tmp_path / "d"))
    assert sorted(documents.read_document(spark, str(tmp_path / "d"), "marked_pattern", "a: int, b: double, c: string").collect()) == sorted(rows.collect())
    with pytest.raises(Exception, match="not a document of multimodal"):
        documents.read_document(spark, str(tmp_path / "d"), "multimodal", "a: int").collect()
    (tmp_path / "old").write_text('{"format_version": "0.4", "analysis": {"kind": "marked_pattern", "result": {}}}')
    with pytest.raises(Exception, match="unsupported version 0.4"):
        documents.read_document(spark, str(tmp_path / "old"), "marked_pattern", "a: int").collect()


def test_features_manifest_sections(spark, tmp_path):
    documents.write_features(spark.createDataFrame([("a", 1.0)], "id string, f double"), str(tmp_path / "f"), "id", {"unit": "um"})
    df, note = documents.read_features(spark, str(tmp_path / "f"), "id")
    assert note == {"unit": "um"} and df.first().f == 1.0
    with pytest.raises(ValueError, match="not numeric"):
        documents.write_features(spark.createDataFrame([("a", "b")], "id string, f string"), str(tmp_path / "g"), "id", {})
    for n in "ab":
        (tmp_path / f"{n}.csv").write_text("x,y\n1,2\n3,4\n" if n == "a" else "x,y\n5,6\n")
    (tmp_path / "m.csv").write_text(f"id,cells\none,{tmp_path}/a.csv\ntwo,{tmp_path}/b.csv\n")
    got = documents.read_manifest(spark, str(tmp_path / "m.csv"), "x double, y double")
    assert sorted((r.pattern_id, r.x) for r in got.collect()) == [("one", 1.0), ("one", 3.0), ("two", 5.0)]
    (tmp_path / "he.csv").write_text("cell_id,x_centroid_um,y_centroid_um,predicted_class,class_probability\n1,0,1,tumor,0.9\n")
    (tmp_path / "ihc.csv").write_text("cell_id,x_um,y_um,mmr_mark,mmr_probability\n7,2,3,1,0.2\n8,2,3,,0.7\n")
    rows = {r.cell_id: r for r in documents.read_sections(spark, str(tmp_path / "he.csv"), str(tmp_path / "ihc.csv")).collect()}
    assert rows["1"].cell_type == "tumor" and rows["7"].mark == 1 and rows["8"].mark is None and rows["8"].probability == 0.7


def test_requests_and_exports(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"source": {"kind": "inline", "specimens": [{"id": "s1", "groups": {"arm": "a"}, "cells": [{"id": 1, "x_um": 0.5, "y_um": 1.5, "class": "t"}]}]}}))
    cells, groups = documents.read_request(spark, str(tmp_path / "r.json"))
    assert cells.first() == ("s1", 1, 0.5, 1.5, "t") and groups.first() == ("s1", "arm", "a")
    square = [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]
    (tmp_path / "q.json").write_text(json.dumps({"features": [{"geometry": {"type": "Polygon", "coordinates": square}, "properties": {"classification": {"name": "T"}}}, {"geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {}}]}))
    assert documents.read_qupath(spark, str(tmp_path / "q.json")).collect() == [(0, 1.0, 1.0, "T")]
    (tmp_path / "i.csv").write_text("Object,CD3\n1,0.5\n2,0.7\n")
    (tmp_path / "p.csv").write_text("Object,centroid-0,centroid-1\n1,10,20\n2,11,21\n")
    got = {r.Object: (r.CD3, r.x, r.y) for r in documents.read_intensity_pair(spark, str(tmp_path / "i.csv"), str(tmp_path / "p.csv")).collect()}
    assert got == {1: (0.5, 20, 10), 2: (0.7, 21, 11)}
    (tmp_path / "p.csv").write_text("Object,centroid-0,centroid-1\n1,10,20\n")
    with pytest.raises(Exception, match="in one table only: 2"):
        documents.read_intensity_pair(spark, str(tmp_path / "i.csv"), str(tmp_path / "p.csv")).collect()


def test_embedding_profile(spark, tmp_path):
    rows = [("a", [1.0, 2.0]), ("b", [float("nan"), 1.0]), ("b", None)]
    spark.createDataFrame(rows, "id string, v array<float>").write.parquet(str(tmp_path / "e"))
    spark.createDataFrame(rows[::-1], "id string, v array<float>").repartition(3).write.parquet(str(tmp_path / "f"))
    p, r = (documents.embedding_profile(spark, str(tmp_path / n), "id", "v").first() for n in "ef")
    assert p == r and (p.rows, p.ids, p.null_vectors, p.dimension, p.not_finite) == (3, 2, 1, 2, 1)
    with pytest.raises(ValueError, match="no vectors"):
        documents.embedding_profile(spark, str(tmp_path / "e"), "v", "id")


ACQU = "##$TD= 4\n##$BYTORDA= 0\n##$NoSHOTS= 5\n##$DELAY= 100\n##$DW= 2\n##$ML1= 4000000\n##$ML2= 10\n##$ML3= 0.01\n##$SPType= 0\n"


def test_flex_spectra(spark, tmp_path):
    (tmp_path / "run").mkdir()
    (tmp_path / "run" / "acqu").write_text(ACQU)
    (tmp_path / "run" / "fid").write_bytes(struct.pack("<4i", 3, -1, 0, 9))
    got = binary.read_flex(spark, str(tmp_path)).orderBy("point").collect()
    assert [r.intensity for r in got] == [3.0, 0.0, 0.0, 9.0]
    for k, r in enumerate(got):  # the calibration holds at the mass that was found
        assert 10 + (1e12 / 4e6) ** 0.5 * r.mz**0.5 + 0.01 * r.mz == pytest.approx(100 + 2 * k)
    for change in ("##$Lift1= 1\n##$Lift2= 1\n", "##$TD= 4\n", "##$HPClUse= yes\n##$HPClBLo= 1\n##$HPClBHi= 1\n##$HPClOrd= 2\n"):
        with pytest.raises(ValueError):
            binary.flex_spectrum((ACQU + change).encode(), b"\0" * 16)
    with pytest.raises(ValueError, match="12 bytes for 4"):
        binary.flex_spectrum(ACQU.encode(), b"\0" * 12)


def _png(rows, bits, rules):
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    wide, raw, above = bits // 8, b"", None
    for row, rule in zip(rows, rules):
        line = b"".join(int(v).to_bytes(wide, "big") for v in row)
        above = above or bytes(len(line))
        left = lambda x, l=line: l[x - wide] if x >= wide else 0
        corner = lambda x, a=above: a[x - wide] if x >= wide else 0

        def guess(x, rule=rule, above=above, left=left, corner=corner):
            if rule == 4:
                p = left(x) + above[x] - corner(x)
                return min((abs(p - v), k, v) for k, v in enumerate((left(x), above[x], corner(x))))[2]
            return (0, left(x), above[x], (left(x) + above[x]) // 2)[rule]

        raw += bytes([rule]) + bytes((v - guess(x)) & 255 for x, v in enumerate(line))
        above = line
    head = struct.pack(">IIBBBBB", len(rows[0]), len(rows), bits, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("bits", [8, 16])
def test_rasters_by_every_filter(spark, tmp_path, bits):
    rows = np.random.default_rng(bits).integers(0, 1 << bits, (5, 7))
    data = _png(rows.tolist(), bits, [0, 1, 2, 3, 4])
    assert (binary.grey_png(data) == rows).all()
    with pytest.raises(ValueError, match="damaged"):
        binary.grey_png(data[:40] + bytes([data[40] ^ 1]) + data[41:])
    (tmp_path / "a.png").write_bytes(data)
    cells = spark.createDataFrame([("a.png", 1, 0.4, 0.2), ("a.png", 2, 3.4, 2.1), ("a.png", 3, 99.0, 0.0), ("b.png", 4, 0.0, 0.0)], "image string, idx long, x double, y double")
    got = {r.idx: r for r in binary.sample_channel(cells, str(tmp_path), 0.5).collect()}
    assert got[1].level == rows[0, 0] and got[2].level == rows[4, 6] and got[3].level is None and got[4].positive is None
    cut = binary.iso_threshold(rows.astype(float).ravel())
    assert got[1].positive == (rows[0, 0] > cut) and binary.iso_threshold(np.full(4, 7.0)) == 7.0


def test_workflows_read_what_is_unchanged(spark, tmp_path):
    calls = []

    def make(name, n):
        calls.append(name)
        return spark.range(n)

    nodes = lambda n: [workflow.Node("b", lambda a, k: (calls.append("b"), a.withColumn("k", F.lit(k)))[1], ("a",), {"k": 2}), workflow.Node("a", lambda n: make("a", n), (), {"n": n})]
    tables, said = workflow.Workflow(nodes(3)).run(spark, str(tmp_path))
    assert tables["b"].count() == 3 and said == {"a": "made", "b": "made"} and calls == ["a", "b"]
    assert workflow.Workflow(nodes(3)).run(spark, str(tmp_path))[1] == {"a": "read", "b": "read"} and calls == ["a", "b"]
    assert workflow.Workflow(nodes(4)).run(spark, str(tmp_path))[0]["b"].count() == 4 and calls == ["a", "b"] * 2
    for wrong, said in (([workflow.Node("a", make, ("a",))], "cycle"), ([workflow.Node("a", make, ("z",))], "unknown"), ([workflow.Node("a", make)] * 2, "share a name")):
        with pytest.raises(ValueError, match=said):
            workflow.Workflow(wrong)


def test_studies_resume(spark, tmp_path):
    units, seen = spark.createDataFrame([(k,) for k in range(5)], "slide int"), []

    def make(left):
        seen.append(sorted(r.slide for r in left.collect()))
        return left.withColumn("v", F.col("slide") * 2)

    path = str(tmp_path / "out")
    assert workflow.resume(spark, units, "slide", path, make, 2).count() == 2
    assert workflow.resume(spark, units, "slide", path, make).count() == 5
    assert seen == [[0, 1], [2, 3, 4]] and workflow.environment(spark).where("not suits").count() == 0


def test_validation_ladder(spark):
    steps = workflow.LADDER
    rows = [("a", steps[0], True), ("a", steps[1], True), ("a", steps[3], True), ("b", steps[1], True), ("c", steps[0], False)] + [("d", s, True) for s in steps]
    got = {r.u: r.level for r in workflow.validation_level(spark.createDataFrame(rows, "u string, step string, passed boolean"), "u").collect()}
    assert got == {"a": steps[1], "b": "none", "c": "none", "d": steps[-1]}


def test_figures_and_manifests(spark):
    import xml.etree.ElementTree as ET

    rows = spark.createDataFrame([("a<b&c", float(x), float(x * x)) for x in (3, 1, 2)] + [("flat", 1.0, 5.0), ("flat", 2.0, 5.0), ("flat", 3.0, None)], "u string, x double, y double")
    got = {r.u: ET.fromstring(r.svg) for r in documents.curve_figures(rows, "u", "x", "y").collect()}
    line = {k: v.find("{http://www.w3.org/2000/svg}polyline") for k, v in got.items()}
    assert line["a<b&c"].get("points").split() == ["24.0,176.0", "160.0,119.0", "296.0,24.0"] and line["a<b&c"][0].text == "a<b&c"
    assert line["flat"].get("points").split() == ["24.0,100.0", "296.0,100.0"]
    one, two = (json.loads(documents.run_manifest(spark, {"radius": 30}, {"t": df})) for df in (rows, rows.orderBy("y").repartition(3)))
    assert one == two and one["tables"]["t"]["rows"] == 6 and one["parameters"] == {"radius": 30}
    assert json.loads(documents.run_manifest(spark, {}, {"t": rows.limit(5)}))["tables"]["t"]["digest"] != one["tables"]["t"]["digest"]
