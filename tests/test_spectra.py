"""Spectra, territories and the sources of spectra and arrays."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import models, spectra
from tessella.sources import spectra as sources


@pytest.fixture(scope="module")
def striped(spark):
    rng = np.random.default_rng(2)
    xy = rng.uniform(0, 100, (400, 2))
    rows = [(1, k, float(x), float(y), int(math.sin(2 * math.pi * x / 50) > 0), "s") for k, (x, y) in enumerate(xy)]
    return spark.createDataFrame([*rows, (2, 0, 1.0, 1.0, 1, "s")], "pattern_id long, idx long, x double, y double, mark int, stratum string")


def test_spectrum_equals_the_structure_factor_and_finds_the_stripes(spark, striped):
    got = spectra.permuted_spectrum(striped, 100.0, 0.06, 0.5, 5, 60, 1).where("pattern_id = 1").orderBy("k").collect()
    powers = models.structure_factor(striped, models.wave_numbers(spark, 100.0, 0.06, 0.5)).where("pattern_id = 1")
    want = models.shell_means(powers, 0.06, 0.5, 5).orderBy("shell").collect()
    assert [r.observed for r in got] == pytest.approx([r.power for r in want])
    r = {x.pattern_id: x for x in spectra.spectrum_readouts(striped, 100.0, 0.06, 0.5, 5, 1, 60, 1).collect()}
    assert r[1].p_excess == pytest.approx(1 / 61) and r[1].excess > 1 and r[1].slope < 0
    assert r[2].excess is None and r[2].p_peak is None  # one mark has no spread


def test_labels_that_cannot_move_leave_no_excess(striped):
    fixed = striped.withColumn("stratum", F.col("mark").cast("string"))
    r = spectra.spectrum_readouts(fixed, 100.0, 0.06, 0.5, 5, 1, 20, 1, stratum="stratum").where("pattern_id = 1").first()
    assert r.excess == pytest.approx(0) and r.p_excess == 1


def test_periodogram_peaks_at_the_stripes(striped):
    got = spectra.periodogram(striped, 100.0, 32, 16).where("pattern_id = 1").collect()
    best = max(got, key=lambda r: r.power)
    assert abs(best.k - 2 * math.pi / 50) < math.pi * 32 / 100 / 16


def test_territories_do_not_overlap_and_are_significant(striped):
    found = spectra.residual_territories(striped, [3.0, 6.0], 1.5).where("pattern_id = 1").collect()
    assert found and all(r.z >= 1.5 for r in found)
    assert all(math.hypot(a.cx - b.cx, a.cy - b.cy) > math.sqrt(2) * min(a.scale, b.scale) for i, a in enumerate(found) for b in found[:i])
    shape = json.loads(sources.circles(spectra.residual_territories(striped, [3.0], 1.5), "scale").first().value)
    ring = shape["geometry"]["coordinates"][0]
    assert len(ring) == 33 and ring[0] == ring[-1] and shape["properties"]["scale"] == 3.0


def test_deltas_keep_one_sided_rows(spark):
    a = spark.createDataFrame([(1, 0.1 + 0.2, 5.0), (1, 2.0, 1.0)], "p int, axis double, v double")
    b = spark.createDataFrame([(1, 0.3, 5.5), (1, 4.0, 1.0)], "p int, axis double, v double")
    got = {r.axis: (r.before, r.after, r.within) for r in spectra.paired_deltas(a, b, ["p", "axis"], "v", 0.6).collect()}
    assert got == {0.3: (5.0, 5.5, True), 2.0: (1.0, None, None), 4.0: (None, 1.0, None)}


def test_text_spectra(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# made\nm/z intensity\n100.5 3\n\n101 4.5\n")
    (tmp_path / "b.txt").write_text("5,1\r\n4,2\r\n")
    df = sources.read_spectra(spark, str(tmp_path))
    assert sorted((r.file[-5:], r.line, r.mz, r.intensity) for r in df.collect()) == [("a.txt", 3, 100.5, 3.0), ("a.txt", 5, 101.0, 4.5), ("b.txt", 1, 5.0, 1.0), ("b.txt", 2, 4.0, 2.0)]
    assert [(r.file[-5:], r.line) for r in sources.unordered_spectra(df).collect()] == [("b.txt", 2)]
    (tmp_path / "c.txt").write_text("1 2\nnonsense\n")
    with pytest.raises(Exception, match="no two numbers in line 2"):
        sources.read_spectra(spark, str(tmp_path)).collect()


def test_npy_rows_and_refusals(spark, tmp_path):
    values = np.arange(10, dtype="<f4").reshape(5, 2)
    np.save(tmp_path / "a.npy", values)
    got = sources.read_npy(spark, str(tmp_path)).orderBy("row").collect()
    assert [r.embedding for r in got] == values.tolist()
    np.save(tmp_path / "b.npy", values.astype("<f8"))
    with pytest.raises(Exception, match="row-major matrix of float32"):
        sources.read_npy(spark, str(tmp_path)).collect()
