"""Declared windows and mark spectra with their nulls, as queries and SQL."""

from __future__ import annotations

import json
import math

import numpy as np

from ..operators import spectra
from ..sources import cells
from .queries import ORACLES, PTS, q, query, shuffle

_RINGS = [[[(100, 80), (820, 140), (760, 700), (300, 760), (60, 420)], [(300, 300), (300, 450), (480, 470), (500, 280)]], [[(850, 760), (980, 780), (900, 960)]]]
_DOC = json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[[*map(list, r), list(r[0])] for r in p] for p in _RINGS]}}]})
_ROWS = [(k, n, *a, *b) for k, p in enumerate(_RINGS) for n, r in enumerate(p) for a, b in zip(r, [*r[1:], r[0]])]
_SEG = "seg AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {n}, {a}.0::DOUBLE, {b}.0::DOUBLE, {c}.0::DOUBLE, {d}.0::DOUBLE)" for k, n, a, b, c, d in _ROWS) + ") s(polygon, ring, x1, y1, x2, y2))"


def _edges(pts):
    return cells.window_edges(pts.sparkSession.createDataFrame([(_DOC,)], "json string"))


@query(f"""WITH {PTS}, {_SEG}, d AS (SELECT pattern_id, idx, x, y, x1, y1, x2, y2, least(1.0, greatest(0.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) AS t FROM pts, seg),
    m AS (SELECT pattern_id, idx, min(sqrt(pow(x - (x1 + t * (x2 - x1)), 2) + pow(y - (y1 + t * (y2 - y1)), 2))) AS b, count(*) FILTER ((y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1) % 2 = 1 AS odd FROM d GROUP BY 1, 2)
    SELECT pattern_id, idx, {q('b')} AS boundary_distance, odd OR b = 0 AS inside, {q('CASE WHEN odd OR b = 0 THEN -b ELSE b END')} AS signed_distance FROM m""")
def window_distance(pts):
    return cells.in_window(pts, _edges(pts), "pattern_id", "idx").select("pattern_id", "idx", "boundary_distance", "inside", "signed_distance")


@query(f"""WITH {_SEG}, r AS (SELECT polygon, ring, abs(sum(x1 * y2 - x2 * y1)) / 2 AS a, sum(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2))) AS p FROM seg GROUP BY 1, 2) SELECT {q('sum(CASE WHEN ring = 0 THEN a ELSE -a END)')} AS area, {q('sum(p)')} AS perimeter FROM r""")
def window_measures(pts):
    return cells.polygon_area(_edges(pts))


@query(f"WITH {PTS} SELECT pattern_id, idx, {q('0.8 * x - 0.6 * y + 12')} AS x, {q('0.6 * x + 0.8 * y - 5')} AS y FROM pts")
def projected_points(pts):
    x, y = cells.affine((0.8, -0.6, 12.0, 0.6, 0.8, -5.0))
    return pts.select("pattern_id", "idx", x.alias("x"), y.alias("y"))


# Spectra ----------------------------------------------------------------------------------------

_LOW, _HIGH, _SHELLS, _STEP = 0.006, 0.045, 6, 2 * math.pi / 1000


def _spectrum(within: str) -> str:
    """CTEs up to `sh`(pattern_id, replicate, shell, k, v): mean power of each shell, replicate 0 observed."""
    k = spectra._lattice(1000.0, _LOW, _HIGH)
    rows = ", ".join(f"({a}, {b}, {s}, {z!r}::DOUBLE)" for (a, b), s, z in zip((k / _STEP).round().astype(int).tolist(), np.minimum(((np.hypot(*k.T) - _LOW) / ((_HIGH - _LOW) / _SHELLS)).astype(int), _SHELLS - 1).tolist(), np.hypot(*k.T).tolist()))
    return f"""md AS (SELECT * FROM (VALUES {rows}) m(mx, my, shell, k)), {shuffle('sm', 'pts', within, 'idx', 'mark', 99, 4)}, n AS (SELECT pattern_id, count(*) AS n, avg(mark) AS p FROM pts GROUP BY 1),
    al AS MATERIALIZED (SELECT pattern_id, 0 AS replicate, idx FROM pts WHERE mark = 1 UNION ALL SELECT pattern_id, replicate, idx FROM sm WHERE mark = 1),
    ph AS MATERIALIZED (SELECT pattern_id, idx, mx, my, shell, k, cos({_STEP!r} * (mx * x + my * y)) AS c, sin({_STEP!r} * (mx * x + my * y)) AS s FROM pts, md), al_ AS (SELECT pattern_id, mx, my, sum(c) AS c, sum(s) AS s FROM ph GROUP BY 1, 2, 3),
    mk AS (SELECT ph.pattern_id, a.replicate, ph.mx, ph.my, ph.shell, any_value(ph.k) AS k, sum(ph.c) AS c, sum(ph.s) AS s FROM ph JOIN al a USING (pattern_id, idx) GROUP BY 1, 2, 3, 4, 5),
    po AS (SELECT mk.pattern_id, replicate, shell, k, (pow(mk.c - p * t.c, 2) + pow(mk.s - p * t.s, 2)) / n AS v FROM mk JOIN al_ t USING (pattern_id, mx, my) JOIN n USING (pattern_id)), sh AS MATERIALIZED (SELECT pattern_id, replicate, shell, avg(k) AS k, avg(v) AS v FROM po GROUP BY 1, 2, 3)"""


_READ = f"""li AS (SELECT pattern_id, shell, any_value(k) AS k, list(v ORDER BY replicate) AS vs FROM sh GROUP BY 1, 2), wh AS (SELECT pattern_id, shell, k, vs[1] AS seen, r AS replicate, vs[r + 1] / list_median(list_concat(vs[1:r], vs[r + 2:])) AS w FROM li, (SELECT unnest(range(100)) AS r)),
    st AS (SELECT pattern_id, replicate, avg(w) FILTER (shell < 2) - 1 AS excess, max(w) AS peak, arg_max(k, w) AS pk FROM wh GROUP BY 1, 2), sl AS (SELECT pattern_id, regr_slope(ln(seen), ln(k)) AS slope FROM wh WHERE replicate = 0 GROUP BY 1),
    ob AS (SELECT pattern_id, excess, peak, pk FROM st WHERE replicate = 0) SELECT o.pattern_id, {q('o.excess')} AS excess, {q('2 * pi() / o.pk')} AS peak_length, {q('slope')} AS slope, {q('(1 + count(*) FILTER (s.excess >= o.excess - 1e-12)) / 100.0')} AS p_excess, {q('(1 + count(*) FILTER (s.peak >= o.peak - 1e-12)) / 100.0')} AS p_peak
    FROM ob o JOIN sl USING (pattern_id) JOIN st s ON s.pattern_id = o.pattern_id AND s.replicate > 0 GROUP BY o.pattern_id, o.excess, o.pk, slope, o.peak"""

ORACLES["permuted_spectrum"] = f"""WITH {PTS}, {_spectrum('pattern_id')}, o AS (SELECT pattern_id, shell, k, v AS seen FROM sh WHERE replicate = 0), a AS (SELECT pattern_id, shell, median(v) AS m, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM sh WHERE replicate > 0 GROUP BY 1, 2)
    SELECT pattern_id, {q('k')} AS k, {q('seen')} AS observed, {q('m')} AS median, {q('lo')} AS lower, {q('hi')} AS upper, CASE WHEN m > 0 THEN {q('seen / m')} END AS whitened FROM o JOIN a USING (pattern_id, shell)"""
ORACLES["spectrum_readouts"] = f"WITH {PTS}, {_spectrum('pattern_id')}, {_READ}"
ORACLES["stratified_spectrum_readouts"] = f"WITH {PTS}, {_spectrum('pattern_id, stratum')}, {_READ}"
