"""Mark spectra with permutation nulls, periodograms and residual territories; the pattern is the unit of work."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import pairs
from ..functions.draws import orders


def _lattice(side: float, low: float, high: float) -> np.ndarray:
    """Half of the wave vectors 2 pi / side * (mx, my) with low <= length <= high; opposite ones are equal."""
    step, top = 2 * math.pi / side, int(high * side / (2 * math.pi)) + 1
    k = np.array([(x, y) for x in range(top + 1) for y in range(-top, top + 1) if x > 0 or y > 0], float) * step
    size = np.hypot(*k.T)
    return k[(size >= low) & (size <= high)]


def _shell_curves(pdf: pd.DataFrame, side: float, low: float, high: float, shells: int, replicates: int, seed: int, mark: str, stratum: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Mean wave number of each nonempty shell, and curves: the observed one, then the shuffled ones."""
    pdf = pdf.sort_values("idx")
    k = _lattice(side, low, high)
    size = np.hypot(*k.T)
    shell = np.minimum(((size - low) / ((high - low) / shells)).astype(int), shells - 1)
    m, n = pdf[mark].to_numpy(float), len(pdf)
    marks, blocks = np.tile(m, (replicates + 1, 1)), pd.factorize(pdf[stratum])[0] if stratum else np.zeros(n, int)
    for b in np.unique(blocks):
        at = np.flatnonzero(blocks == b)
        marks[1:, at] = m[at][orders(pdf["idx"].to_numpy()[at].tolist(), seed, replicates)]
    marks -= m.mean()
    sums, used = np.zeros((replicates + 1, shells)), np.bincount(shell, minlength=shells)
    for s in range(0, len(k), 128):
        phase = pdf[["x", "y"]].to_numpy(float) @ k[s : s + 128].T
        power = ((marks @ np.cos(phase)) ** 2 + (marks @ np.sin(phase)) ** 2) / n
        for b in np.unique(shell[s : s + 128]):
            sums[:, b] += power[:, shell[s : s + 128] == b].sum(1)
    some = used > 0
    return np.bincount(shell, size, shells)[some] / used[some], sums[:, some] / used[some]


def permuted_spectrum(points: DataFrame, side: float, low: float, high: float, shells: int, replicates: int, seed: int, mark: str = "mark", stratum: str | None = None) -> DataFrame:
    """Shell powers of centred marks against shuffled marks, within strata if given.

    -> pattern_id, k, observed, median and the null's pointwise 2.5 and 97.5 % quantiles, whitened
    (observed over median; null where the median is zero).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k, c = _shell_curves(pdf, side, low, high, shells, replicates, seed, mark, stratum)
        mid, (lower, upper) = np.median(c[1:], axis=0), np.quantile(c[1:], [0.025, 0.975], axis=0)
        white = np.divide(c[0], mid, out=np.full(len(k), np.nan), where=mid > 0)
        return pd.DataFrame({"pattern_id": pdf["pattern_id"].iloc[0], "k": k, "observed": c[0], "median": mid, "lower": lower, "upper": upper, "whitened": white})

    out = points.select("pattern_id", "idx", "x", "y", mark, *([stratum] if stratum else [])).groupBy("pattern_id")
    out = out.applyInPandas(run, "pattern_id long, k double, observed double, median double, lower double, upper double, whitened double")
    return out.withColumn("whitened", F.when(F.col("median") > 0, F.col("whitened")))


def spectrum_readouts(points: DataFrame, side: float, low: float, high: float, shells: int, low_shells: int, replicates: int, seed: int, mark: str = "mark", stratum: str | None = None) -> DataFrame:
    """What a whitened spectrum says: excess at low wave numbers, peak length, log-log slope, plus-one p-values.

    Every curve, observed or shuffled, is whitened by the median of all the others. p_excess counts
    shuffled excesses at least the observed one, p_peak shuffled peaks at least the observed one.
    Marks without spread give nulls.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k, c = _shell_curves(pdf, side, low, high, shells, replicates, seed, mark, stratum)
        row = {"pattern_id": pdf["pattern_id"].iloc[0], "excess": None, "peak_length": None, "slope": None, "p_excess": None, "p_peak": None}
        if (c[0] > 0).all() and len(k) > 1:
            mid = np.stack([np.median(np.delete(c, r, 0), axis=0) for r in range(len(c))])
            white = c / mid
            excess, peak = white[:, :low_shells].mean(1) - 1, white.max(1)
            p = lambda v: (1 + (v[1:] >= v[0] - 1e-12).sum()) / (1 + replicates)
            row |= {"excess": excess[0], "peak_length": 2 * math.pi / k[white[0].argmax()], "slope": np.polyfit(np.log(k), np.log(c[0]), 1)[0], "p_excess": p(excess), "p_peak": p(peak)}
        return pd.DataFrame([row]).astype({c: "float64" for c in row if c != "pattern_id"})

    names = ["excess", "peak_length", "slope", "p_excess", "p_peak"]
    out = points.select("pattern_id", "idx", "x", "y", mark, *([stratum] if stratum else [])).groupBy("pattern_id").applyInPandas(run, "pattern_id long, " + ", ".join(f"{c} double" for c in names))
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in names})


def periodogram(points: DataFrame, side: float, grid: int, annuli: int, mark: str = "mark") -> DataFrame:
    """Power of the raster of centred marks under a separable Hann window, mean over radial annuli.

    -> pattern_id, annulus, modes, k (mean), power. The zero mode is left out, as are modes beyond
    the grid's Nyquist radius.
    """
    freq = 2 * np.pi * np.fft.fftfreq(grid, side / grid)
    size = np.hypot(freq[:, None], freq[None]).ravel()
    top = np.pi * grid / side
    ring = np.where((size > 0) & (size <= top), np.minimum((size / (top / annuli) + 1e-9).astype(int), annuli - 1), annuli)
    taper = np.hanning(grid)[:, None] * np.hanning(grid)[None]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf[mark].to_numpy(float) - pdf[mark].mean()
        at = [np.clip((pdf[c].to_numpy(float) / (side / grid)).astype(int), 0, grid - 1) for c in ("x", "y")]
        raster = np.zeros((grid, grid))
        np.add.at(raster, tuple(at), m)
        power = (np.abs(np.fft.fft2(raster * taper)) ** 2 / (taper**2).sum()).ravel()
        n = np.bincount(ring, minlength=annuli + 1)[:annuli]
        some = n > 0
        mean = lambda v: np.bincount(ring, v, annuli + 1)[:annuli][some] / n[some]
        return pd.DataFrame({"pattern_id": pdf["pattern_id"].iloc[0], "annulus": np.flatnonzero(some), "modes": n[some], "k": mean(size), "power": mean(power)})

    return points.select("pattern_id", "x", "y", mark).groupBy("pattern_id").applyInPandas(run, "pattern_id long, annulus long, modes long, k double, power double")


def residual_discs(points: DataFrame, scales: Sequence[float], mark: str = "mark", eps: float = 1e-9) -> DataFrame:
    """Discs of radius sqrt(2) * scale around marked cells, centre included, with their binomial z.

    z = (local share - share) / sqrt(share * (1 - share) / n + eps).
    """
    share = points.groupBy("pattern_id").agg(F.avg(mark).alias("share"))
    marked = points.where(F.col(mark) == 1)
    met = pairs(marked, points, math.sqrt(2) * max(scales), [mark]).withColumnRenamed(f"j_{mark}", "m")
    met = met.select("*", F.explode(F.array(*[F.lit(float(s)) for s in scales])).alias("scale")).where("d2 <= 2 * scale * scale")
    out = met.groupBy("pattern_id", F.col("i").alias("idx"), "scale").agg(F.count(F.lit(1)).alias("n"), F.sum("m").cast("long").alias("marked"), F.avg(F.when(F.col("m") == 1, F.col("j_x"))).alias("cx"), F.avg(F.when(F.col("m") == 1, F.col("j_y"))).alias("cy"))
    out = out.join(share, "pattern_id")
    z = (F.col("marked") / F.col("n") - F.col("share")) / F.sqrt(F.col("share") * (1 - F.col("share")) / F.col("n") + eps)
    return out.select("pattern_id", "idx", "scale", "n", "marked", "cx", "cy", z.alias("z"))


def residual_territories(points: DataFrame, scales: Sequence[float], least_z: float, mark: str = "mark") -> DataFrame:
    """The strongest discs that don't overlap: by z, then size, then index, each drops what lies within
    the smaller of both radii."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["z", "n", "scale", "idx"], ascending=[False, False, True, True])
        kept: list[tuple] = []
        for r in pdf.itertuples(index=False):
            if all(math.hypot(r.cx - k.cx, r.cy - k.cy) > math.sqrt(2) * min(r.scale, k.scale) for k in kept):
                kept.append(r)
        return pd.DataFrame(kept, columns=pdf.columns)

    found = residual_discs(points, scales, mark).where(F.col("z") >= least_z)
    return found.groupBy("pattern_id").applyInPandas(run, found.schema)


def paired_deltas(before: DataFrame, after: DataFrame, on: Sequence[str], value: str, margin: float, digits: int = 9) -> DataFrame:
    """after - before of matching rows, with whether it is within a margin; one-sided rows are there with nulls.

    The last name in `on` is an axis, matched after rounding to `digits` decimals; the others match exactly.
    """
    *keys, axis = on
    a, b = (df.select(*keys, F.round(axis, digits).alias(axis), F.col(value).alias(name)) for df, name in ((before, "before"), (after, "after")))
    delta = F.col("after") - F.col("before")
    return a.join(b, list(on), "full").select(*on, "before", "after", delta.alias("delta"), (F.abs(delta) <= margin).alias("within"))
