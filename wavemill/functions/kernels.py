"""Numeric kernels that SQL cannot express: numpy over one window, run in Arrow batches by ``per_window``."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def per_window(rows: DataFrame, key: str, kernel: Callable[[np.ndarray], dict[str, float]], names: list[str]) -> DataFrame:
    """One row of named values per window; a kernel that fails or gives a non-finite value yields NULL, not a failed job."""
    packed = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("x"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for x in frame["x"]:
                try:
                    found = kernel(np.asarray(x, float))
                except (ValueError, FloatingPointError, np.linalg.LinAlgError, IndexError, ZeroDivisionError):
                    found = {}
                out.append({n: (float(np.clip(v, -1e6, 1e6)) if (v := found.get(n)) is not None and np.isfinite(v) else None) for n in names})
            yield pd.concat([frame[[key]].reset_index(drop=True), pd.DataFrame(out, columns=names, dtype="float64")], axis=1)

    return packed.mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, " + ", ".join(f"`{n}` double" for n in names))


def per_window_samples(rows: DataFrame, key: str, kernel: Callable[..., np.ndarray], with_key: bool = False) -> DataFrame:
    """Windows in, equally long windows out; with_key hands the window's key to the kernel as well."""
    packed = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("x"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys = ((k,) for k in frame[key]) if with_key else (() for _ in frame[key])
            yield frame.assign(x=[kernel(np.asarray(x, float), *k).tolist() for x, k in zip(frame["x"], keys)])

    out = packed.mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, x array<double>")
    return out.select(key, F.posexplode("x").alias("i", "x"))


def band_pass(x: np.ndarray, fs: float, low: float, high: float, order: int = 4) -> np.ndarray:
    """Zero-phase Butterworth gain |H|^2 in the frequency domain, the window mirrored at both ends first."""
    high = min(high, 0.99 * fs / 2)
    pad = min(len(x) - 1, max(1, int(3 * order * fs / low / 10)))
    wide = np.concatenate((2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]))
    f = np.fft.rfftfreq(len(wide), 1 / fs)
    with np.errstate(divide="ignore"):
        gain = 1 / (1 + (f / high) ** (2 * order)) / (1 + np.where(f > 0, low / np.where(f > 0, f, 1), np.inf) ** (2 * order))
    return np.fft.irfft(np.fft.rfft(wide) * gain, len(wide))[pad : pad + len(x)]


def resample_polyphase(x: np.ndarray, up: int, down: int, zeros: int = 10, beta: float = 5.0) -> np.ndarray:
    """x at up / down times its rate by a zero-phase Kaiser-windowed low-pass; samples beyond the ends count as 0.

    Output m stands at input place m * down / up. up and down are reduced by their common divisor; the filter reaches
    ``zeros`` zero crossings of the slower rate to each side.
    """
    up, down = up // math.gcd(up, down), down // math.gcd(up, down)
    slow = max(up, down)
    reach = zeros * slow
    low_pass = np.sinc(np.arange(-reach, reach + 1) / slow) * np.kaiser(2 * reach + 1, beta)
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    return np.convolve(wide, low_pass * up / low_pass.sum())[reach : reach + len(wide) : down]


def welch(x: np.ndarray, y: np.ndarray, fs: float, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Frequencies, both spectra and the cross spectrum, averaged over Hann segments with half overlap."""
    size = min(size, len(x))
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    starts = range(0, len(x) - size + 1, max(1, size // 2))
    a, b = (np.array([np.fft.rfft((z[s : s + size] - z[s : s + size].mean()) * w) for s in starts]) for z in (x, y))
    return np.fft.rfftfreq(size, 1 / fs), (abs(a) ** 2).mean(0), (abs(b) ** 2).mean(0), (a.conj() * b).mean(0)


def coherence(x: np.ndarray, y: np.ndarray, fs: float, size: int, low: float, high: float) -> dict[str, float]:
    f, pa, pb, pab = welch(x, y, fs, size)
    band = (f >= low) & (f <= high)
    c = abs(pab[band]) ** 2 / (pa[band] * pb[band] + 1e-20)
    return {"coh_mean": c.mean(), "coh_max": c.max(), "df": abs(f[band][pa[band].argmax()] - f[band][pb[band].argmax()])}


def spectral_summary(x: np.ndarray, fs: float, edges: tuple[float, ...]) -> dict[str, float]:
    """Relative power of the bands between the edges, spectral entropy and excess kurtosis."""
    f, p, _, _ = welch(x, x, fs, len(x))
    q = p[1:] / p[1:].sum()
    out = {f"band_{k}": float(q[(f[1:] >= a) & (f[1:] < b)].sum()) for k, (a, b) in enumerate(zip(edges, edges[1:]))}
    z = (x - x.mean()) / x.std()
    return out | {"entropy": float(-(q[q > 0] * np.log(q[q > 0])).sum()), "kurtosis": float((z**4).mean() - 3)}


# The low-pass filter of the Daubechies wavelet with four vanishing moments.
DB4 = (0.23037781330885523, 0.7148465705525415, 0.6308807679295904, -0.02798376941698385, -0.18703481171888114, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278)


def wavelet_energy(x: np.ndarray, levels: int) -> dict[str, float]:
    """Relative energies of the detail levels and the rest, and their entropy; symmetric extension at the ends."""
    low = np.array(DB4)
    high = low[::-1] * (-1) ** np.arange(len(low))
    energies, a = [], x
    for _ in range(levels):
        wide = np.pad(a, len(low) - 1, mode="symmetric")
        d, a = (np.convolve(wide, h, "valid")[1::2] for h in (high, low))
        energies.append((d**2).sum())
    energies.append((a**2).sum())
    e = np.array(energies) / max(sum(energies), 1e-20)
    return {f"e{k}": v for k, v in enumerate(e)} | {"entropy": float(-(e[e > 0] * np.log(e[e > 0])).sum())}


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction; for result-sized tables only."""
    from math import exp, lgamma, log

    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    if x >= (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    c, d = 1.0, 1 / max(1e-300, abs(1 - (a + b) * x / (a + 1)))
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d)
            c = 1 + num / c
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h / a


def t_p_value(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def cp_upper(k: int, n: int, confidence: float) -> float:
    """One-sided Clopper-Pearson upper bound by bisection."""
    if k >= n:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_cdf(mid, k + 1, n - k) < confidence else (low, mid)
    return (low + high) / 2


@F.pandas_udf(T.DoubleType())
def cp_upper_90(k: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([cp_upper(int(a), int(b), 0.9) for a, b in zip(k, n)])


@F.pandas_udf(T.DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if t_ is None or np.isnan(t_) else t_p_value(float(t_), float(d)) for t_, d in zip(t, df)], dtype="float64")
