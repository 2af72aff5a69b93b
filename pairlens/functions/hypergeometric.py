"""Hypergeometric counts for margins of any size that fits 63 bits."""
from __future__ import annotations

import math

import numpy as np

#: The range of numpy's generator; beyond it the same distribution is drawn by rejection.
NUMPY_RANGE = 1_000_000_000
_SMALL = np.array([math.lgamma(k + 1.0) for k in range(32)])
#: Ratio of uniforms: the hat of a discrete log-concave law has this half width, in deviations and absolute.
_WIDTH, _EXTRA = 2 * math.sqrt(2 / math.e), 3 - 2 * math.sqrt(3 / math.e)


def log_factorial(x: np.ndarray) -> np.ndarray:
    """log x! by Stirling's series, exact to rounding; a table below 32."""
    x = np.asarray(x, float)
    y = np.maximum(x, 31.0)
    series = (y + 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return np.where(x < 32, _SMALL[np.clip(x, 0, 31).astype(int)], series)


def _change(a: np.ndarray, e: np.ndarray) -> np.ndarray:
    """log (a + e)! - log a!, without the digits that large factorials would lose."""
    large = (a >= 1e5) & (a + e >= 1e5)
    s, t = np.where(large, a, 1e5), np.where(large, e, 0.0)
    far = (s + t + 0.5) * np.log1p(t / s) + t * np.log(s) - t + (1 / (s + t) - 1 / s) / 12
    return np.where(large, far, log_factorial(np.where(large, 0, a + e)) - log_factorial(np.where(large, 0, a)))


def _rejected(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, sample: np.ndarray) -> np.ndarray:
    total = good + bad
    # Both symmetries: the rarer colour in the smaller of sample and rest.
    m, low = np.minimum(sample, total - sample), np.minimum(good, bad)
    high = total - low
    t, p = total.astype(float), low / total.astype(float)
    centre = m * p + 0.5
    deviation = np.sqrt((t - m) * m * p * (1 - p) / np.maximum(t - 1, 1) + 0.5)
    mode = np.clip(np.floor((m + 1.0) * (low + 1.0) / (t + 2)), 0, np.minimum(m, low)).astype(np.int64)
    out, left = np.zeros_like(good), np.arange(len(good))
    while len(left):
        u, v = rng.random(len(left)), rng.random(len(left))
        w = centre[left] + (_WIDTH * deviation[left] + _EXTRA) * (v - 0.5) / np.maximum(u, 1e-300)
        inside = (w >= 0) & (w < np.minimum(m, low)[left] + 1.0)
        k = np.where(inside, np.floor(np.where(inside, w, 0)), mode[left]).astype(np.int64)
        d, at = (k - mode[left]).astype(float), mode[left]
        less = (_change(at.astype(float), d) + _change((low[left] - at).astype(float), -d)
                + _change((m[left] - at).astype(float), -d) + _change((high[left] - m[left] + at).astype(float), d))
        with np.errstate(divide="ignore"):
            kept = inside & (2 * np.log(u) <= -less)
        out[left[kept]] = k[kept]
        left = left[~kept]
    out = np.where(good > bad, m - out, out)
    return np.where(m < sample, good - out, out)


def hypergeometric(rng: np.random.Generator, good, bad, sample) -> np.ndarray:
    """How many of ``sample`` rows are among ``good`` of ``good + bad``, drawn without replacement."""
    good, bad, sample = (np.array(x, np.int64) for x in np.broadcast_arrays(
        np.asarray(good, np.int64), np.asarray(bad, np.int64), np.asarray(sample, np.int64)))
    shape = good.shape
    good, bad, sample = good.ravel(), bad.ravel(), sample.ravel()
    wide = good + bad >= NUMPY_RANGE
    out = rng.hypergeometric(np.where(wide, 1, good), np.where(wide, 1, bad), np.where(wide, 1, sample))
    if wide.any():
        out[wide] = _rejected(rng, good[wide], bad[wide], sample[wide])
    return out.reshape(shape)
