"""The polyphase resampler against its defining sum."""

import numpy as np
import pytest
from wavemill.functions.kernels import resample_polyphase


@pytest.mark.parametrize("up,down,n", [(3, 4, 64), (6, 8, 64), (2, 1, 33), (1, 5, 100), (125, 250, 41), (7, 3, 1)])
def test_equals_the_direct_sum(up, down, n):
    x = np.random.default_rng(n).normal(size=n)
    got = resample_polyphase(x, up, down)
    g = np.gcd(up, down)
    u, d = up // g, down // g
    slow = max(u, d)
    t = np.arange(-10 * slow, 10 * slow + 1)
    h = np.sinc(t / slow) * np.kaiser(len(t), 5.0)
    h *= u / h.sum()
    want = [sum(x[k] * h[m * d - k * u + 10 * slow] for k in range(n) if abs(m * d - k * u) <= 10 * slow) for m in range(-(-n * u // d))]
    assert len(got) == len(want) and np.allclose(got, want, atol=1e-12)


def test_a_slow_wave_stays():
    wave = lambda rate, n: np.sin(2 * np.pi * 2.0 * np.arange(n) / rate)
    assert np.abs(resample_polyphase(wave(100, 400), 3, 4) - wave(75, 300))[30:-30].max() < 0.01
