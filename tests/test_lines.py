"""Coasts and river lines: plain numbers and many lines at once give what one at a time gave."""

import time

import numpy as np

from worldframe.functions.prng import stream
from worldframe.operators import polyline, rivers


def slow_fractal(ring: np.ndarray, feature: int) -> np.ndarray:
    """The ring in arrays of two numbers, the profile by np.interp."""
    following = np.roll(ring, -1, axis=0)
    length = np.hypot(*(following - ring).T)
    draw = stream(f"0_c{feature}")
    n, k = polyline.SAMPLES, polyline.HARMONICS
    height, phase = np.array([next(draw) for _ in range(2 * k)]).reshape(k, 2).T
    wave = height @ np.cos(np.outer(np.arange(1, k + 1), 2 * np.pi * np.arange(n) / n) + 2 * np.pi * phase[:, None])
    profile = ((wave - wave.min()) / max(np.ptp(wave), 1e-9)) ** polyline.CONTRAST
    along = (np.cumsum(length) - length) / length.sum()
    fixed = (ring <= 0).any(axis=1)
    chords = [(p, q, u, v, 0 if w else polyline.DEPTH) for p, q, u, v, w in zip(ring, following, along, np.roll(along, -1), fixed & np.roll(fixed, -1), strict=True)][::-1]
    out = []
    while chords:
        p, q, u, v, depth = chords.pop()
        across = np.array([p[1] - q[1], q[0] - p[0]])
        reach = float(np.hypot(*across))
        half = (u - (0.5 - (u - v + 0.5) % 1.0) / 2) % 1.0 if v != u else u
        rough = float(np.interp(half * n, np.arange(n), profile, period=n)) if depth and reach >= polyline.MIN_EDGE else -1.0
        if rough < polyline.SMOOTH_UNDER:
            out.append(p)
            continue
        bend = (next(draw) - 0.5) * polyline.AMPLITUDE * polyline.DECAY ** (polyline.DEPTH - depth) * rough / np.sqrt(reach)
        m = (p + q) / 2 + across * bend
        chords += [(m, q, half, v, depth - 1), (p, m, u, half, depth - 1)]
    return np.array(out)


def test_fractal_ring_in_plain_numbers():
    rng = np.random.default_rng(4)
    took = [0.0, 0.0]
    for feature, n in enumerate((3, 4, 40, 90, 120, 200)):
        ring = np.stack([rng.integers(0, 900, n), rng.integers(0, 90, n)], 1).astype(float)
        ring[n // 2] = ring[n // 2 - 1]
        times, found = [time.perf_counter()], []
        for shape in (slow_fractal, polyline.fractal_ring):
            found.append(shape(ring, feature))
            times.append(time.perf_counter())
        took = [t + b - a for t, a, b in zip(took, times, times[1:], strict=False)]
        assert np.array_equal(*found)
    assert took[1] < took[0] / 3


def test_rivers_relaxed_together():
    rng = np.random.default_rng(5)
    lines = []
    for k, n in enumerate((1, 2, 3, 4, 9, 30, 2, 50)):
        anchor = rng.random(n) < 0.4
        anchor[[0, -1]] = k % 3 != 2  # lines that do not begin and end at an anchor too
        lines.append((rng.integers(0, 6, (n, 2)).astype(float), anchor, np.full(n, k)))
    line, anchor, river = (np.concatenate(x) for x in zip(*lines, strict=True))
    alone = [rivers.relax_between(p, a) for p, a, _ in lines]
    assert np.array_equal(rivers.relax_between(line, anchor, river=river), np.concatenate(alone))
    assert any(not np.array_equal(x, p) for x, (p, _, _) in zip(alone, lines, strict=True))
    assert rivers.relax_between(np.zeros((0, 2)), np.zeros(0, dtype=bool)).shape == (0, 2)
