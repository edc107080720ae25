"""Height colours, tabulated: heights are 0 to 100, so the ramp is a table of 101 rows to join."""

from worldframe.functions.expressions import HEIGHT_STOPS


def spline(t: float, values: list[float]) -> float:
    """Cubic B-spline through equally spaced control values; the ends are exact, neighbours beyond them repeat."""
    n = len(values) - 1
    if t <= 0 or t >= 1:
        return values[0 if t <= 0 else n]
    i = min(int(t * n), n - 1)
    u = t * n - i
    at = [values[min(max(j, 0), n)] for j in range(i - 1, i + 3)]
    weights = ((1 - u) ** 3, 4 - 6 * u**2 + 3 * u**3, 1 + 3 * u + 3 * u**2 - 3 * u**3, u**3)
    return sum(w * v for w, v in zip(weights, at, strict=True)) / 6


def height_colours() -> list[tuple[int, float, float, float]]:
    """(height, r, g, b) in linear light, to six digits."""
    channels = [[int(s[2 * k : 2 * k + 2], 16) / 255 for s in HEIGHT_STOPS] for k in range(3)]
    out = []
    for h in range(101):
        t = min(max(1 - (h - 5 if h < 20 else h) / 100, 0.0), 1.0)
        rgb = (spline(t, c) for c in channels)
        out.append((h, *(round(c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4, 6) for c in rgb)))
    return out
