"""Scalar functions of the map model as SQL expressions: all stay in generated JVM code."""

#: Palette stops of the thematic layers (hex, from t = 0 to 1; and (t, r, g, b)).
HEIGHT_STOPS = ("9e0142", "d33e4f", "f46d43", "fdae61", "fee08b", "ffffbf", "e6f598", "abdda4", "66c2a5", "3288bd", "5e4fa2")
TEMPERATURE_STOPS = ((0.0, 0.23, 0.30, 0.67), (0.25, 0.20, 0.63, 0.78), (0.5, 0.96, 0.96, 0.70), (0.75, 0.96, 0.55, 0.26), (1.0, 0.62, 0.04, 0.19))
#: Leading widths of a river by place along its course, over 200.
RIVER_START = (1, 1, 2, 3, 5, 8, 13, 21, 34)


def num(x: float) -> str:
    """A double literal in both Spark and ANSI dialects."""
    return f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x))


def rn(x: str, digits: int = 0) -> str:
    """Rounding with ties towards positive infinity; the result has no negative zero."""
    p = num(10**digits)
    return f"(floor(({x}) * {p} + 5e-1) / {p} + 0e0)"


def whole(x: str) -> str:
    return f"CAST(floor({x}) AS BIGINT)"


def height_display(h: str, exponent: str = "2e0", feet: bool = False) -> str:
    """Height 0..100 to the displayed height: land by a power, water by depth, 0 as the deepest."""
    metres = f"CASE WHEN {h} >= 20 THEN power({h} - 18e0, {exponent}) WHEN {h} > 0 THEN ({h} - 20e0) / {h} * 50e0 ELSE -990e0 END"
    return f"({metres}) * 3.28084e0" if feet else f"({metres})"


def linear(channel: str) -> str:
    """sRGB 0..1 to linear light."""
    return f"(CASE WHEN {channel} <= 0.04045e0 THEN {channel} / 12.92e0 ELSE power(({channel} + 0.055e0) / 1.055e0, 2.4e0) END)"


def hex_byte(text: str, at: int) -> str:
    """Value of the two hex digits of text at a place; 0 where a digit is bad."""
    digit = lambda k: f"instr('0123456789abcdef', lower(substr({text}, {at + k}, 1)))"
    a, b = digit(0), digit(1)
    there = f"length(substr({text}, {at}, 2)) = 2"
    return f"(CASE WHEN {there} AND {a} > 0 AND {b} > 0 THEN ({a} - 1) * 16 + {b} - 1 ELSE 0 END)"


def temperature_colour(t: str, channel: int) -> str:
    """Channel (1 to 3) of the five-stop ramp at 1 - t."""
    u = f"(1e0 - {t})"
    parts = []
    for a, b in zip(TEMPERATURE_STOPS, TEMPERATURE_STOPS[1:], strict=False):
        parts.append(f"WHEN {u} <= {num(b[0])} THEN {num(a[channel])} + ({num(b[channel])} - ({num(a[channel])})) * (({u} - {num(a[0])}) / {num(b[0] - a[0])})")
    return f"(CASE {' '.join(parts)} ELSE {num(TEMPERATURE_STOPS[-1][channel])} END)"


def source_width(flux: str) -> str:
    return f"least(power({flux} / 500e0, 0.9e0), 1e0)"


def river_offset(i: str, flux: str, factor: str, start: str) -> str:
    stops = " ".join(f"WHEN {k} THEN {num(v / 200)}" for k, v in enumerate(RIVER_START))
    return f"(CASE WHEN {i} = 0 THEN {start} ELSE {factor} * ({i} / 200e0 + (CASE least({i}, 8) {stops} END) + least(power({flux} / 500e0, 0.7e0), 1e0)) + {start} END)"


def river_width(offset: str) -> str:
    return f"power({offset} / 1.5e0, 1.8e0)"


def escape_xml(text: str) -> str:
    for a, b in (("'&'", "&amp;"), ("'<'", "&lt;"), ("'>'", "&gt;"), ("'\"'", "&quot;"), ("chr(39)", "&apos;")):
        text = f"replace({text}, {a}, '{b}')"
    return text


def nice_spacing(extent: str, parts: int) -> str:
    """1, 2, 5 or 10 times a power of ten, by how many such powers extent / parts is: under 1.5, 3.5, 7.5 or more (fixed values); 1 at least."""
    raw = f"({extent} / {num(parts)})"
    power = f"power(1e1, floor(log10({raw})))"
    return f"greatest(1e0, CASE WHEN {raw} < 1.5e0 * {power} THEN {power} WHEN {raw} < 3.5e0 * {power} THEN 2e0 * {power} WHEN {raw} < 7.5e0 * {power} THEN 5e0 * {power} ELSE 1e1 * {power} END)"


def edge_point(x: str, y: str, width: str, height: str) -> tuple[str, str]:
    """The nearest point on the map's edge; on ties top before bottom, left and right."""
    below, beyond = f"({height} - {y})", f"({width} - {x})"
    top = f"{y} <= {below} AND {y} <= {x} AND {y} <= {beyond}"
    bottom = f"{below} <= {x} AND {below} <= {beyond}"
    return (f"CASE WHEN {top} OR {bottom} THEN {x} WHEN {x} <= {beyond} THEN 0e0 ELSE {width} END", f"CASE WHEN {top} THEN 0e0 WHEN {bottom} THEN {height} ELSE {y} END")
