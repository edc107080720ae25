"""View boxes of map windows as column expressions over a table of views.

A view is a row: cx, cy (centre), tall (visible height), aspect (width over height) and its map's box x0, y0, x1, y1. Every
operation adds or replaces columns, so any number of views is moved in one projection.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worldframe.functions import expressions as E

#: Least and most visible height, room around a framed box, share of the map a view may leave it by.
LEAST, MOST, PADDING, MARGIN = 4.0, 1e6, 1.03, 0.3


def wide() -> Column:
    return F.expr("tall * aspect")


def on_screen(views: DataFrame) -> DataFrame:
    """sx, sy: where the world point (wx, wy) of each row lies on its screen of sw by sh; 0, 0 on a screen without extent."""
    return views.withColumns({c: F.expr(f"CASE WHEN least(sw, sh) > 0 THEN {size} * (0.5e0 + ({at} - {centre}) / {span}) ELSE 0e0 END") for c, size, at, centre, span in (("sx", "sw", "wx", "cx", "(tall * aspect)"), ("sy", "sh", "wy", "cy", "tall"))})


def in_world(views: DataFrame) -> DataFrame:
    """wx, wy: the world point under (sx, sy); the view's centre on a screen without extent."""
    return views.withColumns({c: F.expr(f"{centre} + CASE WHEN least(sw, sh) > 0 THEN ({at} / {size} - 0.5e0) * {span} ELSE 0e0 END") for c, size, at, centre, span in (("wx", "sw", "sx", "cx", "(tall * aspect)"), ("wy", "sh", "sy", "cy", "tall"))})


def kept(views: DataFrame) -> DataFrame:
    """The views, their centres within MARGIN of the map and their heights within its measure."""

    def centre(c: str, lo: str, hi: str, span: str) -> Column:
        # The centre's range is the widened map less half a view on each side; a range turned over leaves the map's middle.
        low, high = f"({lo} - {MARGIN}e0 * ({hi} - {lo}) + {span} / 2e0)", f"({hi} + {MARGIN}e0 * ({hi} - {lo}) - {span} / 2e0)"
        return F.expr(f"CASE WHEN {low} >= {high} THEN ({lo} + {hi}) / 2e0 ELSE greatest({low}, least({high}, {c})) END")

    floor = f"greatest({LEAST}e0, 5e-3 * least(x1 - x0, y1 - y0))"
    return views.withColumns({
        "cx": centre("cx", "x0", "x1", "(tall * aspect)"), "cy": centre("cy", "y0", "y1", "tall"),
        "tall": F.expr(f"greatest({floor}, least(1.2e0 * greatest(x1 - x0, y1 - y0, {floor}), tall))"),
    })


def zoomed(views: DataFrame) -> DataFrame:
    """Each view magnified by its factor about the point (sx, sy) of its screen, which keeps showing what it showed."""
    tall = f"greatest({LEAST}e0, least({MOST}e0, tall / factor))"
    seen = "CASE WHEN least(sw, sh) > 0 THEN {at} / {size} - 0.5e0 ELSE 0e0 END"
    x, y = seen.format(at="sx", size="sw"), seen.format(at="sy", size="sh")
    return kept(views.withColumns({"cx": F.expr(f"cx + ({x}) * aspect * (tall - {tall})"), "cy": F.expr(f"cy + ({y}) * (tall - {tall})"), "tall": F.expr(tall)}))


def panned(views: DataFrame) -> DataFrame:
    """Each view dragged by dx, dy pixels of its screen."""
    moved = views.withColumns({"cx": F.expr("CASE WHEN least(sw, sh) > 0 THEN cx - dx * tall * aspect / sw ELSE cx END"), "cy": F.expr("CASE WHEN least(sw, sh) > 0 THEN cy - dy * tall / sh ELSE cy END")})
    return kept(moved)


def framed(boxes: DataFrame) -> DataFrame:
    """A view of each box (x0, y0, x1, y1, aspect); a box without extent or end becomes that of an empty map, 1000 by 1000."""
    real = "coalesce(x1 > x0 AND abs(x0) < double('inf') AND abs(y0) < double('inf') AND abs(x1) < double('inf') AND abs(y1) < double('inf'), false)"
    box = boxes.withColumns({c: F.expr(f"CASE WHEN {real} THEN double({c}) ELSE {v} END") for c, v in (("x0", "0e0"), ("y0", "0e0"), ("x1", "1e3"), ("y1", "1e3"))})
    need = f"{PADDING}e0 * greatest(y1 - y0, 1e0, greatest(x1 - x0, 1e0) / greatest(aspect, 1e-6))"
    return kept(box.withColumns({"cx": F.expr("(x0 + x1) / 2e0"), "cy": F.expr("(y0 + y1) / 2e0"), "tall": F.expr(f"greatest({LEAST}e0, least({MOST}e0, {need}))")}))


def presets_shown(shown: DataFrame, presets: DataFrame) -> DataFrame:
    """id, preset: the first preset that has just the layers that an id shows, `custom` if none has. shown: id, layer; presets: preset, k (their order), layer.

    Sets are compared as sorted arrays, which are as long as there are layers at most.
    """
    layers = F.sort_array(F.collect_set("layer")).alias("layers")
    sets = presets.groupBy("preset", "k").agg(layers).groupBy("layers").agg(F.min_by("preset", "k").alias("preset"))
    return shown.groupBy("id").agg(layers).join(sets, "layers", "left").select("id", F.coalesce("preset", F.lit("custom")).alias("preset"))


def grid_lines(cells: DataFrame, parts: int) -> DataFrame:
    """axis, k, coord, low, high: lines at round distances across the box of all cells, about so many along its shorter side; none if the box has no area."""
    box = cells.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).where("x1 > x0 AND y1 > y0")
    box = box.withColumn("g", F.greatest(F.expr(E.nice_spacing("least(x1 - x0, y1 - y0)", parts)), F.lit(1.0)))
    sides = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"{a}0").alias("begin"), F.col(f"{a}1").alias("upto"), F.col(f"{b}0").alias("low"), F.col(f"{b}1").alias("high")) for a, b in ("xy", "yx")])
    each = box.select("g", F.explode(sides).alias("s")).select("g", "s.*").withColumn("start", F.ceil(F.col("begin") / F.col("g")) * F.col("g"))
    count = F.floor((F.col("upto") - F.col("start")) / F.col("g")).cast("long")
    return each.where("start <= upto").select("axis", F.explode(F.sequence(F.lit(0).cast("long"), count)).alias("k"), "g", "start", "low", "high").select("axis", "k", (F.col("start") + F.col("k") * F.col("g")).alias("coord"), "low", "high")
