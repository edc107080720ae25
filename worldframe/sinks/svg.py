"""Maps as SVG lines and worlds as Parquet tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worldframe.functions import expressions as E
from worldframe.functions.palette import height_colours


#: Parts of a drawing in their order; the ids within a part order its lines.
HEAD, CELLS, RIVERS, BORDERS, TOWNS, TAIL = range(6)
#: Strokes and fonts of the drawing.
_POLYGON_END, _RIVER_END = '" stroke="none" opacity="0.95"/>', '" stroke-linecap="round" stroke-linejoin="round"/>'
_BORDER_END, _TOWN = '" fill="none" stroke="#e63333" stroke-width="1.5" opacity="0.8"/>', '" fill="white" stroke="black" stroke-width="0.5"/>'
_LABEL = '" font-size="8" fill="white" stroke="black" stroke-width="0.3" font-family="sans-serif" text-anchor="start" dy=".3em">'


def height_fills() -> list[str]:
    """Fill of each height: the linear channels written as they are, cut off to bytes."""
    return ["#" + "".join(f"{int(min(max(v, 0.0), 1.0) * 255):02x}" for v in rgb) for _, *rgb in height_colours()]


def _tenth(x: Column) -> Column:
    """To one digit, halves up: the same text whatever engine formats it."""
    return F.format_string("%.1f", F.floor(x * 10 + 0.5) / 10)


def svg_lines(cells: DataFrame, rings: DataFrame, vertices: DataFrame, paths: DataFrame, rivers: DataFrame, edges: DataFrame, burgs: DataFrame, width: float, height: float) -> DataFrame:
    """layer, id, pos, line: the lines of a drawing; in this order they are one SVG file.

    Background, a polygon for each cell (cells: cell_id, x, y, height, state; rings: cell_id, pos, vertex; vertices: vertex, x, y), a line for each river (paths: river, pos,
    cell_id, a point a line, at 0, 0 for a cell that is none; rivers: river, discharge), the borders of states as one path with a line for each cell, and towns with labels. No element is gathered but a cell's polygon and its borders.
    """
    order = lambda layer, id_, pos, line: (F.lit(layer).cast("long").alias("layer"), F.lit(id_).cast("long").alias("id") if isinstance(id_, int) else id_.alias("id"), F.lit(pos).cast("long").alias("pos") if isinstance(pos, int) else pos.alias("pos"), line.alias("line"))
    spark = cells.sparkSession
    one = spark.range(1)
    w, h = f"{width:g}", f"{height:g}"
    head = one.select(*order(HEAD, 0, 0, F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" width="{w}" height="{h}" viewBox="0 0 {w} {h}">'))).unionByName(
        one.select(*order(HEAD, 0, 1, F.lit(f'<rect width="{w}" height="{h}" fill="#1a3a5c"/>')))
    )
    tail = one.select(*order(TAIL, 0, 0, F.lit("</svg>")))
    corner = rings.join(vertices, "vertex").select("cell_id", F.struct("pos", F.concat(_tenth(F.col("x")), F.lit(","), _tenth(F.col("y"))).alias("t")).alias("c"))
    shape = corner.groupBy("cell_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: c["t"]), " ").alias("points"))
    fill = F.element_at(F.array(*map(F.lit, height_fills())), F.greatest(F.least(F.col("height"), F.lit(100)), F.lit(0)).cast("int") + 1)
    polygons = cells.select("cell_id", "height").join(shape, "cell_id").select(*order(CELLS, F.col("cell_id"), 0, F.concat(F.lit('<polygon points="'), "points", F.lit('" fill="'), fill, F.lit(_POLYGON_END))))
    at = cells.select("cell_id", "x", "y", "state")
    steps = paths.join(at.drop("state"), "cell_id", "left").select("river", "pos", F.concat(_tenth(F.coalesce("x", F.lit(0.0))), F.lit(","), _tenth(F.coalesce("y", F.lit(0.0)))).alias("t"))
    drawn = rivers.join(paths.groupBy("river").agg(F.max("pos").alias("last")), "river")
    broad = F.least(F.greatest(F.col("discharge") / 5000, F.lit(0.5)), F.lit(4.0))
    lines = drawn.select(*order(RIVERS, F.col("river"), -1, F.lit('<polyline points="')))
    lines = lines.unionByName(steps.join(drawn.select("river"), "river", "left_semi").select(*order(RIVERS, F.col("river"), F.col("pos"), F.col("t"))))
    lines = lines.unionByName(drawn.select(*order(RIVERS, F.col("river"), F.col("last") + 1, F.concat(F.lit('" fill="none" stroke="#4488cc" stroke-width="'), _tenth(broad), F.lit(_RIVER_END)))))
    a, b = (at.select(*(F.col(c).alias(f"{c}_{n}") for c in at.columns)) for n in ("a", "b"))
    pairs = edges.where("src < dst").join(a, F.col("src") == F.col("cell_id_a")).join(b, F.col("dst") == F.col("cell_id_b")).where("state_a <> state_b")
    piece = F.struct("dst", F.concat(F.lit("M "), _tenth(F.col("x_a")), F.lit(","), _tenth(F.col("y_a")), F.lit(" L "), _tenth(F.col("x_b")), F.lit(","), _tenth(F.col("y_b"))).alias("t"))
    border = pairs.groupBy("src").agg(F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda c: c["t"]), " ").alias("d"))
    ends = cells.agg(F.min("cell_id").alias("lo"), F.max("cell_id").alias("hi"))
    borders = border.select(*order(BORDERS, F.col("src"), 0, F.col("d")))
    borders = borders.unionByName(ends.select(*order(BORDERS, F.col("lo") - 1, 0, F.lit('<path d="')))).unionByName(ends.select(*order(BORDERS, F.col("hi") + 1, 0, F.lit(_BORDER_END))))
    town = burgs.where("id <> 0 AND NOT removed").join(at.withColumnRenamed("cell_id", "cell").drop("state"), "cell").withColumn("r", F.when(F.col("is_capital"), 5).otherwise(3))
    dots = town.select(*order(TOWNS, F.col("id"), 0, F.concat(F.lit('<circle cx="'), _tenth(F.col("x")), F.lit('" cy="'), _tenth(F.col("y")), F.lit('" r="'), F.col("r").cast("string"), F.lit(_TOWN))))
    labels = town.select(*order(TOWNS, F.col("id"), 1, F.concat(F.lit('<text x="'), _tenth(F.col("x") + F.col("r") + 2), F.lit('" y="'), _tenth(F.col("y")), F.lit(_LABEL), F.expr(E.escape_xml("name")), F.lit("</text>"))))
    out = head
    for more in (polygons, lines, borders, dots, labels, tail):
        out = out.unionByName(more)
    return out.where("line IS NOT NULL AND id IS NOT NULL")


def write_svg(lines: DataFrame, path: str) -> None:
    """The lines as text files under path; the files in the order of their names are the drawing. Ranges of lines are sorted by their own tasks."""
    lines.repartitionByRange("layer", "id", "pos").sortWithinPartitions("layer", "id", "pos").select("line").write.text(path)


def save_world(tables: dict[str, DataFrame], path: str) -> None:
    """Every table of a world as Parquet under path, and a table of their names and columns to read first."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    rows = [(name, ",".join(df.columns)) for name, df in tables.items()]
    spark.createDataFrame(rows, "name string, columns string").coalesce(1).write.mode("overwrite").parquet(f"{path}/_metadata_table")


def load_world(spark, path: str) -> dict[str, DataFrame]:
    return {r["name"]: spark.read.parquet(f"{path}/{r['name']}") for r in spark.read.parquet(f"{path}/_metadata_table").collect()}
