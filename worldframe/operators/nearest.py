"""Nearest cell within a radius: points and cells meet in square buckets as wide as the radius."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nearest_cell(points: DataFrame, cells: DataFrame, radius: float = 20.0, id_col: str = "event_id") -> DataFrame:
    """id_col, cell_id, d2 of each point that has a cell at a squared distance under radius squared; ties to the least id.

    Each point probes the three by three buckets around it, which hold all cells that near; the join is an equi-join.
    """
    bucket = lambda c: F.floor(F.col(c) / radius).cast("long")
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    probes = points.select(id_col, "x", "y", F.explode(near).alias("n")).select(id_col, "x", "y", (bucket("x") + F.col("n.i")).alias("bx"), (bucket("y") + F.col("n.j")).alias("by"))
    held = cells.select("cell_id", F.col("x").alias("qx"), F.col("y").alias("qy"), bucket("x").alias("bx"), bucket("y").alias("by"))
    d2 = (F.col("x") - F.col("qx")) ** 2 + (F.col("y") - F.col("qy")) ** 2
    met = probes.join(held, ["bx", "by"]).withColumn("d2", d2).where(F.col("d2") < radius * radius)
    best = met.groupBy(id_col).agg(F.min(F.struct("d2", "cell_id")).alias("best"))
    return best.select(id_col, F.col("best.cell_id").alias("cell_id"), F.expr("floor(best.d2 * 1e4 + 5e-1) / 1e4 + 0e0").alias("d2"))
