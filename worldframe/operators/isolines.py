"""Closed outlines of regions over any polygon mesh, ordered by list ranking; no task holds a region or a ring.

A side of a cell is a boundary if no cell of the same region lies beyond it. The side after it is found by turning about its end: the next side of
the same cell, or while that is inner, the next side of the cell beyond. Then pointers double around each ring and carry the
least side met and the distance to it, so that the rounds grow with the logarithm of the longest ring and all rings are ranked at once.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worldframe.operators.graph import BLOCK_BITS
from worldframe.plans.lineage import cut

#: Sides that a cell may have; a side's number is its cell's id times this, plus its place.
SIDES = 1024


def sides(rings: DataFrame, regions: DataFrame) -> DataFrame:
    """side, cell_id, region, a, b, onward (the cell's next side), inner (the next side of the cell beyond, if that is of the region), beyond (its cell).

    rings: cell_id, pos, vertex, a cell's corners in order, all cells in the same sense; regions: cell_id, region; cells without one only lie beyond others.
    """
    around = Window.partitionBy("cell_id").orderBy("pos")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    number = F.col("cell_id") * SIDES + F.col("pos")
    each = rings.select(
        "cell_id", number.alias("side"), F.col("vertex").alias("a"),
        F.coalesce(F.lead("vertex").over(around), F.first("vertex").over(whole)).alias("b"), F.coalesce(F.lead(number).over(around), F.first(number).over(whole)).alias("onward"),
    )
    every = each.join(regions.select("cell_id", "region"), "cell_id", "left")
    # A side and the one against it fall together: as many as cells meet there, two in a plain mesh.
    pair = every.select(F.struct("side", "region", "a", "b", "onward").alias("s"), F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).groupBy("low", "high").agg(F.collect_list("s").alias("all"))
    each = pair.select("all", F.explode("all").alias("s")).where("s.region IS NOT NULL")
    met = each.select("s.*", F.explode_outer(F.filter("all", lambda o: (o["a"] == F.col("s.b")) & (o["b"] == F.col("s.a")))).alias("o"))
    cell = lambda side: F.floor(F.col(side) / SIDES).cast("long")
    return met.select("side", cell("side").alias("cell_id"), "region", "a", "b", "onward", F.when(F.col("o.region") == F.col("region"), F.col("o.onward")).alias("inner"), cell("o.side").alias("beyond"))


def following(every: DataFrame) -> DataFrame:
    """side, next: the boundary side after each boundary side; as many rounds as inner sides meet in a corner."""
    inner = every.where("inner IS NOT NULL").select(F.col("side").alias("next"), "inner")
    open_ = every.where("inner IS NULL").select("side", F.col("onward").alias("next"))
    found = None
    while not open_.isEmpty():
        turned = cut(open_.join(inner, "next", "left"))
        ends = turned.where("inner IS NULL").select("side", "next")
        found = ends if found is None else found.unionByName(ends)
        open_ = turned.where("inner IS NOT NULL").select("side", F.col("inner").alias("next"))
    return open_ if found is None else found


def _block_rings(part: pd.DataFrame) -> pd.DataFrame:
    """side, next, ring, pos, sides: rings that lie inside the block are ranked, sides of others have no ring."""
    part = part.sort_values("side")
    side, onward = part["side"].to_numpy(), part["next"].to_numpy()
    at = np.minimum(np.searchsorted(side, onward), len(side) - 1)
    jump = np.where(side[at] == onward, at, -1)
    # Sides from which a way leaves the block are on no ring inside it. If no way leaves after so many sides to twice as many, none does later.
    leads, left = jump, -1
    while (gone := int((leads < 0).sum())) != left:
        leads, left = np.where(leads >= 0, leads[leads], -1), gone
    lost = leads < 0
    kept = np.flatnonzero(~lost)
    place = np.full(len(side), -1)
    place[kept] = np.arange(len(kept))
    to, ring, ahead, size = place[jump[kept]], np.arange(len(kept)), np.zeros(len(kept), dtype=np.int64), 1
    while ((low := ring[to]) < ring).any():
        ring, ahead = np.minimum(ring, low), np.where(low < ring, ahead[to] + size, ahead)
        to, size = to[to], 2 * size
    length = np.bincount(ring, minlength=len(kept))[ring] if len(kept) else ahead
    out = pd.DataFrame({"side": side, "next": onward})
    for name, found in (("ring", side[kept][ring]), ("pos", (length - ahead) % np.maximum(length, 1)), ("sides", length)):
        values = np.zeros(len(side), dtype=np.int64)
        values[kept] = found
        out[name] = pd.arrays.IntegerArray(values, lost.copy())
    return out


def ranked(links: DataFrame) -> DataFrame:
    """side, ring (the least side of the ring), pos (sides after it, from 0), sides (of the ring); links: side, next, a permutation.

    Rings inside a block of consecutive cells are ranked in its task; the rounds carry those that cross blocks.
    """
    near = cut(links.groupBy(F.shiftright(F.floor(F.col("side") / SIDES).cast("long"), BLOCK_BITS)).applyInPandas(_block_rings, "side long, next long, ring long, pos long, sides long"))
    at, size = cut(near.where("ring IS NULL").select("side", F.col("next").alias("jump"), F.col("side").alias("ring"), F.lit(0).cast("long").alias("ahead"))), 1
    while not at.isEmpty():
        far = at.select(F.col("side").alias("jump"), F.col("jump").alias("to"), F.col("ring").alias("low"), F.col("ahead").alias("more"))
        lower = F.col("low") < F.col("ring")
        at = cut(at.join(far, "jump").select("side", F.col("to").alias("jump"), F.least("ring", "low").alias("ring"), F.when(lower, F.col("more") + size).otherwise(F.col("ahead")).alias("ahead"), lower.alias("moved")))
        size *= 2
        # If no run of so many sides meets a lower one, every run has seen its whole ring.
        if at.where("moved").isEmpty():
            break
    length = at.groupBy("ring").agg((F.max("ahead") + 1).alias("sides"))
    across = at.join(length, "ring").select("side", "ring", ((F.col("sides") - F.col("ahead")) % F.col("sides")).alias("pos"), "sides")
    return near.where("ring IS NOT NULL").select("side", "ring", "pos", "sides").unionByName(across)


def outlines(rings: DataFrame, regions: DataFrame) -> DataFrame:
    """region, ring, pos, vertex, onward (the next vertex), beyond (the cell on the other side, null at the mesh's end) of all outer rings and holes."""
    every = cut(sides(rings, regions))
    order = ranked(following(every))
    edge = every.where("inner IS NULL").select("side", "region", F.col("a").alias("vertex"), F.col("b").alias("onward"), "beyond")
    return edge.join(order, "side").select("region", "ring", "pos", "vertex", "onward", "beyond")


def without_lakes(outline: DataFrame, places: DataFrame, features: DataFrame) -> DataFrame:
    """outline without the rings that part a region from a lake which lies wholly inside it: beyond all their sides is that one lake, and beyond none of the lake's other sides another region.

    places: cell_id, feature; features: id, kind. Rings that are kept are whole.
    """
    lakes = features.where("kind = 'lake'").select(F.col("id").alias("lake"))
    over = outline.join(places.select(F.col("cell_id").alias("beyond"), F.col("feature").alias("lake")), "beyond", "left").join(lakes.withColumn("wet", F.lit(True)), "lake", "left")
    each = over.select("region", "ring", F.when(F.col("wet"), F.col("lake")).alias("lake"))
    ring = each.groupBy("ring").agg(F.min("lake").alias("lake"), F.max("lake").alias("most"), F.count("*").alias("sides"), F.count("lake").alias("wet"))
    one = ring.where("sides = wet AND lake = most").select("ring", "lake")
    shared = each.where("lake IS NOT NULL").groupBy("lake").agg(F.min("ring").alias("first"), F.max("ring").alias("last")).where("first = last")
    return outline.join(one.join(shared, "lake").select("ring"), "ring", "left_anti")


def areas(outline: DataFrame, vertices: DataFrame) -> DataFrame:
    """region, ring, sides, area (twice the signed one; a hole's sign is the other one); vertices: vertex, x, y."""
    at = outline.join(vertices.select("vertex", "x", "y"), "vertex").join(vertices.select(F.col("vertex").alias("onward"), F.col("x").alias("nx"), F.col("y").alias("ny")), "onward")
    return at.groupBy("region", "ring").agg(F.count("*").alias("sides"), F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y")).alias("area"))
