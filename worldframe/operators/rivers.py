"""Rivers as entities: their cells, widths, outlets and drawn shapes, composed of windows, equi-joins and pointer doubling."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worldframe.functions import expressions as E
from worldframe.operators import graph, hydrology, polyline
from worldframe.plans.lineage import cut
from worldframe.plans.relational import PLANS

#: Fixed value: flux that forms a river.
MIN_FLUX = 30


def streams(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """cell_id, flux, river: land cells and the water that rivers end in. A river is a drainage tree, named by its end plus one; 0 under MIN_FLUX."""
    pointers = cut(graph.down(cells, edges))
    flux = graph.flow(cells, edges, pointers=pointers)
    ends = graph.roots(pointers).withColumnRenamed("node", "cell_id")
    land = cut(flux.join(ends, "cell_id", "left").select("cell_id", "flux", F.coalesce("root", "cell_id").alias("root")))
    water = land.where(f"flux >= {MIN_FLUX}").select(F.col("root").alias("cell_id")).distinct().join(cells.where("height < 20").select("cell_id"), "cell_id", "left_semi")
    rows = land.selectExpr("cell_id", "flux", f"CASE WHEN flux >= {MIN_FLUX} THEN root + 1 ELSE 0 END AS river")
    return rows.unionByName(water.selectExpr("cell_id", "0L AS flux", "cell_id + 1 AS river"))


def outlets(cells: DataFrame, edges: DataFrame, lakes: DataFrame) -> DataFrame:
    """lake, out_cell, lake_cell: the lowest shore of each lake and the first of its neighbours that is the lake's.

    cells: cell_id, height, feature; lakes: id.
    """
    low = graph.shores(cells, edges).join(lakes.select(F.col("id").alias("feature")), "feature")
    return low.select(F.col("feature").alias("lake"), F.col("cell_id").alias("out_cell"), F.col("beside").alias("lake_cell"))


def drains(last: DataFrame, places: DataFrame, features: DataFrame, outflow: DataFrame) -> DataFrame:
    """river, drain: the ocean, or the lake without an outlet, where a river ends after all lakes it runs through; null on land or in a cycle.

    last: river, cell_id; places: cell_id, feature; features: id, kind; outflow: lake, river (the river that leaves it).
    """
    known = places.join(features.select(F.col("id").alias("feature"), "kind"), "feature").select("cell_id", "feature", "kind")
    on = outflow.select(F.col("lake").alias("feature"), F.col("river").alias("to"))
    step = last.join(known, "cell_id", "left").join(on, "feature", "left").withColumn("to", F.when(F.col("kind") == "lake", F.col("to")))
    at = cut(step.selectExpr("river", "to", "CASE WHEN to IS NULL AND kind IN ('lake', 'ocean') THEN feature END AS drain"))
    # Round k settles chains of up to 2^k rivers. Behind every long chain are all shorter ones: a round that settles none leaves circles only.
    settled, more = at.where("to IS NULL").count(), True
    while more:
        after = at.select(F.col("river").alias("to"), F.col("to").alias("next"), "drain")
        onward = at.where("to IS NOT NULL").select("river", "to").join(after, "to", "left").select("river", F.col("next").alias("to"), "drain")
        at = cut(at.where("to IS NULL").unionByName(onward))
        now = at.where("to IS NULL").count()
        settled, more = now, now > settled
    return at.selectExpr("river", "CASE WHEN to IS NULL THEN drain END AS drain")


def cell_rings(rings: DataFrame, vertices: DataFrame) -> DataFrame:
    """cell_id, pos, x, y: the corners of every cell in ring order; a vertex that is missing is left out."""
    return rings.join(vertices, "vertex").select("cell_id", "pos", "x", "y")


def perimeters(features: DataFrame, vertices: DataFrame) -> DataFrame:
    """id, pos, x, y: the vertices on each feature's perimeter (id, vertices); missing ones are left out, pos keeps the place in the list."""
    listed = features.select("id", F.posexplode("vertices").alias("pos", "vertex"))
    return listed.join(vertices, "vertex").select("id", F.col("pos").cast("long").alias("pos"), "x", "y")


def anchors(paths: DataFrame, cells: DataFrame, width: float, height: float) -> DataFrame:
    """river, pos, cell_id, x, y: the points of river paths (river, pos, cell_id). A null cell is the map's edge: the nearest edge of the cell before it."""
    at = paths.join(cells.select("cell_id", F.col("x").alias("px"), F.col("y").alias("py")), "cell_id", "left")
    w = "OVER (PARTITION BY river ORDER BY pos)"
    held = at.selectExpr("*", f"last_value(px) IGNORE NULLS {w} AS hx", f"last_value(py) IGNORE NULLS {w} AS hy").where("hx IS NOT NULL AND (cell_id IS NULL OR px IS NOT NULL)")
    ex, ey = E.edge_point("hx", "hy", E.num(width), E.num(height))
    return held.selectExpr("river", "pos", "cell_id", f"CASE WHEN cell_id IS NULL THEN {ex} ELSE px END AS x", f"CASE WHEN cell_id IS NULL THEN {ey} ELSE py END AS y")


def clipped(points: DataFrame, cells: DataFrame, corners: DataFrame) -> DataFrame:
    """river, pos, x, y: rivers cut where their last step from land into water enters that cell's ring; others stay whole.

    points: river, pos, cell_id, x, y; cells: cell_id, height; corners: cell_id, pos, x, y.
    """
    wet = points.join(cells.select("cell_id", (F.col("height") < 20).alias("wet")), "cell_id", "left")
    w = "OVER (PARTITION BY river ORDER BY pos)"
    steps = wet.selectExpr("river", "pos", "x", "y", "wet", f"lead(wet) {w} AS to_wet", f"lead(pos) {w} AS to_pos", f"lead(cell_id) {w} AS mouth", f"lead(x) {w} AS wx", f"lead(y) {w} AS wy")
    enters = steps.where("NOT wet AND to_wet").groupBy("river").agg(F.max(F.struct("pos", "to_pos", "mouth", "x", "y", "wx", "wy")).alias("s")).select("river", "s.*")
    r = "OVER (PARTITION BY cell_id ORDER BY pos)"
    whole = "OVER (PARTITION BY cell_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    mouths = corners.join(enters.select(F.col("mouth").alias("cell_id")).distinct(), "cell_id", "left_semi")
    sides = mouths.selectExpr("cell_id AS mouth", "pos AS side", "x AS ax", "y AS ay", f"coalesce(lead(x) {r}, first_value(x) {whole}) AS bx", f"coalesce(lead(y) {r}, first_value(y) {whole}) AS bv")
    met = enters.drop("pos").join(sides, "mouth").selectExpr("*", "(wx - x) * (bv - ay) - (wy - y) * (bx - ax) AS d")
    met = met.where("abs(d) >= 1e-9").selectExpr("*", "((ax - x) * (bv - ay) - (ay - y) * (bx - ax)) / d AS t", "((ax - x) * (wy - y) - (ay - y) * (wx - x)) / d AS u")
    hit = met.where("t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1").selectExpr("river", "to_pos", "side", "x + t * (wx - x) AS hx", "y + t * (wy - y) AS hy", "abs(t * (wx - x)) + abs(t * (wy - y)) AS far")
    best = hit.groupBy("river").agg(F.min(F.struct("far", "side", "to_pos", "hx", "hy")).alias("h")).select("river", "h.to_pos", "h.hx", "h.hy")
    kept = points.join(best, "river", "left").where("to_pos IS NULL OR pos <= to_pos")
    return kept.selectExpr("river", "pos", "CASE WHEN pos = to_pos THEN hx ELSE x END AS x", "CASE WHEN pos = to_pos THEN hy ELSE y END AS y")


def relax_between(line: np.ndarray, anchor: np.ndarray, passes: int = 4, river: np.ndarray | None = None) -> np.ndarray:
    """Flip the points between two anchors over the anchors' chord where that makes the three corners about them less acute; all of a pass at once.

    river: whose point each is, if there are several lines, one after another.
    """
    n = len(line)
    at = np.arange(n)
    opens = np.ones(n, dtype=bool) if river is None else np.append(True, river[1:] != river[:-1])[:n]
    opens[1:] &= river is not None
    first = np.maximum.accumulate(np.where(opens, at, 0))
    end = np.append(np.minimum.accumulate(np.where(opens, at, n)[::-1])[::-1], n)[1:]
    before = np.maximum.accumulate(np.where(anchor, at, -1))
    after = np.minimum.accumulate(np.where(anchor, at, n)[::-1])[::-1]
    free = at[~anchor & (before >= first) & (after < end) & (at > first) & (at < end - 1)]
    first, end = first[free], end[free]

    def sharp(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        u, v = a - b, c - b
        size = np.sqrt((u * u).sum(axis=1) * (v * v).sum(axis=1))
        return np.clip(np.divide((u * v).sum(axis=1), size, out=np.zeros(len(u)), where=size > 0), 0, None)

    for _ in range(passes if len(free) else 0):
        p, chord = line[before[free]], line[after[free]] - line[before[free]]
        size = (chord * chord).sum(axis=1)
        along = np.divide(((line[free] - p) * chord).sum(axis=1), size, out=np.zeros(len(free)), where=size > 0)
        flipped = np.where((size > 0)[:, None], 2 * (p + along[:, None] * chord) - line[free], line[free])
        left2, left, right, right2 = line[np.maximum(free - 2, 0)], line[free - 1], line[free + 1], line[np.minimum(free + 2, n - 1)]
        old, new = ((free > first + 1) * sharp(left2, left, m) + sharp(left, m, right) + (free < end - 2) * sharp(m, right, right2) for m in (line[free], flipped))
        better = new < old - 1e-6
        if not better.any():
            break
        line = line.copy()
        line[free[better]] = flipped[better]
    return line


def shapes(paths: DataFrame, rivers: DataFrame, cells: DataFrame, corners: DataFrame, width: float, height: float, km_per_px: float = 1.0) -> DataFrame:
    """river, pos, lx, ly, rx, ry: the banks of every river of two points or more, clipped at the coast, meandering and smoothed.

    paths: river, pos, cell_id; rivers: river, discharge, width_factor, source_width. A river is the unit that meets in one task.
    """
    line = clipped(anchors(paths, cells, width, height), cells, corners)
    w = "OVER (PARTITION BY river ORDER BY pos)"
    line = line.selectExpr("river", f"row_number() {w} - 1 AS pos", "x", "y", "count(*) OVER (PARTITION BY river) AS n").where("n >= 2").selectExpr("river", "CAST(pos AS BIGINT) AS pos", "x", "y")
    bent = polyline.meander(line, id_col="river").selectExpr("river", "CAST(row_number() OVER (PARTITION BY river ORDER BY pos, part) - 1 AS BIGINT) AS pos", "x", "y", "part = 0 AS anchor")

    def relax(part: pd.DataFrame) -> pd.DataFrame:
        out = relax_between(part[["x", "y"]].to_numpy(float), part["anchor"].to_numpy(bool), river=part["river"].to_numpy())
        return pd.DataFrame({"river": part["river"].to_numpy(), "pos": part["pos"].to_numpy(), "x": out[:, 0], "y": out[:, 1]})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rivers of a batch together; the last may go on in the next."""
        kept = None
        for part in parts:
            part = part if kept is None else pd.concat([kept, part], ignore_index=True)
            last = part["river"].to_numpy() == part["river"].iloc[-1] if len(part) else np.zeros(0, dtype=bool)
            kept = part[last]
            if not last.all():
                yield relax(part[~last])
        if kept is not None and len(kept):
            yield relax(kept)

    dealt = bent.repartition("river").sortWithinPartitions("river", "pos")
    calm = dealt.mapInPandas(run, "river long, pos long, x double, y double")
    smooth = polyline.catmull_rom(calm, 4, "river").selectExpr("river", "CAST(row_number() OVER (PARTITION BY river ORDER BY pos, part) - 1 AS BIGINT) AS pos", "x", "y", "count(*) OVER (PARTITION BY river) AS n")
    known = rivers.selectExpr("river", "greatest(discharge, 1e0) AS q", "greatest(width_factor, 1e-1) AS wf", "greatest(source_width, 5e-2) AS sw")
    flux = "(q * (1e-1 + 9e-1 * pos / greatest(n - 1, 1)))"
    beside = smooth.join(known, "river").selectExpr("*", f"coalesce(lag(x) {w}, x) - coalesce(lead(x) {w}, x) AS dx", f"coalesce(lag(y) {w}, y) - coalesce(lead(y) {w}, y) AS dy", f"{E.river_width(E.river_offset('pos', flux, 'wf', 'sw'))} / {E.num(km_per_px)} AS wide")
    normal = beside.selectExpr("*", "sqrt(dx * dx + dy * dy) AS l").selectExpr("*", "CASE WHEN l > 0 THEN dy / l * wide ELSE 0e0 END AS sn", "CASE WHEN l > 0 THEN dx / l * wide ELSE wide END AS cs")
    return normal.selectExpr("river", "pos", "x - sn AS lx", "y + cs AS ly", "x + sn AS rx", "y - cs AS ry")


def anchor_flux(points: DataFrame, path: DataFrame) -> DataFrame:
    """id, pos, flux: flux along a meandered line. The i-th of k path cells sets the point trunc(i * n / k) of n; the line never loses flux.

    points: id, pos (from 0); path: id, pos, flux (null at the map's edge: the cell before it).
    """
    w = "OVER (PARTITION BY id ORDER BY pos)"
    size = points.groupBy("id").agg(F.count("*").alias("n"))
    cells = path.selectExpr("id", f"row_number() {w} - 1 AS i", "count(*) OVER (PARTITION BY id) AS k", f"coalesce(flux, lag(flux) {w}, 0) AS flux")
    put = cells.join(size, "id").selectExpr("id", "CAST(floor(i * n / CAST(k AS DOUBLE)) AS BIGINT) AS pos", "i", "flux").groupBy("id", "pos").agg(F.max_by("flux", "i").alias("put"))
    return points.select("id", "pos").join(put, ["id", "pos"], "left").selectExpr("id", "pos", f"max(coalesce(put, 0)) {w} AS flux")


def parents(drained: DataFrame, pointers: DataFrame) -> DataFrame:
    """river, parent: the river whose cell a river's last cell drains into; null where it ends in none or keeps its name. drained: cell_id, river (-1 if none); pointers: src, dst."""
    named = drained.where("river >= 0").select("cell_id", "river")
    after = pointers.join(named.select(F.col("cell_id").alias("src"), "river"), "src").join(named.select(F.col("cell_id").alias("dst"), F.col("river").alias("parent")), "dst")
    lost = after.where("river <> parent").groupBy("river").agg(F.min("parent").alias("parent"))
    return named.select("river").distinct().join(lost, "river", "left")


def specified(rivers: DataFrame, tree: DataFrame) -> DataFrame:
    """id, name, type_name, parent, basin of rivers (id, name, type_name): the basin is the parent if that is a river, else the river itself; empty names become `River id` and `River`. tree: river, parent."""
    held = rivers.join(tree.select(F.col("river").alias("id"), "parent"), "id", "left")
    name = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), other)
    told = held.select("id", name(F.col("name"), F.concat(F.lit("River "), F.col("id").cast("string"))).alias("name"), name(F.col("type_name"), F.lit("River")).alias("type_name"), "parent")
    return with_basin(told, "id")


def with_basin(rivers: DataFrame, id_col: str) -> DataFrame:
    """rivers with basin: the parent if that is a river, else the river itself. Rivers without a parent take no part in the join: they would all meet in one task."""
    known = rivers.select(F.col(id_col).alias("parent"), F.col(id_col).alias("basin"))
    tied = rivers.where("parent IS NOT NULL").join(known, "parent", "left").select(*rivers.columns, F.coalesce("basin", id_col).alias("basin"))
    return tied.unionByName(rivers.where("parent IS NULL").withColumn("basin", F.col(id_col)))


def without(rivers: DataFrame, removed: DataFrame) -> DataFrame:
    """rivers (id, parent, basin) but for those that are removed (id), and those whose parent or basin is."""
    out = rivers
    for c in ("id", "parent", "basin"):
        out = out.join(removed.select(F.col("id").alias(c)), c, "left_anti")
    return out.select(rivers.columns)


def courses(cells: DataFrame, edges: DataFrame, drained: DataFrame) -> DataFrame:
    """river, step, cell_id: from the cell where a river begins, each time the lowest strictly lower neighbour (the first of equals) of the same river, to its mouth."""
    named = cells.select("cell_id", "height").join(drained.where("river >= 0").select("cell_id", "river"), "cell_id")
    a, b = named.select(F.col("cell_id").alias("src"), F.col("height").alias("high"), F.col("river").alias("own")), named.select(F.col("cell_id").alias("dst"), F.col("height").alias("low"), "river")
    lower = edges.join(a, "src").join(b, "dst").where("own = river AND low < high")
    onward = cut(lower.groupBy("src").agg(F.min(F.struct("low", "slot", "dst")).alias("best")).select("src", F.col("best.dst").alias("dst")))
    return graph.trace(named.where("cell_id = river").select("cell_id"), onward).withColumnRenamed("start", "river")


def define(streams: DataFrame) -> DataFrame:
    """id, source_cell, mouth_cell, discharge, width_factor, source_width, width_km, n_cells: rivers of three cells or more.

    streams: cell_id, flux, river, modifier.
    """
    return PLANS["define_rivers"].run(streams.sparkSession, streams=streams)


def generate(cells: DataFrame, edges: DataFrame, existing: DataFrame, erosion: bool = False, map_col: str = "map_id") -> tuple[DataFrame, DataFrame]:
    """(cells with flux, river and eroded height; rivers): heights altered, depressions filled, water drained, rivers defined and put after the existing ones.

    cells: map_id, cell_id, height, precipitation; cell ids are distinct over all maps, edges stay inside a map. existing: id, name, type_name, parent.
    """
    spark = cells.sparkSession
    altered = PLANS["alter_heights"].run(spark, cells=cells, edges=edges)
    raised = cells.drop("height").join(altered.select("cell_id", F.col("h").alias("height")), "cell_id")
    filled = cut(hydrology.fill_depressions(raised, edges, map_col))
    thinned = cells.groupBy(map_col).agg(F.pow(F.count("*") / 1e4, 0.25).alias("modifier"))
    ground = filled.join(cells.select("cell_id", "precipitation"), "cell_id").join(thinned, map_col).selectExpr("cell_id", "modifier", "h AS height", "CAST(floor(precipitation / modifier) AS BIGINT) AS precipitation")
    pointers = cut(graph.down(ground, edges))
    drained = cut(hydrology.drain(ground, pointers, min_flux=MIN_FLUX))
    named = drained.selectExpr("cell_id", "flux", "CASE WHEN river < 0 THEN 0 ELSE river + 1 END AS river")
    made = define(named.join(ground.select("cell_id", "modifier"), "cell_id")).selectExpr("id", "'' AS name", "'' AS type_name", "CAST(NULL AS BIGINT) AS parent")
    every = existing.select("id", "name", "type_name", "parent").unionByName(made)
    basins = every.selectExpr("id AS parent", "id AS p_id").dropDuplicates(["parent"])
    rivers = every.join(basins, "parent", "left").selectExpr("id", "coalesce(nullif(name, ''), concat('River ', id)) AS name", "coalesce(nullif(type_name, ''), 'River') AS type_name", "parent", "coalesce(p_id, id) AS basin")
    wet = ground.select("cell_id", "height").join(named, "cell_id")
    if not erosion:
        return wet.select("cell_id", "flux", "river", "height"), rivers
    cut_by = PLANS["downcut"].run(spark, cells=wet.withColumn("height", F.floor("height")), edges=edges, streams=named)
    return wet.join(cut_by, "cell_id", "left").selectExpr("cell_id", "flux", "river", "CAST(greatest(floor(height) - coalesce(cut, 0), 0) AS DOUBLE) AS height"), rivers
