"""Drainage, depressions and outlines against plain sequential forms on random maps."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from worldframe.operators import graph, hydrology, isolines, rivers


def grid(rng, wide, high, heights):
    h = {y * wide + x: heights(x, y) for y in range(high) for x in range(wide)}
    near = {c: [c + d for d, ok in ((1, c % wide < wide - 1), (wide, c // wide < high - 1), (-1, c % wide > 0), (-wide, c // wide > 0)) if ok] for c in h}
    return h, near, {c: rng.randint(0, 25) for c in h}


def frames(spark, h, near, rain):
    cells = spark.createDataFrame([(c, float(h[c]), rain[c]) for c in h], "cell_id long, height double, precipitation long")
    edges = spark.createDataFrame([(c, s, n) for c, x in near.items() for s, n in enumerate(x)], "src long, slot long, dst long")
    return cells, edges


def plain_drainage(h, near, rain, outlets):
    """Cells from high to low hand on what they hold; outlets: out cell -> (lake cell, entering)."""
    flux, side, name = dict.fromkeys(h, 0), dict.fromkeys(h, 0), dict.fromkeys(h, -1)

    def hand_on(c, to):
        main = max(0, flux[to] - side[to])
        wins = flux[c] > main
        if name[to] >= 0:
            side[to] = min(65535, side[to] + (flux[to] if wins else flux[c]))
        if name[to] < 0 or wins:
            name[to] = name[c]
        if h[to] >= 20:
            flux[to] = min(65535, flux[to] + flux[c])

    for c in sorted((c for c in h if h[c] >= 20), key=lambda c: (-h[c], c)):
        flux[c] = min(65535, flux[c] + rain[c])
        lower = [n for n in near[c] if h[n] < h[c]]
        to = min(lower, key=lambda n: (h[n], near[c].index(n))) if lower else None
        if c in outlets:
            lake, entering = outlets[c]
            flux[lake] = min(65535, flux[lake] + entering)
            name[lake] = lake if name[lake] < 0 else name[lake]
            if to is not None:
                hand_on(c, to)
        if flux[c] >= 30 and name[c] < 0:
            name[c] = c
        if to is not None:
            hand_on(c, to)
    return {c: (flux[c], side[c], name[c]) for c in h}


@pytest.mark.parametrize("seed", range(4))
def test_drainage_against_a_plain_fold(spark, seed):
    rng = random.Random(seed)
    wide = 14
    slope = (lambda x, y: 20 + x * 3 + rng.random()) if seed == 3 else (lambda x, y: rng.choice([5, 10, *range(20, 60)]))
    h, near, rain = grid(rng, wide, 11, slope)
    if seed == 3:
        rain = {c: 60_000 if c % 17 == 0 else v for c, v in rain.items()}  # full cells
    shores = [c for c in h if h[c] >= 20 and any(h[n] < 20 for n in near[c])]
    chosen = rng.sample(shores, min(len(shores), 12)) if seed in (1, 2) else []
    outlets = {c: (next(n for n in near[c] if h[n] < 20), rng.randint(0, 90)) for c in chosen}
    if seed == 2:  # outlets in a row
        row = sorted(shores)[:6]
        outlets |= {c: (next(n for n in near[c] if h[n] < 20), 40) for c in row}
    cells, edges = frames(spark, h, near, rain)
    lakes = spark.createDataFrame([(i, c, at, e) for i, (c, (at, e)) in enumerate(outlets.items())], "lake long, out_cell long, lake_cell long, entering long")
    got = hydrology.drain(cells, graph.down(cells, edges), lakes if outlets else None)
    assert {r["cell_id"]: (r["flux"], r["confluence"], r["river"]) for r in got.collect()} == plain_drainage(h, near, rain, outlets)


def plain_filling(h, near, most):
    h, first = {c: np.float32(v) for c, v in h.items()}, dict(h)
    for _ in range(min(len(h), most)):
        rose = False
        for c in sorted((c for c in h if first[c] >= 20), key=lambda c: (first[c], c)):
            low = min((h[n] for n in near[c]), default=np.float32(np.inf))
            if h[c] < 100 and low < 100 and h[c] <= low:
                h[c] = low + np.float32(0.1)
                rose = True
        if not rose:
            break
    return {c: float(v) for c, v in h.items()}


@pytest.mark.parametrize(("seed", "most"), [(0, 500), (1, 500), (2, 500), (3, 3), (4, 500)])
def test_depressions_against_plain_passes(spark, monkeypatch, seed, most):
    monkeypatch.setattr(hydrology, "GROUP", 40)
    rng = random.Random(seed)
    high = {
        0: lambda x, y: rng.randint(10, 99), 1: lambda x, y: rng.choice([30, 31, 32, 99, 100, 104]) if 0 < x < 12 else 5,
        2: lambda x, y: 5 if x == 0 else 90 - 10 * ((x - 7) ** 2 + (y - 5) ** 2 < 20) - 40 * ((x - 7) ** 2 + (y - 5) ** 2 < 8) + rng.random(),  # a bowl
        3: lambda x, y: rng.randint(15, 40), 4: lambda x, y: rng.randint(20, 40),  # no water: all rise
    }[seed]
    h, near, rain = grid(rng, 13, 11, high)
    cells, edges = frames(spark, h, near, rain)
    got = hydrology.fill_depressions(cells.withColumn("map_id", F.lit(1).cast("long")), edges, rounds=most)
    assert {r["cell_id"]: r["h"] for r in got.collect()} == plain_filling(h, near, most)


def test_least_ways_to_water(spark):
    rng = random.Random(8)
    h, near, rain = grid(rng, 12, 12, lambda x, y: rng.choice([5, *range(20, 80)]))
    cells, edges = frames(spark, h, near, rain)
    best = {c: v if v < 20 else np.inf for c, v in h.items()}
    for _ in h:
        best = {c: min(best[c], min(max(best[n], h[c]) for n in near[c])) for c in h}
    assert {r["cell_id"]: r["level"] for r in hydrology.spill_levels(cells, edges).collect()} == {c: best[c] for c in h if h[c] >= 20}


def plain_rings(corners, region):
    """Rings by walking: {(region, frozenset of directed sides)}; at a corner with several ways on, the walk turns about the corner inside the region."""
    sides = {(r[k], r[(k + 1) % len(r)]): c for c, r in corners.items() for k in range(len(r))}
    after = {(r[k], r[(k + 1) % len(r)]): (r[(k + 1) % len(r)], r[(k + 2) % len(r)]) for c, r in corners.items() for k in range(len(r))}
    edge = {s for s, c in sides.items() if c in region and region.get(sides.get(s[::-1])) != region[c]}
    rings = set()
    while edge:
        start = s = min(edge)
        ring = []
        while True:
            ring.append(s)
            s = after[s]
            while s not in edge and s not in ring and region.get(sides.get(s[::-1])) == region[sides[s]]:
                s = after[s[::-1]]
            if s == start:
                break
        edge -= set(ring)
        rings.add((region[sides[start]], tuple(ring)))
    return rings


def lattice_corners(wide, high):
    return {y * wide + x: [y * (wide + 1) + x, y * (wide + 1) + x + 1, (y + 1) * (wide + 1) + x + 1, (y + 1) * (wide + 1) + x] for y in range(high) for x in range(wide)}


def voronoi_corners(spark):
    from worldframe.operators import mesh

    maps = spark.createDataFrame([(1, "outline", 100, 100, 150)], "map_id long, seed string, width int, height int, cells int")
    return {r["cell_id"]: list(r["ring"]) for r in mesh.voronoi(maps).collect() if len(r["ring"]) > 2}


@pytest.mark.parametrize("kind", ["noise", "blocks", "voronoi"])
def test_outlines_against_walks(spark, kind):
    rng = random.Random(5)
    corners = voronoi_corners(spark) if kind == "voronoi" else lattice_corners(12, 9)
    colour = {c: (c % 12 // 4 + c // 36 * 3 if kind == "blocks" else rng.randint(0, 2)) for c in corners}
    region = {c: v for c, v in colour.items() if v != 0 or kind == "blocks"}
    rings = spark.createDataFrame([(c, k, v) for c, r in corners.items() for k, v in enumerate(r)], "cell_id long, pos long, vertex long")
    out = isolines.outlines(rings, spark.createDataFrame(list(region.items()), "cell_id long, region long")).collect()
    rows = {}
    for r in sorted(out, key=lambda r: (r["ring"], r["pos"])):
        rows.setdefault((r["region"], r["ring"]), []).append((r["vertex"], r["onward"]))
        assert r["pos"] == len(rows[r["region"], r["ring"]]) - 1
    turned = lambda x: tuple(x[x.index(min(x)) :] + x[: x.index(min(x))])
    assert {(g, turned(x)) for (g, _), x in rows.items()} == {(g, turned(list(x))) for g, x in plain_rings(corners, region)}
    assert all(r["ring"] // isolines.SIDES in region for r in out)


def test_lakes_inside_are_left_out(spark):
    corners = lattice_corners(9, 5)
    rings = spark.createDataFrame([(c, k, v) for c, r in corners.items() for k, v in enumerate(r)], "cell_id long, pos long, vertex long")
    lake, shared = {11, 12, 20}, {24, 33}  # 24 and 33 are one lake that touches both regions
    place = {c: 100 if c in lake else 200 if c in shared else 1 if c % 9 < 6 else 2 for c in corners}
    places = spark.createDataFrame(list(place.items()), "cell_id long, feature long")
    features = spark.createDataFrame([(1, "island"), (2, "island"), (100, "lake"), (200, "lake")], "id long, kind string")
    regions = spark.createDataFrame([(c, f) for c, f in place.items() if f < 100], "cell_id long, region long")
    out = isolines.outlines(rings, regions)
    assert out.select("ring").distinct().count() == 3
    kept = isolines.without_lakes(out, places, features)
    assert kept.select("ring").distinct().count() == 2 and kept.where("beyond IN (11, 12, 20)").count() == 0
    assert kept.count() == out.count() - 8
    corners_at = spark.createDataFrame([(y * 10 + x, float(x), float(y)) for y in range(6) for x in range(10)], "vertex long, x double, y double")
    size = {(r["region"], r["ring"]): r["area"] for r in isolines.areas(out, corners_at).collect()}
    assert min(size.values()) == -6 and sum(size.values()) == 2 * len([c for c in place if place[c] < 100])


def test_outlets_feed_rivers(spark):
    rng = random.Random(3)
    h, near, rain = grid(rng, 6, 1, lambda x, y: [60, 40, 10, 35, 30, 5][x])
    cells, edges = frames(spark, h, near, dict.fromkeys(h, 10))
    lakes = spark.createDataFrame([(2,)], "id long")
    out = rivers.outlets(cells.withColumn("feature", F.col("cell_id")), edges, lakes)
    assert [tuple(r) for r in out.select("out_cell", "lake_cell").collect()] == [(3, 2)]
    got = {r["cell_id"]: (r["flux"], r["river"]) for r in hydrology.drain(cells, graph.down(cells, edges), out.withColumn("entering", F.lit(50))).collect()}
    assert got[2] == (50, 2) and got[5] == (0, -1)
