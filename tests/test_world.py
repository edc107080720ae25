"""Kernels, parsers, edits and sinks of the map model; the relational plans are compared with DuckDB."""

import gzip
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from worldframe.functions import geometry
from worldframe.functions.prng import stream
from worldframe.operators import edits, graph, hydrology, mesh, polyline
from worldframe.plans import catalog
from worldframe.sinks import svg
from worldframe.sources import mapfile

AT = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("v", "d", "out"), [(-0.5, 0, 0), (-1.5, 0, -1), (10.125, 2, 10.13), (10.05, 1, 10.1)])
def test_rounding(v, d, out):
    assert geometry.rn(v, d) == out


def test_stream_is_seeded_and_uniform():
    a, b = stream("42"), stream("42")
    first = [next(a) for _ in range(1000)]
    assert first == [next(b) for _ in range(1000)] != [next(stream("43"))] * 1000
    assert 0 <= min(first) and max(first) < 1 and abs(np.mean(first) - 0.5) < 0.05


def test_grid_sizing():
    placed = geometry.place(2000, 2000, 10000, "861039636")
    assert (placed["spacing"], placed["columns"], placed["rows"], len(placed["points"])) == (20, 100, 100, 10000)
    assert placed["boundary"][:2] == [(1, -20), (1, 2020)] and len(placed["boundary"]) == 200


def test_triangulation_counts_and_circles():
    placed = geometry.place(2000, 2000, 10000, "861039636")
    points = placed["points"] + placed["boundary"]
    triangles, over = geometry.Triangulation(points).result()
    twins = geometry.half_edges(triangles, over)
    assert (len(points), len(triangles), triangles.size, int((twins < 0).sum())) == (10200, 20198, 60594, 200)
    inner = twins >= 0
    assert (twins[twins[inner]] == np.flatnonzero(inner)).all()
    for t in random.Random(0).sample(range(len(triangles)), 3000):
        a, b, c = (points[i] for i in triangles[t])
        assert geometry.turn(a, b, c) > 0
        for n in over[t]:
            if n >= 0:
                far = next(int(v) for v in triangles[n] if v not in triangles[t])
                assert not geometry.in_circle(a, b, c, points[far])


def test_triangulation_of_degenerate_sets():
    assert len(geometry.Triangulation([(0, 0), (1, 1), (2, 2)]).result()[0]) == 0
    square = [(float(x), float(y)) for x in range(5) for y in range(5)]
    assert len(geometry.Triangulation(square + square[:3]).result()[0]) == 32


def test_circumcentre_floor():
    points = np.array([(0, 0), (1, 0), (0, 1), (-2, -2), (0, -2), (-1, -1)], dtype=float)
    assert geometry.circumcentres(points, np.array([[0, 1, 2], [3, 4, 5]])).tolist() == [[0, 0], [-1, -2]]


def test_dual_cells_cover_the_map():
    placed = geometry.place(400, 300, 1000, "s")
    cells = geometry.dual(placed["points"] + placed["boundary"], len(placed["points"]))
    total = sum(abs(geometry.area(cells["vertices"][r])) for r in cells["rings"])
    assert abs(total / (400 * 300) - 1) < 0.15
    for i, near in enumerate(cells["neighbours"]):
        assert all(i in cells["neighbours"][j] for j in near)


def test_repacking_extremes():
    placed = geometry.place(200, 200, 100, "s")
    cells = geometry.dual(placed["points"] + placed["boundary"], len(placed["points"]))
    n = len(placed["points"])
    none = np.zeros(n, dtype=bool)
    assert geometry.repack(placed["points"], cells, placed["spacing"], np.zeros(n), np.full(n, -3), none) == []
    inland = geometry.repack(placed["points"], cells, placed["spacing"], np.full(n, 50), np.full(n, 2), none)
    assert [r[2] for r in inland] == list(range(n))


def test_lines():
    square = np.array([(-5.0, -5.0), (5.0, -5.0), (5.0, 5.0), (-5.0, 5.0)])
    clipped = polyline.clip_ring(square, 10, 10)
    assert sorted(map(tuple, np.unique(clipped, axis=0))) == [(0, 0), (0, 5), (5, 0), (5, 5)]
    assert len(polyline.clip_ring(square - 20, 10, 10)) == 0
    straight = np.array([(float(i), 0.0) for i in range(50)])
    assert polyline.thin_and_simplify(straight, 0.3).tolist() == [[0, 0], [49, 0]]
    ring = square * 20
    rough = polyline.fractal_ring(ring, 3)
    assert len(rough) > len(ring) and np.array_equal(rough, polyline.fractal_ring(ring, 3))
    assert len(polyline.relax_corners(straight)) == 50


def map_text():
    slots = [""] * 47
    slots[0] = "1.138.0|licence|2026-1-1|861039636|400|300|17"
    slots[1] = "|".join(["km", "3", "square", "m", "1.8", "C", *["x"] * 13, "{}", "Name", "0", "style"])
    slots[2] = '{"latT":90,"latN":45,"latS":-45,"lonW":-80,"lonE":80}'
    slots[3] = "#111,#222|0,50|Sea,Steppe"
    slots[4] = json.dumps([{"id": "b1", "name": "Note", "legend": "L \ud800 x"}])
    slots[5] = '<svg id="map" width="1">\r\n<g/>\r\n</svg>'
    slots[7], slots[8], slots[9], slots[10], slots[11] = "10,300,x", "1,-1,65537", "1,2,2", "-1,200,1", "5,-5,0.9"
    slots[13] = json.dumps([0, {"i": 1, "name": "Elves", "origins": [0, "x", -2], "type": "Lake"}, {"i": 2, "name": "Orcs", "removed": True}])
    slots[6] = json.dumps({"spacing": 2.5, "cellsX": 3, "cellsY": 2, "cellsDesired": 0, "points": [[1.5, 2]], "features": [0, {"i": 1, "type": "ocean", "border": True}, {"i": 3, "type": "isle", "land": True}, 5]})
    slots[12] = json.dumps([0, {"i": 1, "type": "ocean", "land": False}, {"i": 2, "type": "continent", "land": True, "group": "continent"}, {"i": 3, "type": "lake", "group": "salt"}, {"i": 4, "type": "lake", "group": "odd"}])
    slots[14] = json.dumps([{"i": 0}, {"i": 1, "form": "Union", "type": "Lake", "neighbors": [2, 3]}, {"i": 2, "form": "Tribe", "type": "Highland", "removed": 0}])
    slots[15] = json.dumps([{}, {"i": 1, "type": "Naval", "capital": 1, "port": 2, "feature": 3, "walls": 1}, {"i": 2, "type": "Lake", "port": 0, "feature": 3, "removed": True}])
    slots[31] = "English|4|9|lt|0.1|a/bad|1/Nordic|5|9|7|0.2|b"
    slots[32] = json.dumps([{"i": 1, "name": "R", "cells": [4, 5, -1]}])
    slots[36] = json.dumps({"1": {"2": 7}, "x": {"3": 8}})
    return "\r\n".join(slots)


@pytest.mark.parametrize("pack", [lambda b: b, gzip.compress])
def test_map_file(spark, tmp_path, pack):
    (tmp_path / "a.map").write_bytes(pack(map_text().encode("utf-8")))
    files = mapfile.read(spark, str(tmp_path))
    assert files.select(F.size("slots")).first()[0] == 47
    head = mapfile.header(files).first()
    assert (head["seed"], head["graph_width"], int(head["map_id"])) == ("861039636", 400, 17)
    cells = [tuple(r) for r in mapfile.cell_columns(files, mapfile.GRID).drop("path").orderBy("cell_id").collect()]
    assert cells == [(0, 10, 1, 1, -1, 5), (1, 255, 65535, 2, -56, -5), (2, 0, 1, 2, 1, 0)]
    assert [r["name"] for r in mapfile.catalog(files, "cultures").collect()] == ["Elves", "Orcs"]
    river = mapfile.catalog(files, "rivers").first()["cells"]
    assert river == [4, 5, mapfile.UNSET_CELL]
    assert [(r["kind"], r["origins"], r["removed"]) for r in mapfile.catalog(files, "cultures").collect()] == [("lake", [0], False), ("generic", [], True)]
    burgs = mapfile.catalog(files, "burgs").collect()
    assert [(r["kind"], r["is_capital"], r["port_feature"], r["has_walls"], r["removed"]) for r in burgs] == [("naval", True, 3, True, False), ("generic", False, None, False, True)]
    states = mapfile.catalog(files, "states").collect()
    assert [(r["form"], r["kind"], r["neighbors"], r["removed"]) for r in states] == [("union", "generic", [2, 3], False), ("anarchy", "highland", [], False)]
    features = mapfile.catalog(files, "features").collect()
    assert [(r["kind"], r["is_land"], r["land_group"], r["lake_group"]) for r in features] == [("ocean", False, None, None), ("island", True, "continent", None), ("lake", False, None, "salt"), ("lake", False, None, None)]
    grid = mapfile.grid_general(files).first()
    assert (grid["cells_desired"], grid["cells_x"], [tuple(p) for p in grid["points"]], grid["boundary"]) == (6, 3, [(1.5, 2.0)], [])
    assert [(r["id"], r["kind"], r["land_group"]) for r in mapfile.grid_features(files).orderBy("id").collect()] == [(1, "ocean", None), (3, "island", "island")]
    assert [(r["id"], r["kind"]) for r in mapfile.grid_feature_kinds(files).orderBy("id").collect()] == [(0, "ocean"), (1, "ocean"), (2, "ocean"), (3, "island")]
    assert [tuple(r)[1:] for r in mapfile.route_map(files).collect()] == [(1, 2, 7)]
    assert [(r["id"], r["name"]) for r in mapfile.namebases(files).collect()] == [(0, "English"), (2, "Nordic")]
    assert mapfile.notes(files).first()["content"] == "Note\n\nL ? x"
    assert [r["name"] for r in mapfile.biomes(files).collect()] == ["Sea", "Steppe"]
    assert mapfile.coordinates(files).first()["lon_l"] == -80
    assert mapfile.settings(files).first()["map_name"] == "Name"


def test_lengths_must_match(spark):
    rows = spark.createDataFrame([("p", [""] * 7 + ["1,2", "1", "", "", ""])], "path string, slots array<string>")
    with pytest.raises(Exception, match="lengths differ"):
        mapfile.cell_columns(rows, mapfile.GRID).collect()


def test_edits(spark):
    states = spark.createDataFrame([(0, "W", "#000000", False), (1, "A", "#111111", False), (2, "B", "#222222", True)], "id long, name string, colour string, removed boolean")
    rows = [(1, "state", 1, "rename", " X "), (2, "state", 1, "rename", "Y"), (3, "state", 1, "recolor", "ABC123"), (4, "state", 2, "rename", "Z"), (5, "state", 0, "rename", "Z"), (6, "state", 1, "rename", "  "), (7, "state", 1, "recolor", "#ZZZZZZ")]
    commands = spark.createDataFrame(rows, "seq long, entity string, id long, op string, value string")
    assert {r["id"]: (r["name"], r["colour"]) for r in edits.apply(states, commands, "state").collect()}[1] == ("Y", "#abc123")
    bad = {r["seq"]: r["error"] for r in edits.checked(commands, states, "state")[1].collect()}
    assert bad == {4: "EntityNotFound", 5: "EntityNotFound", 6: "EmptyName", 7: "InvalidHexColor"}


def test_streamed_edits(spark, tmp_path):
    from worldframe.streaming.edits import follow

    states = spark.createDataFrame([(1, "A", "#111111", False)], "id long, name string, colour string, removed boolean")
    states.write.parquet(str(tmp_path / "c" / "v=0"))
    commands = spark.createDataFrame([(1, "state", 1, "rename", "New")], "seq long, entity string, id long, op string, value string")
    commands.write.parquet(str(tmp_path / "in"))
    follow(spark.readStream.schema(commands.schema).parquet(str(tmp_path / "in")), str(tmp_path / "c"), "state", str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "c" / "v=1")).first()["name"] == "New"


def test_world_round_trip(spark, tmp_path):
    tables = {"cells": spark.range(5).withColumnRenamed("id", "cell_id"), "notes": spark.createDataFrame([("a", [1, 2])], "id string, cells array<int>")}
    svg.save_world(tables, str(tmp_path / "w"))
    again = svg.load_world(spark, str(tmp_path / "w"))
    assert {n: df.count() for n, df in again.items()} == {"cells": 5, "notes": 1}


def lattice(spark, heights):
    n = len(heights[0])
    cells = [(y * n + x, h, 1) for y, row in enumerate(heights) for x, h in enumerate(row)]
    edges = [(y * n + x, s, (y + dy) * n + x + dx) for y in range(len(heights)) for x in range(n) for s, (dx, dy) in enumerate(((1, 0), (0, 1), (-1, 0), (0, -1))) if 0 <= x + dx < n and 0 <= y + dy < len(heights)]
    return spark.createDataFrame(cells, "cell_id long, height long, precipitation long"), spark.createDataFrame(edges, "src long, slot long, dst long")


def test_flow_down_a_slope(spark):
    cells, edges = lattice(spark, [[60, 50, 40, 30, 10]])
    assert {r["cell_id"]: r["flux"] for r in graph.flow(cells, edges).collect()} == {0: 1, 1: 2, 2: 3, 3: 4}
    pointers = graph.down(cells, edges)
    assert {r["node"]: r["root"] for r in graph.roots(pointers).collect()} == dict.fromkeys(range(5), 4)
    rivers = hydrology.drain(cells, pointers, min_flux=2)
    assert {r["cell_id"]: r["river"] for r in rivers.collect()} == {0: -1, 1: 1, 2: 1, 3: 1, 4: 1}


def test_depressions_fill(spark):
    cells, edges = lattice(spark, [[50, 50, 50], [50, 30, 50], [50, 50, 10]])
    one = lambda df: df.withColumn("map_id", F.lit(1).cast("long"))
    h = {r["cell_id"]: r["h"] for r in hydrology.fill_depressions(one(cells), one(edges)).collect()}
    assert h[4] > 50 and h[8] == 10


@pytest.mark.parametrize(("width", "height", "cells", "seed"), [(100, 100, 50, "a"), (300, 100, 700, "b"), (90, 400, 300, "c"), (960, 540, 2500, "d")])
def test_flips_give_the_triangulation_of_insertion(width, height, cells, seed):
    placed = geometry.place(width, height, cells, seed)
    points, n = placed["points"] + placed["boundary"], len(placed["points"])
    assert geometry.lattice_triangles(np.array(points), *placed["lattice"], len(points) - n) is not None
    fast, slow = geometry.dual(points, n, placed["lattice"]), geometry.dual(points, n)
    assert {tuple(sorted(t)) for t in fast["triangles"].tolist()} == {tuple(sorted(t)) for t in slow["triangles"].tolist()}
    assert (geometry._turns(np.array(points), fast["triangles"]) > 0).all() and fast["border"] == slow["border"]
    assert [sorted(x) for x in fast["neighbours"]] == [sorted(x) for x in slow["neighbours"]]
    whole = [abs(geometry.area(fast["vertices"][r])) for r in fast["rings"]]
    assert np.allclose(np.abs(fast["areas"]), whole)


def test_ten_thousand_cells_take_a_fraction_of_a_second():
    import time

    took = []
    for _ in range(3):
        began = time.process_time()
        placed = geometry.place(2000, 2000, 10000, "861039636")
        geometry.dual(placed["points"] + placed["boundary"], len(placed["points"]), placed["lattice"])
        took.append(time.process_time() - began)
    assert min(took) < 0.6


def test_points_that_are_no_lattice_are_inserted():
    square = [(float(x), float(y)) for x in range(5) for y in range(5)]
    assert len(geometry.dual(square, 25, (5, 5))["triangles"]) == 32


def test_maps_are_independent(spark):
    maps = spark.createDataFrame([(1, "a", 100, 100, 50), (2, "b", 100, 100, 50), (3, "a", 100, 100, 50)], "map_id long, seed string, width int, height int, cells int")
    got = {k: [] for k in (1, 2, 3)}
    for r in mesh.voronoi(maps).orderBy("cell_id").collect():
        got[r["map_id"]].append((r["x"], r["y"], r["area"]))
    assert got[1] == got[3] != got[2]


def test_plans_against_duckdb(spark):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(AT):
        pytest.skip("no tables")
    con = duckdb.connect()
    for f in os.listdir(AT):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{AT}/{f}'")
    key = lambda r: tuple((x is None, str(x)) for x in r)
    wrong = []
    for name, sql in catalog.ORACLE_SQL.items():
        mine, theirs = catalog.QUERIES[name](spark, AT), con.sql(sql)
        columns = sorted(mine.columns)
        a = sorted((tuple(r) for r in mine.select(columns).collect()), key=key)
        b = sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall(), key=key)
        if columns != sorted(theirs.columns) or a != b:
            wrong.append(name)
    assert wrong == []


def test_views(spark):
    from worldframe.functions import views

    boxes = spark.createDataFrame([(0.0, 0.0, 400.0, 300.0, 4 / 3), (5.0, 0.0, 5.0, 1.0, 1.0), (0.0, 0.0, float("inf"), 1.0, 1.0)], "x0 double, y0 double, x1 double, y1 double, aspect double")
    view = views.framed(boxes)
    assert [(r["x1"], r["y1"]) for r in view.collect()] == [(400, 300), (1000, 1000), (1000, 1000)]
    first = view.where("x1 = 400").selectExpr("*", "200e0 AS wx", "150e0 AS wy", "800e0 AS sw", "600e0 AS sh")
    r = views.on_screen(first).first()
    assert (r["sx"], r["sy"]) == (400, 300)
    there = views.in_world(views.on_screen(first.selectExpr("* EXCEPT (wx, wy)", "123e0 AS wx", "45e0 AS wy"))).first()
    assert np.allclose((there["wx"], there["wy"]), (123, 45))
    aimed = first.selectExpr("*", "400e0 AS sx", "300e0 AS sy", "4e0 AS factor", "1e9 AS dx", "0e0 AS dy")
    near = views.in_world(views.zoomed(aimed)).first()
    assert near["tall"] < first.first()["tall"] and np.allclose((near["wx"], near["wy"]), (200, 150))
    assert views.panned(views.zoomed(aimed)).first()["cx"] >= -0.3 * 400
    flat = first.selectExpr("* EXCEPT (sw)", "0e0 AS sw")
    assert (views.on_screen(flat).first()["sx"], views.in_world(views.on_screen(flat)).first()["wx"]) == (0, 200)


def test_native_header():
    from worldframe.sources.native import Header, decode

    assert decode(Header(77).encode() + b"rest") == Header(77) and len(Header(1).encode()) == 16
    for bad in (b"NOPE" + b"\0" * 12, Header(1, version=9).encode(), b"VO"):
        with pytest.raises(ValueError, match="magic|version|short"):
            decode(bad)


def test_path_commands(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    rough = [(0.0, 0.0), (1.0, 0.1), (2.0, 0.0), (2.0, 2.0)]
    rows = [(1, i, *p, True) for i, p in enumerate(square)] + [(2, i, *p, i != 1) for i, p in enumerate(rough)] + [(3, 0, 1.0, 1.0, True)]
    got = polyline.path_commands(spark.createDataFrame(rows, "id long, pos long, x double, y double, corner boolean")).orderBy("id", "pos", "step").collect()
    by = {i: [(r["command"], tuple(r["args"])) for r in got if r["id"] == i] for i in (1, 2)}
    assert by[1] == [("M", (0, 1)), ("Q", (0, 0, 1, 0)), ("Q", (2, 0, 2, 1)), ("Q", (2, 2, 1, 2)), ("Q", (0, 2, 0, 1)), ("Z", ())]
    assert [c for c, _ in by[2]] == ["M", "L", "C", "C", "L", "Q", "Z"]
    assert by[2][2][1] == (0 + (1 - 2) / 8, (0.1 - 2) / 8, 1 - (2 - 0) / 8, 0.1 - 0.0, 1, 0.1)


def test_fractal_ring_draws_in_line_order():
    ring = np.array([(0.0, 0.0), (40.0, 0.0), (40.0, 40.0), (0.0, 40.0)])
    whole, edged = polyline.fractal_ring(ring, 5), polyline.fractal_ring(ring, 5, size=(1e9, 1e9))
    assert [p.tolist() for p in ring] == [p for p in whole.tolist() if p in ring.tolist()] and len(whole) <= 4 * 16
    assert not any(0 < y < 40 and x == 0 for x, y in whole) and any(np.array_equal(p, (0, 40)) for p in edged)
    assert len(edged) <= len(whole) and polyline.fractal_ring(ring[:2], 5).tolist() == ring[:2].tolist()


def test_palette_ends():
    from worldframe.functions.palette import height_colours, spline

    assert spline(0, [1, 2, 3]) == 1 and spline(1, [1, 2, 3]) == 3
    assert len(height_colours()) == 101 and all(0 <= v <= 1 for row in height_colours() for v in row[1:])


def test_relaxing_keeps_anchors_and_flips_spikes():
    from worldframe.operators.rivers import relax_between

    line = np.array([(0.0, 0.0), (1.0, 5.0), (2.0, 0.0), (3.0, 5.0), (4.0, 0.0)])
    anchor = np.array([True, False, True, True, True])
    assert relax_between(line, anchor).tolist() == [[0, 0], [1, -5], [2, 0], [3, 5], [4, 0]]
    wide = np.array([(0.0, 0.0), (1.0, 5.0), (2.0, 0.0), (3.0, -5.0), (4.0, 0.0)])
    assert np.array_equal(relax_between(wide, anchor), wide)
    assert np.array_equal(relax_between(line[:2], anchor[:2]), line[:2])


def test_capital_commands(spark):
    burgs = spark.createDataFrame([(1, 10, 1, False, True), (2, 20, 1, False, False), (3, 30, 0, False, False)], "id long, cell long, state long, removed boolean, is_capital boolean")
    states = spark.createDataFrame([(1, -1)], "id long, center_cell long")
    commands = spark.createDataFrame([(1, "burg", 2, "capital", "true"), (2, "burg", 3, "capital", "true"), (3, "burg", 2, "capital", "false")], "seq long, entity string, id long, op string, value string")
    towns, seats = edits.capitals(burgs, states, commands)
    assert {r["id"]: r["is_capital"] for r in towns.collect()} == {1: False, 2: False, 3: True}
    assert seats.first()["center_cell"] == 20


def test_drains_through_lakes_and_circles(spark):
    from worldframe.operators import rivers

    last = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)], "river long, cell_id long")
    places = spark.createDataFrame([(1, 11), (2, 12), (3, 13), (4, 14), (5, 15)], "cell_id long, feature long")
    features = spark.createDataFrame([(11, "lake"), (12, "ocean"), (13, "lake"), (14, "island"), (15, "lake")], "id long, kind string")
    outflow = spark.createDataFrame([(11, 2), (13, 3)], "lake long, river long")
    assert {r["river"]: r["drain"] for r in rivers.drains(last, places, features, outflow).collect()} == {1: 12, 2: 12, 3: None, 4: None, 5: 15}


def full_map(seed, cells, short=()):
    """A map file whose columns fit its mesh; those in short have one value too few."""
    placed = geometry.place(120, 90, cells, seed)
    n = len(placed["points"])
    grid = geometry.dual(placed["points"] + placed["boundary"], n, placed["lattice"])
    height = [50 if (x - 60) ** 2 + (y - 45) ** 2 < 900 else 5 for x, y in placed["points"]]
    land = [h >= 20 for h in height]
    near = [any(land[j] != land[i] for j in grid["neighbours"][i]) for i in range(n)]
    water = [(1 if near[i] else 2) if land[i] else (-1 if near[i] else -3) for i in range(n)]
    packed = geometry.repack(placed["points"], grid, placed["spacing"], np.array(height), np.array(water), np.zeros(n, dtype=bool))
    out = [""] * 47
    out[0] = f"1.9|x|d|{seed}|120|90|7"
    out[6] = json.dumps({"spacing": 1, "cellsX": 1, "cellsY": 1, "cellsDesired": cells, "points": placed["points"], "features": [0, {"i": 1, "type": "ocean"}, {"i": 2, "type": "island", "land": True}]})
    lists = {7: height, 8: [3] * n, 9: [2 if x else 1 for x in land], 10: water, 11: [4] * n, 16: [k % 12 for k in range(len(packed))], 25: [k % 5 for k in range(len(packed))]}
    for at, values in lists.items():
        out[at] = ",".join(map(str, values[1:] if at in short else values))
    return "\r\n".join(out), placed, packed


def test_import_with_its_mesh(spark, tmp_path):
    (tmp_path / "in").mkdir()
    good = {}
    for k, (seed, cells) in enumerate((("a", 80), ("b", 120), ("c", 60))):
        text, *good[f"{k}.map"] = full_map(seed, cells)
        (tmp_path / "in" / f"{k}.map").write_text(text, newline="")
    (tmp_path / "in" / "bad.map").write_text(full_map("d", 70, (16, 25))[0], newline="")
    (tmp_path / "in" / "worse.map").write_text(full_map("e", 70, (7,))[0], newline="")
    (tmp_path / "in" / "none.map").write_text("1.9|x", newline="")
    from worldframe.__main__ import main

    main(str(tmp_path / "in"), str(tmp_path / "out"))
    world = svg.load_world(spark, str(tmp_path / "out"))
    name = F.element_at(F.split("path", "/"), -1).alias("file")
    errors = {r["file"]: r["message"] for r in world["import_errors"].select(name, "message").collect()}
    assert set(errors) == {"bad.map", "worse.map", "none.map"} and errors["none.map"] == "no header or no grid"
    assert errors["bad.map"].startswith("biome: ") and "; state: " in errors["bad.map"] and errors["worse.map"].startswith("height: ")
    pack = world["pack_cells"].select(name, "*").collect()
    grid = world["grid_cells"].select(name, "*").collect()
    assert {r["file"] for r in pack} == {r["file"] for r in grid} == set(good)
    for file, (placed, packed) in good.items():
        mine = sorted((r for r in pack if r["file"] == file), key=lambda r: r["cell_id"])
        assert [(r["x"], r["y"], r["grid_id"], r["height"]) for r in mine] == [tuple(p) for p in packed]
        assert [(r["biome"], r["state"]) for r in mine] == [(k % 12, k % 5) for k in range(len(packed))] and all(r["burg"] is None for r in mine)
        about = {r["cell_id"]: set(r["neighbors"]) for r in mine}
        assert all(a in about[b] for a, x in about.items() for b in x) and all(len(r["ring"]) == len(r["ring_x"]) == len(r["ring_y"]) for r in mine)
        ground = sorted((r for r in grid if r["file"] == file), key=lambda r: r["cell_id"])
        assert [(r["x"], r["y"]) for r in ground] == placed["points"] and {r["temperature"] for r in ground} == {4} and {r["feature_id"] for r in ground} == {1, 2}


def test_drawing_in_global_order(spark, tmp_path):
    import xml.etree.ElementTree as ET

    cells = spark.createDataFrame([(i, float(i % 4 * 10 + 5), float(i // 4 * 10 + 5), 10 * i, i % 4 // 2) for i in range(12)], "cell_id long, x double, y double, height long, state long")
    near = [(i, s, j) for i in range(12) for s, (j, ok) in enumerate(((i + 1, i % 4 < 3), (i + 4, i < 8), (i - 1, i % 4 > 0), (i - 4, i >= 4))) if ok]
    edges = spark.createDataFrame(near, "src long, slot long, dst long")
    rings = spark.createDataFrame([(i, k, i // 4 * 5 + i % 4 + d) for i in range(12) for k, d in enumerate((0, 1, 6, 5))], "cell_id long, pos long, vertex long")
    vertices = spark.createDataFrame([(v, float(v % 5 * 10), float(v // 5 * 10)) for v in range(20)], "vertex long, x double, y double")
    paths = spark.createDataFrame([(3, 0, 1), (3, 1, 5), (3, 2, 99)], "river long, pos long, cell_id long")
    rivers = spark.createDataFrame([(3, 9000.0), (4, 1.0)], "river long, discharge double")
    burgs = spark.createDataFrame([(1, "A & <b>", 2, False, True), (2, "gone", 3, True, False), (0, "none", 3, False, False)], "id long, name string, cell long, removed boolean, is_capital boolean")
    lines = svg.svg_lines(cells, rings, vertices, paths, rivers, edges, burgs, 40, 30)
    svg.write_svg(lines.repartition(7), str(tmp_path / "map"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "map").glob("part-*")))
    root = ET.fromstring(text)
    kinds = [e.tag.split("}")[1] for e in root]
    assert kinds == ["rect", *["polygon"] * 12, "polyline", "path", "circle", "text"]
    assert root[1].attrib["points"] == "0.0,0.0 10.0,0.0 10.0,10.0 0.0,10.0"
    assert root[13].attrib["points"].split() == ["15.0,5.0", "15.0,15.0", "0.0,0.0"] and root[13].attrib["stroke-width"] == "1.8"
    assert root[14].attrib["d"].split() == [x for y in (5, 15, 25) for x in ("M", f"15.0,{y}.0", "L", f"25.0,{y}.0")]
    assert root[-1].text == "A & <b>" and root[-2].attrib["r"] == "5"


def test_first_preset_that_fits(spark):
    from worldframe.functions import views

    presets = spark.createDataFrame([("p", 0, "a"), ("p", 0, "b"), ("q", 1, "b"), ("q", 1, "a"), ("r", 2, "c")], "preset string, k long, layer string")
    shown = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "c"), (3, "a"), (4, "a"), (4, "b"), (4, "c")], "id long, layer string")
    assert {r["id"]: r["preset"] for r in views.presets_shown(shown, presets).collect()} == {1: "p", 2: "r", 3: "custom", 4: "custom"}


def test_lines_at_round_distances(spark):
    from worldframe.functions import views

    box = lambda x, y: spark.createDataFrame([(3.0, -7.0), (3.0 + x, -7.0 + y)], "x double, y double")
    got = [(r["axis"], r["coord"]) for r in views.grid_lines(box(60.0, 120.0), 12).orderBy("axis", "k").collect()]
    assert [a for x, a in got if x == "x"] == [5.0 * k for k in range(1, 13)] and [a for x, a in got if x == "y"] == [5.0 * k for k in range(-1, 23)]
    assert views.grid_lines(box(0.0, 5.0), 12).count() == 0


def test_river_tree(spark):
    from worldframe.operators import rivers

    drained = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (8, 8), (9, -1)], "cell_id long, river long")
    pointers = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 2), (8, 6), (9, 1)], "src long, dst long")
    tree = rivers.parents(drained, pointers)
    assert {r["river"]: r["parent"] for r in tree.collect()} == {1: None, 5: 1, 8: 5}
    named = rivers.specified(spark.createDataFrame([(1, "Elbe", ""), (5, "", "Fork"), (8, "", "")], "id long, name string, type_name string"), tree)
    assert {r["id"]: (r["name"], r["type_name"], r["basin"]) for r in named.collect()} == {1: ("Elbe", "River", 1), 5: ("River 5", "Fork", 1), 8: ("River 8", "River", 5)}
    assert [r["id"] for r in rivers.without(named, spark.createDataFrame([(5,)], "id long")).collect()] == [1]
    assert rivers.without(named, spark.createDataFrame([(1,)], "id long")).select("id").collect()[0][0] == 8


def test_edits_keep_clashing_columns(spark):
    states = spark.createDataFrame([(1, "A", "#111111", False, 5, 6, 7)], "id long, name string, colour string, removed boolean, new_name int, Known int, k int")
    commands = spark.createDataFrame([(1, "state", 1, "rename", "X", 3, 4)], "seq long, entity string, id long, op string, value string, known int, k int")
    assert tuple(edits.apply(states, commands, "state").first()) == (1, "X", "#111111", False, 5, 6, 7)
    assert edits.last_writes(commands).columns == commands.columns
