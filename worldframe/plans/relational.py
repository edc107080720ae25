"""Operators of the map model as declared SQL plans over named frames.

Each plan names its inputs and is one statement that Catalyst optimises as a whole; run() binds any DataFrames
with the right columns. Joins are equi-joins, catalogs are left to the optimizer to broadcast by their size,
and windows and aggregates are keyed by entity or cell.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from worldframe.functions import expressions as E


@dataclass(frozen=True)
class Plan:
    needs: tuple[str, ...]
    sql: str
    recursive: bool = False

    def run(self, spark: SparkSession, **frames: DataFrame) -> DataFrame:
        return spark.sql(self.sql, **{n: frames[n] for n in self.needs})

    def ansi(self) -> str:
        """The statement over tables with the inputs' own names."""
        return self.sql.format(**{n: n for n in self.needs})


def _colour(x: str) -> str:
    return ", ".join(f"{E.rn(E.linear(f'({E.hex_byte(x, at)} / 255e0)'), 6)} AS {c}" for c, at in (("r", 2), ("g", 4), ("b", 6)))


def _catalog_colour(table: str, key: str) -> Plan:
    """Cell to catalog colour by id; a missing, empty or neutral entry is transparent."""
    return Plan(("cells", table), f"SELECT c.cell_id, c.{key} AS id, CASE WHEN c.{key} = 0 THEN '' ELSE coalesce(t.colour, '') END AS colour, CASE WHEN c.{key} = 0 OR coalesce(t.colour, '') = '' THEN 0e0 ELSE 1e0 END AS alpha FROM {{cells}} c LEFT JOIN {{{table}}} t ON c.{key} = t.id")


def _border(key: str) -> Plan:
    """Each pair of neighbours with different non-equal keys once, with the centres it joins."""
    return Plan(("cells", "edges"), f"SELECT e.src, e.dst, a.{key} AS a_id, b.{key} AS b_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS bp FROM {{edges}} e JOIN {{cells}} a ON e.src = a.cell_id JOIN {{cells}} b ON e.dst = b.cell_id WHERE e.src < e.dst AND a.{key} <> b.{key}")


_LEAD = "lead({0}) OVER (PARTITION BY id ORDER BY pos)"
_LAG = "lag({0}) OVER (PARTITION BY id ORDER BY pos)"
_NEAR = "SELECT e.src, e.slot, e.dst, b.height, b.precipitation FROM {edges} e JOIN {cells} b ON e.dst = b.cell_id"
#: Steepest strictly lower neighbour of land cells, the first on ties.
_DOWN = """SELECT src, dst FROM (SELECT e.src, e.dst, row_number() OVER (PARTITION BY e.src ORDER BY b.height, e.slot) AS k
    FROM {edges} e JOIN {cells} a ON e.src = a.cell_id JOIN {cells} b ON e.dst = b.cell_id WHERE a.height >= 20 AND b.height < a.height) q WHERE k = 1"""

PLANS: dict[str, Plan] = {
    # Flagship: the cell inspector.
    "inspector_join": Plan(("cells", "biomes", "states", "cultures", "provinces", "burgs"), f"""SELECT c.cell_id, c.height, {E.rn(E.height_display('c.height'), 4)} AS height_display,
        coalesce(b.name, '?') AS biome_name, CASE WHEN c.state = 0 THEN 'Wildlands' ELSE coalesce(s.name, '?') END AS state_name,
        CASE WHEN c.culture = 0 THEN 'Wildlands' ELSE coalesce(k.name, '?') END AS culture_name,
        CASE WHEN c.province = 0 THEN '—' ELSE coalesce(p.name, '?') END AS province_name,
        coalesce(t.name, '—') AS burg_name, {E.whole('c.population * 1e3 + 5e-1')} AS population_people
        FROM {{cells}} c LEFT JOIN {{biomes}} b ON c.biome = b.id LEFT JOIN {{states}} s ON c.state = s.id LEFT JOIN {{cultures}} k ON c.culture = k.id
        LEFT JOIN {{provinces}} p ON c.province = p.id LEFT JOIN {{burgs}} t ON c.cell_id = t.cell"""),
    # Scalar projections.
    "height_display": Plan(("cells",), f"SELECT c.cell_id, {E.rn(E.height_display('c.height'), 4)} AS metres, {E.rn(E.height_display('c.height', '1.8e0', True), 4)} AS feet FROM {{cells}} c"),
    "js_round": Plan(("points",), f"SELECT p.event_id, {E.rn('p.y - 5e1')} AS r0, {E.rn('p.y - 5e1', 1)} AS r1, {E.rn('(p.event_id % 9 - 4) / 2e0')} AS half FROM {{points}} p"),
    "hex_to_linear": Plan(("states",), f"SELECT s.id, {_colour('s.colour')} FROM {{states}} s"),
    "temperature_color": Plan(("cells",), "SELECT q.cell_id, " + ", ".join(f"{E.rn(E.temperature_colour('q.t', k), 6)} AS {c}" for k, c in ((1, "r"), (2, "g"), (3, "b"))) + ", 0.85e0 AS a FROM (SELECT c.cell_id, greatest(least((c.temperature + 50e0) / 1e2, 1e0), 0e0) AS t FROM {cells} c) q"),
    "precip_color": Plan(("cells",), f"SELECT q.cell_id, {E.rn('0.05e0 + 0.1e0 * q.i', 6)} AS r, {E.rn('0.15e0 + 0.4e0 * q.i', 6)} AS g, {E.rn('0.5e0 + 0.5e0 * q.i', 6)} AS b, 0.75e0 AS a FROM (SELECT c.cell_id, c.precipitation * 1e0 / greatest(m.top, 1) AS i FROM {{cells}} c JOIN (SELECT max(precipitation) AS top FROM {{cells}}) m ON 1 = 1) q"),
    "population_color": Plan(("cells",), f"""SELECT q.cell_id, CASE WHEN q.t > 0 THEN {E.rn('0.1e0 + 0.9e0 * q.t', 6)} ELSE 0e0 END AS r, CASE WHEN q.t > 0 THEN {E.rn('0.9e0 * (1e0 - 0.8e0 * q.t)', 6)} ELSE 0e0 END AS g,
        CASE WHEN q.t > 0 THEN {E.rn('0.4e0 * (1e0 - q.t)', 6)} ELSE 0e0 END AS b, CASE WHEN q.t > 0 THEN {E.rn('0.6e0 + 0.4e0 * q.t', 6)} ELSE 0e0 END AS a
        FROM (SELECT c.cell_id, CASE WHEN c.population <= 0 OR m.top <= 0 THEN 0e0 ELSE least(1e0, sqrt(c.population / m.top)) END AS t FROM {{cells}} c JOIN (SELECT max(population) AS top FROM {{cells}}) m ON 1 = 1) q"""),
    "lake_route_color": Plan(("features",), """SELECT q.id, q.lake_group, CASE WHEN q.lake_group IN ('dry', 'lava') THEN 0.7e0 ELSE 0.2e0 END AS lake_r, CASE q.lake_group WHEN 'dry' THEN 0.65e0 WHEN 'lava' THEN 0.25e0 ELSE 0.45e0 END AS lake_g, CASE q.lake_group WHEN 'dry' THEN 0.5e0 WHEN 'lava' THEN 0.1e0 ELSE 0.8e0 END AS lake_b,
        q.route_group, CASE q.route_group WHEN 'roads' THEN 0.5e0 WHEN 'trails' THEN 0.6e0 ELSE 0.2e0 END AS route_r, CASE q.route_group WHEN 'roads' THEN 0.3e0 WHEN 'trails' THEN 0.5e0 ELSE 0.4e0 END AS route_g, CASE q.route_group WHEN 'roads' THEN 0.1e0 WHEN 'trails' THEN 0.3e0 ELSE 0.8e0 END AS route_b, CASE q.route_group WHEN 'roads' THEN 0.7e0 ELSE 0.5e0 END AS route_a
        FROM (SELECT id, CASE id % 6 WHEN 0 THEN 'freshwater' WHEN 1 THEN 'salt' WHEN 2 THEN 'dry' WHEN 3 THEN 'sinkhole' WHEN 4 THEN 'lava' END AS lake_group, CASE id % 3 WHEN 0 THEN 'roads' WHEN 1 THEN 'trails' ELSE 'searoutes' END AS route_group FROM {features}) q"""),
    "relief_class": Plan(("cells",), "SELECT c.cell_id, c.height, CASE WHEN c.height >= 80 THEN 6e0 WHEN c.height >= 60 THEN 4e0 ELSE 2.5e0 END AS size FROM {cells} c WHERE c.height >= 40"),
    # Colours and shapes of relief triangles (three corners, from the top).
    "relief_triangles": Plan(("cells",), f"""SELECT r.cell_id, k.corner, {E.rn("r.x + k.sx * r.size * CASE WHEN r.height >= 80 THEN 0.7e0 ELSE 0.5e0 END", 4)} AS x,
        {E.rn("r.y + r.size * CASE WHEN k.corner = 0 THEN CASE WHEN r.height >= 80 THEN -1e0 ELSE -0.6e0 END WHEN r.height >= 80 THEN 0.5e0 ELSE 0.4e0 END", 4)} AS y,
        CASE WHEN r.height >= 80 THEN 0.6e0 WHEN r.height >= 60 THEN 0.45e0 ELSE 0.3e0 END AS r, CASE WHEN r.height >= 60 THEN 0.55e0 ELSE 0.5e0 END AS g,
        CASE WHEN r.height >= 80 THEN 0.5e0 WHEN r.height >= 60 THEN 0.3e0 ELSE 0.25e0 END AS b, CASE WHEN r.height >= 80 THEN 0.7e0 WHEN r.height >= 60 THEN 0.6e0 ELSE 0.5e0 END AS a
        FROM (SELECT c.*, CASE WHEN c.height >= 80 THEN 6e0 WHEN c.height >= 60 THEN 4e0 ELSE 2.5e0 END AS size FROM {{cells}} c WHERE c.height >= 40) r CROSS JOIN (VALUES (CAST(0 AS BIGINT), 0e0), (CAST(1 AS BIGINT), -1e0), (CAST(2 AS BIGINT), 1e0)) k(corner, sx)"""),
    "normalize_hex": Plan(("states",), """SELECT q.id, q.raw, CASE WHEN length(q.h) = 6 AND length(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(lower(q.h), '0', ''), '1', ''), '2', ''), '3', ''), '4', ''), '5', ''), '6', ''), '7', ''), '8', ''), '9', ''), 'a', ''), 'b', ''), 'c', ''), 'd', ''), 'e', ''), 'f', '')) = 0
        THEN concat('#', lower(q.h)) END AS hex FROM (SELECT s.id, s.raw, CASE WHEN substr(s.raw, 1, 1) = '#' THEN substr(s.raw, 2) ELSE s.raw END AS h FROM (SELECT id, CASE WHEN id % 5 = 4 THEN upper(replace(colour, '#', '')) WHEN id % 5 = 3 THEN concat(colour, 'Z') WHEN id % 5 = 2 THEN '#12G456' ELSE upper(colour) END AS raw FROM {states}) s) q"""),
    "trim_name": Plan(("burgs",), "SELECT q.id, trim(q.name) AS name, length(trim(q.name)) > 0 AS valid FROM (SELECT id, CASE WHEN id % 7 = 0 THEN '   ' ELSE concat('  ', name, ' ') END AS name FROM {burgs}) q"),
    "rgba_to_hex": Plan(("points",), "SELECT p.event_id, printf('#%02x%02x%02x', CAST(floor((p.event_id % 11) / 1e1 * 255e0) AS INT), CAST(floor((p.event_id % 7) / 6e0 * 255e0) AS INT), CAST(floor((p.event_id % 5) / 4e0 * 255e0) AS INT)) AS hex FROM {points} p"),
    "xml_escape": Plan(("pages",), f"SELECT p.page_id, {E.escape_xml('p.html')} AS escaped FROM {{pages}} p"),
    "river_width": Plan(("points",), f"SELECT q.event_id, {E.rn('q.off', 6)} AS off, {E.rn(E.river_width('q.off'), 6)} AS width, {E.rn(E.source_width('q.flux'), 6)} AS source_width FROM (SELECT event_id, flux, {E.river_offset('pos', 'flux', '1.2e0', '0.05e0')} AS off FROM (SELECT event_id, pos, greatest(flux, 0e0) AS flux FROM {{points}}) p) q"),
    "edge_point": Plan(("cells",), "SELECT c.cell_id, CASE WHEN c.y <= 15e2 - c.y AND c.y <= c.x AND c.y <= 1e3 - c.x THEN c.x WHEN 15e2 - c.y <= c.x AND 15e2 - c.y <= 1e3 - c.x THEN c.x WHEN c.x <= 1e3 - c.x THEN 0e0 ELSE 1e3 END AS ex, CASE WHEN c.y <= 15e2 - c.y AND c.y <= c.x AND c.y <= 1e3 - c.x THEN 0e0 WHEN 15e2 - c.y <= c.x AND 15e2 - c.y <= 1e3 - c.x THEN 15e2 ELSE c.y END AS ey FROM {cells} c WHERE c.y <= 15e2"),
    "nice_grid": Plan(("cells",), f"SELECT {E.nice_spacing('least(q.w, q.h)', 12)} AS grid, {E.nice_spacing('least(q.w, q.h)', 8)} AS coordinates FROM (SELECT max(x) - min(x) AS w, max(y) - min(y) AS h FROM {{cells}}) q"),
    "segment_intersection": Plan(("points",), f"""SELECT q.event_id, CASE WHEN abs(q.d) >= 1e-9 AND q.s >= 0 AND q.s <= 1 AND q.u >= 0 AND q.u <= 1 THEN {E.rn('q.x + q.s * q.dx', 6)} END AS ix FROM (
        SELECT r.*, CASE WHEN abs(r.d) < 1e-9 THEN NULL ELSE ((47e1 - r.x) * 1e2 - (0e0 - r.y) * 0e0) / r.d END AS s, CASE WHEN abs(r.d) < 1e-9 THEN NULL ELSE ((47e1 - r.x) * r.dy - (0e0 - r.y) * r.dx) / r.d END AS u FROM (
        SELECT event_id, x, y, {_LEAD.format('x')} - x AS dx, {_LEAD.format('y')} - y AS dy, ({_LEAD.format('x')} - x) * 1e2 - ({_LEAD.format('y')} - y) * 0e0 AS d FROM {{points}}) r WHERE r.dx IS NOT NULL) q"""),
    "is_navigable": Plan(("streams",), "SELECT s.cell_id, s.river <> 0 AND s.flux >= 100 AS navigable FROM {streams} s"),
    "world_to_screen": Plan(("cells",), f"SELECT q.cell_id, q.sx, q.sy, {E.rn('q.sx / 2e0 + 1e2', 6)} AS wx FROM (SELECT c.cell_id, (c.x - 1e2) * 2e0 AS sx, (c.y - 5e1) * 2e0 AS sy FROM {{cells}} c) q"),
    # Filters.
    "land_filter": Plan(("cells",), "SELECT c.cell_id, c.height FROM {cells} c WHERE c.height >= 20"),
    "water_mask": Plan(("cells", "places", "features"), "SELECT c.cell_id, c.height < 20 OR f.id IS NOT NULL AS is_water FROM {cells} c JOIN {places} p ON c.cell_id = p.cell_id LEFT JOIN (SELECT id FROM {features} WHERE kind = 'lake') f ON p.feature = f.id"),
    "soft_delete": Plan(("burgs",), "SELECT b.id, b.name FROM {burgs} b WHERE NOT b.removed AND b.id <> 0"),
    "viewport_cull": Plan(("burgs", "cells"), "SELECT q.id, q.name, q.sx, q.sy FROM (SELECT b.id, b.name, (c.x - 2e2) * 1.5e0 AS sx, (c.y - 1e2) * 1.5e0 AS sy FROM {burgs} b JOIN {cells} c ON b.cell = c.cell_id WHERE NOT b.removed) q WHERE q.sx >= 0 AND q.sx <= 8e2 AND q.sy >= 0 AND q.sy <= 6e2"),
    "border_points": Plan(("cells",), "SELECT c.cell_id, c.x <= 5e0 OR c.x >= 995e0 OR c.y <= 5e0 AS on_border FROM {cells} c WHERE c.x >= 0 AND c.x <= 1e3"),
    "feature_filter": Plan(("features",), "SELECT f.id, f.kind FROM {features} f WHERE f.kind <> 'lake' AND f.kind <> 'ocean' AND f.cell_count >= 3"),
    # Joins.
    "pack_grid_fk": Plan(("cells",), "SELECT p.cell_id, p.grid_id, coalesce(g.province, 0) AS feature_id, g.temperature, g.precipitation FROM (SELECT cell_id, cell_id - cell_id % 4 AS grid_id FROM {cells}) p LEFT JOIN {cells} g ON p.grid_id = g.cell_id"),
    "biome_color_join": Plan(("cells", "biomes"), "SELECT c.cell_id, coalesce(b.colour, '#000000') AS colour FROM {cells} c LEFT JOIN {biomes} b ON c.biome = b.id"),
    "state_color_join": _catalog_colour("states", "state"),
    "province_color_join": _catalog_colour("provinces", "province"),
    "religion_color_join": _catalog_colour("religions", "religion"),
    "culture_color_join": _catalog_colour("cultures", "culture"),
    "zone_last_wins": Plan(("cells", "zones"), "SELECT c.cell_id, z.zone FROM {cells} c LEFT JOIN (SELECT cell_id, max(zone) AS zone FROM {zones} GROUP BY cell_id) z ON c.cell_id = z.cell_id"),
    "entity_from_cell": Plan(("cells", "states", "burgs"), "SELECT c.cell_id, CASE WHEN s.id IS NOT NULL THEN 'state' WHEN b.id IS NOT NULL THEN 'burg' WHEN c.province <> 0 THEN 'province' END AS kind, CASE WHEN s.id IS NOT NULL THEN s.id WHEN b.id IS NOT NULL THEN b.id WHEN c.province <> 0 THEN c.province END AS id FROM {cells} c LEFT JOIN (SELECT id FROM {states} WHERE id <> 0 AND NOT removed) s ON c.state = s.id LEFT JOIN (SELECT id, cell FROM {burgs} WHERE NOT removed) b ON c.cell_id = b.cell"),
    "hover_tooltip": Plan(("cells", "biomes"), f"SELECT c.cell_id, coalesce(b.name, '?') AS biome, {E.rn(E.height_display('c.height'), 2)} AS height FROM {{cells}} c LEFT JOIN {{biomes}} b ON c.biome = b.id"),
    "burg_markers": Plan(("burgs", "cells", "states"), "SELECT b.id, c.x, c.y, CASE WHEN b.is_capital THEN 5e0 ELSE 3e0 END AS radius, coalesce(s.colour, '#808080') AS colour FROM {burgs} b JOIN {cells} c ON b.cell = c.cell_id LEFT JOIN (SELECT id, colour FROM {states} WHERE id <> 0) s ON b.state = s.id WHERE NOT b.removed"),
    "neighbor_join": Plan(("cells", "edges"), "SELECT e.src, e.slot, e.dst, a.height AS src_height, b.height AS dst_height FROM {edges} e JOIN {cells} a ON e.src = a.cell_id JOIN {cells} b ON e.dst = b.cell_id"),
    "fk_antijoin": Plan(("cells", "states"), "SELECT c.cell_id, c.state FROM {cells} c LEFT ANTI JOIN (SELECT id FROM {states} WHERE id % 6 <> 5) s ON c.state = s.id"),
    # Aggregates.
    "layer_maxima": Plan(("cells",), "SELECT max(precipitation) AS precipitation, max(population) AS population FROM {cells}"),
    "bbox": Plan(("cells",), "SELECT coalesce(min(x), 0e0) AS x0, coalesce(min(y), 0e0) AS y0, coalesce(max(x), 0e0) AS x1, coalesce(max(y), 0e0) AS y1 FROM {cells}"),
    "next_id": Plan(("burgs",), "SELECT coalesce(max(id), 0) + 1 AS next_id FROM {burgs}"),
    "lake_flux": Plan(("cells", "edges", "places", "features"), "SELECT q.lake, CAST(sum(q.precipitation) AS BIGINT) AS entering FROM (SELECT DISTINCT p.feature AS lake, e.dst, b.precipitation FROM {edges} e JOIN {places} p ON e.src = p.cell_id JOIN {features} f ON p.feature = f.id JOIN {cells} b ON e.dst = b.cell_id WHERE b.height >= 20 AND f.kind = 'lake') q GROUP BY q.lake"),
    "neighbor_mean": Plan(("cells", "edges"), f"SELECT n.src AS cell_id, {E.rn('avg(CASE WHEN n.height >= 20 THEN 1e1 ELSE 1e0 END)', 6)} AS mean FROM ({_NEAR}) n GROUP BY n.src"),
    "confluence_influx": Plan(("cells", "edges", "streams"), "SELECT e.src AS cell_id, CAST(sum(s.flux) - max(s.flux) AS BIGINT) AS influx FROM {edges} e JOIN {cells} a ON e.src = a.cell_id JOIN {cells} b ON e.dst = b.cell_id JOIN {streams} s ON e.dst = s.cell_id WHERE b.height > a.height AND s.river <> 0 GROUP BY e.src HAVING count(*) > 1"),
    "downcut": Plan(("cells", "edges", "streams"), f"SELECT c.cell_id, {E.whole('least(o.flux / n.higher, 5e0)')} AS cut FROM {{cells}} c JOIN {{streams}} o ON c.cell_id = o.cell_id JOIN (SELECT e.src, avg(s.flux * 1e0) AS higher FROM {{edges}} e JOIN {{cells}} a ON e.src = a.cell_id JOIN {{cells}} b ON e.dst = b.cell_id JOIN {{streams}} s ON e.dst = s.cell_id WHERE b.height > a.height GROUP BY e.src) n ON c.cell_id = n.src WHERE c.height >= 35 AND o.flux > 0 AND n.higher > 0"),
    "river_groups": Plan(("points",), "SELECT p.id AS river, count(*) AS cells, min(p.event_id) AS source, max(p.event_id) AS last FROM {points} p GROUP BY p.id HAVING count(*) >= 3"),
    # Cells of a river in order of id; the mouth is the last but one. modifier: the fourth root of the map's cells over 10,000.
    "define_rivers": Plan(("streams",), f"""SELECT q.id, q.source_cell, q.mouth_cell, q.discharge, q.width_factor, {E.rn('q.source_width', 6)} AS source_width, {E.rn(E.river_width(E.river_offset('q.n_cells', 'q.discharge', 'q.width_factor', 'q.source_width')), 6)} AS width_km, q.n_cells FROM (
        SELECT r.river AS id, min(r.cell_id) AS source_cell, max(CASE WHEN r.pos = r.n - 2 THEN r.cell_id END) AS mouth_cell, max(CASE WHEN r.pos = r.n - 2 THEN r.flux END) AS discharge, max(1.2e0 * {E.rn('1e0 / r.modifier', 2)}) AS width_factor, max(CASE WHEN r.pos = 0 THEN {E.source_width('r.flux')} END) AS source_width, count(*) AS n_cells
        FROM (SELECT river, cell_id, flux, modifier, row_number() OVER (PARTITION BY river ORDER BY cell_id) - 1 AS pos, count(*) OVER (PARTITION BY river) AS n FROM {{streams}} WHERE river <> 0) r WHERE r.n >= 3 GROUP BY r.river) q"""),
    "polyline_length": Plan(("points",), f"SELECT q.id, {E.rn('coalesce(sum(sqrt(q.dx * q.dx + q.dy * q.dy)), 0e0)', 4)} AS length FROM (SELECT id, {_LEAD.format('x')} - x AS dx, {_LEAD.format('y')} - y AS dy FROM {{points}}) q GROUP BY q.id"),
    "ring_area": Plan(("points",), f"SELECT q.id, {E.rn('sum(q.x * q.ny - q.nx * q.y) / 2e0', 3)} AS signed_area, {E.whole('least(abs(sum(q.x * q.ny - q.nx * q.y) / 2e0), 65535e0)')} AS area FROM (SELECT id, x, y, coalesce({_LEAD.format('x')}, first_value(x) OVER (PARTITION BY id ORDER BY pos)) AS nx, coalesce({_LEAD.format('y')}, first_value(y) OVER (PARTITION BY id ORDER BY pos)) AS ny FROM {{points}}) q GROUP BY q.id"),
    "lowest_shore": Plan(("cells", "edges", "places", "features"), "SELECT lake, dst AS cell_id, height FROM (SELECT q.*, row_number() OVER (PARTITION BY lake ORDER BY height, dst) AS k FROM (SELECT DISTINCT p.feature AS lake, e.dst, b.height FROM {edges} e JOIN {places} p ON e.src = p.cell_id JOIN {features} f ON p.feature = f.id JOIN {cells} b ON e.dst = b.cell_id WHERE f.kind = 'lake' AND b.height >= 20) q) r WHERE k = 1"),
    "water_counts": Plan(("cells",), "SELECT CAST(count_if(height < 20) AS BIGINT) AS water, CAST(count_if(height >= 20) AS BIGINT) AS land, count(*) AS cells FROM {cells}"),
    "state_stats": Plan(("cells", "burgs"), f"SELECT c.state, c.cells, c.rural, coalesce(b.burgs, 0) AS burgs, coalesce(b.urban, 0e0) AS urban FROM (SELECT state, count(*) AS cells, {E.rn('sum(population)', 2)} AS rural FROM {{cells}} GROUP BY state) c LEFT JOIN (SELECT state, count(*) AS burgs, {E.rn('sum(population)', 2)} AS urban FROM {{burgs}} WHERE NOT removed GROUP BY state) b ON c.state = b.state"),
    # Ordered sequences.
    "segments": Plan(("points",), f"SELECT q.id, q.pos, q.x, q.y, q.nx, q.ny FROM (SELECT id, pos, x, y, {_LEAD.format('x')} AS nx, {_LEAD.format('y')} AS ny FROM {{points}}) q WHERE q.nx IS NOT NULL"),
    "ring_pairs": Plan(("points",), f"SELECT id, pos, event_id AS a, coalesce({_LEAD.format('event_id')}, first_value(event_id) OVER (PARTITION BY id ORDER BY pos)) AS b FROM {{points}}"),
    "running_max_flux": Plan(("points",), "SELECT id, pos, max(flux) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS flux FROM {points}"),
    "arc_param": Plan(("points",), f"SELECT q.id, q.pos, {E.rn('CASE WHEN q.total > 0 THEN coalesce(q.cum, 0e0) / q.total ELSE 0e0 END', 5)} AS t FROM (SELECT id, pos, sum(d) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cum, sum(d) OVER (PARTITION BY id) AS total FROM (SELECT id, pos, sqrt(power(coalesce({_LEAD.format('x')}, first_value(x) OVER (PARTITION BY id ORDER BY pos)) - x, 2e0) + power(coalesce({_LEAD.format('y')}, first_value(y) OVER (PARTITION BY id ORDER BY pos)) - y, 2e0)) AS d FROM {{points}}) s) q"),
    "anchor_fill": Plan(("points",), "SELECT id, pos, max(CASE WHEN event_id % 4 = 0 THEN pos END) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prev_anchor, min(CASE WHEN event_id % 4 = 0 THEN pos END) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_anchor FROM {points}"),
    "corner_cos": Plan(("points",), f"SELECT q.event_id, CASE WHEN q.l = 0 THEN -1e0 ELSE {E.rn('(q.ax * q.bx + q.ay * q.bv) / q.l', 6)} END AS corner FROM (SELECT event_id, ax, ay, bx, bv, sqrt(ax * ax + ay * ay) * sqrt(bx * bx + bv * bv) AS l FROM (SELECT event_id, {_LAG.format('x')} - x AS ax, {_LAG.format('y')} - y AS ay, {_LEAD.format('x')} - x AS bx, {_LEAD.format('y')} - y AS bv FROM {{points}}) r WHERE ax IS NOT NULL AND bx IS NOT NULL) q"),
    "gap_segments": Plan(("points",), "SELECT id, CAST(island AS BIGINT) AS island, count(*) AS points, min(pos) AS first_pos, max(pos) AS last_pos FROM (SELECT id, pos, gap, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM (SELECT id, pos, flux > 60 AS gap FROM {points}) p) q WHERE NOT gap GROUP BY id, island"),
    "fill_path": Plan(("points",), f"SELECT id, pos, x AS cx, y AS cy, {E.rn('(x + coalesce(' + _LEAD.format('x') + ', first_value(x) OVER (PARTITION BY id ORDER BY pos))) / 2e0', 4)} AS mx, {E.rn('(y + coalesce(' + _LEAD.format('y') + ', first_value(y) OVER (PARTITION BY id ORDER BY pos))) / 2e0', 4)} AS mp FROM {{points}}"),
    "river_banks": Plan(("points",), f"""SELECT id, pos, {E.rn('x - w * dy / l', 4)} AS lx, {E.rn('y + w * dx / l', 4)} AS ly, {E.rn('x + w * dy / l', 4)} AS rx, {E.rn('y - w * dx / l', 4)} AS ry FROM (SELECT id, pos, x, y, dx, dy, sqrt(dx * dx + dy * dy) AS l, {E.river_width(E.river_offset('pos', 'flux', '1.2e0', '0.05e0'))} AS w FROM (
        SELECT id, pos, x, y, greatest(flux, 0e0) AS flux, coalesce({_LEAD.format('x')}, x) - coalesce({_LAG.format('x')}, x) AS dx, coalesce({_LEAD.format('y')}, y) - coalesce({_LAG.format('y')}, y) AS dy FROM {{points}}) q) r WHERE l > 0"""),
    "laplacian_smooth": Plan(("cells", "edges"), f"SELECT c.cell_id, {E.rn('CASE WHEN n.k >= 2 THEN c.x + (n.mx - c.x) * 0.2e0 ELSE c.x END', 6)} AS x, {E.rn('CASE WHEN n.k >= 2 THEN c.y + (n.mp - c.y) * 0.2e0 ELSE c.y END', 6)} AS y FROM {{cells}} c LEFT JOIN (SELECT e.src, count(*) AS k, avg(b.x) AS mx, avg(b.y) AS mp FROM {{edges}} e JOIN {{cells}} b ON e.dst = b.cell_id GROUP BY e.src) n ON c.cell_id = n.src"),
    "height_order": Plan(("cells",), "SELECT cell_id, CAST(row_number() OVER (PARTITION BY state ORDER BY height, cell_id) AS BIGINT) AS rising, CAST(row_number() OVER (PARTITION BY state ORDER BY height DESC, cell_id) AS BIGINT) AS falling FROM {cells} WHERE height >= 20"),
    # Graph.
    "alter_heights": Plan(("cells", "edges"), f"SELECT c.cell_id, {E.rn('CASE WHEN c.height >= 20 THEN c.height + t.t / 1e2 + coalesce(n.mean, t.t) / 1e4 ELSE c.height * 1e0 END', 5)} AS h FROM {{cells}} c JOIN (SELECT cell_id, CASE WHEN height > 50 THEN 1e1 ELSE 5e0 END AS t FROM {{cells}}) t ON c.cell_id = t.cell_id LEFT JOIN (SELECT n.src, avg(CASE WHEN n.height >= 20 THEN 1e1 ELSE 1e0 END) AS mean FROM ({_NEAR}) n GROUP BY n.src) n ON c.cell_id = n.src"),
    # Temperature of the shore's first cell; a lake stands a tenth below its lowest shore.
    "lake_climate": Plan(("features", "places", "edges", "cells"), f"""SELECT q.id, q.flux, {E.rn('q.evaporation', 4)} AS evaporation, NOT q.touches_border AND q.evaporation >= q.flux AS closed,
        CASE WHEN NOT q.touches_border AND q.evaporation < q.flux THEN q.out_cell END AS out_cell FROM (
        SELECT f.id, f.touches_border, s.out_cell, coalesce(s.flux, 0) AS flux, ((700e0 * (coalesce(s.temperature, 20) + 6e-3 * sqrt(greatest(coalesce(s.low, 0) - 0.1e0 - 18e0, 0e0)))) / 5e1 + 75e0) / (8e1 - coalesce(s.temperature, 20)) * f.cell_count AS evaporation
        FROM {{features}} f LEFT JOIN (SELECT d.lake, CAST(sum(d.precipitation) AS BIGINT) AS flux, min(d.height) AS low, max(CASE WHEN d.first = 1 THEN d.temperature END) AS temperature, max(CASE WHEN d.lowest = 1 THEN d.dst END) AS out_cell FROM (
        SELECT u.*, row_number() OVER (PARTITION BY u.lake ORDER BY u.dst) AS first, row_number() OVER (PARTITION BY u.lake ORDER BY u.height, u.dst) AS lowest FROM (
        SELECT DISTINCT p.feature AS lake, e.dst, b.height, b.precipitation, b.temperature FROM {{edges}} e JOIN {{places}} p ON e.src = p.cell_id JOIN {{cells}} b ON e.dst = b.cell_id WHERE b.height >= 20) u) d GROUP BY d.lake) s ON f.id = s.lake WHERE f.kind = 'lake') q"""),
    "steepest_descent": Plan(("cells", "edges"), f"SELECT d.src, d.dst FROM ({_DOWN}) d"),
    "borders_state": _border("state"),
    "borders_province": _border("province"),
    "borders_culture": _border("culture"),
    "coast_edges": Plan(("cells", "edges"), "SELECT e.src AS land, e.dst AS water, a.state FROM {edges} e JOIN {cells} a ON e.src = a.cell_id JOIN {cells} b ON e.dst = b.cell_id WHERE a.height >= 20 AND b.height < 20 AND a.state <> 0"),
    "svg_borders": Plan(("cells", "edges"), f"SELECT e.src, e.dst, concat('M', printf('%.1f', a.x), ',', printf('%.1f', a.y), 'L', printf('%.1f', b.x), ',', printf('%.1f', b.y)) AS path FROM {{edges}} e JOIN {{cells}} a ON e.src = a.cell_id JOIN {{cells}} b ON e.dst = b.cell_id WHERE e.src < e.dst AND a.state <> b.state"),
    "generated_union": Plan(("burgs",), "SELECT id, name FROM {burgs} WHERE id % 2 = 0 UNION ALL SELECT id + 1000000 AS id, 'generated' AS name FROM {burgs} WHERE id % 2 = 1"),
    # Edits.
    "rename_states": Plan(("states", "burgs"), "SELECT s.id, coalesce(e.name, s.name) AS name FROM {states} s LEFT JOIN (SELECT state, concat('New ', name) AS name FROM (SELECT state, name, row_number() OVER (PARTITION BY state ORDER BY id DESC) AS k FROM {burgs}) q WHERE k = 1 AND state % 3 = 1) e ON s.id = e.state AND s.id <> 0 AND NOT s.removed"),
    "set_population": Plan(("cells", "burgs"), "SELECT c.cell_id, coalesce(b.population, c.population) AS population FROM {cells} c LEFT JOIN (SELECT cell, greatest(population - 5e3, 0e0) AS population FROM {burgs} WHERE id % 10 = 0 AND NOT removed) b ON c.cell_id = b.cell"),
    "toggle_capital": Plan(("burgs",), "SELECT b.id, b.state, CASE WHEN t.id IS NULL OR b.state = 0 THEN b.is_capital ELSE b.id = t.id END AS is_capital FROM {burgs} b LEFT JOIN (SELECT state, min(id) AS id FROM {burgs} WHERE state % 4 = 1 AND NOT removed GROUP BY state) t ON b.state = t.state"),
    "recolor_reject": Plan(("states",), "SELECT s.id, CASE WHEN s.id = 0 OR s.removed THEN 'EntityNotFound' WHEN s.id % 5 = 2 THEN 'InvalidHexColor' WHEN s.id % 7 = 3 THEN 'EmptyName' END AS error FROM {states} s"),
    # Referential integrity: one row per check.
    "validate": Plan(("cells", "states", "cultures", "burgs"), """SELECT 'state' AS rule, count(*) AS broken FROM (SELECT 1 AS x FROM {cells} c LEFT JOIN {states} s ON c.state = s.id WHERE c.state <> 0 AND s.id IS NULL) a
        UNION ALL SELECT 'culture' AS rule, count(*) AS broken FROM (SELECT 1 AS x FROM {cells} c LEFT JOIN {cultures} s ON c.culture = s.id WHERE c.culture <> 0 AND s.id IS NULL) b
        UNION ALL SELECT 'burg_cell' AS rule, count(*) AS broken FROM (SELECT 1 AS x FROM {burgs} b LEFT JOIN {cells} c ON b.cell = c.cell_id WHERE c.cell_id IS NULL) d"""),
}
