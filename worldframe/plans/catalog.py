"""The registered queries and, where SQL can express them, the same as ANSI SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worldframe.functions import views
from worldframe.functions.palette import height_colours
from worldframe.operators import edits, graph, hydrology, isolines, mesh, nearest, polyline, rivers
from worldframe.plans.lineage import cut
from worldframe.plans.relational import PLANS
from worldframe.sinks import svg
from worldframe.sources import derived, mapfile

Query = Callable[[SparkSession, str], DataFrame]
PLAIN = ("pages", "documents", "events", "conversations")

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A named input: a derived table, the zones, or a plain scan."""
    if name in PLAIN:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "zones":
        near = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")), lambda z: F.col("cell_id") % (z + 3) == 0)
        return derived.cells(spark, sf_dir).select("cell_id", F.explode(near).alias("zone"))
    return derived.FRAMES[name](spark, sf_dir)


def frames(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    """The named inputs; cells and edges that several need are written once, and the components that places and features share are found once."""
    made: dict[str, DataFrame] = {}
    if "cells" in names and {"edges", "places", "streams"} & {*names}:
        made["cells"] = cut(frame(spark, sf_dir, "cells"))
        made["edges"] = cut(derived.edges(spark, sf_dir, made["cells"]))
        if {"places", "features"} & {*names}:
            made["places"] = derived.places(spark, sf_dir, made["cells"], made["edges"])
        made |= {n: derived.FRAMES[n](spark, sf_dir, made["cells"]) for n in ("rings", "vertices") if n in names}
        if "streams" in names:
            made["streams"] = derived.streams(spark, sf_dir, made["cells"], made["edges"])
    made |= {n: frame(spark, sf_dir, n) for n in names if n != "features" and n not in made}
    if "features" in names:
        made["features"] = derived.features(spark, sf_dir, made.get("places"), made.get("cells"))
    return {n: made[n] for n in names}


ZONES = "zones AS (SELECT CAST(z AS BIGINT) AS zone, cell_id FROM cells CROSS JOIN (VALUES (0), (1), (2), (3), (4)) v(z) WHERE cell_id % (z + 3) = 0)"


def _with(needs: tuple[str, ...], recursive: bool = False, more: tuple[str, ...] = ()) -> str:
    names = tuple(n for n in needs if n not in PLAIN and n != "zones")
    clause = derived.with_clause(names, recursive)
    extra = [*([ZONES] if "zones" in needs else []), *more]
    return clause.rstrip() + (", " if extra else " ") + ", ".join(extra) + " "


def _plan(name: str) -> Query:
    plan = PLANS[name]
    return lambda spark, sf_dir: plan.run(spark, **frames(spark, sf_dir, plan.needs))


for _name, _p in PLANS.items():
    QUERIES[_name] = _plan(_name)
    _ansi = _p.ansi().replace("LEFT ANTI JOIN", "ANTI JOIN")
    ORACLE_SQL[_name] = (_with(_p.needs) if set(_p.needs) - set(PLAIN) else "") + _ansi


# The same pairs: slots 0 and 1 lead to the larger id.
_PAIRS = "SELECT e.src, e.dst, a.{0} AS a_id, b.{0} AS b_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS bp FROM edges e JOIN cells a ON e.src = a.cell_id JOIN cells b ON e.dst = b.cell_id WHERE e.slot < 2"
for _key in ("state", "province", "culture"):
    ORACLE_SQL[f"borders_{_key}"] = _with(("edges",), more=(f"pairs AS MATERIALIZED ({_PAIRS.format(_key)})",)) + "SELECT * FROM pairs WHERE a_id <> b_id"
ORACLE_SQL["svg_borders"] = _with(("edges",), more=(f"pairs AS MATERIALIZED ({_PAIRS.format('state')})",)) + "SELECT src, dst, printf('M%.1f,%.1fL%.1f,%.1f', ax, ay, bx, bp) AS path FROM pairs WHERE a_id <> b_id"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["inspector_join"](spark, sf_dir)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


R4 = "floor(({0}) * 1e4 + 5e-1) / 1e4 + 0e0"
DOWN = """down AS MATERIALIZED (SELECT src, dst FROM (SELECT e.src, e.dst, row_number() OVER (PARTITION BY e.src ORDER BY b.height, e.slot) AS k
    FROM edges e JOIN cells a ON e.src = a.cell_id JOIN cells b ON e.dst = b.cell_id WHERE a.height >= 20 AND b.height < a.height) WHERE k = 1)"""


@query(_with(("cells",)) + """SELECT c.cell_id, CAST(l.level AS BIGINT) AS level FROM cells c JOIN (SELECT range AS level FROM range(20, 99, 6)) l ON c.height >= l.level""")
def height_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.height_bands(frame(spark, sf_dir, "cells"))


def _side(a: str, b: str, k: int) -> str:
    t = f"CASE WHEN abs({b}_h - {a}_h) < 1e-8 THEN 0.5e0 ELSE (level - {a}_h) * 1e0 / ({b}_h - {a}_h) END"
    return f"SELECT cell_id, level, {k} AS k, {a}_x + {t} * ({b}_x - {a}_x) AS x, {a}_y + {t} * ({b}_y - {a}_y) AS y FROM levels WHERE ({a}_h >= level) <> ({b}_h >= level)"


_CORNERS = ", ".join(f"{n}.{c} AS {n}_{k}" for n in "abcd" for c, k in (("x", "x"), ("y", "y"), ("height", "h")))


@query(_with(("cells",), more=(
    "lattice AS MATERIALIZED (SELECT cell_id, cx, x, y, height FROM cells)",
    f"squares AS MATERIALIZED (SELECT a.cell_id, {_CORNERS} FROM lattice a JOIN lattice b ON b.cell_id = a.cell_id + 1 JOIN lattice c ON c.cell_id = a.cell_id + 101 JOIN lattice d ON d.cell_id = a.cell_id + 100 WHERE a.cx < 99)",
    "levels AS MATERIALIZED (SELECT * FROM squares, (SELECT range AS level FROM range(10, 91, 10)) l)",
    "sides AS (" + " UNION ALL ".join(_side(a, b, k) for k, (a, b) in enumerate((("a", "b"), ("b", "c"), ("d", "c"), ("a", "d")))) + ")",
    "ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY cell_id, level ORDER BY k) - 1 AS i FROM sides)"))
    + f"""SELECT CAST(p.level AS BIGINT) AS level, p.cell_id, CAST(p.i // 2 AS BIGINT) AS part, {R4.format('p.x')} AS x1, {R4.format('p.y')} AS y1, {R4.format('q.x')} AS x2, {R4.format('q.y')} AS y2
    FROM ranked p JOIN ranked q ON p.cell_id = q.cell_id AND p.level = q.level AND q.i = p.i + 1 WHERE p.i % 2 = 0""")  # fmt: skip
def contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.contours(frame(spark, sf_dir, "cells"))


@query(_with(("points", "cells")) + f"""SELECT event_id, cell_id, {R4.format('d2')} AS d2 FROM (SELECT p.event_id, c.cell_id, (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y) AS d2,
    row_number() OVER (PARTITION BY p.event_id ORDER BY (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y), c.cell_id) AS k
    FROM points p JOIN cells c ON c.x > p.x - 20 AND c.x < p.x + 20 AND c.y > p.y - 20 AND c.y < p.y + 20 WHERE (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y) < 400) WHERE k = 1""")
def nearest_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest_cell(frame(spark, sf_dir, "points"), frame(spark, sf_dir, "cells"))


@query(_with(("edges",), True, (DOWN, "walk(cell_id, w) AS (SELECT cell_id, precipitation FROM cells WHERE height >= 20 UNION ALL SELECT d.dst, k.w FROM walk k JOIN down d ON k.cell_id = d.src)"))
    + "SELECT k.cell_id, least(CAST(sum(k.w) AS BIGINT), 65535) AS flux FROM walk k JOIN cells c ON k.cell_id = c.cell_id WHERE c.height >= 20 GROUP BY k.cell_id")
def flow_accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.flow(frame(spark, sf_dir, "cells"), frame(spark, sf_dir, "edges"))


@query(_with(("edges",), True, (DOWN, "walk(node, cell_id) AS (SELECT src, dst FROM down UNION ALL SELECT k.node, d.dst FROM walk k JOIN down d ON k.cell_id = d.src)"))
    + "SELECT k.node, k.cell_id AS root, c.height < 20 AS reaches_water FROM walk k JOIN cells c ON k.cell_id = c.cell_id ANTI JOIN down d ON k.cell_id = d.src")
def drain_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = frame(spark, sf_dir, "cells")
    ends = graph.roots(graph.down(cells, frame(spark, sf_dir, "edges"))).where("node <> root")
    return ends.join(cells.selectExpr("cell_id AS root", "height < 20 AS reaches_water"), "root").select("node", "root", "reaches_water")


@query(_with(("edges",), True, (DOWN, "walk(start, step, cell_id) AS (SELECT cell_id, CAST(0 AS BIGINT), cell_id FROM cells WHERE height >= 90 UNION ALL SELECT k.start, k.step + 1, d.dst FROM walk k JOIN down d ON k.cell_id = d.src)"))
    + "SELECT start, step, cell_id FROM walk")
def river_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = frame(spark, sf_dir, "cells")
    return graph.trace(cells.where("height >= 90"), graph.down(cells, frame(spark, sf_dir, "edges")))


@query(_with(("edges",), True, ("same AS (SELECT e.src, e.dst FROM edges e JOIN cells a ON e.src = a.cell_id JOIN cells b ON e.dst = b.cell_id WHERE a.state = b.state)",
    "walk(cell_id, label) AS (SELECT cell_id, cell_id FROM cells UNION SELECT s.dst, k.label FROM walk k JOIN same s ON k.cell_id = s.src WHERE k.label < s.dst)"))
    + "SELECT cell_id, min(label) AS region FROM walk GROUP BY cell_id")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(frame(spark, sf_dir, "cells"), frame(spark, sf_dir, "edges"), "state")


_CR = "0.5e0 * (2e0 * {c} + ({c}2 - {c}0) * t + (2e0 * {c}0 - 5e0 * {c} + 4e0 * {c}2 - {c}3) * t * t + (3e0 * {c} - {c}0 - 3e0 * {c}2 + {c}3) * t * t * t)"
_NEAR = """near AS (SELECT *, lead(x, 1) OVER w AS x2, lead(y, 1) OVER w AS y2, coalesce(lag(x, 1) OVER w, x) AS x0, coalesce(lag(y, 1) OVER w, y) AS y0,
    coalesce(lead(x, 2) OVER w, lead(x, 1) OVER w) AS x3, coalesce(lead(y, 2) OVER w, lead(y, 1) OVER w) AS y3, count(*) OVER (PARTITION BY id) AS n FROM points WINDOW w AS (PARTITION BY id ORDER BY pos))"""


@query(_with(("points",), more=(_NEAR,)) + f"""SELECT id, pos, CAST(part AS BIGINT) AS part, {R4.format(_CR.format(c='x'))} AS x, {R4.format(_CR.format(c='y'))} AS y FROM (SELECT n.*, r.range AS part, r.range / 4e0 AS t FROM near n CROSS JOIN range(4) r WHERE x2 IS NOT NULL AND n.n > 2)
    UNION ALL SELECT id, pos, CAST(r.range AS BIGINT), {R4.format('x + (x2 - x) * (r.range / 5e0)')}, {R4.format('y + (y2 - y) * (r.range / 5e0)')} FROM near CROSS JOIN range(5) r WHERE x2 IS NOT NULL AND n = 2
    UNION ALL SELECT id, pos, CAST(0 AS BIGINT) AS part, {R4.format('x')} AS x, {R4.format('y')} AS y FROM near WHERE x2 IS NULL""")
def catmull_rom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polyline.catmull_rom(frame(spark, sf_dir, "points"))


_RING = """ring AS (SELECT p.id, p.pos, p.x, p.y, b.x AS x0, b.y AS y0, c.x AS x2, c.y AS y2, d.x AS x3, d.y AS y3, s.n FROM points p JOIN (SELECT id, count(*) AS n FROM points GROUP BY id) s ON p.id = s.id
    JOIN points b ON b.id = p.id AND b.pos = (p.pos + s.n - 1) % s.n JOIN points c ON c.id = p.id AND c.pos = (p.pos + 1) % s.n JOIN points d ON d.id = p.id AND d.pos = (p.pos + 2) % s.n)"""


@query(_with(("points",), more=(_RING,)) + f"""SELECT id, pos, CAST(part AS BIGINT) AS part, {R4.format(_CR.format(c='x'))} AS x, {R4.format(_CR.format(c='y'))} AS y FROM (SELECT g.*, r.range AS part, r.range / 4e0 AS t FROM ring g CROSS JOIN range(4) r WHERE g.n >= 4)
    UNION ALL SELECT id, pos, CAST(0 AS BIGINT), {R4.format('x')}, {R4.format('y')} FROM ring WHERE n < 4""")
def catmull_rom_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polyline.catmull_rom(frame(spark, sf_dir, "points"), closed=True)


_BENT = f"""bent AS (SELECT *, 0.5e0 + 1e0 / step + greatest(0.5e0 - step / 1e2, 0e0) AS m, CASE WHEN d2 > 0 THEN (y2 - y) / sqrt(d2) ELSE 0e0 END AS si, CASE WHEN d2 > 0 THEN (x2 - x) / sqrt(d2) ELSE 1e0 END AS co,
    step < 20 AND (d2 > 64 OR (d2 > 36 AND n < 5)) AS two, x2 IS NULL OR (d2 <= 25 AND n >= 6) AS none FROM (SELECT *, CAST(10 + pos AS DOUBLE) AS step, power(x2 - x, 2e0) + power(y2 - y, 2e0) AS d2 FROM near))"""


@query(_with(("points",), more=(_NEAR, _BENT)) + f"""SELECT id, pos, CAST(0 AS BIGINT) AS part, {R4.format('x')} AS x, {R4.format('y')} AS y FROM bent
    UNION ALL SELECT id, pos, CAST(1 AS BIGINT) AS part, {R4.format('(2e0 * x + x2) / 3e0 - si * m')} AS x, {R4.format('(2e0 * y + y2) / 3e0 + co * m')} AS y FROM bent WHERE NOT none AND two
    UNION ALL SELECT id, pos, CAST(2 AS BIGINT) AS part, {R4.format('(x + 2e0 * x2) / 3e0 + si * m * 0.5e0')} AS x, {R4.format('(y + 2e0 * y2) / 3e0 - co * m * 0.5e0')} AS y FROM bent WHERE NOT none AND two
    UNION ALL SELECT id, pos, CAST(1 AS BIGINT) AS part, {R4.format('(x + x2) / 2e0 - si * m')} AS x, {R4.format('(y + y2) / 2e0 + co * m')} AS y FROM bent WHERE NOT none AND NOT two AND (d2 > 25 OR n < 6)""")
def meander(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polyline.meander(frame(spark, sf_dir, "points"))


# Layers: draw order and presets. Fixed values.
LAYERS = "heightmap relief biomes temperature precipitation ice lakes rivers states provinces cultures religions population zones borders_state borders_province borders_culture burgs".split()
PRESETS = {
    "physical": "heightmap relief rivers lakes temperature precipitation ice", "heightmap_only": "heightmap relief lakes rivers", "biomes": "biomes rivers borders_state lakes",
    "political": "states provinces burgs borders_state borders_province rivers population lakes", "cultural": "cultures states religions burgs borders_state borders_culture lakes rivers",
    "religions": "religions states borders_state lakes rivers", "provinces": "provinces states burgs borders_state borders_province rivers population lakes",
    "places_of_interest": "burgs states borders_state lakes rivers", "goods": "lakes rivers", "trade_animation": "burgs lakes rivers", "military": "states burgs borders_state lakes rivers",
    "emblems": "states burgs lakes rivers", "pure_landmass": "heightmap relief lakes rivers",
}


@query("SELECT preset, CAST(layer_id AS BIGINT) AS layer_id, layer FROM (VALUES " + ", ".join(f"('{p}', {k + 1}, '{layer}')" for p, on in PRESETS.items() for k, layer in enumerate(LAYERS) if layer in on.split()) + ", " + ", ".join(f"('{p}', 0, 'landmass')" for p in PRESETS) + ") v(preset, layer_id, layer)")
def active_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fill layers of each preset in drawing order; the landmass is always drawn."""
    order = spark.createDataFrame([(k + 1, layer) for k, layer in enumerate(LAYERS)], "layer_id long, layer string")
    on = spark.createDataFrame([(p, x) for p, v in PRESETS.items() for x in v.split()], "preset string, layer string")
    base = on.select("preset").distinct().select("preset", F.lit(0).cast("long").alias("layer_id"), F.lit("landmass").alias("layer"))
    return on.join(order, "layer").select("preset", "layer_id", "layer").unionByName(base)


# Parsers over text tables.
@query("SELECT event_id, trim(props) <> '' AS there, length(props) AS size FROM events")
def opaque_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "events").selectExpr("event_id", "trim(props) <> '' AS there", "CAST(length(props) AS BIGINT) AS size")


@query("SELECT event_id, coalesce(CAST(json_extract_string(props, '$.v') AS VARCHAR), CAST(json_extract_string(props, '$.k') AS VARCHAR)) AS first_value FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.v"), F.get_json_object("props", "$.k")).alias("first_value"))


@query("""SELECT p.page_id, part.pos - 1 AS pos, CASE WHEN coalesce(TRY_CAST(trim(part.token) AS DOUBLE), 0) < 0 THEN 0 WHEN coalesce(TRY_CAST(trim(part.token) AS DOUBLE), 0) > 255 THEN 255 ELSE CAST(floor(coalesce(TRY_CAST(trim(part.token) AS DOUBLE), 0)) AS BIGINT) END AS v
    FROM (SELECT page_id, list_filter(string_split(concat(page_id, ',', page_id * 7 % 400, '.5,,x,-', page_id % 9, ', 12 '), ','), lambda x: x <> '') AS t FROM pages) p, LATERAL (SELECT unnest(p.t) AS token, generate_subscripts(p.t, 1) AS pos) part""")
def csv_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("concat(page_id, ',', page_id * 7 % 400, '.5,,x,-', page_id % 9, ', 12 ')")
    return frame(spark, sf_dir, "pages").select("page_id", F.posexplode(mapfile.numbers(text, "u8")).alias("pos", "v")).selectExpr("page_id", "CAST(pos AS BIGINT) AS pos", "CAST(v AS BIGINT) AS v")


@query("""SELECT conv_id, turn, split_part(concat('1.1|', role, '|', turn, '|', length(text), '|400|300'), '|', 4) AS seed, CAST(400 AS INT) AS graph_width, CAST(0 AS BIGINT) AS map_id FROM conversations""")
def header_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "conversations").selectExpr("concat(conv_id, '/', turn) AS path", "array(concat('1.1|', role, '|', turn, '|', length(text), '|400|300')) AS slots")
    found = mapfile.header(rows)
    return found.selectExpr("CAST(split_part(path, '/', 1) AS BIGINT) AS conv_id", "CAST(split_part(path, '/', 2) AS BIGINT) AS turn", "seed", "graph_width", "CAST(map_id AS BIGINT) AS map_id")


@query("SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS slots, string_split(text, chr(10))[1] AS first_slot FROM documents")
def slot_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = frame(spark, sf_dir, "documents").select("doc_id", mapfile.slots(F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n"))).alias("slots"))
    return found.select("doc_id", F.size("slots").cast("long").alias("slots"), F.col("slots")[0].alias("first_slot"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat('a?b ', doc_id) WHEN doc_id % 3 = 1 THEN concat('a\\ud83d\\ude00b ', doc_id) ELSE concat('a?b ', doc_id) END AS fixed FROM documents")
def surrogate_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.when(F.col("doc_id") % 3 == 0, "a\\ud800b ").when(F.col("doc_id") % 3 == 1, "a\\ud83d\\ude00b ").otherwise("a\\udc01b "), F.col("doc_id").cast("string"))
    return frame(spark, sf_dir, "documents").select("doc_id", mapfile.sanitised(text).alias("fixed"))


@query(_with(("cells",)) + "SELECT cell_id AS src, cell_id + 1 AS dst, cell_id % 13 AS route_id FROM cells UNION ALL SELECT cell_id AS src, cell_id + 100 AS dst, cell_id % 13 + 1 AS route_id FROM cells")
def route_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.expr("""concat('{"', cell_id, '":{"', cell_id + 1, '":', cell_id % 13, ',"', cell_id + 100, '":', cell_id % 13 + 1, '},"bad":{"1":2}}')""")
    rows = frame(spark, sf_dir, "cells").select(F.lit("m").alias("path"), F.concat(F.array_repeat(F.lit(""), 36), F.array(body)).alias("slots"))
    return mapfile.route_map(rows).select("src", "dst", "route_id")


def _map_files(rows: DataFrame, at: int, item: str) -> DataFrame:
    """path, slots: map files of a hundred entities each (rows: key), with a JSON catalog in slot at and its placeholder."""
    made = rows.selectExpr("CAST(key DIV 100 AS STRING) AS path", f"struct({item}) AS e", "key").groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("key", F.to_json("e").alias("j")))), lambda x: x["j"]).alias("items"))
    text = F.concat(F.lit("[0,"), F.array_join("items", ","), F.lit("]"))
    return made.select("path", F.concat(F.array_repeat(F.lit(""), at), F.array(text)).alias("slots"))


@query("""SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'naval' WHEN 1 THEN 'river' ELSE 'generic' END AS kind, c_custkey % 10 = 0 AS is_capital,
    CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey END AS port_feature, c_acctbal < 0 AS removed FROM customer""")
def burg_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of map files with one burg for each customer."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("CAST(c_custkey AS BIGINT) AS key", "CAST(c_nationkey AS BIGINT) AS feature", "c_acctbal AS paid")
    item = "key AS i, CASE key % 4 WHEN 0 THEN 'Naval' WHEN 1 THEN 'River' WHEN 2 THEN 'Lake' ELSE 'Odd' END AS type, CAST(key % 10 = 0 AS INT) AS capital, key % 3 AS port, feature, paid < 0 AS removed"
    return mapfile.catalog(_map_files(rows, 15, item), "burgs").select("id", "kind", "is_capital", "port_feature", "removed")


@query("""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'ocean' WHEN 1 THEN 'island' WHEN 2 THEN 'lake' ELSE 'ocean' END AS kind, CASE WHEN p_partkey % 4 = 1 THEN 'island' END AS land_group,
    CASE WHEN p_partkey % 4 = 2 AND p_size % 2 = 0 THEN 'salt' END AS lake_group FROM part""")
def feature_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of map files with one feature for each part."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("CAST(p_partkey AS BIGINT) AS key", "p_size AS size")
    item = "key AS i, CASE key % 4 WHEN 0 THEN 'ocean' WHEN 1 THEN 'isle' WHEN 2 THEN 'lake' ELSE 'reef' END AS type, key % 4 = 1 AS land, CASE WHEN size % 2 = 0 THEN 'salt' ELSE 'brine' END AS `group`"
    return mapfile.catalog(_map_files(rows, 12, item), "features").select("id", "kind", "land_group", "lake_group")


@query("""SELECT o_orderkey AS id, CAST(CASE WHEN o_custkey % 5 = 0 THEN 4294967295 ELSE o_custkey END AS BIGINT) AS last_cell, CAST(3 AS BIGINT) AS n_cells FROM orders WHERE o_orderkey IS NOT NULL""")
def river_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of map files with one river for each order; a negative cell is the map's edge."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("CAST(o_orderkey AS BIGINT) AS key", "CAST(o_custkey AS BIGINT) AS c")
    found = mapfile.catalog(_map_files(rows, 32, "key AS i, array(1, 2, CASE WHEN c % 5 = 0 THEN -1 ELSE c END) AS cells"), "rivers")
    return found.select("id", F.element_at("cells", -1).alias("last_cell"), F.size("cells").cast("long").alias("n_cells"))


@query("""SELECT c_custkey AS id, c_name AS name, CASE c_nationkey % 4 WHEN 0 THEN 'lake' WHEN 1 THEN 'nomadic' WHEN 2 THEN 'highland' ELSE 'generic' END AS kind, CAST(CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END AS BIGINT) AS first_origin,
    CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS n_origins, c_acctbal < 0 AS removed FROM customer""")
def culture_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of map files with one culture for each customer; origins that are no unsigned whole numbers are dropped."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("CAST(c_custkey AS BIGINT) AS key", "CAST(c_nationkey AS BIGINT) AS n", "c_name", "c_acctbal AS paid")
    item = "key AS i, c_name AS name, CASE n % 4 WHEN 0 THEN 'Lake' WHEN 1 THEN 'NOMADIC' WHEN 2 THEN 'highland' ELSE 'Odd' END AS type, array(CASE WHEN key % 3 = 0 THEN CAST(n AS STRING) ELSE '-7' END, 'x', '1.5') AS origins, CAST(paid < 0 AS INT) AS removed"
    found = mapfile.catalog(_map_files(rows, 13, item), "cultures")
    return found.select("id", "name", "kind", F.get("origins", F.lit(0)).alias("first_origin"), F.size("origins").alias("n_origins"), "removed")


@query("""SELECT s_suppkey AS id, s_name AS name, CASE s_nationkey % 4 WHEN 0 THEN 'union' WHEN 1 THEN 'monarchy' ELSE 'anarchy' END AS form, CASE WHEN s_nationkey % 5 = 0 THEN 'naval' ELSE 'generic' END AS kind,
    CAST(s_nationkey AS BIGINT) AS neighbor, '{"a":[' || s_suppkey || ',"x"]}' AS diplomacy, s_acctbal < 0 AS removed FROM supplier""")
def state_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of map files with one state for each supplier; diplomacy stays as it is written."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("CAST(s_suppkey AS BIGINT) AS key", "CAST(s_nationkey AS BIGINT) AS n", "s_name", "s_acctbal AS paid")
    item = "key AS i, s_name AS name, CASE n % 4 WHEN 0 THEN 'Union' WHEN 1 THEN 'Monarchy' WHEN 2 THEN 'Horde' END AS form, CASE WHEN n % 5 = 0 THEN 'Naval' ELSE 'Lake' END AS type, array(n) AS neighbors, named_struct('a', array(CAST(key AS STRING), 'x')) AS diplomacy, paid < 0 AS removed"
    found = mapfile.catalog(_map_files(rows, 14, item), "states")
    told = F.regexp_replace("diplomacy", r'"([0-9]+)"', "$1")
    return found.select("id", "name", "form", "kind", F.get("neighbors", F.lit(0)).alias("neighbor"), told.alias("diplomacy"), "removed")


@query("""SELECT p_partkey AS id, p_name AS name, p_brand AS kind, CAST(p_size AS BIGINT) AS center_cell, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 0 END AS n_origins FROM part""")
def religion_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of map files with one religion for each part; the list has no placeholder, the file's own is taken off."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("CAST(p_partkey AS BIGINT) AS key", "p_name", "p_brand", "p_size")
    made = _map_files(rows, 29, "key AS i, p_name AS name, p_brand AS type, p_size AS center, CASE WHEN p_size % 2 = 0 THEN array(1, 2) ELSE array(-1) END AS origins")
    return mapfile.catalog(made, "religions").select("id", "name", "kind", "center_cell", F.size("origins").alias("n_origins"))


@query("""SELECT o_orderkey AS id, CAST(o_custkey % 25 AS BIGINT) AS state, CAST(o_custkey AS BIGINT) AS capital, o_orderstatus = 'F' AS locked, CAST(2 AS BIGINT) AS n_burgs FROM orders""")
def province_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of map files with one province for each order; its burg is the capital."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("CAST(o_orderkey AS BIGINT) AS key", "CAST(o_custkey AS BIGINT) AS c", "o_orderstatus AS told")
    found = mapfile.catalog(_map_files(rows, 30, "key AS i, c % 25 AS state, c AS burg, CASE WHEN told = 'F' THEN 'yes' ELSE '' END AS lock, array(c, key) AS burgs"), "provinces")
    return found.select("id", "state", "capital", "locked", F.size("burgs").cast("long").alias("n_burgs"))


def _grid_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, slots: a map file for each nation, its suppliers being points and features."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("CAST(s_nationkey AS STRING) AS path", "CAST(s_suppkey AS BIGINT) AS key", "s_acctbal AS a")
    point, feature = F.array(F.col("key") / 2, F.col("a")), F.expr("to_json(struct(key AS i, CASE key % 3 WHEN 0 THEN 'ocean' WHEN 1 THEN 'isle' ELSE 'lake' END AS type, key % 3 = 1 AS land, a < 0 AS border))")
    made = rows.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("key", point.alias("p"), feature.alias("f")))).alias("s"))
    points = F.to_json(F.transform("s", lambda x: x["p"]))
    text = F.concat(F.lit('{"spacing":2.5,"cellsX":4,"cellsY":'), F.size("s"), F.lit(',"cellsDesired":'), F.when(F.col("path").cast("int") % 2 == 0, F.lit(0)).otherwise(F.lit(99)), F.lit(',"points":'), points, F.lit(',"features":[0,'), F.array_join(F.transform("s", lambda x: x["f"]), ","), F.lit("]}"))
    return made.select("path", F.concat(F.array_repeat(F.lit(""), 6), F.array(text)).alias("slots"))


@query("""SELECT CAST(s_nationkey AS VARCHAR) AS path, CASE WHEN s_nationkey % 2 = 0 THEN 4 * count(*) ELSE 99 END AS cells_desired, count(*) AS n_points, min(s_suppkey) / 2e0 AS first_x FROM supplier GROUP BY s_nationkey""")
def grid_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mapfile.grid_general(_grid_files(spark, sf_dir))
    return found.select("path", "cells_desired", F.size("points").cast("long").alias("n_points"), F.col("points")[0]["x"].cast("double").alias("first_x"))


@query("""SELECT CAST(s_nationkey AS VARCHAR) AS path, s_suppkey AS id, CASE s_suppkey % 3 WHEN 1 THEN 'island' WHEN 2 THEN 'lake' ELSE 'ocean' END AS kind, s_suppkey % 3 = 1 AS is_land, s_acctbal < 0 AS touches_border, CASE WHEN s_suppkey % 3 = 1 THEN 'island' END AS land_group FROM supplier""")
def grid_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapfile.grid_features(_grid_files(spark, sf_dir)).select("path", "id", "kind", "is_land", "touches_border", "land_group")


@query("""SELECT CAST(n.s_nationkey AS VARCHAR) AS path, CAST(r.range AS BIGINT) AS id, CASE WHEN s.s_suppkey IS NULL THEN 'ocean' ELSE CASE s.s_suppkey % 3 WHEN 1 THEN 'island' WHEN 2 THEN 'lake' ELSE 'ocean' END END AS kind
    FROM (SELECT s_nationkey, max(s_suppkey) AS most FROM supplier GROUP BY s_nationkey) n JOIN range((SELECT max(s_suppkey) + 1 FROM supplier)) r ON r.range <= n.most LEFT JOIN supplier s ON s.s_suppkey = r.range AND s.s_nationkey = n.s_nationkey""")
def grid_feature_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapfile.grid_feature_kinds(_grid_files(spark, sf_dir)).select("path", "id", "kind")


@query("""SELECT b.id, coalesce(r.name, b.name) AS name FROM (""" + derived.SQL["burgs"].replace("c_custkey AS id, c_name AS name", "c_custkey AS id, c_name AS name", 1) + """) b
    LEFT JOIN (SELECT user_id AS id, 'B' || max(event_id) AS name FROM events WHERE event_id % 3 <> 0 GROUP BY user_id) r ON b.id = r.id AND NOT b.removed""")
def rename_burgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event renames its user's burg; those divisible by three to nothing, which is refused."""
    commands = frame(spark, sf_dir, "events").selectExpr("event_id AS seq", "'burg' AS entity", "CAST(user_id AS BIGINT) AS id", "'rename' AS op", "CASE WHEN event_id % 3 = 0 THEN '  ' ELSE concat(' B', event_id, ' ') END AS value")
    return edits.apply(frame(spark, sf_dir, "burgs"), commands, "burg").select("id", "name")


# One task per map, line or basin: no SQL form.
def maps(spark: SparkSession, sf_dir: str, cells: int = 1000) -> DataFrame:
    """A batch of maps, one for each 25 suppliers."""
    groups = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("CAST(s_suppkey DIV 25 AS BIGINT) AS map_id").distinct()
    return groups.selectExpr("map_id", "concat('seed', map_id) AS seed", "400 AS width", "300 AS height", f"{cells} AS cells")


@query()
def alea_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.alea_stream(maps(spark, sf_dir))


@query()
def jittered_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.grid_points(maps(spark, sf_dir)).where("kind = 'grid'")


@query()
def boundary_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.grid_points(maps(spark, sf_dir)).where("kind = 'boundary'")


@query()
def delaunay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.triangles(maps(spark, sf_dir))


@query()
def voronoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.voronoi(maps(spark, sf_dir))


@query()
def repack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.repacked(maps(spark, sf_dir))


@query()
def simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polyline.per_line(frame(spark, sf_dir, "points"), lambda line, _: polyline.thin_and_simplify(line, 3.0))


@query()
def clip_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polyline.per_line(frame(spark, sf_dir, "points"), lambda line, _: polyline.clip_ring(line, 600.0, 60.0))


@query()
def fractal_coast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polyline.per_line(frame(spark, sf_dir, "points"), lambda line, i: polyline.fractal_ring(line, i))


@query()
def relax_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polyline.per_line(frame(spark, sf_dir, "points"), lambda line, _: polyline.relax_corners(line))


@query()
def fill_depressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each state is a map of its own."""
    cells = cut(frame(spark, sf_dir, "cells").select("cell_id", "cx", "height", "state"))
    return hydrology.fill_depressions(cells.withColumn("map_id", F.col("state")), cut(derived.edges(spark, sf_dir, cells)))


#: Arrivals at each cell, in the order of the cells that send them, folded one after another; names by following the stream that prevails. twice: cells that send on two times, fill: what lakes get.
def _drainage(twice: str, fill: str) -> str:
    return _with(("edges", "places", "features"), True, (
        "lakes AS MATERIALIZED (SELECT id AS lake FROM features WHERE kind = 'lake')", f"twice AS MATERIALIZED ({twice})", f"fill AS MATERIALIZED ({fill})", DOWN,
        "send AS MATERIALIZED (SELECT d.src, d.dst, b.height >= 20 AS land, CASE WHEN t.cell_id IS NULL THEN 1 ELSE 2 END AS times FROM down d JOIN cells b ON d.dst = b.cell_id LEFT JOIN twice t ON d.src = t.cell_id)",
        "walk(cell_id, w) AS (SELECT cell_id, precipitation FROM cells WHERE height >= 20 UNION ALL SELECT d.dst, k.w * d.times FROM walk k JOIN send d ON k.cell_id = d.src AND d.land)",
        "wet AS MATERIALIZED (SELECT cell_id, least(CAST(sum(w) AS BIGINT), 65535) AS flux FROM walk GROUP BY cell_id)",
        # On a lattice at most three cells drain into one, so a cell that has a name keeps one.
        "named AS MATERIALIZED (SELECT DISTINCT d.dst AS cell_id FROM send d JOIN wet w ON d.src = w.cell_id WHERE w.flux >= 30)",
        """event AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY high DESC, src, step) AS k FROM (
            SELECT d.dst AS cell_id, c.height AS high, d.src, s.step, w.flux AS f, CASE WHEN CASE s.step WHEN 2 THEN w.flux >= 30 ELSE n.cell_id IS NOT NULL END THEN d.src END AS heir, d.land FROM send d JOIN cells c ON d.src = c.cell_id
                JOIN wet w ON d.src = w.cell_id LEFT JOIN named n ON d.src = n.cell_id JOIN (VALUES (1), (2)) s(step) ON s.step = 2 OR d.times = 2
            UNION ALL SELECT f.lake_cell, c.height, f.cell_id, 0, f.entering, f.lake_cell, false FROM fill f JOIN cells c ON f.cell_id = c.cell_id))""",
        """fold(cell_id, k, flux, confluence, heir) AS (SELECT DISTINCT cell_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT) FROM event UNION ALL
            SELECT e.cell_id, e.k, CASE WHEN e.land OR e.step = 0 THEN least(65535, s.flux + e.f) ELSE s.flux END,
            CASE WHEN e.step = 0 OR s.heir IS NULL THEN s.confluence WHEN e.f > greatest(0, s.flux - s.confluence) THEN least(65535, s.confluence + s.flux) ELSE least(65535, s.confluence + e.f) END,
            CASE WHEN e.step = 0 THEN coalesce(s.heir, e.heir) WHEN s.heir IS NULL OR e.f > greatest(0, s.flux - s.confluence) THEN e.heir ELSE s.heir END FROM fold s JOIN event e ON s.cell_id = e.cell_id AND e.k = s.k + 1)""",
        "met AS MATERIALIZED (SELECT cell_id, max_by(flux, k) AS flux, max_by(confluence, k) AS confluence, arg_max_null(heir, k) AS heir FROM fold GROUP BY cell_id)",
        "name(cell_id, begun) AS (SELECT cell_id, heir FROM met WHERE heir IS NOT NULL UNION ALL SELECT n.cell_id, m.heir FROM name n JOIN met m ON n.begun = m.cell_id WHERE m.heir IS NOT NULL AND m.heir <> m.cell_id)",
        "origin AS (SELECT n.cell_id, n.begun FROM name n LEFT JOIN met m ON n.begun = m.cell_id WHERE m.heir IS NULL OR m.heir = m.cell_id)")) + """SELECT c.cell_id, CAST(CASE WHEN c.height >= 20 THEN coalesce(w.flux, 0) ELSE coalesce(m.flux, 0) END AS BIGINT) AS flux, coalesce(m.confluence, 0) AS confluence,
        coalesce(o.begun, CASE WHEN c.height >= 20 AND w.flux >= 30 THEN c.cell_id END, -1) AS river FROM cells c LEFT JOIN wet w ON c.cell_id = w.cell_id LEFT JOIN met m ON c.cell_id = m.cell_id LEFT JOIN origin o ON c.cell_id = o.cell_id"""


def _sloping(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, edges, the way down from each), written."""
    cells = cut(frame(spark, sf_dir, "cells").select("cell_id", "cx", "height", "precipitation"))
    edges = cut(derived.edges(spark, sf_dir, cells))
    return cells, edges, cut(graph.down(cells, edges))


@query(_drainage("SELECT cell_id FROM cells WHERE false", "SELECT cell_id, cell_id AS lake_cell, cell_id AS entering FROM cells WHERE false"))
def river_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without lakes."""
    cells, _, pointers = _sloping(spark, sf_dir)
    return hydrology.drain(cells, pointers)


_OUTLET = """SELECT cell_id, arg_max(lake_cell, lake) AS lake_cell, arg_max(entering, lake) AS entering FROM (
    SELECT l.lake, l.src AS cell_id, l.dst AS lake_cell, n.entering FROM (SELECT p.feature AS lake, e.src, e.dst, row_number() OVER (PARTITION BY p.feature ORDER BY c.height, e.src, e.slot) AS k
        FROM edges e JOIN places p ON e.dst = p.cell_id JOIN lakes s ON p.feature = s.lake JOIN cells c ON e.src = c.cell_id WHERE c.height >= 20) l
    JOIN (SELECT lake, CAST(sum(precipitation) AS BIGINT) AS entering FROM (SELECT DISTINCT p.feature AS lake, e.src, c.precipitation FROM edges e JOIN places p ON e.dst = p.cell_id JOIN lakes s ON p.feature = s.lake JOIN cells c ON e.src = c.cell_id WHERE c.height >= 20) GROUP BY lake) n
    ON l.lake = n.lake WHERE l.k = 1) GROUP BY cell_id"""


_DRAINED = _drainage("SELECT cell_id FROM cells WHERE false", "SELECT cell_id, cell_id AS lake_cell, cell_id AS entering FROM cells WHERE false")
_TREE = (DOWN, f"drained AS MATERIALIZED ({_DRAINED})", "tree AS MATERIALIZED (SELECT r.river, min(p.parent) AS parent FROM (SELECT DISTINCT river FROM drained WHERE river >= 0) r LEFT JOIN (SELECT a.river, b.river AS parent FROM down d JOIN drained a ON d.src = a.cell_id JOIN drained b ON d.dst = b.cell_id WHERE a.river >= 0 AND b.river >= 0 AND a.river <> b.river) p ON r.river = p.river GROUP BY r.river)")
_SPECIFIED = """known AS MATERIALIZED (SELECT t.river AS id, CASE WHEN b.id IS NULL OR b.id % 3 = 0 THEN 'River ' || t.river ELSE b.name END AS name, CASE WHEN b.is_capital THEN 'Fork' ELSE 'River' END AS type_name, t.parent, coalesce(p.river, t.river) AS basin
    FROM tree t LEFT JOIN (SELECT cell, min(id) AS id, min_by(name, id) AS name, min_by(is_capital, id) AS is_capital FROM burgs GROUP BY cell) b ON b.cell = t.river LEFT JOIN tree p ON t.parent = p.river)"""


def _rivers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(cells, edges, drained, tree) of the whole land."""
    cells, edges, pointers = _sloping(spark, sf_dir)
    drained = cut(hydrology.drain(cells, pointers))
    return cells, edges, drained, cut(rivers.parents(drained, pointers))


@query(_with(("edges",), True, _TREE) + "SELECT t.river, t.parent, coalesce(p.river, t.river) AS basin FROM tree t LEFT JOIN tree p ON t.parent = p.river")
def parent_basin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rivers.with_basin(_rivers(spark, sf_dir)[3], "river").select("river", "parent", "basin")


def _specified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rivers that begin at a town bear its name, but for every third; those of capitals are forks."""
    tree = _rivers(spark, sf_dir)[3]
    town = frame(spark, sf_dir, "burgs").groupBy(F.col("cell").alias("river")).agg(F.min(F.struct("id", "name", "is_capital")).alias("t"))
    named = tree.select("river").join(town, "river", "left").selectExpr("river AS id", "CASE WHEN t.id % 3 <> 0 THEN t.name ELSE '' END AS name", "CASE WHEN t.is_capital THEN 'Fork' ELSE '' END AS type_name")
    return rivers.specified(named, tree)


@query(_with(("edges", "burgs"), True, (*_TREE, _SPECIFIED)) + "SELECT * FROM known")
def basin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _specified(spark, sf_dir)


@query(_with(("edges", "burgs"), True, (*_TREE, _SPECIFIED, "gone AS (SELECT k.id FROM known k JOIN cells c ON k.id = c.cell_id WHERE c.state = 3)"))
    + "SELECT k.id, k.parent, k.basin FROM known k WHERE k.id NOT IN (SELECT id FROM gone) AND coalesce(k.parent NOT IN (SELECT id FROM gone), true) AND k.basin NOT IN (SELECT id FROM gone)")
def river_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the rivers that begin in one state, their direct children and their basins."""
    known = cut(_specified(spark, sf_dir).select("id", "parent", "basin"))
    return rivers.without(known, known.join(frame(spark, sf_dir, "cells").where("state = 3").select(F.col("cell_id").alias("id")), "id", "left_semi"))


@query(_with(("edges",), True, (*_TREE[:2], """step AS MATERIALIZED (SELECT src, dst FROM (SELECT e.src, e.dst, row_number() OVER (PARTITION BY e.src ORDER BY b.height, e.slot) AS k FROM edges e JOIN cells a ON e.src = a.cell_id JOIN cells b ON e.dst = b.cell_id
    JOIN drained p ON e.src = p.cell_id JOIN drained q ON e.dst = q.cell_id WHERE p.river >= 0 AND p.river = q.river AND b.height < a.height) WHERE k = 1)""",
    "course(river, step, cell_id) AS (SELECT river, CAST(0 AS BIGINT), cell_id FROM drained WHERE river = cell_id UNION ALL SELECT c.river, c.step + 1, s.dst FROM course c JOIN step s ON c.cell_id = s.src)")) + "SELECT * FROM course")
def river_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path of every river from where it begins, along cells of its own."""
    cells, edges, drained, _ = _rivers(spark, sf_dir)
    return rivers.courses(cells, edges, drained)


@query("SELECT i.*, CASE WHEN d.river < 0 THEN '—' ELSE 'River ' || d.river END AS river_name, d.flux FROM (" + ORACLE_SQL["inspector_join"] + ") i JOIN (" + _DRAINED + ") d ON i.cell_id = d.cell_id")
def inspector_river(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell inspector with the river of each cell."""
    drained = _rivers(spark, sf_dir)[2].selectExpr("cell_id", "CASE WHEN river < 0 THEN '—' ELSE concat('River ', river) END AS river_name", "flux")
    return flagship(spark, sf_dir).join(drained, "cell_id")


@query(_with(("cells",)) + """SELECT axis, CAST(k AS BIGINT) AS k, start + k * spacing AS coord, low, high FROM (
    SELECT 'x' AS axis, ceil(x0 / g) * g AS start, g AS spacing, x1 AS upto, y0 AS low, y1 AS high FROM spans UNION ALL SELECT 'y', ceil(y0 / g) * g, g, y1, x0, x1 FROM spans) l, range(1000) r(k) WHERE start + k * spacing <= upto""".replace(
    "FROM spans", "FROM (SELECT *, greatest(CASE WHEN b / m < 1.5 THEN 1 WHEN b / m < 3.5 THEN 2 WHEN b / m < 7.5 THEN 5 ELSE 10 END * m, 1e0) AS g FROM (SELECT *, power(10e0, floor(log10(b))) AS m FROM (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, least(max(x) - min(x), max(y) - min(y)) / 12e0 AS b FROM cells))) s"))
def grid_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.grid_lines(frame(spark, sf_dir, "cells"), 12)


@query(_drainage(f"SELECT cell_id FROM ({_OUTLET})", _OUTLET))
def lake_drainage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lake runs over at its outlet; what enters it is the precipitation of its shore."""
    made = frames(spark, sf_dir, ("cells", "edges", "places", "features"))
    placed = cut(made["cells"].join(made["places"], "cell_id"))
    edges, lakes = made["edges"], cut(made["features"].where("kind = 'lake'").select("id"))
    entering = PLANS["lake_flux"].run(spark, cells=placed, edges=edges, places=placed.select("cell_id", "feature"), features=lakes.withColumn("kind", F.lit("lake")))
    outlets = cut(rivers.outlets(placed, edges, lakes).join(entering, "lake"))
    return hydrology.drain(placed, cut(graph.down(placed, edges)), outlets)


@query(_with(("edges",), True, ("reach(cell_id, level) AS (SELECT cell_id, height FROM cells WHERE height < 20 UNION SELECT e.dst, greatest(r.level, c.height) FROM reach r JOIN edges e ON r.cell_id = e.src JOIN cells c ON e.dst = c.cell_id WHERE c.height >= 20)",))
    + "SELECT c.cell_id, CAST(min(r.level) AS DOUBLE) AS level FROM cells c LEFT JOIN reach r ON c.cell_id = r.cell_id WHERE c.height >= 20 GROUP BY c.cell_id")
def spill_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The height that water must reach to leave each land cell."""
    cells = cut(frame(spark, sf_dir, "cells").select("cell_id", "cx", "height"))
    return hydrology.spill_levels(cells, cut(derived.edges(spark, sf_dir, cells)))


_TENTH = "printf('%.1f', floor(({0}) * 10 + 0.5e0) / 10)"
_X, _Y = _TENTH.format("{0}.x"), _TENTH.format("{0}.y")
_XY = lambda t: f"{_X.format(t)} || ',' || {_Y.format(t)}"
_FILLS = "[" + ", ".join(f"'{x}'" for x in svg.height_fills()) + "]"


@query(_with(("edges", "vertices", "burgs"), more=("route AS (SELECT o_custkey AS river, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, o_orderkey AS cell_id FROM orders)",
    "span AS (SELECT r.river, max(r.pos) AS last, c.c_acctbal AS discharge FROM route r JOIN customer c ON r.river = c.c_custkey GROUP BY r.river, c.c_acctbal)",
    f"town AS (SELECT b.id, b.name, c.x, c.y, CASE WHEN b.is_capital THEN 5 ELSE 3 END AS r FROM burgs b JOIN cells c ON b.cell = c.cell_id WHERE b.id <> 0 AND NOT b.removed)"))
    + f"""SELECT CAST(layer AS BIGINT) AS layer, CAST(id AS BIGINT) AS id, CAST(pos AS BIGINT) AS pos, line FROM (
    SELECT 0 AS layer, 0 AS id, 0 AS pos, '<svg xmlns="http://www.w3.org/2000/svg" width="1000" height="1500" viewBox="0 0 1000 1500">' AS line UNION ALL SELECT 0, 0, 1, '<rect width="1000" height="1500" fill="#1a3a5c"/>' UNION ALL SELECT 5, 0, 0, '</svg>'
    UNION ALL SELECT 1, c.cell_id, 0, '<polygon points="' || string_agg({_XY('v')}, ' ' ORDER BY k.pos) || '" fill="' || ({_FILLS})[least(greatest(any_value(c.height), 0), 100) + 1] || '" stroke="none" opacity="0.95"/>' FROM cells c JOIN rings k ON c.cell_id = k.cell_id JOIN vertices v ON k.vertex = v.vertex GROUP BY c.cell_id
    UNION ALL SELECT 2, river, -1, '<polyline points="' FROM span UNION ALL SELECT 2, r.river, r.pos, coalesce({_XY('c')}, '0.0,0.0') FROM route r SEMI JOIN span s ON r.river = s.river LEFT JOIN cells c ON r.cell_id = c.cell_id
    UNION ALL SELECT 2, river, last + 1, '" fill="none" stroke="#4488cc" stroke-width="' || {_TENTH.format('least(greatest(discharge / 5000, 0.5e0), 4e0)')} || '" stroke-linecap="round" stroke-linejoin="round"/>' FROM span
    UNION ALL SELECT 3, e.src, 0, string_agg('M ' || {_XY('a')} || ' L ' || {_XY('b')}, ' ' ORDER BY e.dst) FROM edges e JOIN cells a ON e.src = a.cell_id JOIN cells b ON e.dst = b.cell_id WHERE e.src < e.dst AND a.state <> b.state GROUP BY e.src
    UNION ALL SELECT 3, min(cell_id) - 1, 0, '<path d="' FROM cells UNION ALL SELECT 3, max(cell_id) + 1, 0, '" fill="none" stroke="#e63333" stroke-width="1.5" opacity="0.8"/>' FROM cells
    UNION ALL SELECT 4, id, 0, '<circle cx="' || {_X.format('t')} || '" cy="' || {_Y.format('t')} || '" r="' || r || '" fill="white" stroke="black" stroke-width="0.5"/>' FROM town t
    UNION ALL SELECT 4, id, 1, '<text x="' || {_TENTH.format('t.x + r + 2')} || '" y="' || {_Y.format('t')} || '" font-size="8" fill="white" stroke="black" stroke-width="0.3" font-family="sans-serif" text-anchor="start" dy=".3em">' || replace(replace(replace(replace(replace(name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&apos;') || '</text>' FROM town t)""")  # fmt: skip
def svg_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole map; each customer's orders, which are cells, stand for the path of a river."""
    made = frames(spark, sf_dir, ("cells", "rings", "vertices", "edges", "burgs"))
    orders, people = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "customer"))
    paths = orders.selectExpr("CAST(o_custkey AS BIGINT) AS river", "CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS pos", "CAST(o_orderkey AS BIGINT) AS cell_id")
    return svg.svg_lines(made["cells"], made["rings"], made["vertices"], paths, people.selectExpr("CAST(c_custkey AS BIGINT) AS river", "c_acctbal AS discharge"), made["edges"], made["burgs"], 1000, 1500)


_SHOWN = f"""SELECT c.c_custkey AS id, l.layer FROM customer c JOIN (VALUES {', '.join(f"('{p}', {k}, '{x}')" for k, p in enumerate(PRESETS) for x in LAYERS if x in PRESETS[p].split())}) l(preset, k, layer) ON c.c_nationkey % 13 = l.k WHERE NOT (c.c_custkey % 5 = 0 AND l.layer = 'burgs')
    UNION ALL SELECT c_custkey, 'zones' FROM customer WHERE c_acctbal < 0"""


@query(f"""WITH shown AS ({_SHOWN}), preset(preset, k, layer) AS (VALUES {', '.join(f"('{p}', {k}, '{x}')" for k, p in enumerate(PRESETS) for x in LAYERS if x in PRESETS[p].split())}),
    fit AS (SELECT s.id, p.preset, p.k FROM (SELECT DISTINCT id FROM shown) s CROSS JOIN (SELECT DISTINCT preset, k FROM preset) p
        WHERE NOT EXISTS (SELECT 1 FROM shown h WHERE h.id = s.id AND NOT EXISTS (SELECT 1 FROM preset q WHERE q.preset = p.preset AND q.layer = h.layer))
        AND NOT EXISTS (SELECT 1 FROM preset q WHERE q.preset = p.preset AND NOT EXISTS (SELECT 1 FROM shown h WHERE h.id = s.id AND h.layer = q.layer)))
    SELECT s.id, coalesce(arg_min(f.preset, f.k), 'custom') AS preset FROM (SELECT DISTINCT id FROM shown) s LEFT JOIN fit f ON s.id = f.id GROUP BY s.id""")
def preset_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first preset that shows just the layers a user shows: each customer has those of a preset, some without towns, some with zones."""
    every = spark.createDataFrame([(p, k, x) for k, p in enumerate(PRESETS) for x in LAYERS if x in PRESETS[p].split()], "preset string, k long, layer string")
    people = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("CAST(c_custkey AS BIGINT) AS id", "CAST(c_nationkey % 13 AS BIGINT) AS k", "c_acctbal")
    shown = people.join(every, "k").where("NOT (id % 5 = 0 AND layer = 'burgs')").select("id", "layer").unionByName(people.where("c_acctbal < 0").select("id", F.lit("zones").alias("layer")))
    return views.presets_shown(shown, every)


@query(_with(("states",)) + """SELECT s.id, coalesce(r.name, s.name) AS name, coalesce(c.colour, s.colour) AS colour, s.removed FROM states s
    LEFT JOIN (SELECT event_id % 30 AS id, concat('S', max(event_id)) AS name FROM events WHERE event_id % 2 = 0 GROUP BY 1) r ON s.id = r.id AND s.id <> 0 AND NOT s.removed
    LEFT JOIN (SELECT event_id % 30 AS id, printf('#%06x', max(event_id)) AS colour FROM events WHERE event_id % 2 = 1 GROUP BY 1) c ON s.id = c.id AND s.id <> 0 AND NOT s.removed""")
def edit_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of commands, made from events, applied to the states."""
    made = frame(spark, sf_dir, "events").selectExpr("event_id AS seq", "'state' AS entity", "event_id % 30 AS id", "CASE WHEN event_id % 2 = 0 THEN 'rename' ELSE 'recolor' END AS op", "CASE WHEN event_id % 2 = 0 THEN concat(' S', event_id, ' ') ELSE printf('#%06X', event_id) END AS value")
    return edits.apply(frame(spark, sf_dir, "states"), made, "state")


@query(_with(("provinces", "states")) + """SELECT p.id, coalesce(r.name, p.name) AS name, coalesce(f.form, 'anarchy') AS form FROM provinces p
    LEFT JOIN (SELECT event_id % 9 AS id, concat('P', max(event_id)) AS name FROM events WHERE event_id % 3 = 0 GROUP BY 1) r ON p.id = r.id AND p.id <> 0 AND NOT p.removed
    LEFT JOIN (SELECT event_id % 9 AS id, concat('f', max(event_id) % 4) AS form FROM events WHERE event_id % 3 = 1 GROUP BY 1) f ON p.id = f.id AND p.id <> 0 AND NOT p.removed""")
def province_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and forms set by events; a third of the renames is empty and is refused."""
    made = frame(spark, sf_dir, "events").selectExpr("event_id AS seq", "'province' AS entity", "event_id % 9 AS id", "CASE WHEN event_id % 3 = 1 THEN 'form' ELSE 'rename' END AS op", "CASE event_id % 3 WHEN 0 THEN concat('P', event_id, ' ') WHEN 1 THEN concat('f', event_id % 4) ELSE '  ' END AS value")
    return edits.apply(frame(spark, sf_dir, "provinces").withColumn("form", F.lit("anarchy")), made, "province").select("id", "name", "form")


_CAPITALS = """told AS (SELECT o_orderkey AS seq, o_custkey AS id, o_orderkey % 3 <> 0 AS made, b.state, b.cell FROM orders JOIN burgs b ON o_custkey = b.id WHERE NOT b.removed),
    last AS (SELECT t.* FROM told t JOIN (SELECT state, max(seq) AS seq FROM told WHERE made AND state > 0 GROUP BY state) m ON t.state = m.state AND t.seq = m.seq)"""


def _capital_edits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    made = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS seq", "'burg' AS entity", "o_custkey AS id", "'capital' AS op", "CASE WHEN o_orderkey % 3 <> 0 THEN 'true' ELSE 'false' END AS value")
    return edits.capitals(frame(spark, sf_dir, "burgs"), frame(spark, sf_dir, "states").withColumn("center_cell", F.lit(-1).cast("long")), made)


@query(_with(("burgs",), more=(_CAPITALS,)) + """SELECT b.id, CASE WHEN l.seq IS NOT NULL THEN b.id = l.id AND NOT EXISTS (SELECT 1 FROM told t WHERE t.id = b.id AND t.seq > l.seq) WHEN x.id IS NULL THEN b.is_capital ELSE x.made END AS is_capital
    FROM burgs b LEFT JOIN last l ON b.state = l.state LEFT JOIN (SELECT id, arg_max(made, seq) AS made FROM told GROUP BY id) x ON b.id = x.id""")
def capital_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _capital_edits(spark, sf_dir)[0].select("id", "is_capital")


@query(_with(("burgs", "states"), more=(_CAPITALS,)) + "SELECT s.id, CAST(coalesce(l.cell, -1) AS BIGINT) AS center_cell FROM states s LEFT JOIN last l ON s.id = l.state")
def capital_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _capital_edits(spark, sf_dir)[1].select("id", "center_cell")


@query(_with(("states", "provinces", "burgs")) + """SELECT e.event_id, CASE e.event_id % 4 WHEN 0 THEN coalesce(s.name, '') WHEN 1 THEN coalesce(p.name, '') WHEN 2 THEN coalesce(b.name, '') ELSE '' END AS name,
    CASE e.event_id % 4 WHEN 0 THEN coalesce(s.colour, '') WHEN 1 THEN coalesce(p.colour, '') ELSE '' END AS colour
    FROM events e LEFT JOIN states s ON e.user_id = s.id LEFT JOIN provinces p ON e.user_id = p.id LEFT JOIN burgs b ON e.user_id = b.id""")
def entity_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = frame(spark, sf_dir, "events").selectExpr("event_id", "user_id AS id", "element_at(array('state', 'province', 'burg', 'culture'), CAST(event_id % 4 AS INT) + 1) AS entity")
    return edits.selection(chosen, {"state": frame(spark, sf_dir, "states"), "province": frame(spark, sf_dir, "provinces"), "burg": frame(spark, sf_dir, "burgs")}).select("event_id", "name", "colour")


@query(_with(("cells",)) + "SELECT c.cell_id, p.r, p.g, p.b FROM cells c JOIN (VALUES " + ", ".join(f"({h}, {r!r}e0, {g!r}e0, {b!r}e0)" for h, r, g, b in height_colours()) + ") p(h, r, g, b) ON least(c.height, 100) = p.h")
def height_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The colour ramp has 101 rows: a table that is always small enough to broadcast."""
    ramp = spark.createDataFrame(height_colours(), "h int, r double, g double, b double")
    return frame(spark, sf_dir, "cells").join(F.broadcast(ramp), F.least("height", F.lit(100)) == F.col("h")).select("cell_id", "r", "g", "b")


_LAKES = ("cells", "edges", "places", "features")
_SHORE = """shore AS (SELECT f.id AS lake, e.dst AS out_cell, b.height FROM features f JOIN places p ON f.id = p.feature JOIN edges e ON p.cell_id = e.src JOIN cells b ON e.dst = b.cell_id WHERE f.kind = 'lake' AND b.height >= 20),
    low AS MATERIALIZED (SELECT lake, arg_min(out_cell, (height, out_cell)) AS out_cell FROM shore GROUP BY lake)"""


def _featured(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """cells with their feature, edges, features; the components are found once."""
    own = cut(frame(spark, sf_dir, "cells").select("cell_id", "cx", "cy", "height", "state", "precipitation"))
    edges = cut(derived.edges(spark, sf_dir, own))
    placed = cut(own.join(derived.places(spark, sf_dir, own, edges), "cell_id"))
    return placed, edges, cut(derived.features(spark, sf_dir, placed.select("cell_id", "feature"), own))


@query(_with(_LAKES, True, (_SHORE, "walk(lake, cell_id) AS (SELECT lake, out_cell FROM low UNION SELECT w.lake, e.dst FROM walk w JOIN edges e ON w.cell_id = e.src JOIN cells c ON e.dst = c.cell_id WHERE c.height < 39)"))
    + "SELECT k.lake, bool_and(p.feature = k.lake OR c.height >= 20) AS closed FROM walk k JOIN cells c ON k.cell_id = c.cell_id JOIN places p ON k.cell_id = p.cell_id GROUP BY k.lake")
def close_lakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, edges, features = _featured(spark, sf_dir)
    return graph.close_lakes(cells, edges, features.where("kind = 'lake'"))


@query(_with(_LAKES, more=(_SHORE,)) + """SELECT l.lake, l.out_cell, arg_min(e.dst, e.slot) AS lake_cell FROM low l JOIN edges e ON l.out_cell = e.src JOIN places p ON e.dst = p.cell_id AND p.feature = l.lake GROUP BY ALL""")
def lake_outlets(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, edges, features = _featured(spark, sf_dir)
    return rivers.outlets(cells, edges, features.where("kind = 'lake'"))


@query(_with((*_LAKES, "streams"), True, (_SHORE, """leg AS MATERIALIZED (SELECT r.river, f.kind, f.id AS feature, s.river AS onward FROM (SELECT DISTINCT river FROM streams WHERE river <> 0) r JOIN places p ON r.river - 1 = p.cell_id JOIN features f ON p.feature = f.id
    LEFT JOIN low l ON f.id = l.lake LEFT JOIN streams s ON l.out_cell = s.cell_id AND s.river <> 0)""", "chain(river, here) AS (SELECT river, river FROM leg UNION SELECT c.river, g.onward FROM chain c JOIN leg g ON c.here = g.river WHERE g.kind = 'lake' AND g.onward IS NOT NULL)"))
    + "SELECT c.river, max(CASE WHEN g.kind = 'ocean' OR g.kind = 'lake' AND g.onward IS NULL THEN g.feature END) AS drain FROM chain c JOIN leg g ON c.here = g.river GROUP BY c.river")
def drain_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each river ends, through the lakes on its way."""
    cells, edges, features = _featured(spark, sf_dir)
    flow = cut(rivers.streams(cells, edges).select("cell_id", "river")).where("river <> 0")
    leaves = rivers.outlets(cells, edges, features.where("kind = 'lake'")).join(flow.selectExpr("cell_id AS out_cell", "river"), "out_cell").select("lake", "river")
    return rivers.drains(flow.select("river", (F.col("river") - 1).alias("cell_id")).distinct(), cells, features, leaves)


# Rings, perimeters and the shapes of rivers.
@query(_with(("cells",)) + """SELECT cell_id, pos, x + CASE WHEN pos IN (1, 2) THEN 5e0 ELSE -5e0 END AS x, y + CASE WHEN pos >= 2 THEN 5e0 ELSE -5e0 END AS y FROM cells, (SELECT range AS pos FROM range(4)) r""")
def cell_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rivers.cell_rings(frame(spark, sf_dir, "rings"), frame(spark, sf_dir, "vertices"))


@query("""SELECT o.o_custkey AS id, CAST(o.pos AS BIGINT) AS pos, c.x, c.y FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders) o
    JOIN (SELECT o_orderkey AS v, (o_orderkey % 100) * 10e0 AS x, (o_orderkey // 100) * 10e0 AS y FROM orders WHERE o_orderkey % 11 <> 0) c ON o.o_orderkey = c.v""")
def perimeter_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of a customer as a perimeter; every eleventh vertex is unknown."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    around = orders.groupBy(F.col("o_custkey").alias("id")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("vertices"))
    return rivers.perimeters(around, orders.where("o_orderkey % 11 <> 0").selectExpr("o_orderkey AS vertex", "(o_orderkey % 100) * 10e0 AS x", "(o_orderkey DIV 100) * 10e0 AS y"))


def _river_paths(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """river, pos, cell_id: ways down from the heights; every seventh goes on to the map's edge (null)."""
    way = graph.trace(cells.where("height >= 90"), graph.down(cells, edges))
    over = way.where("start % 7 = 0").groupBy("start").agg((F.max("step") + 1).alias("step")).withColumn("cell_id", F.lit(None).cast("long"))
    return way.unionByName(over).withColumnsRenamed({"start": "river", "step": "pos"})


_PATHS = ("walk(river, pos, cell_id) AS (SELECT cell_id, CAST(0 AS BIGINT), cell_id FROM cells WHERE height >= 90 UNION ALL SELECT k.river, k.pos + 1, d.dst FROM walk k JOIN down d ON k.cell_id = d.src)",
    """ended AS MATERIALIZED (SELECT w.*, c.x, c.y, c.height, max(pos) OVER (PARTITION BY river) AS top FROM walk w JOIN cells c ON w.cell_id = c.cell_id)""")  # fmt: skip


@query(_with(("edges",), True, (DOWN, *_PATHS, "edge AS (SELECT * FROM ended WHERE river % 7 = 0 AND pos = top)"))
    + f"""SELECT e.river, e.pos, {R4.format('CASE WHEN e.pos = e.top AND e.height < 20 THEN (e.x + b.x) / 2 ELSE e.x END')} AS x, {R4.format('CASE WHEN e.pos = e.top AND e.height < 20 THEN (e.y + b.y) / 2 ELSE e.y END')} AS y
    FROM ended e LEFT JOIN ended b ON e.river = b.river AND b.pos = e.pos - 1
    UNION ALL SELECT river, pos + 1, CASE WHEN least(y, 1500 - y) <= least(x, 1000 - x) THEN x WHEN x <= 1000 - x THEN 0e0 ELSE 1e3 END AS x,
    CASE WHEN least(y, 1500 - y) <= least(x, 1000 - x) THEN CASE WHEN y <= 1500 - y THEN 0e0 ELSE 15e2 END ELSE y END AS y FROM edge WHERE height >= 20""")  # fmt: skip
def river_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anchors of every river; on the lattice a coast lies half way between two cells."""
    cells = frame(spark, sf_dir, "cells")
    line = rivers.clipped(rivers.anchors(_river_paths(cells, cut(frame(spark, sf_dir, "edges"))), cells, 1000.0, 1500.0), cells, rivers.cell_rings(frame(spark, sf_dir, "rings"), frame(spark, sf_dir, "vertices")))
    return line.selectExpr("river", "pos", R4.format("x") + " AS x", R4.format("y") + " AS y")


@query()
def river_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = cut(frame(spark, sf_dir, "cells").select("cell_id", "cx", "cy", "x", "y", "height", "population"))
    paths = cut(_river_paths(cells, cut(derived.edges(spark, sf_dir, cells))))
    known = cells.where("height >= 90").selectExpr("cell_id AS river", "population / 1e1 AS discharge", "1.2e0 AS width_factor", "5e-2 AS source_width")
    return rivers.shapes(paths, known, cells, rivers.cell_rings(derived.rings(spark, sf_dir, cells), derived.vertices(spark, sf_dir, cells)), 1000.0, 1500.0)


@query(_with(("points",), more=("sized AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM points)", "spots AS (SELECT id, CAST(r.range AS BIGINT) AS pos, n FROM (SELECT id, count(*) AS n FROM points GROUP BY id), range(1000000) r WHERE r.range < 3 * n)"))
    + "SELECT s.id, s.pos, max(coalesce(p.flux, 0e0)) OVER (PARTITION BY s.id ORDER BY s.pos) AS flux FROM spots s LEFT JOIN sized p ON s.id = p.id AND s.pos = 3 * p.pos")
def river_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of three points for each cell of the path."""
    path = frame(spark, sf_dir, "points").select("id", "pos", "flux")
    line = path.selectExpr("id", "explode(array(3 * pos, 3 * pos + 1, 3 * pos + 2)) AS pos")
    return rivers.anchor_flux(line, path)


@query()
def river_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rivers of each state, a map of its own, after those that exist already (burgs stand for them)."""
    cells = cut(frame(spark, sf_dir, "cells").select("cell_id", "cx", "height", "precipitation", F.col("state").alias("map_id")))
    near = cut(graph.within(derived.edges(spark, sf_dir, cells), cells.select("cell_id", F.col("map_id").alias("kind"))))
    old = frame(spark, sf_dir, "burgs").selectExpr("-id AS id", "name", "'Creek' AS type_name", "-(id - id % 5) AS parent")
    return rivers.generate(cells, near, old, erosion=True)[1]


def _outlines(regions: str) -> tuple[str, ...]:
    """outline: region, ring, pos, a, b, beyond. The side after a boundary side by turning about its end, one side at a time; rings by walking from every side as long as no lower one is met."""
    return (
        regions,
        """side AS MATERIALIZED (SELECT cell_id * 1024 + pos AS side, cell_id, vertex AS a, coalesce(lead(vertex) OVER w, first_value(vertex) OVER w) AS b,
            coalesce(lead(cell_id * 1024 + pos) OVER w, cell_id * 1024) AS onward FROM rings WINDOW w AS (PARTITION BY cell_id ORDER BY pos))""",
        """met AS MATERIALIZED (SELECT s.side, s.a, s.b, s.onward, r.region, o.cell_id AS beyond, CASE WHEN q.region = r.region THEN o.onward END AS turn FROM side s JOIN regions r ON s.cell_id = r.cell_id
            LEFT JOIN side o ON s.a = o.b AND s.b = o.a LEFT JOIN regions q ON o.cell_id = q.cell_id)""",
        "turned(side, went) AS (SELECT side, onward FROM met WHERE turn IS NULL UNION ALL SELECT t.side, m.turn FROM turned t JOIN met m ON t.went = m.side WHERE m.turn IS NOT NULL)",
        "onto AS MATERIALIZED (SELECT t.side, t.went FROM turned t JOIN met m ON t.went = m.side WHERE m.turn IS NULL)",
        "round(ring, pos, side) AS (SELECT side, CAST(0 AS BIGINT), side FROM onto UNION ALL SELECT r.ring, r.pos + 1, o.went FROM round r JOIN onto o ON r.side = o.side WHERE o.went > r.ring)",
        "closed AS (SELECT r.ring FROM round r JOIN onto o ON r.side = o.side WHERE o.went = r.ring)",
        "outline AS MATERIALIZED (SELECT m.region, r.ring, r.pos, m.a, m.b, m.beyond FROM round r JOIN closed k ON r.ring = k.ring JOIN met m ON r.side = m.side)",
    )


_CULTURES = """regions AS MATERIALIZED (SELECT cell_id, min(label) AS region FROM culture_walk GROUP BY cell_id)"""
_CULTURE_WALK = (
    "alike AS MATERIALIZED (SELECT e.src, e.dst FROM edges e JOIN cells a ON e.src = a.cell_id JOIN cells b ON e.dst = b.cell_id WHERE a.culture = b.culture AND a.culture <> 0)",
    "culture_walk(cell_id, label) AS (SELECT cell_id, cell_id FROM cells WHERE culture <> 0 UNION SELECT s.dst, k.label FROM culture_walk k JOIN alike s ON k.cell_id = s.src WHERE k.label < s.dst)",
)


@query(_with(("edges", "vertices"), True, (*_CULTURE_WALK, *_outlines(_CULTURES)))
    + "SELECT o.region, o.ring, o.pos, v.x, v.y FROM outline o JOIN vertices v ON o.a = v.vertex")
def isoline_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outer rings and holes of connected cells of one culture, culture 0 left out."""
    made = frames(spark, sf_dir, ("cells", "edges", "rings", "vertices"))
    inside = made["cells"].where("culture <> 0").select("cell_id", "culture")
    out = isolines.outlines(made["rings"], graph.components(inside, made["edges"], "culture"))
    return out.join(made["vertices"], "vertex").select("region", "ring", "pos", "x", "y")


@query(_with(("edges", "features", "vertices"), True, _outlines("regions AS MATERIALIZED (SELECT p.cell_id, p.feature AS region FROM places p JOIN features f ON p.feature = f.id WHERE f.kind = 'island')"))
    + """, wet AS (SELECT o.*, f.id AS lake FROM outline o LEFT JOIN places p ON o.beyond = p.cell_id LEFT JOIN features f ON p.feature = f.id AND f.kind = 'lake'),
    one AS (SELECT ring, min(lake) AS lake FROM wet GROUP BY ring HAVING count(*) = count(lake) AND min(lake) = max(lake)), alone AS (SELECT lake FROM wet WHERE lake IS NOT NULL GROUP BY lake HAVING count(DISTINCT ring) = 1)
    SELECT o.region, o.ring, count(*) AS sides, sum(u.x * v.y - v.x * u.y) AS area FROM outline o JOIN vertices u ON o.a = u.vertex JOIN vertices v ON o.b = v.vertex
    WHERE o.ring NOT IN (SELECT ring FROM one JOIN alone ON one.lake = alone.lake) GROUP BY o.region, o.ring""")  # fmt: skip
def state_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the rings of each state's connected land, without those about a lake that lies wholly inside."""
    made = frames(spark, sf_dir, ("rings", "vertices", "places"))
    places = cut(made["places"])
    features = cut(derived.features(spark, sf_dir, places))
    land = places.join(features.where("kind = 'island'").select(F.col("id").alias("feature")), "feature", "left_semi").withColumnRenamed("feature", "region")
    out = cut(isolines.outlines(made["rings"], land))
    return isolines.areas(isolines.without_lakes(out, places, features), cut(made["vertices"]))

