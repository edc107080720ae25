"""A map world derived from order, customer and event tables, so that every operator runs on Parquet at any scale.

Each table is a lazy DataFrame over the scans it needs; the same definitions as ANSI SQL are in SQL, for
comparison with another engine. Cells lie on a lattice of 100 columns; heights 20 and above are land.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worldframe.operators import graph, rivers
from worldframe.plans.lineage import cut

WIDTH = 100


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per cell. The customer side carries its nation; catalogs are left to the optimizer to broadcast."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    people = _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    found = _table(spark, sf_dir, "orders").join(people, F.col("o_custkey") == F.col("c_custkey"))
    return found.selectExpr(
        "o_orderkey AS cell_id", f"o_orderkey % {WIDTH} AS cx", f"o_orderkey DIV {WIDTH} AS cy",
        f"(o_orderkey % {WIDTH}) * 10e0 + 5e0 AS x", f"(o_orderkey DIV {WIDTH}) * 10e0 + 5e0 AS y",
        "CAST(floor(o_totalprice / 5e3) AS BIGINT) AS height", "o_custkey % 50 AS precipitation",
        "CAST(month(o_orderdate) AS BIGINT) * 5 - 30 AS temperature", "CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS biome",
        "CAST(c_nationkey AS BIGINT) AS state", "CAST(n_regionkey AS BIGINT) AS culture", "o_custkey % 10 AS province", "o_custkey % 7 AS religion",
        "greatest(c_acctbal, 0e0) AS population",
    )


def edges(spark: SparkSession, sf_dir: str, at: DataFrame | None = None) -> DataFrame:
    """Adjacency (src, slot, dst): the cells to the right and below, two offsets per cell, by an equi-join; each pair gives an edge in either direction. at: cell_id, cx of the cells, if written."""
    at = (cells(spark, sf_dir) if at is None else at).select("cell_id", "cx")
    step = F.explode(F.array(*[F.struct(F.lit(s).cast("long").alias("slot"), F.lit(x).cast("long").alias("dx"), F.lit(x + WIDTH * y).cast("long").alias("by")) for s, (x, y) in enumerate(((1, 0), (0, 1)))]))
    moved = at.select("cell_id", "cx", step.alias("o")).select("cell_id", "o.slot", (F.col("cell_id") + F.col("o.by")).alias("other"), (F.col("cx") + F.col("o.dx")).alias("at"))
    pairs = moved.where(F.col("at").between(0, WIDTH - 1)).join(at.select(F.col("cell_id").alias("other")), "other")
    there, back = F.struct(F.col("cell_id").alias("src"), "slot", F.col("other").alias("dst")), F.struct(F.col("other").alias("src"), (F.col("slot") + 2).alias("slot"), F.col("cell_id").alias("dst"))
    return pairs.select(F.explode(F.array(there, back)).alias("e")).select("e.*")


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS id", "n_name AS name", "printf('#%02x%02x%02x', n_nationkey * 9, n_nationkey * 5 + 20, 255 - n_nationkey * 7) AS colour", "n_nationkey % 11 = 10 AS removed")


def cultures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "region").selectExpr("CAST(r_regionkey AS BIGINT) AS id", "r_name AS name", "printf('#%02x40%02x', r_regionkey * 50, 200 - r_regionkey * 40) AS colour")


def biomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderpriority").distinct().selectExpr("CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS id", "substr(o_orderpriority, 3) AS name", "printf('#%02x8050', CAST(substr(o_orderpriority, 1, 1) AS INT) * 40) AS colour")


def provinces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "nation").where("n_nationkey < 9").selectExpr("CAST(n_nationkey AS BIGINT) AS id", "concat('Province ', n_name) AS name", "CASE WHEN n_nationkey % 4 = 3 THEN '' ELSE printf('#%02x%02x40', n_nationkey * 20, 250 - n_nationkey * 9) END AS colour", "n_nationkey = 5 AS removed")


def religions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "region").selectExpr("CAST(r_regionkey AS BIGINT) AS id", "concat('Faith of ', r_name) AS name", "printf('#80%02x%02x', r_regionkey * 45, 220 - r_regionkey * 30) AS colour")


def places(spark: SparkSession, sf_dir: str, own: DataFrame | None = None, near: DataFrame | None = None) -> DataFrame:
    """cell_id, feature: connected water, and connected land of a state; a feature is named by its least cell. own, near: the cells and edges, if written."""
    kind = F.expr("CASE WHEN height < 20 THEN -1 ELSE state END")
    own = cut(cells(spark, sf_dir).select("cell_id", "cx", "height", "state")) if own is None else own
    near = cut(edges(spark, sf_dir, own)) if near is None else near
    return graph.components(own.select("cell_id", kind.alias("kind")), near, "kind").withColumnRenamed("region", "feature")


def features(spark: SparkSession, sf_dir: str, at: DataFrame | None = None, own: DataFrame | None = None) -> DataFrame:
    """Water that touches the left, right or upper border is an ocean, other water a lake, land an island. at, own: the places and cells, if known."""
    own = cells(spark, sf_dir) if own is None else own
    found = own.join(places(spark, sf_dir) if at is None else at, "cell_id").groupBy(F.col("feature").alias("id")).agg(F.min("height").alias("low"), F.expr(f"bool_or(cx IN (0, {WIDTH - 1}) OR cy = 0)").alias("touches_border"), F.count("*").alias("cell_count"))
    return found.selectExpr("id", "CASE WHEN low >= 20 THEN 'island' WHEN touches_border THEN 'ocean' ELSE 'lake' END AS kind", "touches_border", "cell_count")


def streams(spark: SparkSession, sf_dir: str, own: DataFrame | None = None, near: DataFrame | None = None) -> DataFrame:
    """cell_id, flux, river, modifier of the cells that drain. own, near: the cells and edges, if written."""
    own = cut(cells(spark, sf_dir).select("cell_id", "cx", "height", "precipitation")) if own is None else own
    near = cut(edges(spark, sf_dir, own)) if near is None else near
    size = own.agg(F.pow(F.count("*") / 1e4, 0.25).alias("modifier"))
    return rivers.streams(own, near).crossJoin(F.broadcast(size))  # one row


def rings(spark: SparkSession, sf_dir: str, own: DataFrame | None = None) -> DataFrame:
    """cell_id, pos, vertex: the corners of each cell on the lattice, clockwise. own: the cells, if written."""
    steps = F.array(*[F.lit(v).cast("long") for v in (0, 1, WIDTH + 2, WIDTH + 1)])
    return (cells(spark, sf_dir) if own is None else own).select("cell_id", "cx", "cy", F.posexplode(steps).alias("pos", "by")).selectExpr("cell_id", "CAST(pos AS BIGINT) AS pos", f"cy * {WIDTH + 1} + cx + by AS vertex")


def vertices(spark: SparkSession, sf_dir: str, own: DataFrame | None = None) -> DataFrame:
    """vertex, x, y. own: the cells, if written."""
    return rings(spark, sf_dir, own).select("vertex").distinct().selectExpr("vertex", f"(vertex % {WIDTH + 1}) * 10e0 AS x", f"(vertex DIV {WIDTH + 1}) * 10e0 AS y")


def burgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as towns on their first cell; the richest of each state is its capital, ties to the smaller id."""
    first = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderkey").alias("cell"))
    rows = _table(spark, sf_dir, "customer").where("c_custkey > 0").join(first, F.col("c_custkey") == F.col("id"))
    towns = rows.selectExpr("id", "c_name AS name", "cell", "CAST(c_nationkey AS BIGINT) AS state", "greatest(c_acctbal, 0e0) AS population", "c_acctbal AS wealth", "id % 37 = 5 AS removed")
    best = towns.groupBy("state").agg(F.max(F.struct("wealth", -F.col("id"))).alias("top")).select("state", (-F.col("top.col2")).alias("capital"))
    return towns.join(best, "state", "left").selectExpr("id", "name", "cell", "state", "population", "removed", "id = capital AS is_capital")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polylines: the events of each user in order of time; also the probes of the nearest-cell search."""
    numbered = _table(spark, sf_dir, "events").selectExpr("event_id", "user_id AS id", "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos", "CAST(event_id % 937 AS DOUBLE) AS x", "value AS y", "value AS flux")
    return numbered.selectExpr("event_id", "id", "CAST(pos AS BIGINT) AS pos", "x", "y", "flux")


FRAMES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"cells": cells, "edges": edges, "states": states, "cultures": cultures, "biomes": biomes, "provinces": provinces, "religions": religions, "places": places, "features": features, "streams": streams, "rings": rings, "vertices": vertices, "burgs": burgs, "points": points}

#: The same tables as ANSI SQL over the driver's views.
SQL = {
    "cells": f"""SELECT o_orderkey AS cell_id, o_orderkey % {WIDTH} AS cx, o_orderkey // {WIDTH} AS cy, (o_orderkey % {WIDTH}) * 10e0 + 5e0 AS x,
        (o_orderkey // {WIDTH}) * 10e0 + 5e0 AS y, CAST(floor(o_totalprice / 5e3) AS BIGINT) AS height, o_custkey % 50 AS precipitation,
        CAST(month(o_orderdate) AS BIGINT) * 5 - 30 AS temperature, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS biome, CAST(c_nationkey AS BIGINT) AS state,
        CAST(n_regionkey AS BIGINT) AS culture, o_custkey % 10 AS province, o_custkey % 7 AS religion, greatest(c_acctbal, 0e0) AS population
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "edges": f"""SELECT c.cell_id AS src, CAST(v.slot AS BIGINT) AS slot, d.cell_id AS dst FROM cells c
        CROSS JOIN (VALUES (0, 1, 0), (1, 0, 1), (2, -1, 0), (3, 0, -1)) v(slot, dx, dy)
        JOIN cells d ON d.cell_id = c.cell_id + v.dx + {WIDTH} * v.dy AND d.cx = c.cx + v.dx""",
    "states": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, printf('#%02x%02x%02x', n_nationkey * 9, n_nationkey * 5 + 20, 255 - n_nationkey * 7) AS colour, n_nationkey % 11 = 10 AS removed FROM nation",
    "cultures": "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name, printf('#%02x40%02x', r_regionkey * 50, 200 - r_regionkey * 40) AS colour FROM region",
    "biomes": "SELECT DISTINCT CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS id, substr(o_orderpriority, 3) AS name, printf('#%02x8050', CAST(substr(o_orderpriority, 1, 1) AS INT) * 40) AS colour FROM orders",
    "provinces": "SELECT CAST(n_nationkey AS BIGINT) AS id, concat('Province ', n_name) AS name, CASE WHEN n_nationkey % 4 = 3 THEN '' ELSE printf('#%02x%02x40', n_nationkey * 20, 250 - n_nationkey * 9) END AS colour, n_nationkey = 5 AS removed FROM nation WHERE n_nationkey < 9",
    "religions": "SELECT CAST(r_regionkey AS BIGINT) AS id, concat('Faith of ', r_name) AS name, printf('#80%02x%02x', r_regionkey * 45, 220 - r_regionkey * 30) AS colour FROM region",
    "places": """WITH RECURSIVE kinds AS MATERIALIZED (SELECT cell_id, CASE WHEN height < 20 THEN -1 ELSE state END AS kind FROM cells),
        same AS MATERIALIZED (SELECT e.src, e.dst FROM edges e JOIN kinds a ON e.src = a.cell_id JOIN kinds b ON e.dst = b.cell_id WHERE a.kind = b.kind),
        spread(cell_id, label) AS (SELECT cell_id, cell_id FROM kinds UNION SELECT s.dst, k.label FROM spread k JOIN same s ON k.cell_id = s.src WHERE k.label < s.dst)
        SELECT cell_id, min(label) AS feature FROM spread GROUP BY cell_id""",
    "features": f"""SELECT id, CASE WHEN low >= 20 THEN 'island' WHEN touches_border THEN 'ocean' ELSE 'lake' END AS kind, touches_border, cell_count FROM (SELECT p.feature AS id, min(c.height) AS low,
        bool_or(c.cx = 0 OR c.cx = {WIDTH - 1} OR c.cy = 0) AS touches_border, count(*) AS cell_count FROM places p JOIN cells c ON p.cell_id = c.cell_id GROUP BY p.feature)""",
    "streams": """WITH RECURSIVE lowest AS MATERIALIZED (SELECT src, dst FROM (SELECT e.src, e.dst, row_number() OVER (PARTITION BY e.src ORDER BY b.height, e.slot) AS k FROM edges e JOIN cells a ON e.src = a.cell_id JOIN cells b ON e.dst = b.cell_id WHERE a.height >= 20 AND b.height < a.height) WHERE k = 1),
        course(start, cell_id) AS (SELECT cell_id, cell_id FROM cells WHERE height >= 20 UNION ALL SELECT k.start, d.dst FROM course k JOIN lowest d ON k.cell_id = d.src),
        wet AS (SELECT k.cell_id, least(CAST(sum(s.precipitation) AS BIGINT), 65535) AS flux FROM course k JOIN cells s ON k.start = s.cell_id JOIN cells c ON k.cell_id = c.cell_id WHERE c.height >= 20 GROUP BY k.cell_id),
        stops AS (SELECT k.start, k.cell_id AS root FROM course k ANTI JOIN lowest d ON k.cell_id = d.src), size AS (SELECT power(count(*) / 1e4, 0.25e0) AS modifier FROM cells),
        rows AS (SELECT w.cell_id, w.flux, CASE WHEN w.flux >= 30 THEN s.root + 1 ELSE 0 END AS river FROM wet w JOIN stops s ON w.cell_id = s.start
        UNION ALL SELECT DISTINCT s.root, 0, s.root + 1 FROM wet w JOIN stops s ON w.cell_id = s.start JOIN cells c ON s.root = c.cell_id WHERE w.flux >= 30 AND c.height < 20)
        SELECT rows.*, modifier FROM rows, size""",
    "rings": f"SELECT cell_id, pos, (cy + pos // 2) * {WIDTH + 1} + cx + CASE WHEN pos IN (1, 2) THEN 1 ELSE 0 END AS vertex FROM cells, (SELECT range AS pos FROM range(4)) r",
    "vertices": f"SELECT DISTINCT vertex, (vertex % {WIDTH + 1}) * 10e0 AS x, (vertex // {WIDTH + 1}) * 10e0 AS y FROM rings",
    "burgs": """SELECT c_custkey AS id, c_name AS name, cell, CAST(c_nationkey AS BIGINT) AS state, greatest(c_acctbal, 0e0) AS population, c_custkey % 37 = 5 AS removed,
        row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) = 1 AS is_capital
        FROM customer JOIN (SELECT o_custkey, min(o_orderkey) AS cell FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE c_custkey > 0""",
    "points": """SELECT event_id, user_id AS id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS pos,
        CAST(event_id % 937 AS DOUBLE) AS x, value AS y, value AS flux FROM events""",
}
NEEDS = {"edges": ("cells",), "places": ("cells", "edges"), "features": ("cells", "edges", "places"), "streams": ("cells", "edges"), "rings": ("cells",), "vertices": ("cells", "rings")}


def with_clause(names: tuple[str, ...], recursive: bool = False) -> str:
    """WITH clause that defines the named tables, and those they need."""
    wanted = dict.fromkeys(x for n in names for x in (*NEEDS.get(n, ()), n))
    if not wanted:
        return ""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(f"{n} AS MATERIALIZED ({SQL[n]})" for n in wanted) + " "
