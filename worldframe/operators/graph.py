"""Operators on the adjacency edge table: components, flow, traces, height bands and contours.

Iterations run in a number of rounds that grows with the logarithm of the longest path; each round is joins and
aggregates on cell ids, and its result is checkpointed. Components, sums and the ends of chains are first found inside blocks of
consecutive ids, each in one task, so that the rounds only carry what crosses blocks. What an edge says about its two ends is
read in the block of its source, with the few cells outside that its edges lead to.
"""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worldframe.plans.lineage import cut

#: A block has so many bits of consecutive ids; its edges and pointers, which one task looks at together, are bounded by it.
BLOCK_BITS = 16


def block(node: str) -> Column:
    return F.shiftright(node, BLOCK_BITS)


def by_block(edges: DataFrame, cells: DataFrame, run: Callable[[pd.DataFrame, pd.DataFrame, Callable[[np.ndarray], np.ndarray]], pd.DataFrame], schema: str) -> DataFrame:
    """run(edges, cells, at) for each block of sources: its edges whose ends both are cells, these cells and the place of an id among them.

    edges: src, dst and others, read twice; cells: cell_id and others. The edges are moved once, whatever is asked of their ends.
    """
    beyond = edges.where(block("src") != block("dst")).select(block("src").alias("block"), F.col("dst").alias("cell_id")).distinct()
    known = cells.withColumn("block", block("cell_id")).unionByName(beyond.join(cells, "cell_id").select(*cells.columns, "block"))

    def met(part: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("cell_id", ignore_index=True)
        ids = own["cell_id"].to_numpy()

        def at(x: np.ndarray) -> np.ndarray:
            return np.minimum(np.searchsorted(ids, x), max(len(ids) - 1, 0))

        if len(part):
            held = np.zeros(len(part), dtype=bool) if not len(ids) else (ids[at(part["src"].to_numpy())] == part["src"].to_numpy()) & (ids[at(part["dst"].to_numpy())] == part["dst"].to_numpy())
            part = part[held]
        return run(part, own, at)

    return edges.groupBy(block("src").alias("block")).cogroup(known.groupBy("block")).applyInPandas(met, schema)


def firsts(part: pd.DataFrame, keys: list[str], order: list[str]) -> pd.DataFrame:
    """The first row of each of the keys in this order."""
    return part.sort_values([*keys, *order]).drop_duplicates(keys)


def down(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst: the steepest strictly lower neighbour of each land cell, the first on ties."""

    def run(part: pd.DataFrame, own: pd.DataFrame, at: Callable[[np.ndarray], np.ndarray]) -> pd.DataFrame:
        height = own["height"].to_numpy()
        part = part.assign(low=height[at(part["dst"].to_numpy())], high=height[at(part["src"].to_numpy())])
        return firsts(part[(part["high"] >= 20) & (part["low"] < part["high"])], ["src"], ["low", "slot", "dst"])[["src", "dst"]]

    return by_block(edges.select("src", "slot", "dst"), cells.select("cell_id", "height"), run, "src long, dst long")


def within(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """The edges (src, slot, dst) between cells of one kind. cells: cell_id, kind."""
    a, b = cells.selectExpr("cell_id AS src", "kind AS a"), cells.selectExpr("cell_id AS dst", "kind AS b")
    return edges.join(b, "dst").join(a, "src").where("a = b").select("src", "slot", "dst")


def _block_ends(part: pd.DataFrame) -> pd.DataFrame:
    """node, root, out: the last node of each chain inside the block, or the first outside (out)."""
    part = part.sort_values("src")
    src, end = part["src"].to_numpy(), part["dst"].to_numpy().copy()

    def known(x: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(src, x), len(src) - 1)
        return np.where(src[at] == x, at, -1)

    onward = known(end)
    while (on := onward >= 0).any():
        end[on], onward[on] = end[onward[on]], onward[onward[on]]
    out = end >> BLOCK_BITS != src[0] >> BLOCK_BITS
    last = np.unique(end[~out])
    return pd.DataFrame({"node": np.concatenate([src, last]), "root": np.concatenate([end, last]), "out": np.concatenate([out, np.zeros(len(last), dtype=bool)])})


def roots(pointers: DataFrame) -> DataFrame:
    """node, root: where each chain of (src, dst) ends, by pointer doubling. Chains must not be cyclic."""
    inside = cut(pointers.select("src", "dst").groupBy(block("src")).applyInPandas(_block_ends, "node long, root long, out boolean"))
    entered = inside.where("out").select(F.col("root").alias("node")).distinct()
    led = entered.join(inside, "node", "left")
    at = cut(led.select("node", F.coalesce("root", "node").alias("root"), F.col("root").isNull().alias("last")))
    ends = at.where("last").select("node", F.col("node").alias("root"))
    far = at = at.select("node", "root")
    while not far.isEmpty():
        onward = at.select(F.col("node").alias("root"), F.col("root").alias("next"))
        step = cut(at.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root"), (F.coalesce("next", "root") != F.col("root")).alias("moved")))
        at, far = step.select("node", "root"), step.where("moved")
    beyond = at.select(F.col("node").alias("root"), F.col("root").alias("end"))
    whole = inside.where("out").join(beyond, "root").select("node", F.col("end").alias("root"))
    return inside.where("NOT out").select("node", "root").unionByName(whole).unionByName(ends)


def _block_sums(node: np.ndarray, held: np.ndarray, to: np.ndarray, times: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What each node holds and all that reaches it over nodes of the block; the first node outside that its way leads to (-1 if none), and how often what it holds arrives there.

    to: -1 where a way ends.
    """
    order = np.argsort(node)
    at = order[np.minimum(np.searchsorted(node, to, sorter=order), len(node) - 1)]
    hop = np.where(node[at] == to, at, -1)
    out, held, times = to.copy(), held.copy(), times.copy()
    while (on := np.flatnonzero(hop >= 0)).size:
        sent = np.zeros_like(held)
        np.add.at(sent, hop[on], held[on] * times[on])
        out[on], times[on], hop[on] = out[hop[on]], np.minimum(times[on] * times[hop[on]], most), hop[hop[on]]
        held = np.minimum(held + sent, most)
    return held, out, times


def sums(at: DataFrame, most: int) -> DataFrame:
    """at with what each node holds (sum) and all that reaches it, most at most: it passes on to the next (to, null at the end) so many times (times).

    at: node, sum, to, times and others, written; ways must not be cyclic; what leads to no node is lost. Sums inside a block are made in its task; the rounds carry what crosses blocks.
    """
    over = at.where(F.col("to").isNotNull() & (block("node") != block("to"))).select(F.col("to").alias("node")).distinct().withColumn("entered", F.lit(True))
    kind = at.schema
    rest = [f for f in kind if f.name not in ("node", "sum", "to", "times")]

    def read(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        part = part[["node", "sum", "to", "times"]]
        return part["node"].to_numpy(), part["sum"].to_numpy(), part["to"].astype("Int64").fillna(-1).to_numpy(np.int64), part["times"].astype("Int64").fillna(1).to_numpy(np.int64)

    def leaving(part: pd.DataFrame) -> pd.DataFrame:
        """What leaves the block (node: where it arrives, to null), and the ways of nodes that are entered (sum 0)."""
        node, held, to, times = read(part)
        total, out, far = _block_sums(node, held, to, times, most)
        exits = (to >= 0) & (to >> BLOCK_BITS != node[0] >> BLOCK_BITS)
        arrived = pd.DataFrame({"node": to[exits], "sum": np.minimum(total[exits] * times[exits], most)}).groupby("node", as_index=False).sum()
        way = part["entered"].notna().to_numpy()
        ways = pd.DataFrame({"node": node[way], "sum": np.zeros(int(way.sum()), dtype=np.int64), "to": pd.arrays.IntegerArray(out[way], out[way] < 0), "times": far[way]})
        return pd.concat([arrived.assign(to=pd.array([pd.NA] * len(arrived), dtype="Int64"), times=np.ones(len(arrived), dtype=np.int64)), ways])

    joined = at.select("node", "sum", "to", "times").join(over, "node", "left")
    left = cut(joined.groupBy(block("node")).applyInPandas(leaving, "node long, sum long, to long, times long"))
    far = cut(left.groupBy("node").agg(F.least(F.sum("sum"), F.lit(most)).cast("long").alias("sum"), F.max("to").alias("to"), F.max("times").alias("times")))
    done = None
    while not (going := far.where("to IS NOT NULL")).isEmpty():
        sent = going.groupBy(F.col("to").alias("node")).agg(F.sum(F.col("sum") * F.col("times")).alias("got"))
        # Ways that have ended take no part in the second join: they would all meet in one task.
        got = cut(far.join(sent, "node", "left").select("node", F.least(F.col("sum") + F.coalesce("got", F.lit(0)), F.lit(most)).cast("long").alias("sum"), "to", "times", F.col("got").isNotNull().alias("live")))
        onward = far.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("times").alias("again"))
        went = got.where("to IS NOT NULL").join(onward, "to", "left").select("node", "sum", F.col("next").alias("to"), F.least(F.col("times") * F.coalesce("again", F.lit(1)), F.lit(most)).cast("long").alias("times"), F.col("next").isNotNull().alias("more"), "live")
        rest_of = got.where("to IS NULL").select("node", "sum", "to", "times", F.lit(False).alias("more"), "live")
        step = cut(went.unionByName(rest_of))
        still = step.where("NOT (more OR live)").select("node", "sum")
        done = still if done is None else done.unionByName(still)
        far = step.where("more OR live").select("node", "sum", "to", "times")
    brought = far.select("node", "sum") if done is None else far.select("node", "sum").unionByName(done)

    def whole(part: pd.DataFrame) -> pd.DataFrame:
        node, held, to, times = read(part)
        held = np.minimum(held + part["brought"].astype("Int64").fillna(0).to_numpy(np.int64), most)
        return part[["node", *(f.name for f in rest)]].assign(sum=_block_sums(node, held, to, times, most)[0])[["node", "sum", *(f.name for f in rest)]]

    schema = ", ".join(["node long, sum long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)])
    return at.join(brought.withColumnRenamed("sum", "brought"), "node", "left").groupBy(block("node")).applyInPandas(whole, schema)


def flow(cells: DataFrame, edges: DataFrame, weight: str = "precipitation", most: int = 65535, pointers: DataFrame | None = None) -> DataFrame:
    """cell_id, flux: the weight of each land cell and of all that drain into it, held at most. pointers: src, dst, those of down() if known."""
    land = cells.where("height >= 20").select(F.col("cell_id").alias("node"), F.col(weight).cast("long").alias("sum"))
    hop = (down(cells, edges) if pointers is None else pointers).select(F.col("src").alias("node"), F.col("dst").alias("to"))
    at = cut(land.join(hop, "node", "left").withColumn("times", F.lit(1).cast("long")))
    return sums(at, 1 << 62).select(F.col("node").alias("cell_id"), F.least("sum", F.lit(most)).alias("flux"))


def _block_labels(part: pd.DataFrame) -> pd.DataFrame:
    """node, label: the least node reachable over the edges of a block."""
    node, at = np.unique(part[["src", "dst"]].to_numpy(), return_inverse=True)
    a, b = at.reshape(-1, 2).T
    label = np.arange(len(node))
    while True:
        low = np.minimum(label[a], label[b])
        told = label.copy()
        for x in (a, b, label[a], label[b]):
            np.minimum.at(told, x, low)
        told = told[told]
        if (told == label).all():
            return pd.DataFrame({"node": node, "label": node[label]})
        label = told


def components(cells: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """cell_id, region: the least cell reachable over edges (in both directions) between cells of one kind. Edges are read twice; those that lead elsewhere take no part."""

    def run(part: pd.DataFrame, own: pd.DataFrame, at: Callable[[np.ndarray], np.ndarray]) -> pd.DataFrame:
        """node, label of the cells of the block that have one, and the edges that leave it (far)."""
        code = pd.factorize(own["kind"])[0]
        src, dst = part["src"].to_numpy(), part["dst"].to_numpy()
        part = part[(code[at(src)] == code[at(dst)]) & (src != dst)]
        leaves = (part["src"].to_numpy() >> BLOCK_BITS) != (part["dst"].to_numpy() >> BLOCK_BITS)
        far = part[leaves].rename(columns={"src": "node", "dst": "label"}).assign(far=True)
        return pd.concat([_block_labels(part[~leaves]).assign(far=False), far])[["node", "label", "far"]]

    met = cut(by_block(edges.select("src", "dst"), cells.where(F.col(kind).isNotNull()).select("cell_id", F.col(kind).alias("kind")), run, "node long, label long, far boolean"))
    inside = met.where("NOT far").select("node", "label")
    called = lambda x, y: inside.select(F.col("node").alias(x), F.col("label").alias(y))
    far = met.where("far").select(F.col("node").alias("src"), F.col("label").alias("dst")).join(called("src", "a"), "src", "left").join(called("dst", "b"), "dst", "left")
    far = far.select(F.coalesce("a", "src").alias("a"), F.coalesce("b", "dst").alias("b"))
    far = cut(far.unionByName(far.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    at = cut(far.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
    moved = far
    while not moved.isEmpty():
        seen = far.join(at.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        low = at.join(seen, "node").select("node", "label", F.least("label", "low").alias("low"))
        told = low.select("node", "low").unionByName(low.select(F.col("label").alias("node"), "low"))
        lower = cut(told.groupBy("node").agg(F.min("low").alias("label")))
        jumped = cut(lower.join(lower.select(F.col("node").alias("label"), F.col("label").alias("root")), "label").select("node", F.col("root").alias("label")))
        moved = jumped.join(at.withColumnRenamed("label", "old"), "node").where("label <> old")
        at = jumped
    first = cells.select("cell_id").join(called("cell_id", "label"), "cell_id", "left").withColumn("label", F.coalesce("label", "cell_id"))
    return cut(first.join(at.select(F.col("node").alias("label"), F.col("label").alias("region")), "label", "left").select("cell_id", F.coalesce("region", "label").alias("region")))


def trace(starts: DataFrame, pointers: DataFrame) -> DataFrame:
    """start, step, cell_id: the path from each start along (src, dst) to its end; known steps and the length of a hop double in each round."""
    out = cut(starts.select(F.col("cell_id").alias("start"), F.lit(0).cast("long").alias("step"), "cell_id"))
    hop, size = cut(pointers.select(F.col("src").alias("cell_id"), F.col("dst").alias("to"))), 1
    while not hop.isEmpty():
        onward = out.join(hop, "cell_id").select("start", (F.col("step") + size).alias("step"), F.col("to").alias("cell_id"))
        out = cut(out.unionByName(onward))
        hop, size = cut(hop.join(hop.select(F.col("cell_id").alias("to"), F.col("to").alias("far")), "to").select("cell_id", F.col("far").alias("to"))), 2 * size
    return out


def height_bands(cells: DataFrame, lowest: int = 20, highest: int = 98, step: int = 6) -> DataFrame:
    """cell_id, level: the bands that each cell reaches."""
    reach = F.sequence(F.lit(lowest).cast("long"), F.least(F.col("height"), F.lit(highest).cast("long")), F.lit(step).cast("long"))
    return cells.where(F.col("height") >= lowest).select("cell_id", F.explode(reach).alias("level"))


def contours(cells: DataFrame, columns: int = 100) -> DataFrame:
    """level, cell_id, part, x1, y1, x2, y2: marching squares over the lattice; the corners come by equi-joins on cell ids."""
    at = cells.select("cell_id", "cx", "x", "y", F.col("height").cast("double").alias("h"))

    def corner(by: int, name: str) -> DataFrame:
        return at.select((F.col("cell_id") - by).alias("cell_id"), *(F.col(c).alias(f"{c}{name}") for c in ("x", "y", "h")))

    square = at.where(F.col("cx") < columns - 1).join(corner(1, "b"), "cell_id").join(corner(columns + 1, "c"), "cell_id").join(corner(columns, "d"), "cell_id")
    corners = ("h", "hb", "hc", "hd")
    levels = F.filter(F.sequence(F.lit(10).cast("long"), F.lit(90).cast("long"), F.lit(10).cast("long")), lambda at: (at > F.least(*corners)) & (at <= F.greatest(*corners)))
    level = square.withColumn("level", F.explode_outer(levels)).where("level IS NOT NULL")

    def crossing(a: str, b: str) -> Column:
        ha, hb = F.col(f"h{a}"), F.col(f"h{b}")
        t = F.when(F.abs(hb - ha) < 1e-8, F.lit(0.5)).otherwise((F.col("level") - ha) / (hb - ha))
        between = lambda c: F.col(f"{c}{a}") + t * (F.col(f"{c}{b}") - F.col(f"{c}{a}"))
        return F.when((ha >= F.col("level")) != (hb >= F.col("level")), F.struct(between("x").alias("x"), between("y").alias("y")))

    # Top, right, bottom, left, in this order; saddles pair the first two and the last two.
    found = F.filter(F.array(crossing("", "b"), crossing("b", "c"), crossing("d", "c"), crossing("", "d")), lambda p: p.isNotNull())
    cut_at = level.select("level", "cell_id", found.alias("p")).where("size(p) >= 2")
    pairs = cut_at.select("level", "cell_id", "p", F.explode(F.sequence(F.lit(0), (F.size("p") / 2).cast("int") - 1)).alias("part"))
    r = lambda c: F.expr(f"floor(({c}) * 1e4 + 5e-1) / 1e4 + 0e0")
    return pairs.select("level", "cell_id", F.col("part").cast("long").alias("part"), *(r(f"p[2 * part + {k}].{c}").alias(f"{c}{k + 1}") for k in (0, 1) for c in ("x", "y")))


def shores(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """feature, height, cell_id, slot, beside: the lowest land cell beside each feature's water, of equals the least, with the first of its neighbours that is the feature's.

    cells: cell_id, height, feature.
    """

    def run(part: pd.DataFrame, own: pd.DataFrame, at: Callable[[np.ndarray], np.ndarray]) -> pd.DataFrame:
        height, feature, a, b = own["height"].to_numpy(), own["feature"].to_numpy(), at(part["src"].to_numpy()), at(part["dst"].to_numpy())
        part = part.assign(height=height[a], feature=feature[b])[(height[a] >= 20) & (height[b] < 20)].rename(columns={"src": "cell_id", "dst": "beside"})
        return firsts(part, ["feature"], ["height", "cell_id", "slot", "beside"])[["feature", "height", "cell_id", "slot", "beside"]]

    kind = cells.schema["height"].dataType.simpleString()
    near = by_block(edges.select("src", "slot", "dst"), cells.select("cell_id", "height", "feature"), run, f"feature long, height {kind}, cell_id long, slot long, beside long")
    return near.groupBy("feature").agg(F.min(F.struct("height", "cell_id", "slot", "beside")).alias("at")).select("feature", "at.*")


def close_lakes(cells: DataFrame, edges: DataFrame, lakes: DataFrame, rise: int = 20, lake_height: int = 19) -> DataFrame:
    """lake, closed: a lake is closed if no way over cells below its height plus rise leads from its lowest shore to other water.

    cells: cell_id, height, feature; lakes: id. The ways are the connected parts of the passable cells, found once for all lakes.
    """
    low_cells = cells.where(F.col("height") < lake_height + rise).select("cell_id", F.lit(1).alias("kind"))
    parts = components(low_cells, edges, "kind")
    water = cells.where("height < 20").join(parts, "cell_id").groupBy("region").agg(F.min("feature").alias("least"), F.max("feature").alias("most"))
    own = lakes.select(F.col("id").alias("feature"))
    # Edges lead both ways, so a lake's shore are the cells that lead to it.
    low = shores(cells, edges).join(own, "feature").select(F.col("feature").alias("lake"), F.col("cell_id").alias("src"))
    # The shore itself may be too high to pass; its neighbours are tried too.
    tried = low.join(edges.select("src", "dst"), "src").select("lake", F.explode(F.array("src", "dst")).alias("cell_id")).distinct()
    met = tried.join(parts, "cell_id").join(water, "region").where("least <> lake OR most <> lake").select("lake").distinct().withColumn("open", F.lit(True))
    return own.withColumnRenamed("feature", "lake").join(met, "lake", "left").select("lake", F.col("open").isNull().alias("closed"))
