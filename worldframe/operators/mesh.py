"""Mesh generation for batches of maps: one task per seed, as random numbers and triangulation are sequential."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame

import worldframe
from worldframe.functions import geometry
from worldframe.functions.prng import stream

cloudpickle.register_pickle_by_value(worldframe)


def _per_map(maps: DataFrame, make: Callable[[pd.Series], pd.DataFrame], schema: str) -> DataFrame:
    """make(map) for every row of maps (map_id, seed, width, height, cells), each on its own.

    Rows of maps are small and what is made of them is not, so they are dealt over a given number of tasks: by map_id, Spark would put all of them in one.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for _, row in part.iterrows():
                yield make(row)

    spark = maps.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return maps.repartition(tasks).mapInPandas(run, schema)


def alea_stream(maps: DataFrame, n: int = 100) -> DataFrame:
    def make(row: pd.Series) -> pd.DataFrame:
        draw = stream(str(row["seed"]))
        return pd.DataFrame({"map_id": row["map_id"], "k": np.arange(n), "u": [next(draw) for _ in range(n)]})

    return _per_map(maps, make, "map_id long, k long, u double")


def grid_points(maps: DataFrame) -> DataFrame:
    """map_id, kind (grid or boundary), id, x, y."""

    def make(row: pd.Series) -> pd.DataFrame:
        placed = geometry.place(float(row["width"]), float(row["height"]), int(row["cells"]), str(row["seed"]))
        out = [pd.DataFrame({"map_id": row["map_id"], "kind": k, "id": np.arange(len(p)), "x": [q[0] for q in p], "y": [q[1] for q in p]}) for k, p in (("grid", placed["points"]), ("boundary", placed["boundary"]))]
        return pd.concat(out)

    return _per_map(maps, make, "map_id long, kind string, id long, x double, y double")


def _mesh(row: pd.Series) -> tuple[dict, dict]:
    placed = geometry.place(float(row["width"]), float(row["height"]), int(row["cells"]), str(row["seed"]))
    return placed, geometry.dual(placed["points"] + placed["boundary"], len(placed["points"]), placed["lattice"])


def _sizes(areas: np.ndarray) -> np.ndarray:
    return np.minimum(np.abs(areas).astype(np.int64), 65535)


def triangles(maps: DataFrame) -> DataFrame:
    """map_id, triangle, a, b, c, and the triangles over the edges that they face (-1 at the hull)."""

    def make(row: pd.Series) -> pd.DataFrame:
        mesh = _mesh(row)[1]
        t, o = mesh["triangles"], mesh["over"]
        return pd.DataFrame({"map_id": row["map_id"], "triangle": np.arange(len(t)), "a": t[:, 0], "b": t[:, 1], "c": t[:, 2], "n0": o[:, 0], "n1": o[:, 1], "n2": o[:, 2]})

    return _per_map(maps, make, "map_id long, triangle long, a long, b long, c long, n0 long, n1 long, n2 long")


def voronoi(maps: DataFrame) -> DataFrame:
    """map_id, cell_id, x, y, ring, neighbors, is_border, area of every grid cell."""

    def make(row: pd.Series) -> pd.DataFrame:
        placed, mesh = _mesh(row)
        p = placed["points"]
        size = _sizes(mesh["areas"])
        return pd.DataFrame({"map_id": row["map_id"], "cell_id": np.arange(len(p)), "x": [q[0] for q in p], "y": [q[1] for q in p], "ring": mesh["rings"], "neighbors": mesh["neighbours"], "is_border": mesh["border"], "area": size})

    return _per_map(maps, make, "map_id long, cell_id long, x double, y double, ring array<long>, neighbors array<long>, is_border boolean, area long")


def repacked(maps: DataFrame) -> DataFrame:
    """map_id, cell_id, grid_id, x, y, height, area after dropping deep ocean and filling in coasts; heights fall off from the centre."""

    def make(row: pd.Series) -> pd.DataFrame:
        placed, mesh = _mesh(row)
        p = np.array(placed["points"])
        centre = np.array([float(row["width"]), float(row["height"])]) / 2
        draw = stream(f"{row['seed']}_h")
        fall = 1 - np.sqrt((((p - centre) / centre) ** 2).sum(axis=1)) / 1.2
        height = np.clip(fall * 90 + np.array([next(draw) for _ in p]) * 10, 0, 100).astype(int)
        kind = np.where(height >= 20, 2, -3)
        for i, near in enumerate(mesh["neighbours"]):
            if any((height[j] >= 20) != (height[i] >= 20) for j in near):
                kind[i] = 1 if height[i] >= 20 else -1
        for i, near in enumerate(mesh["neighbours"]):
            if kind[i] == -3 and any(kind[j] == -1 for j in near):
                kind[i] = -2
        packed = geometry.repack(placed["points"], mesh, placed["spacing"], height, kind, np.zeros(len(p), dtype=bool))
        again = geometry.dual([(x, y) for x, y, _, _ in packed] + placed["boundary"], len(packed))
        size = _sizes(again["areas"])
        return pd.DataFrame({"map_id": row["map_id"], "cell_id": np.arange(len(packed)), "grid_id": [q[2] for q in packed], "x": [q[0] for q in packed], "y": [q[1] for q in packed], "height": [q[3] for q in packed], "area": size})

    return _per_map(maps, make, "map_id long, cell_id long, grid_id long, x double, y double, height long, area long")


REGENERATED = "path string, part string, cell_id long, grid_id long, x double, y double, height long, area long, feature_id long, is_border boolean, neighbors array<long>, ring array<long>, ring_x array<double>, ring_y array<double>, message string"

_NAMES = [c.split()[0] for c in REGENERATED.split(", ")]


def _cells(path: str, part: str, points: np.ndarray, mesh: dict, columns: dict) -> pd.DataFrame:
    n = len(points)
    at = [mesh["vertices"][r] for r in mesh["rings"]]
    made = {"path": path, "part": part, "cell_id": np.arange(n), "x": points[:, 0], "y": points[:, 1], "area": _sizes(mesh["areas"]), "is_border": mesh["border"], "neighbors": mesh["neighbours"], "ring": mesh["rings"]}
    return pd.DataFrame(made | columns | {"ring_x": [v[:, 0].tolist() for v in at], "ring_y": [v[:, 1].tolist() for v in at], "message": None})


def _regenerate(row: pd.Series) -> list[pd.DataFrame]:
    """The grid's and the packed cells of one file, or what is wrong with it."""

    def wrong(message: str) -> list[pd.DataFrame]:
        known = {"path": row["path"], "part": "error", "message": message}
        return [pd.DataFrame({c: pd.Series([known.get(c)], dtype=object) for c in _NAMES})]

    if row["seed"] is None or not row["width"] > 0 or not row["height"] > 0 or not row["desired"] > 0:
        return wrong("no header or no grid")
    placed = geometry.place(float(row["width"]), float(row["height"]), int(row["desired"]), str(row["seed"]))
    points = np.array(placed["points"])
    n = len(points)
    if n != row["n_points"]:
        return wrong(f"points: {row['n_points']} (expected {n})")
    if len(row["heights"]) != n:
        return wrong(f"height: {len(row['heights'])} (expected {n})")
    mesh = geometry.dual(placed["points"] + placed["boundary"], n, placed["lattice"])
    height, water, feature = (np.resize(np.append(np.asarray(row[c], dtype=np.int64), np.zeros(max(0, n - len(row[c])), dtype=np.int64)), n) for c in ("heights", "water", "features"))
    lake = np.isin(feature, np.asarray(row["lakes"], dtype=np.int64))
    packed = geometry.repack(placed["points"], mesh, placed["spacing"], height, water, lake)
    sizes = [f"{name}: {size} (expected {len(packed)})" for name, size in zip(row["names"], row["sizes"], strict=True) if size not in (0, len(packed))]
    if sizes:
        return wrong("; ".join(sizes))
    out = [_cells(row["path"], "grid", points, mesh, {"grid_id": np.arange(n), "height": height, "feature_id": feature})]
    if packed:
        at = np.array([(x, y) for x, y, _, _ in packed])
        grid_id = np.array([g for _, _, g, _ in packed])
        again = geometry.dual([(x, y) for x, y, _, _ in packed] + placed["boundary"], len(packed))
        out.append(_cells(row["path"], "pack", at, again, {"grid_id": grid_id, "height": np.array([h for _, _, _, h in packed]), "feature_id": feature[grid_id]}))
    return out


def regenerated(rows: DataFrame) -> DataFrame:
    """The cells of every map file with their geometry made anew: part grid or pack; or one row of part error, with all that does not fit in its message.

    rows: path, seed, width, height, desired, n_points, heights, water, features, lakes (ids), names and sizes (of the packed columns), one for each file. A file is one map, and its cells are made in one task.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for _, row in part.iterrows():
                yield from (made[_NAMES] for made in _regenerate(row))

    return rows.mapInPandas(run, REGENERATED)
