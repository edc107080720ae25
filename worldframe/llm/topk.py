"""Exact top-k by inner product: best-first search in paged M-trees.

Vectors become integers, floor(scale * x). With M the largest norm, the point (x, sqrt(M^2 - |x|^2)) has norm
M, so that a larger inner product with the query is a smaller Euclidean distance, which is the metric of the
trees. Every shard of SHARD rows is a tree: leaf pages of near points around a pivot, each with its covering
radius and each entry's distance to the pivot, under routing nodes with radii and parent distances of their
own. A block of QUERIES queries meets every shard once, so up to 20 QUERIES rows at a twentieth asked, each row is shuffled and put
into a tree once; in a shard each query takes its pages best bound first and
stops when no page can hold a better score; within a page the stored parent distances rule entries out by the
triangle inequality before anything is computed. Scores are integers and bounds are widened by SLACK, so the
result is exact.

Vectors that are null, empty, or hold null or non-finite components take no part. A vector shorter than another is
zero where it has no component. A query with fewer candidates gets them all. Ties go to the smaller id; repeated rows (same id) are
candidates of their own, except that rows with a query's id are not its candidates. Rows without an id take
no part. An empty table gives an empty result. Extra columns are not read, whatever their names.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE, FANOUT, SHARD, QUERIES = 128, 16, 16_384, 65_536
#: Queries that search a tree at once.
AT_ONCE = 2048
SLACK = 1e-6
#: A score under all others.
NONE = -(1 << 62)


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as an integer array; null for a vector that takes no part."""
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)), whole)


class Tree:
    """A bulk-loaded M-tree over the rows of x (integers), with routing nodes above leaf pages."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, top: float, seed: int = 5):
        norm = (x * x).sum(axis=1)
        self.ids, self.x, self.top = ids, x, top
        self.points = np.concatenate([x, np.sqrt(np.maximum(top - norm, 0.0))[:, None]], axis=1)
        self.rng = np.random.default_rng(seed)
        self.pages: list[np.ndarray] = []
        self.router: list[int] = []
        routers = self._split(np.arange(len(x)), max(1, -(-len(x) // (PAGE * FANOUT))))
        for r, rows in enumerate(routers):
            for page in self._split(rows, max(1, -(-len(rows) // PAGE))):
                self.pages += [page[i : i + 2 * PAGE] for i in range(0, len(page), 2 * PAGE)]
                self.router += [r] * (len(self.pages) - len(self.router))
        self.pivot = np.stack([self.points[p].mean(axis=0) for p in self.pages])
        self.parent = [np.linalg.norm(self.points[p] - c, axis=1) for p, c in zip(self.pages, self.pivot, strict=True)]
        self.radius = np.array([d.max() for d in self.parent])
        self.router_of = np.array(self.router)
        self.centre = np.stack([self.pivot[self.router_of == r].mean(axis=0) for r in range(len(routers))])
        self.to_centre = np.linalg.norm(self.pivot - self.centre[self.router_of], axis=1)
        self.computed = 0

    def _split(self, rows: np.ndarray, n: int) -> list[np.ndarray]:
        """Rows dealt to the nearest of n of their number; ties to the first."""
        if n <= 1 or len(rows) <= 1:
            return [rows]
        centre = self.points[self.rng.choice(rows, min(n, len(rows)), replace=False)]
        for _ in range(2):
            near = _squares(self.points[rows], centre).argmin(axis=1)
            centre = np.stack([self.points[rows[near == j]].mean(axis=0) if (near == j).any() else centre[j] for j in range(len(centre))])
        near = _squares(self.points[rows], centre).argmin(axis=1)
        return [rows[near == j] for j in range(len(centre)) if (near == j).any()]

    def search(self, ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(len(q), k) scores and ids, the best first; ids are -1 where there are fewer than k candidates.

        Scores and ids are kept as sorted rows; a smaller id wins a tie, so a page may be left out only if its
        bound is under the k-th score.
        """
        n = len(q)
        low = NONE
        score, found = np.full((n, k), low), np.full((n, k), -1)
        flat = np.concatenate([q, np.zeros((n, 1))], axis=1)
        base = ((q * q).sum(axis=1) + self.top) / 2  # an inner product is base less half the squared distance
        to_centre = np.sqrt(_squares(flat, self.centre))
        # Bound of each page: by its router's stored distance, refined by the page's own pivot where a query still needs it.
        rough = np.maximum(0.0, np.abs(to_centre[:, self.router_of] - self.to_centre[None, :]) - self.radius[None, :])
        bound = base[:, None] - rough**2 / 2
        exact = np.zeros((n, len(self.pages)), dtype=bool)
        distance = np.zeros((n, len(self.pages)))
        done = np.zeros((n, len(self.pages)), dtype=bool)
        active = np.arange(n)
        while len(active):
            open_bound = np.where(done[active], -np.inf, bound[active])
            page = open_bound.argmax(axis=1)
            alive = open_bound[np.arange(len(active)), page] + SLACK * (1 + base[active]) >= score[active, -1].astype(float)
            alive &= open_bound[np.arange(len(active)), page] > -np.inf
            active, page = active[alive], page[alive]
            for p in np.unique(page):
                of = active[page == p]
                fresh, ready = of[~exact[of, p]], of[exact[of, p]]
                if len(fresh):  # back into the queue with the page's own bound
                    d = np.sqrt(_squares(flat[fresh], self.pivot[p : p + 1]))[:, 0]
                    distance[fresh, p], exact[fresh, p] = d, True
                    bound[fresh, p] = np.minimum(bound[fresh, p], base[fresh] - np.maximum(0.0, d - self.radius[p]) ** 2 / 2)
                if len(ready):
                    self._page(p, ready, ids, q, base, distance[:, p], score, found, k)
                    done[ready, p] = True
        return score, found

    def _page(self, p: int, of: np.ndarray, ids: np.ndarray, q: np.ndarray, base: np.ndarray, distance: np.ndarray, score: np.ndarray, found: np.ndarray, k: int) -> None:
        rows, parent = self.pages[p], self.parent[p]
        # |d(q, pivot) - d(x, pivot)| <= d(q, x): entries that cannot reach the k-th score of any of these queries are left out.
        least = np.maximum(0.0, np.maximum(distance[of].min() - parent, parent - distance[of].max()))
        keep = (base[of].max() - least**2 / 2) + SLACK * (1 + base[of].max()) >= float(score[of, -1].min())
        rows = rows[keep]
        if not len(rows):
            return
        self.computed += len(rows) * len(of)
        got = np.rint(q[of] @ self.x[rows].T).astype(np.int64)
        who = np.broadcast_to(self.ids[rows], got.shape)
        low = NONE
        got = np.where(who == ids[of][:, None], low, got)
        both, names = np.concatenate([score[of], got], axis=1), np.concatenate([found[of], who], axis=1)
        names = np.where(both == low, np.iinfo(np.int64).max, names)
        order = np.lexsort((names, -both), axis=1)[:, :k] if both.shape[1] <= 4 * k else _best(both, names, k)
        score[of] = np.take_along_axis(both, order, axis=1)
        found[of] = np.where(score[of] == low, -1, np.take_along_axis(names, order, axis=1))


def _best(score: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest scores of each row, ties to the smaller name."""
    edge = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
    widest = int((score >= edge).sum(axis=1).max())
    column = np.argsort(-score, axis=1, kind="stable")[:, :widest]
    order = np.lexsort((np.take_along_axis(names, column, axis=1), -np.take_along_axis(score, column, axis=1)), axis=1)[:, :k]
    return np.take_along_axis(column, order, axis=1)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score. Blocks of queries meet shards of rows; both have bounded sizes, by hashes of the id."""
    whole = vectors.select(F.col(id_col).cast("long").alias("id"), is_query.alias("q"), quantised(F.col(vector_col), scale).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    sizes = whole.agg(F.count("*").alias("rows"), F.count_if("q").alias("asked"), F.max(F.size("v")).alias("width")).first()
    schema = T.StructType([T.StructField(n, t) for n, t in (("query_id", T.LongType()), ("vec_id", T.LongType()), ("score", T.LongType()))])
    if not sizes["asked"]:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = sizes["width"]
    shards, blocks = max(1, -(-sizes["rows"] // shard)), max(1, -(-sizes["asked"] // queries))
    deal = F.xxhash64(F.lit(1), "id", "v")
    rows = whole.select("id", "v", F.pmod(deal, F.lit(shards)).alias("s"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"))
    once = whole.where("q").groupBy("id").agg(F.min("v").alias("v"))
    asked = once.select("id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("s"), F.pmod(deal, F.lit(blocks)).alias("b"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({n: np.array([], dtype=np.int64) for n in ("query_id", "vec_id", "score")})
        x, q = np.zeros((len(left), width)), np.zeros((len(right), width))
        for table, part in ((x, left), (q, right)):
            for i, v in enumerate(part["v"]):
                table[i, : len(v)] = v
        mine, ids = left["id"].to_numpy(np.int64), right["id"].to_numpy(np.int64)
        tree = Tree(mine, x, float((x * x).sum(axis=1).max()))
        parts = [tree.search(ids[at : at + AT_ONCE], q[at : at + AT_ONCE], k) for at in range(0, len(ids), AT_ONCE)]
        score, found = (np.concatenate(z) for z in zip(*parts, strict=True))
        there = found != -1
        return pd.DataFrame({"query_id": np.repeat(ids, there.sum(axis=1)), "vec_id": found[there], "score": score[there]})

    met = rows.groupBy("s", "b").cogroup(asked.groupBy("s", "b")).applyInPandas(meet, schema)
    ranked = met.selectExpr("*", "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank").where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
