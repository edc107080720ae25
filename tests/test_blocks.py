"""Ends of chains, components and rings: inside blocks in one task, across blocks in rounds."""

import random

import pytest

from worldframe.operators import graph, isolines, rivers


@pytest.fixture
def written(monkeypatch):
    """The tables that the operators write."""
    tables = []
    for module in (graph, isolines):
        monkeypatch.setattr(module, "cut", lambda df, whole=module.cut: tables.append(whole(df)) or tables[-1])
    return tables


def test_chains(spark, written):
    # One chain inside a block takes no rounds; one that goes to and fro between blocks ends where it should.
    inside = [(i, i + 1) for i in range(1000)]
    assert {r["root"] for r in graph.roots(spark.createDataFrame(inside, "src long, dst long")).collect()} == {1000}
    assert len(written) <= 3
    ids = random.Random(5).sample(range(0, 6 << graph.BLOCK_BITS), 300)
    across = [*zip(ids[:200], ids[1:201], strict=True), *((i, ids[100]) for i in ids[201:])]
    got = {r["node"]: r["root"] for r in graph.roots(spark.createDataFrame(across, "src long, dst long")).collect()}
    assert got == dict.fromkeys(ids, ids[200])


def test_components(spark, written):
    ids = random.Random(6).sample(range(0, 5 << graph.BLOCK_BITS), 400)
    chain = [*zip(ids[:150], ids[1:150], strict=False), *zip(ids[150:300], ids[151:300], strict=False)]
    inside = [(10_000_000 + i, 10_000_001 + i) for i in range(500)]
    cells = [(i, 1) for i in ids] + [(10_000_000 + i, 1 + (i > 250)) for i in range(501)]
    edges = spark.createDataFrame([x for a, b in chain + inside for x in ((a, b), (b, a))], "src long, dst long")
    got = {r["cell_id"]: r["region"] for r in graph.components(spark.createDataFrame(cells, "cell_id long, kind long"), edges, "kind").collect()}
    want = {i: i for i in ids[300:]} | dict.fromkeys(ids[:150], min(ids[:150])) | dict.fromkeys(ids[150:300], min(ids[150:300]))
    assert got == want | {10_000_000 + i: 10_000_000 + 251 * (i > 250) for i in range(501)}
    written.clear()
    one = spark.createDataFrame(inside, "src long, dst long")
    nodes = spark.createDataFrame([(10_000_000 + i, 1) for i in range(501)], "cell_id long, kind long")
    assert {r["region"] for r in graph.components(nodes, one.union(one.select("dst", "src")), "kind").collect()} == {10_000_000}
    assert len(written) <= 5


def test_rings(spark, written):
    rng = random.Random(7)
    rings = [[isolines.SIDES * c for c in rng.sample(range(k << graph.BLOCK_BITS, (k + spread) << graph.BLOCK_BITS), n)] for k, spread, n in ((0, 1, 90), (1, 1, 1), (2, 3, 40), (5, 1, 4))]
    links = [(a, b) for r in rings for a, b in zip(r, r[1:] + r[:1], strict=True)]
    got = {r["side"]: (r["ring"], r["pos"], r["sides"]) for r in isolines.ranked(spark.createDataFrame(links, "side long, next long")).collect()}
    assert got == {x: (min(r), (k - r.index(min(r))) % len(r), len(r)) for r in rings for k, x in enumerate(r)}
    written.clear()
    assert isolines.ranked(spark.createDataFrame([x for x in links if x[0] in rings[0]], "side long, next long")).count() == 90
    assert len(written) <= 2


def test_ends_of_edges_by_block(spark):
    # Neighbours in other blocks, sources that are no cells, and ids far apart.
    rng = random.Random(8)
    ids = rng.sample(range(0, 4 << graph.BLOCK_BITS), 300) + list(range(500, 560))
    height = {i: rng.randrange(0, 60) for i in ids}
    pairs = {(a, b) for a in ids for b in rng.sample(ids, 4) if a != b} | {(a, a + 1) for a in range(500, 559)} | {(ids[0], 999_999)}
    both = sorted(pairs | {(b, a) for a, b in pairs})
    edges = spark.createDataFrame([(a, k % 7, b) for k, (a, b) in enumerate(both)], "src long, slot long, dst long")
    slot = {ab: k % 7 for k, ab in enumerate(both)}
    cells = spark.createDataFrame([(i, h, i % 5) for i, h in height.items()], "cell_id long, height long, feature long")
    near = {i: [b for a, b in both if a == i and b in height] for i in ids}
    lower = {i: min((height[j], slot[i, j], j) for j in n if height[j] < height[i])[2] for i, n in near.items() if height[i] >= 20 and any(height[j] < height[i] for j in n)}
    assert {r["src"]: r["dst"] for r in graph.down(cells, edges).collect()} == lower
    shore = {}
    for i in ids:
        for j in near[i]:
            if height[i] >= 20 > height[j]:
                shore[j % 5] = min(shore.get(j % 5, (99,)), (height[i], i, slot[i, j], j))
    assert {r["feature"]: tuple(r)[1:] for r in graph.shores(cells, edges).collect()} == shore


def test_sums_over_ways(spark):
    # Ways to and fro between blocks, some sent on twice, held at most; what leads to no node is lost.
    rng = random.Random(9)
    ids = rng.sample(range(0, 5 << graph.BLOCK_BITS), 400)
    to = {i: ids[rng.randrange(max(0, k - 6), k)] if k else None for k, i in enumerate(ids)} | {ids[7]: 9 << graph.BLOCK_BITS}
    times, own = {i: rng.choice((1, 1, 1, 2)) for i in ids}, {i: rng.randrange(50) for i in ids}
    want = dict(own)
    for i in reversed(ids):
        want[i] = min(want[i], 5000)
        if to[i] in want:
            want[to[i]] += want[i] * times[i]
    rows = [(i, own[i], to[i], times[i] if to[i] is not None else None, f"n{i}") for i in ids]
    got = graph.sums(spark.createDataFrame(rows, "node long, sum long, to long, times long, name string"), 5000).collect()
    assert {r["node"]: (r["sum"], r["name"]) for r in got} == {i: (want[i], f"n{i}") for i in ids}


def test_roots_of_rivers_do_not_meet_in_one_task(spark):
    rivers_ = spark.range(0, 2000).selectExpr("id AS river", "CASE WHEN id % 100 = 1 THEN id - 1 WHEN id = 50 THEN -7 END AS parent")
    tied = rivers.with_basin(rivers_, "river")
    assert {r["river"]: r["basin"] for r in tied.collect()} == {i: i - (i % 100 == 1) for i in range(2000)}
    assert tied._jdf.queryExecution().optimizedPlan().toString().startswith("Union")


def test_maps_are_dealt_over_tasks(spark):
    """Rows of maps are so small that Spark would coalesce them into one task; what is made of them is not."""
    from pyspark.sql import functions as F

    from worldframe.operators import mesh

    keys = spark.range(0, 400, 1, 4).selectExpr("id DIV 25 AS map_id").distinct()
    maps = keys.selectExpr("map_id", "concat('seed', map_id) AS seed", "400 AS width", "300 AS height", "16 AS cells")
    dealt = mesh.grid_points(maps).select("map_id", F.spark_partition_id().alias("task")).distinct().collect()
    assert len({r["map_id"] for r in dealt}) == len(dealt) == 16
    assert len({r["task"] for r in dealt}) == 4


def test_parts_of_depressions_read_their_own_edges(spark, monkeypatch):
    """Connected parts of the cells that may rise are found over the edges of these cells, not over all."""
    from worldframe.operators import hydrology

    seen = []

    def stop(cells, edges, kind):
        seen.append(({r["cell_id"] for r in cells.collect()}, {(r["src"], r["dst"]) for r in edges.collect()}))
        raise InterruptedError

    monkeypatch.setattr(hydrology.graph, "components", stop)
    heights = [10, 30, 40, 35, 50, *range(60, 80)]
    cells = spark.createDataFrame([(0, i, h) for i, h in enumerate(heights)], "map_id long, cell_id long, height long")
    edges = spark.createDataFrame([(a, 0 if a < b else 2, b) for i in range(len(heights) - 1) for a, b in ((i, i + 1), (i + 1, i))], "src long, slot long, dst long")
    with pytest.raises(InterruptedError):
        hydrology.fill_depressions(cells, edges)
    assert seen == [({3}, {(3, 2), (3, 4)})]
