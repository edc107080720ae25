"""Near duplicates by shingles: SimHash of five-word shingle sets, blocks, Hamming check, exact verification, components.

Two texts are near duplicates if their sets of WIDTH-word shingles have a Jaccard similarity of SIMILARITY or more. Every
shingle casts a vote on every bit of a wide fingerprint, a signed byte of its hash; a bit is 1 if the votes sum to more than
zero. Texts meet that agree in a block of the fingerprint, where each may take its UNSURE bits of the closest votes either way.
Those within radius() bits of the first CHECK are verified on the whole sets. A pair of exactly SIMILARITY is lost with a
probability of LOSS, more similar ones with less; a pair's sizes do not matter, as votes of bytes tie no more often in small sets.

Blocks have about as many bits as it takes to number the rows, so a block's value is shared by few texts by chance.

Words are split at ASCII white space and A-Z lower-cased. A text of fewer words is one shingle; null and empty texts
have none and are all alike. Texts of the same set count once. Empty tables give empty results. Other columns of the
input are not read.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worldframe.llm.common import materialise, release, trim
from worldframe.llm.simhash import components

WIDTH, SIMILARITY = 5, 0.8
LOSS, UNSURE, CHECK = 0.00007, 2, 128
#: Blocks that more texts share are linked through pivots instead of pairs.
PAIRS_UP_TO = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the word shingles of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = max(min(1, len(h)), len(h) - width + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(min(width, len(h))):
        out = _mix(out * _ODD + h[k : k + n] + np.uint64(1))
    return np.unique(out)


def block_bits(rows: int) -> int:
    return max(18, rows.bit_length() - 2)


def _cosine(similarity: float) -> float:
    """The least cosine of two sets of this Jaccard similarity: that of sets of one size."""
    return 2 * similarity / (1 + similarity)


def blocks(bits: int, similarity: float = SIMILARITY) -> int:
    """How many blocks of so many bits lose at most 6 / 7 of LOSS, by 40,000 simulated blocks."""
    rng, cosine = np.random.default_rng(5), _cosine(similarity)
    sure = lambda v: np.abs(v) > np.partition(np.abs(v), UNSURE - 1, axis=1)[:, UNSURE - 1 : UNSURE]
    met = 0.0
    for _ in range(80):  # a few at a time: the driver's memory is small
        x, y = rng.standard_normal((2, 500, bits))
        y = cosine * x + math.sqrt(1 - cosine**2) * y
        met += float(np.mean(~np.any(((x > 0) != (y > 0)) & sure(x) & sure(y), axis=1))) / 80
    return math.ceil(math.log(LOSS * 6 / 7) / math.log1p(-min(met, 0.999)))


def radius(similarity: float = SIMILARITY) -> int:
    """The Hamming distance over CHECK bits that a seventh of LOSS exceeds at most."""
    p = math.acos(_cosine(similarity)) / math.pi + 0.01  # bytes in sets of five are that far from normal
    over, d = 1.0, -1
    while over > LOSS / 7:
        d += 1
        over -= math.comb(CHECK, d) * p**d * (1 - p) ** (CHECK - d)
    return d


def vote_tables(width: int) -> tuple[np.ndarray, np.ndarray]:
    """A shingle's votes are a row of the one table by 12 bits of its hash, exclusive or a row of the other by 12 more."""
    one, two = np.random.default_rng(17).integers(0, 256, (2, 4096, width), dtype=np.uint8)
    return one, two


def votes(found: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The sum of all shingles' votes on each bit, in odd numbers from -255 to 255."""
    total = np.zeros(one.shape[1], dtype=np.int64)
    for at in range(0, len(found), 256):
        h = found[at : at + 256].astype(np.int64)
        cast = np.take(one, h & 4095, axis=0) ^ np.take(two, h >> 12 & 4095, axis=0)
        total += np.add.reduce(cast.view(np.int8), axis=0, dtype=np.int16)
    return 2 * total + len(found)


def _sketches(docs: DataFrame, id_col: str, text_col: str, width: int, bits: int, many: int) -> DataFrame:
    """Of every row id_col, row, fp (a hash of the whole set), n (its size), the first CHECK bits of its fingerprint (s, t) and
    blocks: of each its value (4 bytes) and, after these, of each the places of its UNSURE bits (a byte each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = vote_tables(max(CHECK, many * bits))
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                sets = [shingles(x.as_py(), width) for x in part.column(2)]
                fp = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
                sums = np.stack([votes(s, *tables) for s in sets])
                check = np.packbits(sums[:, :CHECK] > 0, axis=1, bitorder="little").view("<i8")
                by_block = sums[:, : many * bits].reshape(-1, many, bits)
                value = ((by_block > 0) << np.arange(bits)).sum(axis=2).astype("<i4").view(np.uint8)
                unsure = np.argpartition(np.abs(by_block), UNSURE - 1, axis=2)[:, :, :UNSURE].astype(np.uint8)
                packed = [x.tobytes() for x in np.concatenate([value, unsure.reshape(len(sets), -1)], axis=1)]
                arrays = [part.column(0), part.column(1), pa.array(fp), pa.array([len(s) for s in sets], pa.int32()), pa.array(check[:, 0]), pa.array(check[:, 1]), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "row", "fp", "n", "s", "t", "blocks"])
        trim()

    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(id_col, F.xxhash64(id_col, text_col).alias("row"), text_col)
    return keyed.mapInArrow(run, f"`{id_col}` {kind}, row long, fp long, n int, s long, t long, blocks binary")


def _keys(nodes: DataFrame, bits: int, many: int) -> DataFrame:
    """fp, s, t and key: each block's number and value, its UNSURE bits both ways, and n in the lowest 31 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                raw = np.frombuffer(b"".join(part.column(4).to_pylist()), dtype=np.uint8).reshape(part.num_rows, many * (4 + UNSURE))
                value = raw[:, : 4 * many].copy().view("<i4").astype(np.int64) | np.arange(many) << bits
                flips = np.int64(1) << raw[:, 4 * many :].reshape(-1, many, UNSURE).astype(np.int64)
                each = value[:, :, None]
                for k in range(UNSURE):
                    each = np.concatenate([each, each ^ flips[:, :, k : k + 1]], axis=2)
                key = (each.reshape(part.num_rows, -1) << 31 | part.column(1).to_numpy()[:, None]).ravel()
                again = pa.array(np.repeat(np.arange(part.num_rows), many << UNSURE))
                yield pa.RecordBatch.from_arrays([pa.array(key), *(part.column(k).take(again) for k in (0, 2, 3))], names=["key", "fp", "s", "t"])

    return nodes.select("fp", "n", "s", "t", "blocks").mapInArrow(run, "key long, fp long, s long, t long")


def _met(keyed: DataFrame, similarity: float, pairs_up_to: int) -> DataFrame:
    """The texts that share a key: those within the radius as pairs (fp, other) if it has pairs_up_to or fewer texts, otherwise each
    text (key, fp, n, s, t)."""
    most = radius(similarity)
    names = ["key", "fp", "n", "s", "t", "other"]

    def rows(key: np.ndarray, fp: np.ndarray, s: np.ndarray, t: np.ndarray, other: np.ndarray | None = None) -> pa.RecordBatch:
        last = pa.nulls(len(key), pa.int64()) if other is None else pa.array(other)
        return pa.RecordBatch.from_arrays([*map(pa.array, (key >> 31, fp, (key & (1 << 31) - 1).astype(np.int32), s, t)), last], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = None, None  # the rows of the last key so far; that key, if it is known to be large
        for batch in _and_end(batches):
            if batch is not None:
                cols = [batch.column(k).to_numpy() for k in range(4)]
                held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if held is None or not len(held[0]):
                continue
            key = held[0] >> 31
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[first, len(key)])
            many = (size > pairs_up_to) | (key[first] == (-1 if large is None else large))
            large = int(key[-1]) if many[-1] else None
            done = len(key) if batch is None or many[-1] else first[-1]
            every, of = np.repeat(many, size), np.repeat(first + size, size)
            if (out := every[:done]).any():
                yield rows(*(x[:done][out] for x in held))
            at, apart = np.flatnonzero(~every[:done]), 1
            while len(at := at[at + apart < of[at]]):
                a, b = at, at + apart
                n, m = (held[0][x] & (1 << 31) - 1 for x in (a, b))
                far = sum(np.bitwise_count((x[a] ^ x[b]).view(np.uint64)).astype(np.int64) for x in held[2:])
                near = (far <= most) & (n >= similarity * m - 1e-9) & (m >= similarity * n - 1e-9)
                if near.any():
                    a, b = a[near], b[near]
                    yield rows(*(x[a] for x in held), other=held[1][b])
                apart += 1
            held = [x[done:] for x in held]
        trim()

    dealt = keyed.repartition(F.shiftright("key", 31)).sortWithinPartitions("key")
    return dealt.mapInArrow(run, "key long, fp long, n int, s long, t long, other long")


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """fp and its shingles for the rows wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                sets = pa.array([shingles(x.as_py(), width).view(np.int64) for x in part.column(1)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), sets], names=["fp", "held"])
        trim()

    keyed = docs.select(F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    return keyed.join(wanted, "row").dropDuplicates(["row"]).select("fp", "text").mapInArrow(run, "fp long, held array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are as similar as asked for, written."""
    one = sets.select(F.col("fp").alias("a"), F.col("held").alias("x"))
    two = sets.select(F.col("fp").alias("b"), F.col("held").alias("y"))
    # Written, so that a pivot of many pairs can be dealt over tasks.
    proposed = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    both = F.size(F.array_intersect("x", "y"))
    found = proposed.join(one, "a").join(two, "b").where(both >= similarity * (F.size("x") + F.size("y") - both))
    out = materialise(found.select("a", "b"))
    release(proposed)
    return out


def links(shared: DataFrame, sets: DataFrame, similarity: float = SIMILARITY, pairs: DataFrame | None = None) -> DataFrame:
    """node, label: the components of all similar pairs among pairs (a, b) and among texts that share a key of shared.

    Of pairs, each text's first is verified, then those that are not linked by then. shared (key, fp, n and, if known, s and t)
    holds keys of many texts: each round takes texts of different components as pivots and compares every text with those of
    other components; then the pivot has met all that it could still link, and leaves the key. A key is done once its texts are
    in one component, so no pair is lost and a large group of copies takes a round or two. Pivots are chosen by text and not by
    component, eight times as many in each round, so the rounds grow with the logarithm of the group, however large the
    components are that do not link.
    """
    edges = shared.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    if pairs is not None:
        edges = _verified(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), sets, similarity)
        label = components(edges)
        of = lambda x: label.select(F.col("node").alias(x), F.col("label").alias(f"of_{x}"))
        rest = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b"))
        edges = edges.unionByName(_verified(rest.select("a", "b"), sets, similarity))
    check = [c for c in ("s", "t") if c in shared.columns]
    far = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"head.{c}"))) for c in check), F.lit(0))
    alike = (F.least("n", "head.n") >= similarity * F.greatest("n", "head.n")) & (far <= radius(similarity))
    columns = ["key", "fp", "n", *check]
    members = shared.select(columns)
    pivots = 1
    while True:
        label = components(edges)
        at = members.join(label.select(F.col("node").alias("fp"), "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
        at = materialise(at.select(*columns, "label"))
        apart = at.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
        still = materialise(at.join(apart, "key", "left_semi"))
        release(at)
        if not still.limit(1).count():
            return label
        slot = F.pmod(F.xxhash64("fp"), F.lit(pivots))
        heads = materialise(still.groupBy("key", slot.alias("slot")).agg(F.min(F.struct("label", *columns[1:])).alias("head")).select("key", "head"))
        meet = still.join(heads, "key").where((F.col("label") != F.col("head.label")) & alike)
        edges = edges.unionByName(_verified(meet.select(F.col("head.fp").alias("a"), F.col("fp").alias("b")), sets, similarity))
        members = still.join(heads.select("key", F.col("head.fp").alias("fp")), ["key", "fp"], "left_anti").select(columns)
        pivots = min(8 * pivots, 1 << 40)  # within 64 bits, however many rounds


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """id_col, component_id: the least id of all rows reachable over near duplicates.

    A component whose ids are all null has a null component_id.
    """
    bits = block_bits(docs.count())
    many = blocks(bits, similarity)
    seen = materialise(_sketches(docs, id_col, text_col, width, bits, many))
    columns = ["row", "n", "s", "t", "blocks"]
    nodes = materialise(seen.groupBy("fp").agg(F.min(id_col).alias("least"), F.min(F.struct(*columns)).alias("one")).select("fp", "least", *(f"one.{c}" for c in columns)))
    # A smaller set is similar to no other one.
    keyed = _keys(nodes.where(F.col("n") >= similarity * (F.col("n") + 1) - 1e-9), bits, many)
    met = materialise(_met(keyed, similarity, pairs_up_to))
    pairs = materialise(met.where("other IS NOT NULL").select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct())
    shared = met.where("other IS NULL")
    used = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).unionByName(shared.select("fp")).distinct()
    wanted = nodes.join(used, "fp", "left_semi").select("row", "fp")
    sets = materialise(_sets(docs, wanted, id_col, text_col, width))
    label = links(shared, sets, similarity, pairs)
    for gone in (sets, met, pairs):
        release(gone)
    rooted = nodes.select("fp", "least").join(label.select(F.col("node").alias("fp"), "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = rooted.groupBy("label").agg(F.min("least").alias("component_id"))
    of = materialise(rooted.join(least, "label").select("fp", "component_id"))
    return seen.select(id_col, "fp").join(of, "fp").select(id_col, "component_id")
