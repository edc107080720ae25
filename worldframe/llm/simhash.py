"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, Hamming verification, components.

Nulls and empty texts: no words, fingerprint zero, linked like any other. Texts of any length are read whole. Repeated rows and
ties share a fingerprint and so a class, rows without an id too. Empty tables give empty results. Extra columns are not read, and
kept by drop_near_duplicates(), whatever their names.
"""

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worldframe.llm.common import materialise, release, trim, unused

BITS = 64
#: Five blocks, at most two of which can hold the differing bits: any three that agree name a bucket.
BLOCKS = 5
DISTANCE = 2
#: Buckets above this many distinct fingerprints are linked through midpoints instead of pairs.
PAIRS_UP_TO = 64


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text; A-Z are lower-cased, words split at ASCII space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    if len(words) < width:
        hashes = [digest(join(words), seed)]
    else:
        hashes = [digest(join(x), seed) for x in zip(*(words[i:] for i in range(width)), strict=False)]
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(ones, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """id_col and fp (the 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py(), width) for x in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])
        trim()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def _blocks() -> list[tuple[int, int]]:
    """(mask of the agreeing blocks, mask of the other bits) for each choice of blocks, as signed longs."""
    edges = [round(i * BITS / BLOCKS) for i in range(BLOCKS + 1)]
    block = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    full = (1 << BITS) - 1
    return [(signed(m), signed(full ^ m)) for c in combinations(block, BLOCKS - DISTANCE) if (m := sum(c)) or True]


def links(nodes: DataFrame, pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct fp within two bits.

    Each fingerprint enters a bucket for each choice of three of five blocks; a pair within two bits shares
    one at least. Buckets of bounded size are joined with themselves and verified by Hamming distance. In a
    larger bucket each fingerprint emits itself and its one-bit changes outside the agreeing blocks: two
    fingerprints meet at such a midpoint exactly if they differ by at most two bits there, and at most 27 meet
    at one, so the work stays linear and no pair is lost.
    """
    choices = F.array(*[F.struct(F.lit(i).alias("c"), F.lit(m).alias("m"), F.lit(o).alias("o")) for i, (m, o) in enumerate(_blocks())])
    keyed = nodes.select("fp", F.explode(choices).alias("k")).select("fp", "k.c", "k.o", F.col("fp").bitwiseAND(F.col("k.m")).alias("k"))
    sizes = keyed.groupBy("c", "k").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(keyed.join(sizes, ["c", "k"]))
    few = shared.where(F.col("n") <= pairs_up_to)
    x, y = few.select("c", "k", F.col("fp").alias("a")), few.select("c", "k", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    pairs = x.join(y, ["c", "k"]).where((F.col("a") < F.col("b")) & near).select("a", "b")
    one_bit = F.filter(F.array(*[F.lit(1 << b if b < 63 else -(1 << 63)) for b in range(BITS)]), lambda b: b.bitwiseAND(F.col("o")) != 0)
    middles = F.transform(F.concat(F.array(F.lit(0)), one_bit), lambda b: b.bitwiseXOR(F.col("fp")))
    met = (
        shared.where(F.col("n") > pairs_up_to).select("c", "k", "fp", F.explode(middles).alias("mid"))
        .groupBy("c", "k", "mid").agg(F.collect_set("fp").alias("at")).where(F.size("at") > 1)
        .select(F.array_min("at").alias("a"), F.explode("at").alias("b")).where("a <> b")
    )
    return pairs.unionByName(met).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label: label is the least node of the component. Min-label hooking with pointer jumping.

    Every round is joins and minima over (node, label) rows, written to the shared folder; a hub's rows are
    reduced before the shuffle. The number of rounds grows with the logarithm of the longest chain.
    """
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        at_b = label.select(F.col("node").alias("b"), F.col("label").alias("low"))
        seen = both.join(at_b, "b").groupBy(F.col("a").alias("node")).agg(F.min("low").alias("low"))
        hook = label.join(seen, "node")
        told = hook.select("node", F.least("label", "low").alias("label")).unionByName(hook.select(F.col("label").alias("node"), F.least("label", "low").alias("label")))
        lower = materialise(told.groupBy("node").agg(F.min("label").alias("label")))
        up = lower.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = materialise(lower.join(up, "label").select("node", F.col("root").alias("label")))
        old = label.select("node", F.col("label").alias("old"))
        changed = jumped.join(old, "node").where("label <> old").limit(1).count()
        for gone in (label, lower):
            release(gone)
        label = jumped
        if not changed:
            return label


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """id_col, fp, component_id: the least id of all rows reachable over fingerprints within two bits.

    A component whose ids are all null has a null component_id.
    """
    fps = materialise(fingerprints(docs, id_col, text_col))
    nodes = materialise(fps.groupBy("fp").agg(F.min(id_col).alias("least")))
    edges = materialise(links(nodes, pairs_up_to))
    label = components(edges)
    rooted = nodes.join(label.select(F.col("node").alias("fp"), "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = rooted.groupBy("label").agg(F.min("least").alias("component_id"))
    of = materialise(rooted.join(least, "label").select("fp", "component_id"))
    return fps.join(of, "fp").select(id_col, "fp", "component_id")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: Callable[..., DataFrame] = classes) -> DataFrame:
    """One row of each class (of by) stays: that with the least id (of repeated rows with this id, one); rows without an id stay."""
    found = by(docs, id_col, text_col)
    kept = unused(docs, "keep")[0]
    keep = found.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias(kept)).distinct()
    first = docs.where(F.col(id_col).isNotNull()).join(keep, F.col(id_col) == F.col(kept), "left_semi").dropDuplicates([id_col])
    return first.unionByName(docs.where(F.col(id_col).isNull()))
