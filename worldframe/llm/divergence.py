"""Divergence of sources by an inverted index of corrections to a baseline.

A term no group holds differs by the same f in every pair of groups, so a pair starts at V times the f of zero counts. The postings of
a term then emit what it changes: a group's count of a term against the other group's zero count depends on the count alone, so such
one-sided corrections are made once for each distinct count of a group and not for each term; a term that both
groups hold emits what the two one-sided corrections miss, if that is not zero. All arithmetic is in integers.

A text's terms are runs of A-Z, a-z and characters beyond ASCII, only A-Z folded. Null text, lang and source are empty
strings; empty texts count as documents and their group occurs. Texts of any length are counted whole, one block after another. Repeated rows count as often as they occur.
Ties are ranked by the item's UTF-8 bytes. A lang that keeps no term has pairs of value 0 and no term rows; a lang of one source has no pairs. An empty table gives an
empty result. No other columns are read, whatever their names.

Tasks count their own rows first, in tables of at most HELD entries, so a common term or a large source moves one row a table. Groups
meet in blocks, so that one lang's pairs are dealt over many tasks.
"""

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worldframe.llm.common import materialise, parts, release, trim

MIN_DOCS, TOP, SCALE, PRIOR = 30, 50, 1_000_000_000, 5
#: Entries a task holds before it hands them on, and bytes of a text that are split at once.
HELD, BLOCK = 400_000, 1 << 20
#: Blocks that the groups of a lang fall into.
BLOCKS = 8
#: Counts up to here are scaled without leaving 64 bits.
_SMALL = 9_000_000_000
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def blocks(text: bytes, size: int = BLOCK) -> Iterator[list[bytes]]:
    """The terms of a folded text, some size bytes of it at a time."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + size) if at + size < len(text) else -1
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: partial counts of terms and of documents that hold them; the empty term marks a group that occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out() -> pa.RecordBatch:
            rows = [(g, t, n, docs[t]) for g, (counts, docs) in held.items() for t, n in counts.items()]
            groups, terms, n, docs = zip(*rows, strict=True)
            lang, source = zip(*groups, strict=True)
            held.clear()
            arrays = [pa.array(lang), pa.array(source), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lo, n in parts(batch.column(2)):
                part = batch.slice(lo, n)
                for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    if (lang, source) not in held:
                        held[lang, source] = (Counter({b"": 0}), Counter())
                    counts, docs = held[lang, source]
                    seen: set[bytes] = set()
                    for terms in blocks(text.translate(_FOLD)):
                        counts.update(terms)
                        seen.update(terms)
                    docs.update(seen)
                if sum(len(c) for c, _ in held.values()) > HELD:
                    yield out()
        if held:
            yield out()
        trim()

    return docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")]).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def scaled(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms)), exactly; null where no term is kept."""
    over = f"nullif({total} + {PRIOR} * {terms}, 0)"
    low = f"({n} + {PRIOR}) * {SCALE} div {over}"
    wide = f"CAST({n} + {PRIOR} AS DECIMAL(20, 0)) * CAST({SCALE} AS DECIMAL(10, 0)) div CAST({over} AS DECIMAL(20, 0))"
    return F.expr(f"1 + CASE WHEN {n} < {_SMALL} THEN {low} ELSE {wide} END")


def _apart(a: str, b: str) -> Column:
    return F.abs(F.col(a) - F.col(b))


def _cells(side: DataFrame, own: str, other: str) -> DataFrame:
    """side with its own block and, in turn, each block it meets: two sides meet once, in one of BLOCKS squared cells of a lang."""
    dealt = F.pmod(F.xxhash64("source"), F.lit(BLOCKS)).cast("int")
    return side.withColumn(own, dealt).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(groups, postings): lang, source, total, terms, lang_total of every group that occurs, and lang, source, term, n, lang_n of every kept term it holds."""
    counted = materialise(term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    # At most one row a source stands in such a window.
    term = Window.partitionBy("lang", "term")
    seen = counted.where("term <> ''").select("*", F.sum("docs").over(term).alias("lang_docs"), F.sum("n").over(term).alias("lang_n"), F.min("source").over(term).alias("least"))
    postings = materialise(seen.where(F.col("lang_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n", (F.col("source") == F.col("least")).cast("long").alias("lead")))
    own = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("lead").alias("lead"))
    every = counted.where("term = ''").select("lang", "source").join(own, ["lang", "source"], "left").fillna(0, ["total", "lead"])
    every = materialise(every)
    release(counted)
    whole = every.groupBy("lang").agg(F.sum("lead").alias("terms"), F.sum("total").alias("lang_total"))
    return materialise(every.join(whole, "lang").select("lang", "source", "total", "terms", "lang_total")), postings.drop("lead")


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: every other source of the lang by its distance, and the terms a source holds beyond its lang's share."""
    groups, postings = kept_terms(docs, min_docs)
    groups = groups.withColumn("zero", scaled("0L", "total", "terms"))
    held = postings.join(groups, ["lang", "source"]).withColumn("p", scaled("n", "total", "terms")).withColumn("q", scaled("lang_n", "lang_total", "terms"))
    held = materialise(held.select("lang", "source", "term", "n", "p", "q", "zero"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = held.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    ranked = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    apart = pairs(groups, held)
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    sided = apart.select("lang", both.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    return sided.withColumn("rank", F.row_number().over(order)).unionByName(ranked)


def pairs(groups: DataFrame, held: DataFrame) -> DataFrame:
    """lang, a, b (a < b), value: the baseline of each pair of sources and the corrections of its terms."""
    left = _cells(groups.select("lang", F.col("source"), "terms", F.col("zero").alias("zero_a")), "x", "y").withColumnRenamed("source", "a")
    right = _cells(groups.select("lang", F.col("source"), F.col("zero").alias("zero_b")), "y", "x").withColumnRenamed("source", "b")
    baseline = left.join(right, ["lang", "x", "y"]).where("a < b").select("lang", "a", "b", F.coalesce(F.col("terms") * _apart("zero_a", "zero_b"), F.lit(0)).alias("value"))
    # A count of the one group against zero in the other.
    spread = held.groupBy("lang", "source", "n", "p", "zero").agg(F.count("*").alias("times"))
    mine = _cells(spread.withColumnRenamed("zero", "zero_a"), "x", "y").withColumnRenamed("source", "s")
    sided = mine.join(right.withColumnRenamed("b", "t"), ["lang", "x", "y"]).where("s <> t")
    sided = sided.select("lang", F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"), (F.col("times") * (_apart("p", "zero_b") - _apart("zero_a", "zero_b"))).alias("value")).where("value <> 0")
    # Both groups hold the term.
    one = held.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("p_a"), F.col("zero").alias("zero_a"))
    two = held.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("p_b"), F.col("zero").alias("zero_b"))
    missed = _apart("p_a", "p_b") - _apart("p_a", "zero_b") - _apart("zero_a", "p_b") + _apart("zero_a", "zero_b")
    joint = one.join(two, ["lang", "term"]).where("a < b").select("lang", "a", "b", missed.alias("value")).where("value <> 0")
    each = [x.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")) for x in (sided, joint)]
    return baseline.unionByName(each[0]).unionByName(each[1]).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
