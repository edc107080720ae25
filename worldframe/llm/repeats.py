"""Suffix-array dedup: sparse suffixes at minimisers, sorted, compared with neighbours, extended both ways.

A text is a sequence of words between ASCII white space, compared by 32-bit hashes (the first words of a match
by a 64-bit hash of their own). Of every WINDOW consecutive runs of GRAM words the one of least hash is selected,
so two texts that share LEAST = GRAM + WINDOW - 1 words share a selected position there. Suffixes whose first
run occurs once are dropped by counting; the rest carry the words before and after their position and are sorted
by what follows, then by what precedes (reversed). Two suffixes match if the common words after and before their positions
are LEAST together or more; the words a suffix has in common with any match are a span. Spans of consecutive positions are
merged, so a passage is reported as far as other documents, one or several, hold LEAST words of it at every place.

A position answers for the runs of LEAST words in which it is the (first) least; each run has one, and in every text the same,
so a suffix carries only the words around its position that such runs can hold.

No match is lost. Suffixes of a run that occurs FEW times or less meet all the others of their run. Those of a commoner run
are compared with their nearest neighbours in sort order over all tasks; where that leaves open whether a farther one
reaches more to the left, the runs of LEAST words around the positions are counted by hash: one that two documents hold is a span.

Ties of equal suffixes are dealt by document and position, so that a passage which a third of all documents hold
spreads over tasks; only the outermost rows of each task are compared in one place. Null and empty texts and those of
fewer words have no span; texts of any length are read whole. A document is a row: repeated rows (same id and text) are one,
and a text does not repeat itself; rows of one id and different texts, and rows without an id, are documents of their own. An empty
table gives an empty result. Extra columns are not read, whatever their names.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worldframe.llm.common import materialise, release, trim

GRAM, WINDOW = 8, 43
LEAST = GRAM + WINDOW - 1
#: Words that a suffix carries after its position, and at most before it.
AFTER, BEFORE = LEAST, WINDOW - 1
#: Suffixes of a run that occurs so often or less all meet.
FEW = 32
CACHE = 150_000


class Words:
    """32-bit hashes of the words of texts, remembered between texts."""

    def __init__(self) -> None:
        self.seen: dict[bytes, int] = {}

    def ids(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        seen, digest = self.seen, xxhash.xxh32_intdigest
        if len(seen) > CACHE:
            seen.clear()
        for w in words:
            if w not in seen:
                seen[w] = digest(w)
        return np.fromiter(map(seen.__getitem__, words), dtype=np.uint32, count=len(words))


def grams(ids: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of GRAM words."""
    n = len(ids) - GRAM + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n] + np.uint64(1)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best over every width consecutive values, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = best(out[: len(out) - step], out[step:])
        have += step
    return out


def minimisers(h: np.ndarray) -> np.ndarray:
    """Positions whose hash is the least of some WINDOW consecutive ones (all of them, where some tie)."""
    if len(h) < WINDOW:
        return np.zeros(0, dtype=np.int64)
    least = _sliding(h, WINDOW, np.minimum)
    edge = np.zeros(WINDOW - 1, dtype=h.dtype)
    highest = _sliding(np.concatenate([edge, least, edge]), WINDOW, np.maximum)
    return np.flatnonzero(h == highest)


def room(h: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For selected positions: how many words before, and from the position on, the runs of LEAST words can hold in which it is the first least."""
    if not len(p):
        return np.zeros(0, dtype=np.int8), np.zeros(0, dtype=np.int8)
    edge = np.zeros(WINDOW - 1, dtype=h.dtype)
    seen = np.lib.stride_tricks.sliding_window_view(np.concatenate([edge, h, edge]), WINDOW - 1)
    mine = h[p][:, None]
    back = (seen[p] <= mine)[:, ::-1]  # a nearer one of the same hash or less ends the room
    on = seen[p + WINDOW] < mine
    first = lambda x: np.where(x.any(axis=1), x.argmax(axis=1), WINDOW - 1)
    return first(back).astype(np.int8), (first(on) + GRAM).astype(np.int8)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, row (a hash of id and text: the document) and text."""
    return docs.select(F.col(id_col).alias("doc"), F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).alias("text"))


def positions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, gram, at, back, on: the selected positions of every text, and their room."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                of, gram, at, back, on = [], [], [], [], []
                for i, text in enumerate(part.column(1)):
                    h = grams(words.ids(text.as_py()))
                    p = minimisers(h)
                    of.append(np.full(len(p), i))
                    gram.append(h[p])
                    at.append(p)
                    b, o = room(h, p)
                    back.append(b)
                    on.append(o)
                whole = lambda x, kind: pa.array(np.concatenate(x).astype(kind))
                arrays = [part.column(0).take(pa.array(np.concatenate(of))), pa.array(np.concatenate(gram).view(np.int64)), whole(at, np.int32), whole(back, np.int8), whole(on, np.int8)]
                yield pa.RecordBatch.from_arrays(arrays, names=["row", "gram", "at", "back", "on"])
        del words
        trim()

    return _rows(docs, id_col, text_col).select("row", "text").mapInArrow(run, "row long, gram long, at int, back byte, on byte")


def suffixes(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, row, gram, common, at, after, before: the words (four bytes each) after the kept positions and, reversed, before them. kept: row, gram, at, back, on, common."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                of, gram, common, at, after, before = [], [], [], [], [], []
                for i, (text, places) in enumerate(zip(part.column(2), part.column(3), strict=True)):
                    wide = words.ids(text.as_py()).astype(">u4")
                    for place in places.as_py():
                        p = place["at"]
                        of.append(i)
                        gram.append(place["gram"])
                        common.append(place["common"])
                        at.append(p)
                        after.append(wide[p : p + place["on"]].tobytes())
                        before.append(wide[p - place["back"] : p][::-1].tobytes())
                index = pa.array(of, pa.int64())
                arrays = [part.column(0).take(index), part.column(1).take(index), pa.array(gram, pa.int64()), pa.array(common, pa.bool_()), pa.array(at, pa.int32()), pa.array(after, pa.binary()), pa.array(before, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc", "row", "gram", "common", "at", "after", "before"])
        del words
        trim()

    by_row = kept.groupBy("row").agg(F.collect_set(F.struct("at", "back", "on", "gram", "common")).alias("places"))
    texts = _rows(docs, id_col, text_col).join(by_row, "row").select("doc", "row", "text", "places")
    return texts.mapInArrow(run, f"doc {kind}, row long, gram long, common boolean, at int, after binary, before binary")


def _table(rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(r) // 4 for r in rows], dtype=np.int64)
    return np.frombuffer(b"".join(r.ljust(4 * width, b"\0") for r in rows), dtype=">u4").reshape(len(rows), width), size


def _common(table: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows a and rows b."""
    differ = table[a] != table[b]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), table.shape[1])
    return np.minimum(first, np.minimum(size[a], size[b]))


class Block:
    """Suffixes in sort order, as tables."""

    def __init__(self, batch: pa.RecordBatch):
        number = lambda name: batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)
        self.doc, self.row, self.gram, self.at = batch.column("doc"), number("row"), number("gram"), number("at")
        self.right, self.right_size = _table(batch.column("after").to_pylist(), AFTER)
        self.left, self.left_size = _table(batch.column("before").to_pylist(), BEFORE)

    def reach(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Common words of rows a and rows b before and after their positions."""
        back, on = np.zeros(len(a), dtype=np.int64), np.zeros(len(a), dtype=np.int64)
        for lo in range(0, len(a), 20_000):
            part = slice(lo, lo + 20_000)
            back[part] = _common(self.left, self.left_size, a[part], b[part])
            on[part] = _common(self.right, self.right_size, a[part], b[part])
        return back, on

    def spans(self, a: np.ndarray, b: np.ndarray, back: np.ndarray, on: np.ndarray) -> pa.RecordBatch:
        """doc, row, start, end, other: for each of a the words it shares with any b; all of these hold its position."""
        good = (back + on >= LEAST) & (on >= GRAM)
        a, b, back, on = a[good], b[good], back[good], on[good]
        order = np.lexsort((-back - on, a))
        a, b, back, on = a[order], b[order], back[order], on[order]
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, dtype=np.int64)
        most = lambda x: np.maximum.reduceat(x, first) if len(first) else x
        i, other = a[first], b[first]
        arrays = [self.doc.take(pa.array(i)), pa.array(self.row[i]), pa.array(self.at[i] - most(back)), pa.array(self.at[i] + most(on)), self.doc.take(pa.array(other))]
        return pa.RecordBatch.from_arrays(arrays, names=["doc", "row", "start", "end", "other"])


def few_matches(rows: DataFrame, kind: str) -> DataFrame:
    """doc, row, start, end, other of suffixes whose run is not common: sorted within their run, each meets all of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None
        for batch in _then_none(batches):
            parts = [b for b in (rest, batch) if b is not None and b.num_rows]
            if not parts:
                continue
            whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            gram = whole.column("gram").to_numpy()
            # The last run may go on in the next batch.
            upto = len(gram) if batch is None else int(np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))[-1])
            rest = whole.slice(upto)
            edges = np.append(np.flatnonzero(np.concatenate([[True], gram[1:upto] != gram[: max(0, upto - 1)]])) if upto else np.zeros(0, dtype=np.int64), upto)
            at = 0
            while at < len(edges) - 1:
                to = max(at + 1, int(np.searchsorted(edges, edges[at] + 20_000, "right")) - 1)
                block = Block(whole.slice(int(edges[at]), int(edges[to] - edges[at])))
                a, b = [], []
                for step in range(1, FEW):
                    i = np.flatnonzero((block.gram[step:] == block.gram[:-step]) & (block.row[step:] != block.row[:-step]))
                    a.append(i)
                    b.append(i + step)
                a, b = np.concatenate(a), np.concatenate(b)
                back, on = block.reach(a, b)
                yield block.spans(np.concatenate([a, b]), np.concatenate([b, a]), np.tile(back, 2), np.tile(on, 2))
                at = to

    order = ["gram", "after", "before", "row", "at"]
    return rows.repartition("gram").sortWithinPartitions(*order).mapInArrow(run, f"doc {kind}, row long, start long, end long, other {kind}")


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def common_matches(ordered: DataFrame, kind: str) -> DataFrame:
    """Of suffixes in sort order against their nearest neighbours of other documents: spans (start not null); edge rows of the
    task (task not null); and grams where a farther neighbour may reach more (reach: at most so many words on)."""
    names = ["doc", "row", "start", "end", "other", "task", "gram", "at", "after", "before", "reach"]
    kinds = [None, pa.int64(), pa.int64(), pa.int64(), None, pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        last: pa.RecordBatch | None = None
        first = True

        def out(n: int, id_type: pa.DataType, **columns: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns.get(k, pa.nulls(n, t or id_type)) for k, t in zip(names, kinds, strict=True)], names=names)

        def edge(block: pa.RecordBatch) -> pa.RecordBatch:
            """Compared again, in one place, with those of the tasks beside this one."""
            here = {k: block.column(k) for k in ("doc", "row", "gram", "at", "after", "before")}
            return out(block.num_rows, block.column("doc").type, task=pa.array([task] * block.num_rows, pa.int32()), **here)

        def ends(block: pa.RecordBatch, at_end: bool) -> pa.RecordBatch:
            """The outermost row and the nearest row of another document."""
            row = block.column("row").to_numpy()
            order = np.arange(len(row))[::-1] if at_end else np.arange(len(row))
            other = order[row[order] != row[order[0]]][:1]
            return block.take(pa.array(np.sort(np.concatenate([order[:1], other]))))

        for batch in batches:
            for lo in range(0, batch.num_rows, 20_000):
                part = batch.slice(lo, 20_000)
                whole = pa.Table.from_batches([b for b in (last, part) if b is not None]).combine_chunks().to_batches()[0]
                if first:
                    yield edge(ends(part, False))
                block, n = Block(whole), whole.num_rows
                begin = np.flatnonzero(np.concatenate([[True], block.row[1:] != block.row[:-1]]))
                run_of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, n)))
                before, after = begin[run_of] - 1, np.append(begin, n)[run_of + 1]
                a = np.concatenate([np.flatnonzero(before >= 0), np.flatnonzero(after < n)])
                b = np.concatenate([before[before >= 0], after[after < n]])
                back, on = block.reach(a, b)
                found = block.spans(a, b, back, on)
                yield out(found.num_rows, found.column(0).type, **{k: found.column(k) for k in ("doc", "row", "start", "end", "other")})
                # Open: rows to which a neighbour with less in common on the right may have more in common on the left.
                farthest, left = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
                np.maximum.at(farthest, a, on)
                nearest = on == farthest[a]
                np.maximum.at(left, a[nearest], back[nearest])
                reach_of = np.minimum(farthest, LEAST - 1 - left)  # runs that reach more words on are matched or have no match
                # The outermost document's rows may have a nearer neighbour elsewhere.
                reach_of[(run_of == 0) | (run_of == run_of[-1])] = AFTER
                i = np.flatnonzero((left < block.left_size) & (reach_of >= LEAST - block.left_size) | (reach_of == AFTER))
                grams_open, at = np.unique(block.gram[i], return_inverse=True)
                reach = np.zeros(len(grams_open), dtype=np.int64)
                np.maximum.at(reach, at, reach_of[i])
                yield out(len(reach), found.column(0).type, gram=pa.array(grams_open), reach=pa.array(reach))
                last, first = ends(whole, True), False
        if last is not None:
            yield edge(last)

    columns = "doc {0}, row long, start long, end long, other {0}, task int, gram long, at int, after binary, before binary, reach long".format(kind)
    return ordered.select("doc", "row", "gram", "at", "after", "before").mapInArrow(run, columns)


def counted_matches(rows: DataFrame, reach: DataFrame, kind: str) -> DataFrame:
    """doc, row, start, end, other: runs of LEAST words around the positions of the grams in reach that two documents hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                of, on, key = [], [], []
                for i, (after, before, most) in enumerate(zip(*(part.column(k).to_pylist() for k in ("after", "before", "reach")), strict=True)):
                    for t in range(max(GRAM, LEAST - len(before) // 4), min(most, len(after) // 4) + 1):
                        of.append(i)
                        on.append(t)
                        key.append(xxhash.xxh64_intdigest(before[: 4 * (LEAST - t)] + after[: 4 * t], t) >> 1)
                index = pa.array(of, pa.int64())
                arrays = [part.column("doc").take(index), part.column("row").take(index), part.column("at").take(index), pa.array(on, pa.int64()), pa.array(key, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc", "row", "at", "reach", "key"])

    wanted = rows.join(reach, "gram").select("doc", "row", "at", "after", "before", "reach")
    held = materialise(wanted.mapInArrow(run, f"doc {kind}, row long, at int, reach long, key long"))
    of_key = held.groupBy("key").agg(F.min(F.struct("row", "doc")).alias("lo"), F.max(F.struct("row", "doc")).alias("hi")).where("lo.row <> hi.row")
    other = F.when(F.col("row") == F.col("lo.row"), F.col("hi.doc")).otherwise(F.col("lo.doc"))
    start = F.col("at") + F.col("reach") - LEAST
    return held.join(materialise(of_key), "key").select("doc", "row", start.alias("start"), (start + LEAST).alias("end"), other.alias("other"))


def _merged(found: DataFrame) -> DataFrame:
    """Overlapping or adjoining spans of a document as one."""
    by_row = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(by_row.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(by_row)
    numbered = found.groupBy("row", "start", "end").agg(F.first("doc").alias("doc"), F.min("other").alias("other")).withColumn("reach", reach).withColumn("island", island)
    spans = numbered.groupBy("row", "island").agg(F.first("doc").alias("doc"), F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.min("other").alias("other_doc"))
    return spans.select("doc", "start_word", "end_word", "other_doc")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, start_word, end_word, n_words, other_doc: the passages of a text that another document holds too. other_doc: the least id of those compared."""
    kind = docs.schema[id_col].dataType.simpleString()
    found = materialise(positions(docs, id_col, text_col))
    # Written, so that both sides of the join are shuffled anew and a very common run can be dealt over tasks.
    shared = materialise(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram", (F.col("n") > FEW).alias("common")))
    rows = materialise(suffixes(docs, found.join(shared, "gram").select("row", "gram", "at", "back", "on", "common"), id_col, text_col))
    release(found)
    release(shared)
    few = few_matches(rows.where("NOT common").drop("common"), kind)
    common = rows.where("common").drop("common")
    order = ["after", "before", "row", "at"]
    near = materialise(common_matches(common.repartitionByRange(*order).sortWithinPartitions(*order), kind))
    # Two or four rows of each task meet here: neighbours that the border between two tasks parts.
    edges = near.where("task IS NOT NULL").select("doc", "row", "gram", "at", "after", "before").coalesce(1).sortWithinPartitions(*order)
    both = near.unionByName(materialise(common_matches(edges, kind)))
    reach = materialise(both.where("reach IS NOT NULL").groupBy("gram").agg(F.max("reach").alias("reach")))
    spans = few.unionByName(both.where("start IS NOT NULL").select("doc", "row", "start", "end", "other")).unionByName(counted_matches(common, reach, kind))
    return _merged(spans).select(F.col("doc").alias(id_col), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "other_doc")
