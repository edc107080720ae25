"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact verification.

Texts are sequences of lower-cased words (runs without ASCII white space or punctuation). A passage of a
document matches an item if at most TOLERANCE of the item's words must be edited. Each edit spoils three of
the item's runs of three words, so a window with so few edits holds all the others (the q-gram lemma), and the
windows that do are all that need hashing. A window and the item are embedded by the same random walks, which turns edit distance into Hamming distance; a few sampled positions of each walk
form a key, and the number of walks is chosen so that items with the most edits allowed still meet with the
target recall, from the places where windows are put: edits among an item's first words move these. If no number of walks
reaches it, all windows are verified. A window is verified by exact edit distance, widened by the edits allowed on both
sides, with a free start and a free end.

Items are taken in blocks of ITEM_BLOCK, each checked against all documents without a shuffle; one block is broadcast at a
time. Items and documents without words, null or empty, match nothing. Items without an id take part and match with a null
item_id. Texts of any length are read whole. Repeated documents each get their matches, repeated items count once; of an item's matches
in a document the one of fewest edits is told, of ties the first. Items of under MIN_WORDS words must occur word for word. Empty tables
give empty results. Extra columns are not read by find() and kept by drop_contaminated(), whatever their names.
"""

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worldframe.llm.common import materialise, trim

TOLERANCE = 0.2
RECALL = 0.999
SAMPLED = 2
#: Numbers of walks to choose from.
WALKS = (32, 64, 96, 128, 192, 256)
ITEM_BLOCK = 20_000
MIN_WORDS = 5
BATCH = 1000
#: Windows that rare runs open at once.
PAIRS = 1_000_000
_SPACES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACES).split()


def edit_distance(a: np.ndarray, b: np.ndarray) -> int:
    """Levenshtein distance of two id sequences, a row at a time."""
    row = np.arange(len(b) + 1)
    steps = np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        low = np.minimum(row[1:] + 1, row[:-1] + (b != x))
        # An insertion adds one per place: a running minimum of value minus place.
        row = np.minimum.accumulate(np.concatenate([[i], low]) - steps) + steps
    return int(row[-1])


def best_end(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Least distance of the item to a prefix of the window, and that prefix's length (the shortest)."""
    row = np.arange(len(window) + 1)
    steps = np.arange(len(window) + 1)
    for i, x in enumerate(item, 1):
        low = np.minimum(row[1:] + 1, row[:-1] + (window != x))
        row = np.minimum.accumulate(np.concatenate([[i], low]) - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


def best_span(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Least distance of the item to a run of the window, that run's start and length (the first to end, the shortest)."""
    row = np.zeros(len(window) + 1, dtype=np.int64)
    steps = np.arange(len(window) + 1)
    for i, x in enumerate(item, 1):
        low = np.minimum(row[1:] + 1, row[:-1] + (window != x))
        row = np.minimum.accumulate(np.concatenate([[i], low]) - steps) + steps
    end = int(row.argmin())
    size = best_end(item[::-1], window[:end][::-1])[1]
    return int(row[end]), end - size, size


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cgk(rows: np.ndarray, length: np.ndarray, walk: np.ndarray, steps: int) -> np.ndarray:
    """(n, steps) embedding of padded id rows, each by its walk: at each step a random bit of (id, step) decides whether the walk moves on."""
    n = len(rows)
    at = np.zeros(n, dtype=np.int64)
    out = np.empty((n, steps), dtype=np.int64)
    here = np.arange(n)
    for j in range(steps):
        inside = at < length
        x = np.where(inside, rows[here, np.minimum(at, rows.shape[1] - 1)], -1)
        out[:, j] = x
        move = _mix(x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (walk * 1_000_003 + j).astype(np.uint64)) & np.uint64(1)
        at += inside & (move == 1)
    return out


class Items:
    """A block of items: words, trigrams with their places, walks and keys."""

    def __init__(self, rows: list[tuple[int | None, str | None]], tolerance: float = TOLERANCE, recall: float = RECALL, seed: int = 11):
        found = [(i, t) for i, x in rows if (t := tokens(x))]
        self.ids = [i for i, _ in found]
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for _, t in found for w in t}))}
        self.base = len(self.vocabulary) + 1
        self.words = [np.array([self.vocabulary[w] for w in t], dtype=np.int64) for _, t in found]
        self.most = [int(tolerance * len(w)) if len(w) >= MIN_WORDS else 0 for w in self.words]
        self.sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        self.longest = max((len(w) for w in self.words), default=0)
        self.seed_length = 3
        grams: dict[int, list[tuple[int, int]]] = {}
        for k, w in enumerate(self.words):
            for p in range(max(1, len(w) - self.seed_length + 1)):
                grams.setdefault(self.gram(w[p : p + 3]), []).append((k, p))
        self.short = {len(w) for w in self.words if len(w) < 3}
        for k, w in enumerate(self.words):
            if self.most[k] == 1 and len(w) == MIN_WORDS:  # one edit can spoil all runs of three, but not the last three words and the first two
                grams.setdefault(self.gram(w[:2]), []).append((k, 0))
                self.short.add(2)
        self.gram_keys = np.array(sorted(grams), dtype=np.int64)
        self.edits = np.array(self.most, dtype=np.int64)
        self._seeds(grams)
        self.rng = np.random.default_rng(seed)
        self.share = np.random.default_rng(seed + 1).random((WALKS[-1], SAMPLED))
        self.walks = self._walks(recall)
        every = np.repeat(np.arange(len(self.words)), self.walks)
        own = [self.keys([self.words[i] for i in every[at : at + 50_000]], every[at : at + 50_000], np.arange(at, min(at + 50_000, len(every))) % self.walks) for at in range(0, len(every), 50_000)]
        self.own = np.concatenate(own).reshape(len(self.words), self.walks, SAMPLED) if own else np.zeros((0, self.walks, SAMPLED), dtype=np.int64)

    def _seeds(self, grams: dict[int, list[tuple[int, int]]]) -> None:
        """need: runs of three that the edits allowed leave, and how many different ones and different words; seeds: each item's rarest runs, so many that one is left; and sorted keys of the items' words and runs."""
        self.need = np.array([max(1, len(w) - 2 - 3 * m) for w, m in zip(self.words, self.most, strict=True)], dtype=np.int64)
        rows = [(k, p, g, len(grams[c])) for g, c in enumerate(self.gram_keys.tolist()) for k, p in grams[c]]
        k, p, g, n = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)) if rows else [np.zeros(0, dtype=np.int64)] * 4
        order = np.lexsort((p, g, n, k))
        rank = np.arange(len(order)) - np.searchsorted(k[order], k[order])
        # All runs of items whose edits can spoil any but one, and of those with runs of their own kind.
        total = np.bincount(k, minlength=len(self.words)) if len(k) else np.zeros(len(self.words), dtype=np.int64)
        chosen = order[rank < np.where(self.need > 1, total - self.need + 1, total)[k[order]]] if len(k) else order
        chosen = chosen[np.argsort(g[chosen], kind="stable")]
        self.seed_at = np.searchsorted(g[chosen], np.arange(len(self.gram_keys) + 1))
        self.seed_item, self.seed_off = k[chosen], p[chosen]
        at = np.lexsort((p, k * max(len(self.gram_keys), 1) + g))
        self.run_at, self.run_off = (k * len(self.gram_keys) + g)[at], p[at]
        self.run_keys = np.unique(self.run_at)
        runs = [len(set(zip(w[:-2].tolist(), w[1:-1].tolist(), w[2:].tolist(), strict=True))) if len(w) > 2 else 0 for w in self.words]
        self.need_runs = np.maximum(np.array(runs, dtype=np.int64) - 3 * self.edits, 0)
        self.need_words = np.array([len(set(w.tolist())) for w in self.words], dtype=np.int64) - self.edits
        self.word_keys = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *(i * self.base + w for i, w in enumerate(self.words))]))

    def gram(self, w: np.ndarray) -> int:
        w = list(map(int, w[:3])) + [0] * (3 - len(w[:3]))
        return (w[0] * self.base + w[1]) * self.base + w[2]

    def padded(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        length = np.array([len(r) for r in rows], dtype=np.int64)
        out = np.zeros((len(rows), max(1, int(length.max(initial=1)))), dtype=np.int64)
        for i, r in enumerate(rows):
            out[i, : len(r)] = r
        return out, length

    def keys(self, rows: list[np.ndarray], item: np.ndarray, walk: np.ndarray) -> np.ndarray:
        """Key of each row under its walk: the embedding at the places sampled for the walk, within twice the item's length."""
        wide, length = self.padded(rows)
        size = self.sizes[item]
        e = cgk(wide, length, walk, int(2 * size.max(initial=1)) + 1)
        return np.take_along_axis(e, (self.share[walk] * (2 * size[:, None])).astype(np.int64), axis=1)

    def _walks(self, recall: float) -> int:
        """Walks so that items under the most random edits allowed share a key with the item at the recall asked for; 0 if none do."""
        if not self.words:
            return 1
        some = self.rng.permutation(len(self.words))[:200]
        edited = [self._edit(self.words[i], self.most[i]) for i in some]
        edited = [self._window(e, i) for e, i in zip(edited, some, strict=True)]
        trial = 64
        walk = np.tile(np.arange(trial), len(some))
        item = np.repeat(some, trial)
        own = self.keys([self.words[i] for i in item], item, walk)
        met = (own == self.keys([e for e in edited for _ in range(trial)], item, walk)).all(axis=1).reshape(len(some), trial)
        rate = met.mean(axis=1)
        return next((n for n in WALKS if (1 - (1 - rate) ** n).mean() >= recall), 0)

    def _window(self, edited: np.ndarray, i: int) -> np.ndarray:
        """The window over an edited item that starts where most of its word runs put it."""
        w, most = self.words[i], self.most[i]
        at: dict[tuple, list[int]] = {}
        for o in range(len(w) - 2):
            at.setdefault(tuple(w[o : o + 3]), []).append(o)
        starts = Counter(p - o for p in range(len(edited) - 2) for o in at.get(tuple(edited[p : p + 3]), []) if abs(p - o) <= most)
        s = most + (starts.most_common(1)[0][0] if starts else 0)
        return np.concatenate([[0] * most, edited, [0] * (len(w) + most)]).astype(np.int64)[s : s + len(w)]

    def _edit(self, w: np.ndarray, n: int) -> np.ndarray:
        w = list(w)
        for _ in range(n):
            p = int(self.rng.integers(0, len(w)))
            kind = self.rng.integers(0, 3)
            if kind == 0:
                w[p] = 0
            elif kind == 1 and len(w) > 1:
                del w[p]
            else:
                w.insert(p, 0)
        return np.array(w, dtype=np.int64)

    def matches(self, text: str | None) -> list[tuple[int | None, int, int, int, int]]:
        """(item, first word, words, edits, words of the item) of the best match of each item in a whole text."""
        return self.batch([text])[0]

    def batch(self, texts: list[str | None]) -> list[list[tuple[int | None, int, int, int, int]]]:
        get = self.vocabulary.get
        docs = []
        for text in texts:
            w = tokens(text)
            docs.append(np.fromiter(map(get, w, [0] * len(w)), dtype=np.int64, count=len(w)))
        out: list[dict[int, tuple[int | None, int, int, int, int]]] = [{} for _ in texts]
        if not self.words:
            return [[] for _ in texts]
        flat = np.concatenate([x for d in docs for x in (d, np.zeros(2, dtype=np.int64))])
        bounds = np.concatenate([[0], np.cumsum([len(d) + 2 for d in docs])])
        item, start = self._windows(flat, bounds)
        doc = np.searchsorted(bounds, start, "right") - 1
        order = np.lexsort((start, item, doc))
        item, start, doc = item[order], start[order], doc[order]
        for at in range(0, len(item), 4096):
            some = slice(at, at + 4096)
            self._verify(list(zip(doc[some].tolist(), item[some].tolist(), (start[some] - bounds[doc[some]]).tolist(), strict=True)), docs, out)
        return [sorted(x.values()) for x in out]

    def _windows(self, flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, start in flat) of the windows that hold as many of the item's words and word runs as the edits allowed leave.

        Only an item's rarest runs, one more than the edits allowed can spoil, open windows; what a window holds is counted for those alone.
        """
        grams = self._grams(flat)
        found = [self._counted(k, s, grams[3], flat, bounds) for n, g in grams.items() for k, s in self._opened(g, bounds, n)]
        item, start = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, dtype=np.int64) for i in (0, 1))
        item, start = self._unique(item, start, len(flat))
        few = self.need[item] <= 1
        more = self._banded(item[~few], start[~few], grams[3], bounds, len(flat))
        return np.concatenate([item[few], more[0]]), np.concatenate([start[few], more[1]])

    def _grams(self, flat: np.ndarray) -> dict[int, np.ndarray]:
        """By number of words: which known run begins at each place of flat, -1 where none does."""
        after = np.concatenate([flat[1:], [0]]), np.concatenate([flat[2:], [0, 0]])
        out = {}
        for n in {3, *self.short}:
            known = (flat > 0) & ((after[0] > 0) | (n < 2)) & ((after[1] > 0) | (n < 3))
            code = (flat * self.base + (after[0] if n > 1 else 0)) * self.base + (after[1] if n > 2 else 0)
            g = np.minimum(np.searchsorted(self.gram_keys, code), max(len(self.gram_keys) - 1, 0))
            out[n] = np.where(known & (self.gram_keys[g] == code), g, -1)
        return out

    def _opened(self, gram: np.ndarray, bounds: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(item, start) of the windows that rare runs open, about PAIRS at a time, each once."""
        where = np.flatnonzero(gram >= 0)
        size = self.seed_at[gram[where] + 1] - self.seed_at[gram[where]]
        where, size = where[size > 0], size[size > 0]
        upto = np.cumsum(size)
        lo = 0
        while lo < len(where):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, "right")))
            count, place = size[lo:hi], where[lo:hi]
            at = np.repeat(self.seed_at[gram[place]] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            place = np.repeat(place, count)
            first = bounds[np.searchsorted(bounds, place, "right") - 1]
            yield self._unique(self.seed_item[at], np.maximum(place - self.seed_off[at], first), len(gram))
            lo = hi

    @staticmethod
    def _unique(item: np.ndarray, start: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        both = np.unique(item * n + start)
        return both // max(n, 1), both % max(n, 1)

    def _spread(self, item: np.ndarray, start: np.ndarray, bounds: np.ndarray, less: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) of all places of the windows, widened by the edits allowed on both sides within their documents."""
        doc = np.searchsorted(bounds, start, "right") - 1
        lo = np.maximum(start - self.edits[item], bounds[doc])
        size = np.maximum(np.minimum(start + self.sizes[item] - less + self.edits[item], bounds[doc + 1]) - lo, 0)
        row = np.repeat(np.arange(len(item)), size)
        return row, np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())

    def _counted(self, item: np.ndarray, start: np.ndarray, gram: np.ndarray, flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows with enough different words of the item, then with enough of its different runs of three: an edit spoils one word and three runs at most."""
        for values, keys, base, need, less in ((flat, self.word_keys, self.base, self.need_words, 0), (gram, self.run_keys, len(self.gram_keys), self.need_runs, 2)):
            keep = np.zeros(len(item), dtype=bool)
            for at in range(0, len(item), 20_000):
                k = item[at : at + 20_000]
                row, place = self._spread(k, start[at : at + 20_000], bounds, less)
                key = k[row] * base + values[place]
                known = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
                held = (keys[known] == key) & (values[place] >= 0) if len(keys) else np.zeros(len(key), dtype=bool)
                different = np.unique(row[held] * len(keys) + known[held]) // max(len(keys), 1)
                keep[at : at + 20_000] = np.bincount(different, minlength=len(k)) >= need[k]
            item, start = item[keep], start[keep]
        return item, start

    def _banded(self, item: np.ndarray, start: np.ndarray, gram: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """All starts that runs in these windows point to, where enough of them point within the edits allowed."""
        if not len(item):
            return item, start
        triples = []
        for at in range(0, len(item), 20_000):
            row, place = self._spread(item[at : at + 20_000], start[at : at + 20_000], bounds, 2)
            row, place = row[gram[place] >= 0], place[gram[place] >= 0]
            k = item[at : at + 20_000][row]
            key = k * len(self.gram_keys) + gram[place]
            lo, hi = np.searchsorted(self.run_at, key), np.searchsorted(self.run_at, key, "right")
            of = np.repeat(np.arange(len(key)), hi - lo)
            off = self.run_off[np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange((hi - lo).sum())]
            triples.append(np.unique((k[of] * n + place[of]) * (self.longest + 1) + off))
        both = np.unique(np.concatenate(triples))
        off, both = both % (self.longest + 1), both // (self.longest + 1)
        k, place = both // n, both % n
        doc = np.searchsorted(bounds, place, "right") - 1
        begin = np.maximum(place - off, bounds[doc])
        most = self.edits[k]
        # Starts of different items or documents are further apart than any number of edits.
        wide = n + (2 * int(self.edits.max()) + 2) * len(bounds)
        code = k * 2 * wide + begin + doc * (2 * int(self.edits.max()) + 2)
        order = np.argsort(code, kind="stable")
        code, k, begin, most = code[order], k[order], begin[order], most[order]
        held = np.searchsorted(code, code + most, "right") - np.searchsorted(code, code - most)
        return self._unique(k[held >= self.need[k]], begin[held >= self.need[k]], n)

    def _verify(self, windows: list, docs: list, out: list) -> None:
        item = np.array([k for _, k, _ in windows])
        rows = [docs[d][s : s + len(self.words[k])] for d, k, s in windows]
        met = np.full(len(windows), self.walks == 0)
        for lo, hi in ((0, 4), (4, self.walks)) if self.walks else ():
            rest = np.flatnonzero(~met)
            for at in range(0, len(rest), 512):
                some = rest[at : at + 512]
                walk, of = np.tile(np.arange(lo, hi), len(some)), np.repeat(some, hi - lo)
                mine = self.keys([rows[i] for i in of], item[of], walk)
                met[some] |= (mine == self.own[item[of], walk]).all(axis=1).reshape(len(some), hi - lo).any(axis=1)
        for i in np.flatnonzero(met):
            d, k, s = windows[i]
            n, most = len(self.words[k]), self.most[k]
            begin = max(0, s - most)
            edits, start, size = best_span(self.words[k], docs[d][begin : s + n + most])
            start += begin
            if edits <= most and (k not in out[d] or (edits, start) < (out[d][k][3], out[d][k][1])):
                out[d][k] = (self.ids[k], start, size, edits, n)


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, str | None]]]:
    """Different items in blocks of about ITEM_BLOCK, dealt by a hash; the driver holds one block at a time."""
    each = items.select("item_id", "text").distinct()
    n = -(-each.count() // ITEM_BLOCK)
    for k in range(n):
        rows = each.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        if rows:
            yield [(r[0], r[1]) for r in rows]


def _each_block(docs: DataFrame, items: DataFrame, tolerance: float, step: Callable[[DataFrame, Broadcast], DataFrame], chained: bool) -> Iterator[DataFrame]:
    """step(docs, block) for each block of items, chained: of the result for the block before. A block's broadcast is released before the next one is made: all but the last result are written."""
    blocks = _blocks(items)
    rows = next(blocks, None)
    while rows is not None:
        known = docs.sparkSession.sparkContext.broadcast(Items(rows, tolerance))
        out, rows = step(docs, known), next(blocks, None)
        if rows is not None:
            out = materialise(out)
            known.destroy()
        docs = out if chained else docs
        yield out


def find(docs: DataFrame, items: DataFrame, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, first_word, n_words, edits, item_words: the best match of each item in each document."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, item_id long, first_word long, n_words long, edits long, item_words long"

    def step(docs: DataFrame, block: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = block.value
            for batch in batches:
                for start in range(0, batch.num_rows, BATCH):
                    part = batch.slice(start, BATCH)
                    rows = [(i, *m) for i, found in enumerate(known.batch(part.column(1).to_pylist())) for m in found]
                    if rows:
                        of, *columns = zip(*rows, strict=True)
                        arrays = [part.column(0).take(pa.array(of)), *(pa.array(x, pa.int64()) for x in columns)]
                        yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "item_id", "first_word", "n_words", "edits", "item_words"])
            trim()

        return docs.select(id_col, text_col).mapInArrow(run, schema)

    out = None
    for found in _each_block(docs, items, tolerance, step, chained=False):
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, items: DataFrame, tolerance: float = TOLERANCE, text_col: str = "text") -> DataFrame:
    """The rows whose text matches no item; all columns are kept. One pass for each block of items, no shuffle."""

    def step(docs: DataFrame, block: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                text = batch.column(batch.schema.get_field_index(text_col))
                keep = [not found for start in range(0, batch.num_rows, BATCH) for found in block.value.batch(text.slice(start, BATCH).to_pylist())]
                yield batch.filter(pa.array(keep, pa.bool_()))
            trim()

        return docs.mapInArrow(run, docs.schema)

    out = docs
    for out in _each_block(docs, items, tolerance, step, chained=True):  # noqa: B007
        pass
    return out
