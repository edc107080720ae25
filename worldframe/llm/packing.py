"""Pattern packing: tokenise, cut into pieces, fit pattern counts by non-negative least squares, pack.

Null and empty texts hold the end id alone. Texts of any length are encoded whole and cut into pieces. Repeated rows, those
with a null id too, are packed as rows of their own. Ties (pieces of one length) are dealt in any order. An empty
table gives an empty result. Extra columns of the input are not read, whatever their names.
"""

import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worldframe.llm.common import materialise, parts, trim

ROOM = 2048
#: Buckets of a length's pieces for numbering them: SALT, and one more for each PARTS_PER_SALT tasks that wrote them.
SALT, PARTS_PER_SALT = 64, 64
#: The number of known stems from which on they are forgotten.
CACHE = 600_000
MARK = "\x01"


class Encoder:
    """ids of whole texts, by distinct stems: no id spans ASCII white space in the vocabulary this is used with.

    Splitting, finding the distinct words and stems and looking them up are Arrow kernels; only stems not yet known reach the
    tokenizer. A stem is a word, or where probes show that the tokenizer folds A-Z and parts letters from stops, the
    folded word without its last stops, and these.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self._ids(MARK)
        self.folds = self._ids("AbZ9.,;:!?").tolist() == self._ids("abz9 .,;:!?").tolist()
        self.plain = all(self._ids(w).tolist() == self._model(w) for w in ("abcdefghijklm", "nopqrstuvwxyz", "the"))
        self._forget()

    def _forget(self) -> None:
        self.stems, self.ids, self.bound = pa.array([], pa.large_string()), np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _model(self, word: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(word)]

    def _joined(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """ids and numbers of ids of words, many in one text, parted by a control character that has an id of its own and stands in none of them."""
        lots = [words[at : at + 100] for at in range(0, len(words), 100)]
        ids, sizes = [], []
        for lot, e in zip(lots, self.tokenizer.encode_batch_fast([f" {MARK} ".join(x) for x in lots], add_special_tokens=False), strict=True):
            found = np.array(e.ids, dtype="<u4")
            ends = np.flatnonzero(found == self.mark[0])
            if len(self.mark) == 1 and len(ends) == len(lot) - 1 and not any(MARK in w for w in lot):
                ids.append(np.delete(found, ends))
                sizes.append(np.diff([-1, *ends.tolist(), len(found)]) - 1)
            else:
                single = [self._ids(w) for w in lot]
                ids += single
                sizes.append(np.array([len(x) for x in single]))
        return ids, sizes

    def _learn(self, new: pa.Array) -> None:
        letters = pc.match_substring_regex(new, "^[a-z]+$")
        plain, other = (new.filter(letters), new.filter(pc.invert(letters))) if self.plain else (new.slice(0, 0), new)
        own = [self._model(w) for w in plain.to_pylist()]  # such a word is one pre-token and normalised as it is
        ids, sizes = self._joined(other.to_pylist())
        flat = np.fromiter((i for x in own for i in x), dtype="<u4")
        size = np.concatenate([np.array([len(x) for x in own], dtype=np.int64), *sizes])
        self.stems, self.ids = pa.concat_arrays([self.stems, plain, other]), np.concatenate([self.ids, flat, *ids])
        self.bound = np.concatenate([self.bound, self.bound[-1] + np.cumsum(size)])

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words in a row, and each word's bounds there."""
        if self.folds:
            words = pc.if_else(pc.match_substring(words, "<|"), words, pc.ascii_lower(words))  # special tokens are not folded
            # Not after U+0130: its folding ends in a combining dot, which joins the stop.
            words = pc.replace_substring_regex(words, "([a-z0-9À-ÖØ-öø-įı-ɏ])([.,;:!?]+)$", "\\1 \\2")
        parts = pc.ascii_split_whitespace(words)
        coded = parts.flatten().dictionary_encode()
        if len(self.stems) > CACHE:
            self._forget()
        self._learn(coded.dictionary.filter(pc.is_null(pc.index_in(coded.dictionary, value_set=self.stems))))
        stem = pc.index_in(coded.dictionary, value_set=self.stems).to_numpy(zero_copy_only=False)[coded.indices.to_numpy(zero_copy_only=False)]
        ids, bound = _gathered(self.ids, self.bound, stem)
        return ids, bound[parts.offsets.to_numpy() - parts.offsets[0].as_py()]

    def encode(self, texts: pa.Array, end: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each text's followed by the end id, as little-endian unsigned 32-bit numbers; and the texts' bounds there."""
        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        coded = lists.flatten().dictionary_encode()
        known, bound = self._words(coded.dictionary)
        word = coded.indices.to_numpy(zero_copy_only=False)
        splits = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        # The end id is one more word, put in at each text's end.
        known, bound = np.append(known, np.array(end, dtype="<u4")), np.append(bound, bound[-1] + 1)
        ids, total = _gathered(known, bound, np.insert(word, splits[1:], len(bound) - 2))
        return ids, total[splits + np.arange(len(splits))]


def _gathered(ids: np.ndarray, bound: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ids[bound[i]:bound[i + 1]] of i in at one after another, and their bounds."""
    size = np.diff(bound)[at]
    total = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(int(total[-1]), dtype=ids.dtype)
    for lo in range(0, len(at), 500_000):
        n = size[lo : lo + 500_000]
        first = total[lo : lo + len(n)]
        out[first[0] : total[lo + len(n)]] = ids[np.repeat(bound[at[lo : lo + len(n)]] - first, n) + np.arange(first[0], total[lo + len(n)])]
    return out, total


def pieces(docs: DataFrame, tokenizer: str, room: int = ROOM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, piece, start, length, ids_crc32 of every piece, and row: the piece's place in its task's output. Only documents longer than room are cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        count = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for batch in batches:
            for lo, n in parts(batch.column(1)):
                part = batch.slice(lo, n)
                ids, bounds = encoder.encode(part.column(1))
                total = np.diff(bounds)
                cut = -(-total // room)
                of = np.repeat(np.arange(n), cut)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(cut) - cut, cut)
                start = piece * room
                length = np.minimum(room, total[of] - start)
                first = bounds[of] + start
                data = memoryview(ids.tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
                arrays = [part.column(0).take(pa.array(of)), pa.array(piece.astype(np.int32)), *(pa.array(x, pa.int64()) for x in (start, length, crc, count + np.arange(len(of))))]
                yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "piece", "start", "length", "ids_crc32", "row"])
                count += len(of)
        del encoder
        trim()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, row long")


def patterns(lengths: np.ndarray, room: int) -> np.ndarray:
    """(n, 3) indices of lengths: all multisets of two or three that fill the room exactly; -1 where there are two."""
    at = np.full(room + 1, -1)
    at[lengths] = np.arange(len(lengths))
    a, b = np.meshgrid(lengths, lengths, indexing="ij")
    rest = room - a - b
    two = (rest == 0) & (a >= b)
    three = (rest > 0) & (a >= b) & (b >= rest)
    three &= at[np.where(three, rest, 0)] >= 0
    found = [np.stack([at[a[two]], at[b[two]], np.full(int(two.sum()), -1)], 1), np.stack([at[a[three]], at[b[three]], at[rest[three]]], 1)]
    return np.concatenate(found).astype(np.int32)


def nnls(p: np.ndarray, target: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' use of each length nearest to the histogram (accelerated projected gradient)."""
    n, hole = len(target), p < 0
    index = np.where(hole, n, p)
    scale = 1.0 / np.sqrt(np.maximum(target, 1.0))

    def use(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(index[:, j], x, n + 1)[:n] for j in range(3))

    def gain(r: np.ndarray) -> np.ndarray:
        r = np.append(r, 0.0)
        return r[index[:, 0]] + r[index[:, 1]] + r[index[:, 2]]

    v = np.ones(len(p))
    for _ in range(12):
        v = gain(scale**2 * use(v))
        v /= np.linalg.norm(v) or 1.0
    step = 1.0 / (1.05 * np.linalg.norm(gain(scale**2 * use(v))) + 1e-12)
    x = np.zeros(len(p))
    y, t = x, 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y + step * gain(scale**2 * (target - use(y))))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def plan(histogram: dict[int, int], room: int = ROOM) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, repeats): the fitted patterns, rounded, then best fit for what is left.

    Works on counts by length, so its cost depends on room and not on the number of pieces.
    """
    left = Counter({k: v for k, v in histogram.items() if v > 0})
    out: list[tuple[tuple[int, ...], int]] = []
    if left.get(room):
        out.append(((room,), left.pop(room)))
    lengths = np.array(sorted(left), dtype=np.int64)
    if len(lengths):
        found = patterns(lengths, room)
        if len(found):
            x = np.floor(nnls(found, np.array([left[int(k)] for k in lengths], dtype=float)) + 1e-9).astype(np.int64)
            order = np.flatnonzero(x)
            for i in order[np.argsort(-x[order], kind="stable")]:
                parts = tuple(int(lengths[j]) for j in found[i] if j >= 0)
                need = Counter(parts)
                if (n := min(int(x[i]), *(left[k] // m for k, m in need.items()))) > 0:
                    out.append((parts, n))
                    left.subtract({k: m * n for k, m in need.items()})
    # Best fit, largest first: the same filling is repeated until one of its lengths runs out.
    there = sorted(k for k, v in left.items() if v > 0)
    while there:
        parts, rest, used = [], room, Counter()
        i = len(there) - 1
        while i >= 0:
            k = there[i]
            m = min(rest // k, left[k] - used[k])
            if parts == []:
                m = 1
            if m > 0:
                parts += [k] * m
                used[k] += m
                rest -= k * m
            i = min(i - (m == 0 or len(parts) > 1), int(np.searchsorted(there, rest, "right")) - 1)
        n = min(left[k] // m for k, m in used.items())
        out.append((tuple(parts), n))
        for k, m in used.items():
            left[k] -= m * n
        there = [k for k in there if left[k] > 0]
    return out


def pack(docs: DataFrame, tokenizer: str, room: int = ROOM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces with sequence_id and offset. The driver sees the histogram (room counts at most) and the plan made of it only.

    Pieces of one length are numbered inside buckets plus the buckets' running totals, so that a length that a
    third of all pieces share is dealt over many tasks; a piece's bucket comes from its place in the written table, so
    equal rows part too.
    """
    written = materialise(pieces(docs, tokenizer, room, id_col, text_col))
    salts = max(SALT, -(-written.rdd.getNumPartitions() // PARTS_PER_SALT))
    cut = written.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    counts = materialise(cut.groupBy("length", "salt").count())
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    before = counts.selectExpr("length", "salt", "sum(count) OVER (PARTITION BY length ORDER BY salt) - count AS earlier")
    begin: Counter = Counter()
    slots, sequence = [], 0
    for parts, n in plan(total, room):
        offset = 0
        for k in parts:
            slots.append((k, begin[k], sequence, offset))
            begin[k] += n
            offset += k
        sequence += n
    slots.sort()
    length, first, base, place = (np.array(x, dtype=np.int64) for x in (zip(*slots, strict=True) if slots else ((),) * 4))
    key = (length << 44) + first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, rank = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("length", "rank"))
            at = np.searchsorted(key, (k << 44) + rank, "right") - 1
            kept = [batch.column(x) for x in (id_col, "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(base[at] + rank - first[at]), pa.array(place[at])], names=[id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    numbered = cut.selectExpr("*", "row_number() OVER (PARTITION BY length, salt ORDER BY row) AS number")
    ranked = numbered.join(before, ["length", "salt"]).withColumn("rank", F.col("earlier") + F.col("number") - 1)
    kind = docs.schema[id_col].dataType.simpleString()
    columns = ranked.select(id_col, "piece", "start", "length", "ids_crc32", "rank")
    return columns.mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
