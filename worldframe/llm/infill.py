"""Fill-in-middle by overlapping chunks: boundary counts per chunk, prefix sums, and a rescan of the chunks that hold a cut.

A token is white space with the run of other characters after it, or the white space at a text's end, so a token starts at a text's
start and wherever white space follows another character. That is a predicate of two adjacent bytes: texts fall into chunks of
CHUNK bytes that see one byte of the chunk before them, all chunks of a batch count their boundaries at once, prefix
sums route the ranks of both cuts to the chunks that own them, and only these are scanned again. No row leaves its task.

Cut ranks and forms come from the sha256 of `<seed>:<doc_id>`. Empty and null texts are plain and have no tokens; a null id counts as the
empty string. Texts of any length are cut whole; one of white space only is one token. Repeated rows are treated alike, whatever
their order. Both cuts may fall together, then the middle is empty. An empty table gives an empty result. All columns of the input are kept; the new ones take the place of columns of
these names (names differ by case too).
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worldframe.llm.common import as_bytes, parts, trim

CHUNK = 4096
SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
NEW = ("n", "form", "prefix_chars", "middle_chars", "output")
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[32, *range(9, 14)]] = True


class Chunks:
    """The chunks of many texts that lie one after another in data, text i from bounds[i] to bounds[i + 1]."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, chunk: int = CHUNK):
        self.data, self.bounds = data, bounds
        per_text = -(-np.diff(bounds) // chunk)
        text = np.repeat(np.arange(len(per_text)), per_text)
        self.start = bounds[text] + (np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)) * chunk
        self.end = np.minimum(self.start + chunk, bounds[text + 1])
        first = self.start == bounds[text]
        # A text's first chunk has no byte before it: its first byte is no boundary.
        begins = _WHITE[data[1:]] & ~_WHITE[data[:-1]] if len(data) else np.zeros(0, dtype=bool)
        self.is_start = np.concatenate([[False], begins])[: len(data)]
        self.is_start[self.start[first]] = False
        counts = np.add.reduceat(self.is_start, self.start, dtype=np.int64) if len(self.start) else np.zeros(0, dtype=np.int64)
        self.upto = np.concatenate([[0], np.cumsum(counts)])
        self.first_chunk = np.concatenate([[0], np.cumsum(per_text)])
        held = self.upto[self.first_chunk[1:]] - self.upto[self.first_chunk[:-1]]
        self.tokens = held + (np.diff(bounds) > 0)

    def cut(self, text: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Where the token of this rank begins in data: the text's start at rank 0, its end at the number of its tokens."""
        at = np.where(rank == 0, self.bounds[text], self.bounds[text + 1])
        inner = np.flatnonzero((rank > 0) & (rank < self.tokens[text]))
        nth = self.upto[self.first_chunk[text[inner]]] + rank[inner]
        owner = np.searchsorted(self.upto, nth, "left") - 1
        for i, c, k in zip(inner.tolist(), owner.tolist(), (nth - self.upto[owner]).tolist(), strict=True):
            lo = self.start[c]
            at[i] = lo + np.flatnonzero(self.is_start[lo : self.end[c]])[k - 1]
        return at


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4))


def _code_points(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def _transformed(ids: list, texts: pa.Array, seed: int, fim: int, spm: int) -> list[pa.Array]:
    data, bounds = as_bytes(texts)
    chunks = Chunks(data, bounds)
    drawn = np.array([draws(i, seed) for i in ids], dtype=np.int64).reshape(-1, 4)
    rank = drawn[:, :2] % (chunks.tokens[:, None] + 1)
    text = np.arange(len(ids))
    cut_a, cut_b = chunks.cut(text, rank.min(axis=1)), chunks.cut(text, rank.max(axis=1))
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    forms, before, between, out = [], [], [], []
    raw = memoryview(data)
    for i, (lo, hi, a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), cut_a.tolist(), cut_b.tolist(), strict=True)):
        whole = bytes(raw[lo:hi])
        if not whole or drawn[i, 2] % 100 >= fim or p in whole or s in whole or m in whole:
            forms.append("plain")
            before.append(None)
            between.append(None)
            out.append(whole)
            continue
        head, mid, tail = whole[: a - lo], whole[a - lo : b - lo], whole[b - lo :]
        forms.append("spm" if drawn[i, 3] % 100 < spm else "psm")
        before.append(_code_points(data[lo:a]))
        between.append(_code_points(data[a:b]))
        out.append(b"".join((s, tail, p, head, m, mid) if forms[-1] == "spm" else (p, head, s, tail, m, mid)))
    return [pa.array(chunks.tokens, pa.int64()), pa.array(forms), pa.array(before, pa.int64()), pa.array(between, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]


def fill_in_middle(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (null where plain) and output: the text as it is to be trained on."""
    kept = [c for c in docs.columns if c.lower() not in NEW]
    # Their own copies of id and text: the columns kept pass through unread.
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("a"), F.col(f"`{text_col}`").alias("b"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, n in parts(batch.column(1)):
                part = batch.slice(lo, n)
                made = _transformed(part.column(0).to_pylist(), part.column(1), seed, fim_percent, spm_percent)
                yield pa.RecordBatch.from_arrays([part.column(2), *made], names=["c", *NEW])
        trim()

    schema = f"c {rows.schema['c'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInArrow(run, schema).select("c.*", *NEW)


def restored(output: Column, form: Column) -> Column:
    """The text, from an output and its form alone. Texts with a marker are plain, so a marker in the others is one that was put in."""

    def between(first: str, then: str) -> Column:
        return F.substring_index(F.substring_index(output, first, -1), then, 1)

    prefix, suffix = F.when(form == "spm", between(PREFIX, MIDDLE)).otherwise(between(PREFIX, SUFFIX)), F.when(form == "spm", between(SUFFIX, PREFIX)).otherwise(between(SUFFIX, MIDDLE))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, F.substring_index(output, MIDDLE, -1), suffix))
