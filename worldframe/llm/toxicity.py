"""Toxicity: a gap-weighted subsequence-kernel SVM over the words of labelled sentences, with Nyström landmarks.

A word's features are its subsequences of three letters, weighted by DECAY to the power of their span, so
that gaps and inserted characters lower a match instead of breaking it; characters that are no letters are
left out of a word, and letters spelt out one by one are joined first. Kernel values to a bounded set of
landmark words, whitened by the landmarks' own kernel matrix, are the inputs of a linear SVM (squared
hinge). A sentence's margin is that of its worst word, and a text's margin that of its worst sentence; the
label of a text is shared by its sentences, so the words that bear it are found by alternation (MI-SVM).
Because the margin is linear in the kernel, the trained model is one weight per subsequence.

Null and empty texts score as texts without a word; texts of any length are read whole. Repeated rows and ties score
alike; rows without an id are scored and train nothing. An empty table gives an empty result. Where no words set toxic texts apart, as with labelled rows of one class or none, every score is the
share of toxic labels (none: near 0). Extra columns are kept, whatever their names, but for one named like the score, which is
replaced.
"""

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worldframe.llm.common import labelled_sample, trim

ORDER, SPAN, DECAY = 3, 6, 0.55
#: Bounds of the training sample and of the model.
PER_CLASS, LANDMARKS, NEGATIVES = 2000, 400, 6000
#: Longer words are scored in overlapping stretches.
STRETCH = 24
CACHE = 120_000
#: a to z have a symbol each, a word's edge has EDGE; other letters share the rest of the 64.
SYMBOLS, EDGE = 64, "~"
_SYMBOL = np.array([c - 96 if 97 <= c <= 122 else 63 if c == ord(EDGE) else 27 + c % 36 if c else 0 for c in range(1 << 16)], dtype=np.int64)

_SPELT = re.compile(r"(?<!\S)[^\W\d_](?:[\s.\-_*]+[^\W\d_]){3,}(?!\w)")
_OTHER = re.compile(r"[\W\d_]+")
_RUN = re.compile(r"(.)\1{2,}")
_SENTENCE = re.compile(r"[.!?\n]+(?:\s|$)")
_GAPS = [(j, k) for j in range(1, SPAN - 1) for k in range(j + 1, SPAN)]


def words(text: str) -> list[str]:
    """Lower-cased chunks between white space; runs of single letters are joined."""
    low = text.lower()
    return _SPELT.sub(lambda m: _OTHER.sub("", m[0]), low).split()


def letters(word: str) -> str:
    """A word's letters between two edge marks, none more than twice in a row; nothing if it has no letter."""
    plain = _RUN.sub(r"\1\1", word if word.isalpha() else _OTHER.sub("", word))
    return f"{EDGE}{plain}{EDGE}" if plain else ""


def _codes(stretches: list[str]) -> np.ndarray:
    """(n, STRETCH) symbols, 0 beyond a word's end."""
    return _SYMBOL[np.array(stretches, dtype=f"<U{STRETCH}").view(np.uint32).reshape(len(stretches), STRETCH) & 0xFFFF]


def _subsequences(codes: np.ndarray) -> Iterator[tuple[float, int, np.ndarray]]:
    """For each gap pattern: its weight, its positions and the (n, positions) numbers of the three symbols, 0 if not whole."""
    for j, k in _GAPS:
        p = STRETCH - k
        last = codes[:, k : k + p]
        yield DECAY ** (k + 1), p, np.where(last > 0, (codes[:, :p] * SYMBOLS + codes[:, j : j + p]) * SYMBOLS + last, 0)


def _norm(codes: np.ndarray) -> np.ndarray:
    """Root of the summed squared weights of a word's subsequences; 1 if it has none."""
    n = (codes > 0).sum(axis=1)
    total = sum(DECAY ** (2 * (k + 1)) * np.maximum(0, n - k) for _, k in _GAPS)
    return np.sqrt(np.where(total > 0, total, 1.0))


def kernel(a: list[str], b: list[str]) -> np.ndarray:
    """Kernel values of all of a with all of the (few) b."""
    right = _codes(b)
    there = np.unique(np.concatenate([x.ravel() for _, _, x in _subsequences(right)]))
    there = there[there > 0]
    columns = np.zeros(SYMBOLS**3, dtype=np.int64)
    columns[there] = np.arange(1, len(there) + 1)
    table = np.zeros((len(there) + 1, len(b)))
    for weight, p, number in _subsequences(right):
        np.add.at(table, (columns[number], np.repeat(np.arange(len(b))[:, None], p, axis=1)), weight)
    table[0] = 0
    table /= _norm(right)
    out = np.zeros((len(a), len(b)))
    for at in range(0, len(a), 500):
        codes = _codes(a[at : at + 500])
        part = out[at : at + 500]
        for weight, _, number in _subsequences(codes):
            found = columns[number]
            row, place = np.nonzero(found)
            if len(row):
                begin = np.flatnonzero(np.diff(row, prepend=-1))
                part[row[begin]] += weight * np.add.reduceat(table[found[row, place]], begin, axis=0)
        part /= _norm(codes)[:, None]
    return out


@dataclass
class Model:
    """weights: one per subsequence; slope and shift turn a text's margin into a probability."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(SYMBOLS**3, dtype=np.float32), repr=False)
    bias: float = -1.0
    slope: float = 0.0
    shift: float = 0.0
    seen: dict[str, float] = field(default_factory=dict, repr=False)

    def margins(self, found: list[str]) -> list[float]:
        """The margin of each word; a long word has that of its worst stretch."""
        plain = [letters(w) for w in found]
        best = self._stretches(plain)
        for i, w in enumerate(plain):
            if len(w) > STRETCH:
                best[i] = max(self._stretches([w[at : at + STRETCH] for at in range(0, len(w), STRETCH // 2)]))
        return best

    def _stretches(self, found: list[str]) -> list[float]:
        out: list[float] = []
        for at in range(0, len(found), 5_000):
            codes = _codes(found[at : at + 5_000])
            total = sum(weight * self.weights[number].sum(axis=1, dtype=np.float64) for weight, _, number in _subsequences(codes))
            out += (self.bias + total / _norm(codes)).tolist()
        return out

    def learn(self, found: set[str]) -> None:
        """Make sure that seen has the margin of each word."""
        if len(self.seen) > CACHE:
            self.seen.clear()
        new = [w for w in found if w not in self.seen]
        if new:
            self.seen.update(zip(new, self.margins(new), strict=True))

    def texts(self, texts: list[str | None]) -> list[float]:
        found = [set(words(t or "")) for t in texts]
        self.learn(set().union(*found))
        return [max(map(self.seen.__getitem__, x), default=self.bias) for x in found]

    def score(self, margin: float) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30))))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Squared hinge and ridge by Newton steps; the last column of x is the constant."""
    w = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], ridge)
    reg[-1] = 1e-3
    for _ in range(25):
        bad = y * (x @ w) < 1
        xb, cb = x[bad], weight[bad]
        new = np.linalg.solve(xb.T @ (xb * cb[:, None]) + np.diag(reg), xb.T @ (cb * y[bad]))
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through smoothed targets."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (t - p) - 1e-3 * w)
        w += np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 0.0), float(w[1])


def _constant(y: np.ndarray) -> Model:
    """Without words that tell toxic texts apart: the share of toxic texts for every text."""
    share = np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6)
    return Model(shift=float(np.log(share / (1 - share))))


def _bag(text: str, number: dict[str, int]) -> np.ndarray:
    """Numbers of the words of a text's sentences; a new word gets the next number."""
    found = {number.setdefault(x, len(number)) for sentence in _SENTENCE.split(text) for w in dict.fromkeys(words(sentence)) if (x := letters(w))}
    return np.fromiter(found, dtype=np.int32, count=len(found))


def _telling(toxic: np.ndarray, clean: np.ndarray, base: float) -> np.ndarray:
    """Words whose counts in toxic and clean texts differ beyond chance, by likelihood ratio over the whole vocabulary."""
    p = toxic / np.maximum(toxic + clean, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = toxic * np.log(np.maximum(p, 1e-9) / base) + np.where(clean > 0, clean * np.log(np.maximum(1 - p, 1e-9) / (1 - base)), 0.0)
    return (p > 0.9) & (ratio > np.log((toxic > 0).sum() + 1) + 3)


def _inserted(word: str, rng: np.random.Generator) -> list[str]:
    """Variants of a word with a letter inserted inside, for training."""
    inner = range(2, min(len(word) - 1, STRETCH - 2))
    return [word[:i] + chr(97 + int(rng.integers(26))) + word[i:] for i in inner][: STRETCH // 2]


def _collapse(marks: list[str], beta: np.ndarray) -> np.ndarray:
    """One weight per subsequence: the landmarks' subsequences, each times its landmark's coefficient."""
    codes = _codes(marks)
    scaled = (beta / _norm(codes))[:, None]
    out = np.zeros(SYMBOLS**3)
    for weight, p, number in _subsequences(codes):
        out += np.bincount(number.ravel(), (weight * np.repeat(scaled, p, axis=1)).ravel(), SYMBOLS**3)
    out[0] = 0
    return out.astype(np.float32)


def fit(rows: Iterable[tuple[str, int]], seed: int = 7) -> Model:
    """rows: whole texts and their labels (a bounded sample)."""
    texts = sorted((str(t or ""), int(y)) for t, y in rows)
    y = np.array([y for _, y in texts])
    if not len(y) or y.min() == y.max():
        return _constant(y)
    number: dict[str, int] = {}
    bags = [_bag(t, number) for t, _ in texts]
    names = list(number)
    toxic, clean = (np.bincount(np.concatenate([b for b, lab in zip(bags, y, strict=True) if lab == k]), minlength=len(names)) for k in (1, 0))
    usable = np.array([ORDER <= len(w) <= STRETCH for w in names], dtype=bool)
    telling = set(np.flatnonzero(usable & _telling(toxic, clean, float(y.mean()))).tolist())
    rng = np.random.default_rng(seed)
    pool = sorted(np.flatnonzero(usable & (clean > 0)).tolist(), key=names.__getitem__)
    picked = {pool[i] for i in rng.permutation(len(pool))[:NEGATIVES]}
    model, witness, hard, worst = Model(), set(), set(), []
    word = names.__getitem__
    for _ in range(4):
        good = sorted(telling | witness, key=word)
        if not good or not pool:
            return _constant(y)
        near = sorted(picked | hard, key=word)
        common = sorted(near, key=lambda w: (-clean[w], word(w)))[: LANDMARKS // 6]
        marks = [word(i) for i in dict.fromkeys(sorted(good, key=lambda w: (-toxic[w], word(w)))[: LANDMARKS // 3] + common + worst + near[:: len(near) // (LANDMARKS // 4) + 1])][:LANDMARKS]
        value, vector = np.linalg.eigh(kernel(marks, marks))
        whiten = vector[:, value > 1e-6] / np.sqrt(value[value > 1e-6])
        spoilt = [v for w in good if w in telling for v in _inserted(word(w), rng)]
        x = kernel([*map(word, good), *spoilt, *map(word, near)], marks) @ whiten
        label = np.array([1.0] * (len(good) + len(spoilt)) + [-1.0] * len(near))
        often = np.array([toxic[w] for w in good], dtype=float)
        share = np.concatenate([3000 * often / often.sum(), np.full(len(spoilt), 1000 / max(1, len(spoilt))), np.full(len(near), 0.6)])
        w = _svm(np.concatenate([x, np.ones((len(x), 1))], 1), label, share)
        model = Model(_collapse(marks, whiten @ w[:-1]), float(w[-1]))
        margin = np.array(model.margins([*map(word, pool)]))
        hard |= {pool[i] for i in np.argsort(-margin, kind="stable")[: NEGATIVES // 4]}
        worst = [pool[i] for i in np.argsort(-margin, kind="stable")[: LANDMARKS // 3]]
        # Toxic texts without a telling word name the word of the largest margin, if no clean text has it.
        witness = set()
        for bag, lab in zip(bags, y, strict=True):
            every = [i for i in bag.tolist() if usable[i]]
            if lab and every and not telling.intersection(every):
                found = model.margins([*map(word, every)])
                best = int(np.argmax(found))
                if found[best] > 0.2 and not clean[every[best]]:
                    witness.add(every[best])
    margins = np.array([m for at in range(0, len(texts), 100) for m in model.texts([t for t, _ in texts[at : at + 100]])])
    model.slope, model.shift = _platt(margins, y)
    model.seen = {}
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on at most per_class toxic and twice as many other labelled training documents (a documented bound)."""
    rows = labelled_sample(docs, labels, "toxic", per_class, 2 * per_class).select("text", "y").collect()
    return fit((r["text"], r["y"]) for r in rows)


def score(docs: DataFrame, model: Model, text_col: str = "text", into: str = "score") -> DataFrame:
    """docs and a column with the probability that the whole text is toxic; a column of that name, in any case, is replaced."""
    docs = docs.drop(into)
    schema = docs.withColumn(into, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(text_col))
            p = [model.score(m) for at in range(0, batch.num_rows, 100) for m in model.texts(text.slice(at, 100).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, into])
        model.seen.clear()
        trim()

    return docs.mapInArrow(run, schema)
