"""Quality by a sparse rule ensemble: tree paths over statistics, lasso logistic weights, Spark columns.

Statistics of a text are Spark columns. Small boosted trees are grown on the statistics of a bounded sample
of labelled texts; every path from a root is a conjunctive rule. A logistic model with a lasso penalty over
the rules chooses few of them, and these are compiled into one column expression, so scoring runs in the JVM.

Null and empty texts have all statistics zero and are scored like any other; texts of any length are read whole. Repeated rows
and ties score alike; rows without an id are scored and train nothing. With no labelled row of either class every score is 0.5. An
empty table gives an empty result. All columns are kept, whatever their names, but for one named like the score, which is replaced.
"""

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worldframe.llm.common import labelled_sample, unused

#: Bounds of the sample and of the ensemble.
PER_CLASS, TREES, DEPTH, BINS = 5000, 40, 3, 48
PENALTY = 2e-4


def statistics(text: Column) -> dict[str, Column]:
    """Name and column of each statistic of a whole text; shares are of its code points."""
    n = F.greatest(F.length(text), F.lit(1))
    left = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x) != "")
    share = lambda part, whole: F.coalesce(part / F.greatest(whole, F.lit(1)), F.lit(0.0))
    return {
        "log_chars": F.log1p(F.length(text).cast("double")),
        "upper": left(r"[^\p{Lu}]+") / n,
        "digits": left(r"[^0-9]+") / n,
        "bars": left(r"[^|]+") / n,
        "shouts": left(r"[^!?]+") / n,
        "symbols": left(r"[^#$%&*@^~=+<>{}\[\]_/\\]+") / n,
        "stops": left(r"[^.,;:]+") / n,
        "spaces": left(r"\S+") / n,
        "word_size": share(F.length(text).cast("double"), F.size(words)),
        "distinct_words": share(F.size(F.array_distinct(words)).cast("double"), F.size(words)),
        "distinct_lines": share(F.size(F.array_distinct(lines)).cast("double"), F.size(lines)),
        "line_size": share(F.length(text).cast("double"), F.size(lines)),
    }


def with_statistics(docs: DataFrame, text_col: str = "text", names: tuple[str, ...] = ()) -> DataFrame:
    """docs and the statistics under these names, NAMES if none are given."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({k: v.cast("double") for k, v in zip(names or NAMES, statistics(text).values(), strict=True)})


NAMES = tuple(f"__{k}" for k in ("log_chars", "upper", "digits", "bars", "shouts", "symbols", "stops", "spaces", "word_size", "distinct_words", "distinct_lines", "line_size"))

#: A condition: statistic, whether it must be above (else at most) the bound, the bound.
Condition = tuple[int, bool, float]


@dataclass
class Rules:
    """bias and weighted conjunctions; the score is the logistic of their sum."""

    bias: float = 0.0
    rules: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)

    def column(self, names: tuple[str, ...] = ()) -> Column:
        names = names or NAMES

        def holds(rule: tuple[Condition, ...]) -> Column:
            out = F.lit(True)
            for j, above, bound in rule:
                out = out & (F.col(names[j]) > bound if above else F.col(names[j]) <= bound)
            return out

        total = F.lit(self.bias)
        for rule, weight in self.rules:
            total = total + F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = self.bias + sum(w * _holds(x, r) for r, w in self.rules)
        return 1 / (1 + np.exp(-np.broadcast_to(total, len(x))))


def _holds(x: np.ndarray, rule: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for j, above, bound in rule:
        out &= x[:, j] > bound if above else x[:, j] <= bound
    return out.astype(float)


def _grow(binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, path: tuple[Condition, ...], out: list, value: np.ndarray) -> None:
    """Split rows on the best gain, depth first; out collects the path of every node under the root."""
    total_g, total_h = g[rows].sum(), h[rows].sum()
    value[rows] = total_g / (total_h + 1.0)
    if path:
        out.append(path)
    if len(path) >= DEPTH or len(rows) < 20:
        return
    best = (1e-6, -1, 0)
    for j in range(binned.shape[1]):
        if not len(edges[j]):
            continue
        left_g = np.cumsum(np.bincount(binned[rows, j], g[rows], len(edges[j]) + 1))[:-1]
        left_h = np.cumsum(np.bincount(binned[rows, j], h[rows], len(edges[j]) + 1))[:-1]
        gain = left_g**2 / (left_h + 1.0) + (total_g - left_g) ** 2 / (total_h - left_h + 1.0) - total_g**2 / (total_h + 1.0)
        gain[(left_h < 0.5) | (total_h - left_h < 0.5)] = -1
        k = int(gain.argmax())
        if gain[k] > best[0] + 1e-12:
            best = (float(gain[k]), j, k)
    _, j, k = best
    if j < 0:
        return
    below = binned[rows, j] <= k
    for side, above in ((rows[below], False), (rows[~below], True)):
        _grow(binned, edges, g, h, side, (*path, (j, above, float(edges[j][k]))), out, value)


def fit(x: np.ndarray, y: np.ndarray) -> Rules:
    """Boost small trees, take their paths as rules, and weigh the rules by lasso logistic regression."""
    if not len(y) or y.min() == y.max():
        return Rules()
    edges = []
    for j in range(x.shape[1]):
        cut = np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1]))
        value = np.unique(x[:, j])
        at = np.searchsorted(value, cut, "right")
        edges.append(np.unique((value[np.minimum(at, len(value) - 1)] + cut) / 2)[: BINS - 1] if len(value) > 1 else np.array([]))
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    paths: list[tuple[Condition, ...]] = []
    f = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        value = np.zeros(len(y))
        _grow(binned, edges, y - p, p * (1 - p), np.arange(len(y)), (), paths, value)
        f += 0.3 * value
    rules = list(dict.fromkeys(tuple(sorted(set(r))) for r in paths))
    z = np.stack([_holds(x, r) for r in rules], axis=1) if rules else np.zeros((len(y), 0))
    _, kept = np.unique(z, axis=1, return_index=True)
    kept = np.sort(kept)
    z, rules = z[:, kept], [rules[i] for i in kept]
    weight, bias = _lasso(z, y)
    return Rules(bias, [(r, float(w)) for r, w in zip(rules, weight, strict=True) if w])


def _lasso(z: np.ndarray, y: np.ndarray, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient for the mean logistic loss and PENALTY times the weights' absolute sum."""
    n = len(y)
    full = np.concatenate([z, np.ones((n, 1))], axis=1)
    step = 4.0 * n / (np.linalg.norm(full, 2) ** 2 + 1e-9)
    w = np.zeros(full.shape[1])
    v, t = w, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(full @ v, -30, 30)))
        new = v - step * (full.T @ (p - y) / n)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * PENALTY, 0.0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Rules:
    """Fit on at most per_class labelled training documents of either label (a documented bound)."""
    rows = with_statistics(labelled_sample(docs, labels, "quality", per_class, per_class)).select("doc_id", "y", *NAMES).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return fit(np.array([[r[n] for n in NAMES] for r in rows], dtype=float).reshape(len(rows), len(NAMES)), np.array([r["y"] for r in rows], dtype=float))


def score(docs: DataFrame, rules: Rules, text_col: str = "text", into: str = "score") -> DataFrame:
    """docs and a column with the probability that the text is of good quality; a column of that name, in any case, is replaced."""
    docs = docs.drop(into)
    names = tuple(unused(docs, *(n[2:] for n in NAMES)))
    return with_statistics(docs, text_col, names).withColumn(into, rules.column(names)).drop(*names)
