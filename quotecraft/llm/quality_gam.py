"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into quantile bins and owns a lookup table of log-odds;
a few pairs of features own two-way tables on coarser bins.  Shallow trees
boosted in cycles over the features learn the tables: every step fits one
small tree to the current residuals of one feature (or pair) and adds a
fraction of it to that table.  Scoring adds up table entries, one vectorised
lookup per table, so it is a narrow pass over the texts.

Learning reads at most ``SAMPLE_ROWS`` labelled documents, those with the
smallest hash of their id; this bound, not the corpus, sizes the training set.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text_metrics import COUNTS, text_metrics

#: most labelled documents read for learning (about 2 MB of features)
SAMPLE_ROWS = 20_000
FEATURES = ["log_words", "word_len", "symbols", "upper", "digits", "stops", "marks", "repeats", "runs",
            "distinct", "dup_lines", "line_words", "short"]


def features(counts: pd.DataFrame) -> np.ndarray:
    """(rows, features) matrix from the counts of ``text_metrics``; only the text enters."""
    c = {k: counts[k].to_numpy(dtype=float) for k in COUNTS}
    words, chars, lines = (np.maximum(c[k], 1.0) for k in ("n_words", "word_chars", "n_lines"))
    return np.column_stack([
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / chars, c["n_upper"] / chars,
        c["n_digits"] / chars, c["n_stops"] / words, c["n_marks"] / chars, c["n_repeat_words"] / words,
        c["n_runs"] / words, c["n_distinct"] / words ** 0.8, c["n_dup_lines"] / lines, c["n_words"] / lines,
        c["n_short"] / words])


@dataclass
class AdditiveModel:
    """Lookup tables over bins; ``tables[j][b]`` is the log-odds of bin b of feature j."""

    bias: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)])

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        if not self.tables:
            return out
        fine = self.bins(x, self.edges)
        for j, table in enumerate(self.tables):
            out += table[fine[:, j]]
        if self.pairs:
            rough = self.bins(x, self.coarse)
            for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
                out += table[rough[:, a], rough[:, b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def _split(grad: np.ndarray, hess: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain and place of the best cut of a run of bins into two leaves."""
    g, h = np.cumsum(grad)[:-1], np.cumsum(hess)[:-1]
    if not len(g):
        return 0.0, 0
    G, H = grad.sum(), hess.sum()
    gain = g * g / (h + ridge) + (G - g) ** 2 / (H - h + ridge) - G * G / (H + ridge)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def shallow_tree(grad: np.ndarray, hess: np.ndarray, leaves: int = 3, ridge: float = 5.0) -> np.ndarray:
    """Newton step per bin of a tree with ``leaves`` leaves over ordered bins."""
    parts = [(0, len(grad))]
    while len(parts) < leaves:
        best = max(((*_split(grad[a:b], hess[a:b], ridge), a, b) for a, b in parts), key=lambda t: t[0])
        gain, at, a, b = best
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, a + at), (a + at, b)]
    step = np.zeros(len(grad))
    for a, b in parts:
        step[a:b] = grad[a:b].sum() / (hess[a:b].sum() + ridge)
    return step


def _pair_tree(grad: np.ndarray, hess: np.ndarray, ridge: float = 5.0) -> tuple[np.ndarray, float]:
    """A tree of depth two over a two-way table: one cut of the rows, then a cut
    of the columns in each half (or the other way round); with its gain."""
    best_step, best_gain = np.zeros_like(grad), 0.0
    for turned in (False, True):
        g, h = (grad.T, hess.T) if turned else (grad, hess)
        for cut in range(1, len(g)):
            step, gain = np.zeros_like(g), -g.sum() ** 2 / (h.sum() + ridge)
            for half in (slice(0, cut), slice(cut, len(g))):
                col_g, col_h = g[half].sum(axis=0), h[half].sum(axis=0)
                _, at = _split(col_g, col_h, ridge)
                for cols in (slice(0, at), slice(at, g.shape[1])):
                    sg, sh = col_g[cols].sum(), col_h[cols].sum()
                    step[half, cols] = sg / (sh + ridge)
                    gain += sg * sg / (sh + ridge)
            if gain > best_gain:
                best_step, best_gain = (step.T if turned else step), gain
    return best_step, best_gain


def fit(x: np.ndarray, y: np.ndarray, cycles: int = 120, rate: float = 0.15, n_bins: int = 48,
        n_coarse: int = 8, n_pairs: int = 6, pair_cycles: int = 40) -> AdditiveModel:
    """Learn the tables.  Without rows the model scores 0.5 everywhere; with
    one class only, the smoothed share of that class."""
    model = AdditiveModel()
    if not len(x):
        return model
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    model.bias = float(np.log(share / (1.0 - share)))
    cut = lambda n: [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n + 1)[1:-1])) for j in range(x.shape[1])]
    model.edges, model.coarse = cut(n_bins), cut(n_coarse)
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if y.min() == y.max():
        return model
    fine, rough = model.bins(x, model.edges), model.bins(x, model.coarse)
    odds = np.full(len(x), model.bias)

    def residuals() -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-odds))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(cycles):
        for j, table in enumerate(model.tables):
            r, w = residuals()
            step = rate * shallow_tree(np.bincount(fine[:, j], r, len(table)), np.bincount(fine[:, j], w, len(table)))
            table += step
            odds += step[fine[:, j]]

    def two_way(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        na, nb = len(model.coarse[a]) + 1, len(model.coarse[b]) + 1
        cell = rough[:, a] * nb + rough[:, b]
        r, w = residuals()
        return (np.bincount(cell, r, na * nb).reshape(na, nb), np.bincount(cell, w, na * nb).reshape(na, nb), cell)

    gains = [(_pair_tree(*two_way(a, b)[:2])[1], a, b) for a in range(x.shape[1]) for b in range(a)]
    model.pairs = [(a, b) for gain, a, b in sorted(gains, reverse=True)[:n_pairs] if gain > 0]
    model.pair_tables = [np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)) for a, b in model.pairs]
    for _ in range(pair_cycles):
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            g, h, cell = two_way(a, b)
            step = rate * _pair_tree(g, h)[0]
            table += step
            odds += step.ravel()[cell]
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fold that is never learned from: crc32(id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """Fit on at most ``sample_rows`` labelled rows outside the held-out fold.

    Rows with a null id or a label other than 0 and 1 are left out; an id
    labelled twice counts with its smallest label.
    """
    chosen = (labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
              .where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out("_id"))
              .groupBy("_id").agg(F.min("_y").alias("_y"))
              .orderBy(F.xxhash64("_id"), "_id").limit(sample_rows))
    # at most sample_rows rows of 12 bytes: the bound of this broadcast
    texts = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
             .join(F.broadcast(chosen), "_id"))
    rows = text_metrics(texts, "_text", {"_id": "_id", "_y": "_y"})
    # repeated ids among the documents cannot grow the training set past its bound
    pdf = rows.orderBy(F.xxhash64("_id"), "_id", *COUNTS).limit(sample_rows).toPandas()
    return fit(features(pdf), pdf["_y"].to_numpy(dtype=float))


def score_documents(docs: DataFrame, model: AdditiveModel, text_col: str = "text", threshold: float = 0.3,
                    keep: dict[str, str] | None = None) -> DataFrame:
    """``keep`` columns of every row with its score (0 to 1) and ``predicted``.

    Null and empty texts are scored as texts of zero words; repeated rows are
    scored each; an empty table gives an empty result.
    """
    def scored(counts: pd.DataFrame) -> pd.DataFrame:
        s = model.score(features(counts))
        return pd.DataFrame({"score": s, "predicted": (s >= threshold).astype("int32")})

    return text_metrics(docs, text_col, keep, scored, "score double, predicted int")
