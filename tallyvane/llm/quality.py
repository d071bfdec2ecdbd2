"""Quality classifier: random Fourier features over document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvane.llm._common import cut

WORD = re.compile(r"\S+")
STATS = 18


def statistics(text: str | None) -> np.ndarray:
    """Figures of one whole text: shares of kinds of characters, word shapes, repetition, lines, length."""
    text = text or ""
    out = np.zeros(STATS)
    if not text.strip():
        return out
    words, lines, n = text.split(), text.split("\n"), len(text)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    small = np.bincount(np.minimum(codes, 128), minlength=129)
    lower = [w.lower() for w in words]
    lengths = np.array([len(w) for w in words])
    symbols = small[33:48].sum() + small[58:65].sum() + small[91:97].sum() + small[123:127].sum()
    kinds = {ln.strip() for ln in lines}
    out[:] = (
        np.log1p(n), np.log1p(len(words)), small[65:91].sum() / n, small[48:58].sum() / n, symbols / n,
        (symbols - small[44] - small[46]) / n, small[46] / len(words), small[33] / len(words), small[124] / len(words), small[32] / n,
        lengths.mean(), lengths.std(), len(set(lower)) / len(words), sum(map(str.__eq__, lower, lower[1:])) / len(words),
        1 - len(kinds) / len(lines), len(lines) / len(words), sum(not w[-1].isalnum() and w[-1] not in ".,;:" for w in words) / len(words), small[128] / n,
    )
    return out


class QualityModel:
    """Bounded-size model: the features' scale, the random projection, ridge weights and calibration steps."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = 192, width: float = 3.0, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.frequencies = rng.normal(size=(STATS, features)) / width
        self.phases = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.edges, self.levels = np.array([0.0]), np.array([0.5])

    def expand(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        phi = np.cos(z @ self.frequencies + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([phi, np.ones((len(phi), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.expand(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.edges, self.levels)


def pool_adjacent(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Isotonic least squares: the increasing fit to means y with weights w, given in the order of x."""
    level, weight, size = [], [], []
    for v, k in zip(y.tolist(), w.tolist()):
        level.append(v)
        weight.append(k)
        size.append(1)
        while len(level) > 1 and level[-2] >= level[-1]:
            v, k, s = level.pop(), weight.pop(), size.pop()
            level[-1] = (level[-1] * weight[-1] + v * k) / (weight[-1] + k)
            weight[-1] += k
            size[-1] += s
    return np.repeat(level, size)


def _stats_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"x": [*map(statistics, batch["text"].array)], "y": batch["y"]})


def fit_quality(labelled: DataFrame, text_col: str = "text", label_col: str = "quality", ridge: float = 1e-3, bins: int = 1000) -> QualityModel:
    """Fit on every row with a label of 0 or 1.

    Partitions add up their part of the normal equations, which are then summed by cell; the driver sees those sums
    (features squared numbers) and `bins` counts for the calibration, whatever the number of rows. Null texts count as
    empty ones, repeated rows as often as they occur; scores that tie share a bin. Without labelled rows every score is 0.5.
    """
    rows = labelled.where(F.col(label_col).isin(0, 1)).select(F.col(text_col).alias("text"), F.col(label_col).cast("double").alias("y"))
    points = cut(rows.mapInPandas(_stats_batches, "x array<double>, y double"))
    moments = points.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("k").collect()
    if not moments:
        return QualityModel(np.zeros(STATS), np.ones(STATS))
    model = QualityModel(np.array([r["m"] for r in moments]), np.maximum([r["s"] for r in moments], 1e-6))

    def normal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: np.ndarray | float = 0.0
        for batch in batches:
            if len(batch):
                phi = model.expand(np.stack(batch["x"].array))
                total = total + phi.T @ np.column_stack([phi, batch["y"]])
        if not np.isscalar(total):
            yield pd.DataFrame({"cell": np.arange(total.size), "v": total.ravel()})

    size = len(model.weights)
    sums = np.zeros(size * (size + 1))
    for row in points.mapInPandas(normal, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        sums[row["cell"]] = row["v"]
    sums = sums.reshape(size, size + 1)
    n = max(sums[-1, -2], 1.0)
    model.weights = np.linalg.solve(sums[:, :size] + ridge * n * np.eye(size) / size, sums[:, size])

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                raw = np.clip(model.raw(np.stack(batch["x"].array)), -0.5, 1.5)
                yield pd.DataFrame({"bin": np.floor((raw + 0.5) / 2 * bins).astype(np.int32), "y": batch["y"]})

    found = points.mapInPandas(binned, "bin int, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    x = (np.array([r["bin"] for r in found]) + 0.5) / bins * 2 - 0.5
    model.edges, model.levels = x, pool_adjacent(x, np.array([r["y"] for r in found]), np.array([r["n"] for r in found]))
    return model


def quality_score(text: Column, model: QualityModel) -> Column:
    """The score, 0 to 1, of each whole text; empty and null texts have all figures 0 and get the score of that point."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.clip(model.score(np.stack([statistics(t) for t in texts.array])), 0, 1) if len(texts) else [], dtype=float)

    return F.pandas_udf(run, "double")(text)


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; other columns are left out, so their names cannot clash.

    Null texts score as empty ones; texts of any length are read whole; repeated rows and equal texts give equal scores; an
    empty table gives none.
    """
    return docs.select(F.col(id_col).alias("doc_id"), quality_score(F.col(text_col), model).alias("score"))
