"""A quality classifier learnt from trusted positives and unlabelled texts (non-negative PU risk, Kiryo et al., 2017).

With the class prior p, the risk is p E+[l(g)] + max(0, E[l(-g)] - p E+[l(-g)]), E+ over the positives and E over the
unlabelled; where the second part falls below zero, steps go the other way. The loss is logistic, the model linear in
figures of a text's shape, so that the logistic of its output estimates the probability of the positive class.

The prior is estimated from positives and unlabelled texts alone: of scores that tell the two apart, the share of
unlabelled texts above any level is at least p times that of positives, and where only positives score so high, p times
(Blanchard, Lee and Scott, 2010). Everything is summed over all rows by distributed passes; only sums of fixed size
come to the driver.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarium.llm.shared import pieces, stored

#: Passes over the rows for one fit at most, and the slope at which it ends.
PASSES, FLAT = 16, 1e-4
#: The weights' ridge is this over the square root of the number of positives, as the error of their mean is. Of 0.05 to 2
#: the best on a validation fold of the training rows.
RIDGE = 2.0
#: Steps of score for which shares are counted, and the least share of positives above a level that counts.
LEVELS, LEAST_SHARE = 256, 0.2
PRIOR_RANGE = (0.05, 0.95)
#: Up to so many labelled ids their table is broadcast (some MB); above, it is joined.
BROADCAST_IDS = 100_000

_SYMBOL = re.compile(r"[#*$%&|<>~^_=+@\\/{}\[\]]")
_ONLY_MARKS = re.compile(r"^[^\w]+$")
_LENGTHS = 12


def figures(text: str | None) -> list[float]:
    """The figures of a text's shape, all finite; of a null or empty text, zeros but for the short-text marks."""
    text = text or ""
    words = text.split()
    n, size = len(words), len(text)
    count = Counter(words)
    letters = sum(map(str.isalpha, text))
    upper = sum(map(str.isupper, text))
    digits = sum(map(str.isdigit, text))
    marks = len(_SYMBOL.findall(text))
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    twice = sum(c for c in windows.values() if c > 1)
    lines = [line for line in text.split("\n") if line.strip()]
    of = lambda x, y: x / y if y else 0.0
    shares = [
        of(upper, letters), of(digits, size), of(marks, size), of(sum(1 for w in words if _ONLY_MARKS.match(w)), n),
        of(max(count.values(), default=0), n), of(sum(a == b for a, b in zip(words, words[1:], strict=False)), n - 1), of(twice, len(words) - 2 if n > 2 else 0),
        of(len(lines) - len(set(lines)), len(lines)), of(text.count("!"), size), of(text.count("|"), size),
        of(sum(1 for w in words if w[-1] in ".!?"), n), of(sum(1 for w in words if _SYMBOL.search(w)), n), of(sum(1 for w in words if any(map(str.isdigit, w))), n),
        of(sum(1 for w in words if w[:1].isupper() and w[1:].islower()), n), of(sum(1 for w in words if len(w) > 1 and w.isupper()), n),
    ]
    by_length = Counter(min(len(w), _LENGTHS) for w in words)
    entropy = -sum(c / n * math.log(c / n) for c in count.values()) / math.log(n) if n > 1 else 0.0
    return [
        *shares, *(math.log1p(50 * s) for s in shares), math.log1p(n) / 10, of(letters, size), of(len(count), n), entropy,
        min(of(sum(map(len, words)), n), 50) / 20, math.log1p(of(n, len(lines))) / 5, float(n < 10), float(n < 30), float(n < 60), float(n < 120), *(of(by_length[k], n) for k in range(1, _LENGTHS + 1)),
    ]


def with_figures(df: DataFrame, text: str, keep: list[Column | str], out: str = "figures") -> DataFrame:
    """The kept columns and the figures of each row's whole text, as an array of floats."""
    given = df.select(*keep, F.col(text).alias("__text"))
    schema = given.drop("__text").select("*", F.array().cast("array<float>").alias(out)).schema
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            made = [figures(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.list_(pa.float32()))], names)

    return given.mapInArrow(run, schema)


@dataclass
class Model:
    """Means and spreads of the figures, weights, and bias."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The estimated probability of the positive class, from 0 to 1."""
        g = np.clip((x - self.mean) / self.spread, -6, 6) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


@dataclass
class Sums:
    """What a pass adds up at weights w (bias last), over unlabelled rows (u) and positives (p): number, log(1 + e^g), its
    slope and curvature, and of the positives the figures themselves."""

    n_u: float
    loss_u: float
    slope_u: np.ndarray
    curve_u: np.ndarray
    n_p: float
    loss_p: float
    slope_p: np.ndarray
    curve_p: np.ndarray
    figures_p: np.ndarray

    @staticmethod
    def of(flat: np.ndarray, width: int) -> Sums:
        sizes = [1, 1, width, width * width, 1, 1, width, width * width, width]
        parts = np.split(flat, np.cumsum(sizes)[:-1])
        return Sums(*(float(x[0]) if n == 1 else x.reshape(width, width) if n == width * width else x for x, n in zip(parts, sizes, strict=True)))


def _added(rows: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sums, place by place, of a function of all rows' figures and marks (positive); of no rows, nothing."""
    given = rows.select("figures", "positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
                own = of(x, batch.column(1).to_numpy(zero_copy_only=False))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["place", "value"])

    made = given.mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).orderBy("place").collect()
    return np.array([r["value"] for r in made])


def _scaled(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return np.concatenate((np.clip((x - mean) / spread, -6, 6), np.ones((len(x), 1))), axis=1)


def _pass(rows: DataFrame, mean: np.ndarray, spread: np.ndarray, w: np.ndarray) -> Sums:
    def of(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        x = _scaled(x, mean, spread)
        g = np.clip(x @ w, -30, 30)
        s = 1 / (1 + np.exp(-g))
        out = []
        for some in (slice(None), positive):
            own, chance = x[some], s[some]
            out += [[len(own), np.logaddexp(0, g[some]).sum()], own.T @ chance, (own.T @ (own * (chance * (1 - chance))[:, None])).ravel()]
        return np.concatenate([*out, x[positive].sum(axis=0)])

    return Sums.of(_added(rows, of), len(w))


def _descend(rows: DataFrame, mean: np.ndarray, spread: np.ndarray, w: np.ndarray, ridge: float, risk: Callable[[Sums, np.ndarray], tuple[float, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Newton steps, halved where the risk has risen, one pass each. The bias has next to no ridge."""
    keep = ridge * np.append(np.ones(len(w) - 1), 1e-6)
    step, best, at = np.zeros_like(w), math.inf, w
    for _ in range(PASSES):
        value, slope, curve = risk(_pass(rows, mean, spread, w), w)
        value += 0.5 * float(keep @ (w * w))
        if value > best + 1e-9:
            step = step / 2
            w = at + step
            continue
        best, at = value, w
        slope = slope + keep * w
        if np.abs(slope).max() < FLAT:
            break
        step = -np.linalg.solve(curve + np.diag(keep), slope)
        w = w + step
    return at


def _told_apart(s: Sums, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The logistic risk of telling positives from unlabelled rows, each side with half the weight."""
    return (s.loss_u / s.n_u + (s.loss_p - s.figures_p @ w) / s.n_p) / 2, (s.slope_u / s.n_u + (s.slope_p - s.figures_p) / s.n_p) / 2, (s.curve_u / s.n_u + s.curve_p / s.n_p) / 2


def non_negative(prior: float) -> Callable[[Sums, np.ndarray], tuple[float, np.ndarray, np.ndarray]]:
    """The non-negative risk. l(g) - l(-g) is -g, so while the negatives' part isn't below zero the risk is convex."""

    def risk(s: Sums, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        of_positive = prior * (s.loss_p - s.figures_p @ w) / s.n_p
        negative = s.loss_u / s.n_u - prior * s.loss_p / s.n_p
        of_negative = s.slope_u / s.n_u - prior * s.slope_p / s.n_p
        slope = prior * (s.slope_p - s.figures_p) / s.n_p + of_negative if negative >= 0 else -of_negative
        return of_positive + max(0.0, negative), slope, s.curve_u / s.n_u

    return risk


def class_prior(rows: DataFrame, mean: np.ndarray, spread: np.ndarray, w: np.ndarray) -> float:
    """The least ratio of the shares of unlabelled rows and of positives above a level of score, each share moved by its
    own error twice, one over the root of its rows, against the least: the least of many noisy ratios is too low."""

    def of(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        level = np.clip(1 / (1 + np.exp(-np.clip(_scaled(x, mean, spread) @ w, -30, 30))) * LEVELS, 0, LEVELS - 1).astype(int)
        return np.concatenate([np.bincount(level, minlength=LEVELS), np.bincount(level[positive], minlength=LEVELS)]).astype(np.float64)

    u, p = np.split(_added(rows, of), 2)
    above = [np.cumsum(x[::-1])[::-1] / x.sum() for x in (u, p)]
    error = [1 / math.sqrt(x.sum()) for x in (u, p)]
    enough = above[1] >= LEAST_SHARE + error[1]
    return float(np.clip(((above[0][enough] + error[0]) / (above[1][enough] - error[1])).min(), *PRIOR_RANGE))


def learn(rows: DataFrame, labels: DataFrame, id_column: str = "doc_id", label: str = "quality", held_out: Column | None = None) -> Model:
    """The model for rows (id, figures) and labels (id, 0 or 1), from those that are not held out.

    An id is a trusted positive if all its labels are 1; ids with another label are not told apart from those without
    one. Null ids and null labels teach nothing. All rows count, none is sampled. Without positives or without rows
    nothing can be learnt, and every score is one half.
    """
    allowed = rows if held_out is None else rows.filter(~held_out)
    known = labels.filter(F.col(id_column).isNotNull() & F.col(label).isNotNull())
    known = known if held_out is None else known.filter(~held_out)
    trusted = stored(known.groupBy(id_column).agg(F.min(label).alias("least")).filter("least = 1").select(F.col(id_column).alias("trusted")), "trusted")
    n = trusted.count()
    marked = allowed.select("figures", F.col(id_column).alias("id")).join(F.broadcast(trusted) if n <= BROADCAST_IDS else trusted, F.col("id") == F.col("trusted"), "left")
    marked = stored(marked.select("figures", F.col("trusted").isNotNull().alias("positive")), "marked")
    first = _added(marked, lambda x, positive: np.concatenate(([len(x), positive.sum()], x.sum(axis=0), (x * x).sum(axis=0))))
    width = len(figures(""))
    if not len(first) or not first[1]:
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 0.5)
    mean = first[2 : 2 + width] / first[0]
    spread = np.sqrt(np.maximum(first[2 + width :] / first[0] - mean * mean, 0)) + 1e-3
    ridge = RIDGE / math.sqrt(first[1])
    prior = class_prior(marked, mean, spread, _descend(marked, mean, spread, np.zeros(width + 1), ridge, _told_apart))
    w = _descend(marked, mean, spread, np.append(np.zeros(width), math.log(prior / (1 - prior))), ridge, non_negative(prior))
    return Model(mean, spread, w[:-1], float(w[-1]), prior)


def scored(rows: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """rows without their figures, with the score of each."""
    schema = rows.drop("figures").select("*", F.lit(0.0).alias(out)).schema
    place = rows.columns.index("figures")
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(place).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            rest = [c for i, c in enumerate(batch.columns) if i != place]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(model.scores(x.astype(np.float64)), pa.float64())], names)

    return rows.mapInArrow(run, schema)
