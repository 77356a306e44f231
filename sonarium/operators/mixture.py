"""Gaussian mixtures with diagonal covariance: densities, responsibilities, and EM over rows of any number."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarium.functions.columns import order_key, uniform


@dataclass
class Mixture:
    """Weights (k), means and variances (k by d)."""

    weights: list[float]
    means: list[list[float]]
    variances: list[list[float]]

    def log_parts(self, x: list[Column]) -> list[Column]:
        """The log of each component's weighted density."""
        out = []
        for w, m, v in zip(self.weights, self.means, self.variances, strict=True):
            part = F.lit(math.log(w) - 0.5 * sum(math.log(2 * math.pi * s) for s in v))
            for xi, mi, vi in zip(x, m, v, strict=True):
                part = part - (xi - mi) * (xi - mi) / (2 * vi)
            out.append(part)
        return out


def log_density(x: list[Column], mix: Mixture) -> Column:
    parts = mix.log_parts(x)
    top = F.greatest(*parts) if len(parts) > 1 else parts[0]
    return top + F.ln(sum((F.exp(p - top) for p in parts[1:]), F.exp(parts[0] - top)))


def responsibilities(x: list[Column], mix: Mixture) -> list[Column]:
    whole = log_density(x, mix)
    return [F.exp(p - whole) for p in mix.log_parts(x)]


def m_step(df: DataFrame, dims: list[str], mix: Mixture) -> DataFrame:
    """k, weight, mean_i, var_i: the next parameters, by one pass of partial sums."""
    known = df.select(*dims, *(p.alias(f"__l{k}") for k, p in enumerate(mix.log_parts([F.col(d) for d in dims]))))  # worked out once a row
    logs = [F.col(f"__l{k}") for k in range(len(mix.weights))]
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    known = known.withColumn("__whole", top + F.ln(sum((F.exp(p - top) for p in logs[1:]), F.exp(logs[0] - top))))
    parts = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.exp(p - F.col("__whole")).alias("r")) for k, p in enumerate(logs)))).alias("p")
    rows = known.select(*dims, parts)
    r = F.col("p.r")
    sums = rows.groupBy(F.col("p.k").alias("k")).agg(F.sum(r).alias("__n"), F.count("*").alias("__rows"), *(F.sum(r * F.col(d)).alias(f"__s{i}") for i, d in enumerate(dims)), *(F.sum(r * F.col(d) * F.col(d)).alias(f"__q{i}") for i, d in enumerate(dims)))
    mean = lambda i: F.col(f"__s{i}") / F.col("__n")
    made = [(F.col("__n") / F.col("__rows")).alias("weight"), *(mean(i).alias(f"mean_{i}") for i in range(len(dims))), *((F.col(f"__q{i}") / F.col("__n") - mean(i) * mean(i)).alias(f"var_{i}") for i in range(len(dims)))]
    return sums.select("k", *made)


def initial(df: DataFrame, dims: list[str], k: int, seed: int, id_column: str) -> Mixture:
    """A first row by seed, then k - 1 times the row farthest from those chosen; variances of all rows."""
    point = lambda row: [float(row[d]) for d in dims]
    chosen = [point(df.orderBy(order_key(seed, F.col(id_column)), id_column).first())]
    for _ in range(k - 1):
        gaps = [sum(((F.col(d) - c) * (F.col(d) - c) for d, c in zip(dims[1:], p[1:], strict=True)), (F.col(dims[0]) - p[0]) * (F.col(dims[0]) - p[0])) for p in chosen]
        chosen.append(point(df.orderBy(F.desc(F.least(*gaps) if len(gaps) > 1 else gaps[0]), id_column).first()))
    spread = df.agg(*(F.var_pop(d).alias(d) for d in dims)).first()
    return Mixture([1 / k] * k, chosen, [[max(float(spread[d]), 1e-6) for d in dims]] * k)


def fit(df: DataFrame, dims: list[str], k: int, id_column: str, seed: int = 0, steps: int = 50, tolerance: float = 1e-4) -> Mixture:
    """EM until the mean log-likelihood changes by less than the tolerance; each step is one aggregation of k rows."""
    mix, last = initial(df, dims, k, seed, id_column), -math.inf
    for _ in range(steps):
        rows = sorted(m_step(df, dims, mix).collect(), key=lambda r: r["k"])
        mix = Mixture([r["weight"] for r in rows], [[r[f"mean_{i}"] for i in range(len(dims))] for r in rows], [[max(r[f"var_{i}"], 1e-6) for i in range(len(dims))] for r in rows])
        now = df.agg(F.avg(log_density([F.col(d) for d in dims], mix))).first()[0]
        if abs(now - last) < tolerance:
            break
        last = now
    return mix


def sample(mix: Mixture, n: int, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    kind = rng.choice(len(mix.weights), n, p=np.array(mix.weights) / sum(mix.weights))
    return rng.normal(np.array(mix.means)[kind], np.sqrt(np.array(mix.variances)[kind]))


def match_greedy(cost: np.ndarray) -> list[int]:
    """For each row, in order, the cheapest column that no earlier row has."""
    cost, taken = np.array(cost, float), []
    for row in cost:
        row = row.copy()
        row[taken] += 1e6
        taken.append(int(np.argmin(row)))
    return taken


def cosine_schedule(time: Column, low: float = 0.02, high: float = 0.95) -> tuple[Column, Column]:
    """Noise and signal rate of a diffusion time from 0 to 1."""
    angle = math.acos(high) + time * (math.acos(low) - math.acos(high))
    return F.sin(angle), F.cos(angle)


def diffusion_step(x: Column, noise: Column, now: tuple[Column, Column], after: tuple[Column, Column]) -> tuple[Column, Column]:
    """The image that a noise estimate implies, and the state at the next pair of rates."""
    image = (x - now[0] * noise) / now[1]
    return image, after[1] * image + after[0] * noise


def posterior_sample(df: DataFrame, dims: list[str], mix: Mixture, id_column: str, n: int = 1, seed: int = 0) -> DataFrame:
    """id, draw, k: components drawn by their responsibilities, following from seed, id and draw."""
    r = responsibilities([F.col(d) for d in dims], mix)
    upto, total = [], F.lit(0.0)
    for part in r[:-1]:
        total = total + part
        upto.append(total)
    drawn = df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("__u", uniform(str(seed), F.col(id_column), F.col("draw")))
    k = sum((F.when(F.col("__u") >= u, 1).otherwise(0) for u in upto), F.lit(0))
    return drawn.select(id_column, "draw", k.alias("k"))


def noisy(x: Column, noise: Column, rates: tuple[Column, Column]) -> Column:
    """An image at a pair of noise and signal rates."""
    return rates[1] * x + rates[0] * noise


def guided_step(x: Column, noise: Column, now: tuple[Column, Column], after: tuple[Column, Column], measured: Column, mask: Column, strength: float = 1.0) -> tuple[Column, Column]:
    """diffusion_step with the image drawn towards what was measured: less strength times the slope of half the squared
    difference where the mask is one."""
    image, state = diffusion_step(x, noise, now, after)
    pull = strength * mask * (image - measured)
    return image - pull, state - after[1] * pull
