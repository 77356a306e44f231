"""Choosing scan lines: masks, greedy entropy, and covariance sampling."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sonarium.functions.columns import order_key


def random_lines(masks: DataFrame, n: int, n_lines: int, seed: int, mask: str = "mask") -> DataFrame:
    """mask, line of exactly n lines a mask, those with the least keys."""
    lines = masks.withColumn("line", F.explode(F.sequence(F.lit(0), F.lit(n_lines - 1))))
    place = F.row_number().over(Window.partitionBy(mask).orderBy(order_key(seed, F.col(mask), F.col("line")), "line"))
    return lines.withColumn("__place", place).filter(F.col("__place") <= n).drop("__place")


def equispaced_lines(n: int, n_lines: int, shift: int = 0) -> list[int]:
    """n evenly spaced lines, moved around by a shift."""
    if n_lines % n == 0:
        first = list(range(0, n_lines, n_lines // n))
    else:
        first = [int(k * (n_lines - 1) / max(1, n - 1)) for k in range(n)]
    return sorted((line + shift) % n_lines for line in first)


def line_mask(lines: DataFrame, height: int, width: int, n_lines: int) -> DataFrame:
    """Cells of an image with 1 where a chosen line runs; lines are width / n_lines columns wide."""
    if width % n_lines:
        raise ValueError("the width has to be a multiple of the number of lines")
    columns = lines.withColumn("x", F.explode(F.sequence(F.col("line") * (width // n_lines), (F.col("line") + 1) * (width // n_lines) - 1)))
    return columns.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("value", F.lit(1))


def line_entropy(particles: DataFrame, keys: list[str], width: int, n_lines: int, std: float = 1.0, value: str = "value") -> DataFrame:
    """keys, line, entropy: exp(d^2 / 2 s^2) of all pairs of particles, summed over a line's pixels.

    particles: keys, particle, z, x, value. Pairs are made within a group at a pixel; groups are the few particles of
    one belief.
    """
    line = F.floor(F.col("x") / (width // n_lines)).cast("int")
    a = particles.select(*keys, "z", "x", F.col(value).alias("__a"))
    b = particles.select(*keys, "z", "x", F.col(value).alias("__b"))
    error = F.exp((F.col("__a") - F.col("__b")) * (F.col("__a") - F.col("__b")) / (2 * std * std))
    return a.join(b, [*keys, "z", "x"]).groupBy(*keys, line.alias("line")).agg(F.sum(error).alias("entropy"))


def greedy_lines(entropy: DataFrame, keys: list[str], n: int, n_lines: int, neighbours: int = 5) -> DataFrame:
    """keys, step, line: n times the line of most entropy (the first of equals); then it and its neighbours are damped.

    The damping is 1 - exp(-x^2 / 2) at evenly spaced places from -2 to 2. A group is one row of n_lines numbers.
    """
    shape = [1 - math.exp(-0.5 * (-2 + 4 * k / (neighbours - 1)) ** 2) for k in range(neighbours)]
    half = neighbours // 2
    rows = entropy.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("line", "entropy"))).alias("__rows"))
    df = rows.select(*keys, F.transform("__rows", lambda r: r["entropy"]).alias("__e"), F.array().cast("array<int>").alias("__chosen"))
    for _ in range(n):
        best = F.array_position("__e", F.array_max("__e")).cast("int") - 1
        df = df.withColumn("__best", best).withColumn("__chosen", F.array_append("__chosen", F.col("__best")))
        table = F.array(*(F.lit(s) for s in shape))
        df = df.withColumn("__e", F.transform("__e", lambda e, i: e * F.coalesce(F.get(table, i - F.col("__best") + half), F.lit(1.0))))
    return df.select(*keys, F.posexplode("__chosen").alias("step", "line"))


def covariance_lines(particles: DataFrame, keys: list[str], n: int, n_lines: int, n_masks: int = 200, seed: int = 42, value: str = "value") -> DataFrame:
    """keys, lines: of random masks of n lines, that whose lines' covariance over particles has the largest logdet.

    particles: keys, particle, line, value (a mean or sum over the line). A group is one belief's particles.
    """
    kinds = ", ".join(f"{k} {particles.schema[k].dataType.simpleString()}" for k in keys)

    def best(group: pd.DataFrame) -> pd.DataFrame:
        table = group.pivot_table(index="particle", columns="line", values=value).to_numpy()
        cov = np.atleast_2d(np.cov(table, rowvar=False)) + 1e-9 * np.eye(table.shape[1])
        rng = np.random.default_rng(seed)
        masks = [np.sort(rng.permutation(n_lines)[:n]) for _ in range(n_masks)]
        scores = [np.linalg.slogdet(cov[np.ix_(m, m)])[1] for m in masks]
        return pd.DataFrame([[*(group[k].iloc[0] for k in keys), masks[int(np.argmax(scores))].tolist()]], columns=[*keys, "lines"])

    return particles.groupBy(*keys).applyInPandas(best, f"{kinds}, lines array<int>")


def top_k(df: DataFrame, keys: list[str], k: int, value: str = "value", index: str = "pos") -> DataFrame:
    """Cells with 1 at a group's k largest values (the first of equals), else 0."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), index))
    return df.withColumn("hot", (place <= k).cast("int"))
