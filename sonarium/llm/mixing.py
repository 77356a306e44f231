"""Mixing sources to target weights by weighted fair queueing.

Documents are shuffled within their source. Each gets a virtual finish time: the words its source has served with it,
over the source's target. The documents of all sources, sorted by finish time, are taken until the total budget is
spent. A source whose target exceeds its size is gone through again, at most `most` times.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sonarium.llm.shared import SPACE, stored

#: Rows of a source that one task puts in order; copies of one row that one task counts.
RUN_ROWS = 4096
#: Up to so many sources their table is broadcast (some 10 MB); above, it is joined.
BROADCAST_SOURCES = 100_000
#: Ranges of finish time that are summed up at once, and rows of a range that are put in order.
RANGES, RANGE_ROWS = 4096, 50_000
#: Parts into which equal rows are dealt to be numbered.
DEALT = 64


def weights_of(sources: list[str | None], cycle: tuple[float, ...] = (1, 2, 3)) -> dict[str | None, float]:
    """Weights dealt in turn to the sources by code point, null last."""
    order = sorted(s for s in sources if s is not None) + [None] * (None in sources)
    return {s: cycle[i % len(cycle)] for i, s in enumerate(order)}


def targets_of(sizes: dict, weights: dict, budget: float, most: int = 3) -> dict:
    """Shares of the budget by weight, none above `most` times its source's size; the excess is shared out again."""
    capped: set = set()
    while True:
        rest = budget - sum(most * sizes[s] for s in capped)
        total = sum(weights[s] for s in sizes if s not in capped)
        level = rest / total if total else 0.0
        over = {s for s in sizes if s not in capped and level * weights[s] > most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) if s in capped else level * weights[s] for s in sizes}
        capped |= over


def mix(df: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.0, cycle: tuple[float, ...] = (1, 2, 3), most: int = 3, seed: str = "mix") -> DataFrame:
    """df's columns and a struct __mix of size, source_size, target and copies.

    size is the text's number of words (null: 0); the budget is share times all sizes. copies says how often the mix
    takes the document, from 0 to `most`. The order within a source follows md5 of seed and id, then id and size, so
    reruns agree whatever the partitions. Rows equal in all of these finish one after another too: of n of them some k
    may be taken once more than the others, and which is all one. Documents of several sources that finish at the very
    same time are taken or left together. An empty df gives an empty one; columns of any name stay, but for __mix.

    Finish times are worked out on rows of id and size alone, equal ones counted first, so neither a hot source nor a
    hot id weighs on one task: sources are cut into runs of some RUN_ROWS distinct rows by hash, whose sums are added up.
    As times rise along a source's order, all that the documents themselves need is, for each source and round, the last
    place that is taken: the texts aren't shuffled. A row a source comes to the driver.
    """
    spark = df.sparkSession
    columns = df.columns
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("null"))))
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit("[^" + SPACE[1:])).cast("long")
    place = F.struct(key.alias("key"), F.col(id_column).alias("id"), size.alias("size"))
    sized = stored(df.select(F.col(source).alias("source"), place.alias("place")), "sizes")
    sums = sized.groupBy("source").agg(F.sum("place.size").alias("size"), F.count("*").alias("n")).collect()
    sizes, rows = {r["source"]: r["size"] for r in sums}, {r["source"]: r["n"] for r in sums}
    weights = weights_of(list(sizes), cycle)
    budget = share * sum(sizes.values())
    targets = targets_of(sizes, weights, budget, most)
    table = [(s, k, sizes[s], targets[s], max(1, -(-rows[s] // RUN_ROWS))) for k, s in enumerate(weights)]
    kind = df.schema[source].dataType.simpleString()
    small = F.broadcast if len(table) <= BROADCAST_SOURCES else lambda x: x
    sources = spark.createDataFrame(table, f"name {kind}, rank long, total long, target double, runs long")
    equal = sized.groupBy("source", "place").agg(F.count("*").alias("n"))
    joined = equal.join(small(sources), F.col("source").eqNullSafe(F.col("name")))
    part = F.conv(F.substring("place.key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    own = F.col("n") * F.col("place.size")
    runs = joined.select("rank", "total", "target", "place", "n", own.alias("own"), F.floor(part * F.col("runs")).alias("run"))
    before = Window.partitionBy("rank").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.groupBy("rank", "run").agg(F.sum("own").alias("sum")).select("rank", "run", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("offset"))
    within = F.sum("own").over(Window.partitionBy("rank", "run").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    served = runs.withColumn("within", within).join(offsets, ["rank", "run"])
    served = stored(served.select("rank", "total", "target", "place", "n", (F.col("offset") + F.col("within") - F.col("own")).alias("before")), "served")
    finish = lambda e, j: F.try_divide(F.lit(e) * F.col("total") + F.col("before") + j * F.col("place.size"), F.col("target"))
    last = _last_finish(_times(served, finish, most), budget)
    taken = [_taken(finish, e, last) for e in range(most)]
    counted = served.select("rank", "place", "n", *(k.alias(f"k{e}") for e, k in enumerate(taken)))
    whole = [F.max(F.when(F.col(f"k{e}") == F.col("n"), F.col("place"))).alias(f"cut{e}") for e in range(most)]
    some = [F.max(F.when((F.col(f"k{e}") > 0) & (F.col(f"k{e}") < F.col("n")), F.struct("place", f"k{e}"))).alias(f"some{e}") for e in range(most)]
    plan = stored(sources.drop("runs").join(counted.groupBy("rank").agg(*whole, *some), "rank", "left"), "cuts")
    row = F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row")
    placed = df.select(row, place.alias("place"), F.col(source).alias("source")).join(small(plan), F.col("source").eqNullSafe(F.col("name")))
    shared = [F.col(f"some{e}.place").eqNullSafe(F.col("place")) & F.col(f"some{e}").isNotNull() for e in range(most)]
    copies = lambda number: sum(F.when(F.col("place") <= F.col(f"cut{e}"), 1).when(shared[e] & (number < F.col(f"some{e}.k{e}")), 1).otherwise(0) for e in range(most))
    made = lambda number: F.struct(F.col("place.size").alias("size"), F.col("total").alias("source_size"), F.col("target"), copies(number).cast("long").alias("copies")).alias("__mix")
    out = [F.col(f"row.`{c}`").alias(c) for c in columns]
    if plan.filter(" OR ".join(f"some{e} IS NOT NULL" for e in range(most))).isEmpty():
        return placed.select(*out, made(F.lit(0)))
    is_shared = functools.reduce(lambda a, b: a | b, shared)
    numbered = _numbered(placed.filter(is_shared))
    return placed.filter(~is_shared).select(*out, made(F.lit(0))).unionByName(numbered.select(*out, made(F.col("number"))))


def _times(served: DataFrame, finish: Callable[[int, Column], Column], most: int) -> DataFrame:
    """size and finish of every copy of every row, in every round. Many copies are dealt out before they are counted."""
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN_ROWS)))
    dealt = served.withColumn("block", blocks)
    if not served.filter(F.col("n") > RUN_ROWS).isEmpty():
        dealt = dealt.repartition("rank", "place", "block")
    first = F.col("block") * RUN_ROWS + 1
    copies = dealt.withColumn("j", F.explode(F.sequence(first, F.least(F.col("n"), first + RUN_ROWS - 1))))
    return copies.select(F.col("place.size").alias("size"), F.explode(F.array(*(finish(e, F.col("j")) for e in range(most)))).alias("finish")).filter("finish is not null")


def _taken(finish: Callable[[int, Column], Column], e: int, last: float) -> Column:
    """How many of n equal rows finish by the last time in a round: an estimate, put right by one where rounding has it."""
    n, size = F.col("n"), F.col("place.size")
    about = F.floor(F.try_divide(F.lit(min(last, 1e300)) * F.col("target") - e * F.col("total") - F.col("before"), size))
    about = F.greatest(F.lit(0).cast("long"), F.least(n, F.coalesce(F.when(about > n.cast("double"), n).otherwise(about.cast("long")), F.lit(0).cast("long"))))
    by = lambda j: F.coalesce(finish(e, j) <= last, F.lit(False))
    put = F.when((about < n) & by(about + 1), about + 1).when((about > 0) & ~by(about), about - 1).otherwise(about)
    return F.when(by(n), n).otherwise(put)


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with a number among those of equal source and place; they are dealt out, numbered in parts, and these counted."""
    dealt = stored(rows.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(DEALT))), "equal-rows")
    before = Window.partitionBy("rank", "place").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("rank", "place", "part").count()
    offsets = counts.select("rank", "place", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("rank", "place", "part").orderBy("part"))
    return dealt.withColumn("own", own).join(offsets, ["rank", "place", "part"]).withColumn("number", F.col("own") + F.col("offset") - 1)


def _last_finish(times: DataFrame, budget: float) -> float:
    """The latest finish time up to which all documents together fit the budget.

    RANGES ranges of finish time are summed up, then those of the range in which the budget ends, until it holds few
    rows; only these are put in order.
    """
    low, width, spent, inner = 0.0, 4.0, 0, times  # most finish by 1; what is later than 4 has one range
    while True:
        at = F.least(F.floor((F.col("finish") - low) * (RANGES / width)), F.lit(RANGES))
        ranged = inner.withColumn("range", F.greatest(at, F.lit(0).cast("long")))
        for r in sorted(ranged.groupBy("range").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("finish").alias("least"), F.max("finish").alias("most")).collect(), key=lambda r: r["range"]):
            if spent + r["size"] > budget:
                break
            spent += r["size"]
        else:
            return math.inf
        inner = ranged.filter(F.col("range") == r["range"]).drop("range")
        if r["n"] <= RANGE_ROWS or r["least"] == r["most"]:
            ordered = inner.groupBy("finish").agg(F.sum("size").alias("size"))
            upto = F.sum("size").over(Window.orderBy("finish").rowsBetween(Window.unboundedPreceding, 0))  # of RANGE_ROWS rows
            found = ordered.select("finish", upto.alias("upto")).filter(F.col("upto") + spent <= budget).agg(F.max("finish").alias("last")).first()["last"]
            return math.nextafter(r["least"], -math.inf) if found is None else found
        low, width = r["least"], max(r["most"] - r["least"], 1e-300)


def mixed(df: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mixture itself: every row of df as often as the mix takes it, with df's columns."""
    made = mix(df, id_column, text, source, **options)
    return made.select(F.explode(F.array_repeat(F.struct(*(F.col(f"`{c}`") for c in df.columns)), F.col("__mix.copies").cast("int"))).alias("row")).select("row.*")
