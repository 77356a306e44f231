"""Connected components of a graph given as edges: edges contracted task by task, then rounds of large-star and
small-star (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarium.llm.shared import stored

#: Edges that a task has, some of them; fewer tasks than the session's suffice for few edges.
TASK_EDGES = 50_000
#: Tasks among which edges are dealt at most.
MOST_TASKS = 10_000
#: Up to so many edges (16 bytes each) the table of least neighbours goes to every task; above, it is joined.
BROADCAST_EDGES = 500_000
#: Edges that a task contracts at once.
AT_ONCE = 1 << 20


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every vertex to the least one of what these edges connect, but from that one itself."""
    names, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(names))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while not np.array_equal(flat := root[root], root):
            root = flat
    own = np.flatnonzero(root != np.arange(len(root)))
    return names[own], names[root[own]]


def contracted(edges: DataFrame) -> DataFrame:
    """The edges of each task, contracted some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        count = 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in contract(*(np.concatenate(c) for c in zip(*held, strict=True)))], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy() for c in batch.columns])
                count += batch.num_rows
            if count >= AT_ONCE:
                yield made()
                held, count = [], 0
        if held:
            yield made()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def _signature(edges: DataFrame) -> tuple:
    hashed = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum((hashed % 1_000_003).cast("long")), F.bit_xor(hashed)).first())


def components(edges: DataFrame) -> DataFrame:
    """vertex and root, the least vertex of its component, for each vertex of edges a, b (longs, in either order).

    Vertices without an edge to another are left out, and so are edges with a null. Every task first contracts what
    edges it has. Every round then takes an edge's lower end to the least neighbour of that, and all lower neighbours of
    a vertex to the least of them: an aggregation and a join each, over tasks as many as the edges need. A hub's edges
    stay where they are while the other side is small enough to go to every task; above, the join is Spark's to split.
    Rounds are written to the shared folder, so that none is done again. No edges: no rows.
    """
    given = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b")
    found = stored(contracted(given), "edges")
    last = _signature(found)
    while last[0]:
        tasks = min(MOST_TASKS, -(-last[0] // TASK_EDGES))
        if tasks == 1:  # few edges, which one task contracts to the components themselves
            found = stored(contracted(found.repartition(1)), "edges")
            break
        small = F.broadcast if last[0] <= BROADCAST_EDGES else lambda x: x
        least = lambda df: df.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        large = found.join(small(least(found)), F.col("b") == F.col("u"), "left").select("a", F.coalesce("m", "b").alias("b"))
        large = large.repartition(tasks, "a").distinct()
        joined = large.join(small(least(large)), F.col("a") == F.col("u"))
        moved = joined.select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        moved = moved.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).filter("a > b").repartition(tasks, "a").distinct()
        found = stored(contracted(moved), "edges")
        now = _signature(found)
        if now == last:
            break
        last = now
    children = found.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    return children.unionByName(children.select(F.col("root").alias("vertex"), "root").distinct())
