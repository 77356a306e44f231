"""Near-duplicate documents by the similarity of their shingle sets, with SimHash fingerprints of many words.

Blocks of bits drawn from a fingerprint's first words bring candidates together; in a bucket, rows of distances to fixed
reference fingerprints (pivots) discard pairs by their largest difference, and the last words are compared. What hangs
together by candidates is then compared by the shingle sets themselves, so links are exact. Buckets and groups of any
size are dealt to tasks in chunks first, whose links join nearly all of a group of true copies in linear work; only
where parts stay apart are chunks compared with chunks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarium.llm.components import components
from sonarium.llm.shared import pieces, release, stored
from sonarium.llm.simhash import BOTH, SEED, linked, majority, mixed, shingles, spread

#: Words of a fingerprint from whose bits blocks are drawn, and further ones that are compared within a bucket.
DRAWN, COMPARED = 16, 2
#: Blocks that are dealt out at once; their shuffle files go before the next ones' are written.
BLOCKS_AT_ONCE = 64
#: A bucket of more rows than this is compared in chunks.
BUCKET = 2048
#: Vertices are counted in a sample of one in so many to find such buckets; one that is missed is compared whole.
SAMPLE = 16
#: A group of more texts, or more shingles, than this is compared in chunks.
GROUP_TEXTS, GROUP_SHINGLES = 1024, 4 << 20
#: Times that a large group's chunks are dealt anew before chunks are compared with chunks.
DEALS = 2
#: Fewer shingles than this leave an estimate too coarse to pass a pair over by.
LEAST_SHINGLES = 100
#: Up to so many keys a table is broadcast (a few MB); above, it is joined.
BROADCAST_KEYS = 100_000


@dataclass(frozen=True)
class Plan:
    """Bits of the blocks (masks of the drawn words, one row a block), the radius of the compared words, and that of all."""

    masks: np.ndarray
    radius: int
    radius_all: int


def differing(similarity: float) -> float:
    """How often a bit of two sets' fingerprints differs, at a Jaccard similarity: the angle between the sets over pi."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def _radius(bits: int, differ: float, passing: float) -> int:
    """The least radius within which so many of the pairs are whose bits differ that often (binomial)."""
    total, r = 0.0, 0
    while True:
        total += math.comb(bits, r) * differ**r * (1 - differ) ** (bits - r)
        if total >= passing:
            return r
        r += 1


def plan(rows: int, similarity: float, recall: float = 0.995) -> Plan:
    """A block has four bits fewer than it takes to number the rows, so that some sixteen rows share it by chance. Blocks
    are drawn until so many of 10,000 drawn pairs, just so similar, agree on one and are within the radius; the more
    rows, the more blocks: some rows ** 0.24 of them at similarity 0.8.
    """
    differ, size = differing(similarity), 64 * DRAWN
    bits = min(32, max(8, math.ceil(math.log2(max(rows, 2))) - 4))
    radius = _radius(64 * COMPARED, differ, 0.9995)
    draws = np.random.default_rng(SEED)
    apart = draws.random((10_000, size), np.float32) < differ
    within = draws.binomial(64 * COMPARED, differ, len(apart)) <= radius
    found, masks = np.zeros(len(apart), bool), []
    while (found & within).mean() < recall:
        own = draws.choice(size, bits, replace=False)
        found |= ~apart[:, own].any(axis=1)
        words = [0] * DRAWN
        for b in own.tolist():
            words[b // 64] |= 1 << b % 64
        masks.append(words)
    return Plan(np.array(masks, np.uint64), radius, _radius(64 * (DRAWN + COMPARED), differ, 0.9995))


def fingerprint(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The words of a set's fingerprint, from the distinct hashes of its shingles; of none, zeros.

    Of an even number, half the bits of a fixed pattern break ties, alike in all texts.
    """
    if not len(hashes):
        return np.zeros(len(factors), np.uint64)
    if len(hashes) % 2 == 0:
        hashes = np.append(hashes, np.uint64(0x9E3779B97F4A7C15))
    step, out = max(1, (1 << 19) // len(hashes)), []
    for i in range(0, len(factors), step):
        own = hashes[None, :] * factors[i : i + step, None]
        own ^= own >> np.uint64(32)
        out.append(majority(own))
    return np.concatenate(out)


def hashes_of(text: str | None, n: int) -> np.ndarray:
    """The hashes of a text's distinct n-word shingles, in order; of a null text or one without words, none."""
    cut = shingles(text, n)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(SEED)), np.uint64, len(cut)))


def fingerprints(df: DataFrame, text: str, keep: list[Column], n: int) -> DataFrame:
    """The kept columns and fingerprint, an array of longs, of the text's distinct n-word shingles."""
    given = df.select(*keep, F.col(text).alias("__text"))
    schema = given.drop("__text").select("*", F.array().cast("array<long>").alias("fingerprint")).schema
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = spread(DRAWN + COMPARED, SEED)
        for batch in pieces(batches):
            made = [fingerprint(hashes_of(t, n), factors) for t in batch.column(batch.num_columns - 1).to_pylist()]
            flat = np.concatenate([*made, np.zeros(0, np.uint64)]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * len(factors)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names)

    return given.mapInArrow(run, schema)


def _blocks(vertices: DataFrame, masks: np.ndarray, first: int) -> DataFrame:
    """A row per vertex and block: the key, the vertex, and the words to compare."""
    names = ["key", "vertex", *(f"c{i}" for i in range(COMPARED))]
    factors = spread(DRAWN, 11)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(1).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)
            words = [np.ascontiguousarray(values[:, w]) for w in range(DRAWN)]
            compared = [pa.array(np.ascontiguousarray(values[:, DRAWN + i]).view(np.int64)) for i in range(COMPARED)]
            for j, own in enumerate(masks):
                key = np.zeros(batch.num_rows, np.uint64)
                for w in np.flatnonzero(own).tolist():
                    key += (words[w] & own[w]) * factors[w]
                yield pa.RecordBatch.from_arrays([pa.array(mixed(key, (first + j + 1) * 0x5851F42D4C957F2D & (1 << 64) - 1).view(np.int64)), batch.column(0), *compared], names)

    return vertices.select("vertex", "fingerprint").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _chunked(key: str | Column, vertex: str | Column, parts: Column, deal: int) -> Column:
    """The key of a row's chunk, one of so many parts of its key's rows; where parts are null, of all of them."""
    key = F.col(key) if isinstance(key, str) else key
    return F.when(parts.isNull(), key).otherwise(F.xxhash64(key, F.lit(deal), F.pmod(F.xxhash64(F.lit(deal), key, vertex), parts)))


def _tiled(rows: DataFrame, key: str, parts: str) -> DataFrame:
    """rows as often as their key has parts, with side, each pair of a key's chunks as a key of its own: in it rows of
    unlike sides are compared, or all where a chunk meets itself."""
    own = F.pmod(F.xxhash64(F.lit(DEALS), key, "vertex"), F.col(parts))
    rows = rows.withColumn("__own", own).withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1)))
    low, high = F.least("__own", "__other"), F.greatest("__own", "__other")
    side = F.when(low == high, BOTH).otherwise((F.col("__own") > F.col("__other")).cast("int")).cast("long")
    return rows.withColumns({"side": side, key: F.xxhash64(key, low, high)}).drop("__own", "__other", parts)


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_KEYS else df


def candidates(vertices: DataFrame, made: Plan, bucket: int = BUCKET, sample: int = SAMPLE) -> DataFrame:
    """Links a, b that connect all vertices (vertex, fingerprint) which share a block and are within the radius.

    Blocks are dealt out some at a time. A bucket of many rows is compared in chunks; where the links of all blocks
    leave parts of it apart, its chunks are compared with one another too, those already connected passed over.
    """
    spark = vertices.sparkSession
    few = vertices.filter(F.pmod(F.xxhash64("vertex"), F.lit(sample)) == 0)
    links, held = spark.createDataFrame([], "a long, b long"), []
    for at in range(0, len(made.masks), BLOCKS_AT_ONCE):
        masks = made.masks[at : at + BLOCKS_AT_ONCE]
        counts = _blocks(few, masks, at).groupBy("key").count().filter(F.col("count") > bucket / sample)
        hot = stored(counts.select("key", F.ceil(F.col("count") * sample / bucket).alias("parts")), "hot")
        rows, n = _blocks(vertices, masks, at), hot.count()
        if n:
            rows = rows.join(_small(hot, n), "key", "left").withColumn("key", _chunked("key", "vertex", F.col("parts"), 0))
            held.append((at, masks, hot, n))
        links = links.unionByName(stored(linked(rows, made.radius, COMPARED), "links"))
        release(spark)
    if not held:
        return links
    group = components(links).withColumnRenamed("root", "group")
    for at, masks, hot, n in held:
        rows = _blocks(vertices, masks, at).join(_small(hot, n), "key").join(group, "vertex", "left").withColumn("group", F.coalesce("group", "vertex"))
        rows = stored(rows, "hot-rows")
        apart = stored(rows.groupBy("key").agg(F.min("group").alias("one"), F.max("group").alias("other")).filter("one <> other").select("key"), "apart")
        if (left := apart.count()):
            links = links.unionByName(stored(linked(_tiled(rows.join(_small(apart, left), "key"), "key", "parts"), made.radius, COMPARED), "links"))
        release(spark)
    return links


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least so much."""
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def confirm(vertex: list[int], sets: list[np.ndarray], similarity: float, radius: int, side: np.ndarray | None = None, group: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that span the graph of the pairs of sets that are so similar; pairs are taken by their distance in the list,
    those already connected, by links or as one group, are passed over, and with sides all of one side but BOTH.

    In long lists fingerprints of the sets go before: pairs outside the radius that no pair so similar leaves are
    passed over, if both have enough shingles to tell.
    """
    n, size = len(sets), np.array([len(s) for s in sets])
    prints = None
    if n >= 16:
        factors = spread(DRAWN + COMPARED, SEED)
        prints = np.stack([fingerprint(s, factors) for s in sets])
    root, links = np.arange(n), []
    if group is not None:
        _, first, of = np.unique(group, return_index=True, return_inverse=True)
        root = first[of]

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for s in range(1, n):
        if s % 16 == 0:
            while not np.array_equal(flat := root[root], root):
                root[:] = flat
            if (root == root[0]).all():
                break
        at = np.flatnonzero(root[:-s] != root[s:])
        if side is not None:
            at = at[(side[at] == BOTH) | (side[at] != side[at + s])]
        least, most = np.minimum(size[at], size[at + s]), np.maximum(size[at], size[at + s])
        at, least = at[least >= similarity * most - 1e-9], least[least >= similarity * most - 1e-9]
        if prints is not None and len(at):
            far = np.bitwise_count(prints[at] ^ prints[at + s]).sum(axis=1, dtype=np.int32) > radius
            at = at[~far | (least < LEAST_SHINGLES)]
        for i in at.tolist():
            a, b = top(i), top(i + s)
            if a != b and similar(sets[i], sets[i + s], similarity):
                root[max(a, b)] = min(a, b)
                links.append((vertex[i], vertex[i + s]))
    return links


def _confirmed(rows: DataFrame, similarity: float, radius: int) -> DataFrame:
    """Links a, b between the rows (key, vertex, set; side and group if given) of a key, dealt and taken by key."""
    extra = [c for c in ("side", "group") if c in rows.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, vertex, sets, more = None, [], [], [[] for _ in extra]

        def links() -> pa.RecordBatch:
            found = confirm(vertex, sets, similarity, radius, **{c: np.array(v) for c, v in zip(extra, more, strict=True)}) if len(vertex) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            values = [c.to_pylist() if i != 2 else c for i, c in enumerate(batch.columns)]
            for i in range(batch.num_rows):
                if values[0][i] != now:
                    if vertex:
                        yield links()
                    now, vertex, sets, more = values[0][i], [], [], [[] for _ in extra]
                if vertex and vertex[-1] == values[1][i]:  # a repeated row
                    continue
                vertex.append(values[1][i])
                sets.append(np.frombuffer(values[2][i].as_py(), np.uint64))
                for held, column in zip(more, values[3:], strict=True):
                    held.append(column[i])
        if vertex:
            yield links()

    return rows.select("key", "vertex", "set", *extra).repartition("key").sortWithinPartitions("key", "vertex").mapInArrow(run, "a long, b long")


def _sets(texts: DataFrame, n: int) -> DataFrame:
    """root, vertex, set (the sorted hashes as bytes) and size of rows of root, vertex and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = [hashes_of(t, n) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())], ["root", "vertex", "set", "size"])

    return texts.mapInArrow(run, "root long, vertex long, set binary, size long")


def true_links(members: DataFrame, similarity: float, radius: int, texts: int = GROUP_TEXTS, shingles: int = GROUP_SHINGLES) -> DataFrame:
    """Links a, b that connect all vertices of a root (members: root, vertex, set, size) that pairs so similar connect.

    A root with many texts or shingles is compared in chunks, dealt anew a few times. What is still apart then is
    compared chunk by chunk, at a cost of the square of its size; each task holds two chunks.
    """
    sizes = members.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    parts = F.ceil(F.greatest(F.col("n") / texts, F.col("total") / shingles)).alias("parts")
    large = stored(sizes.select("root", parts).filter("parts > 1"), "large")
    n = large.count()
    rows = members.join(_small(large, n), "root", "left") if n else members.withColumn("parts", F.lit(None).cast("long"))
    links = stored(_confirmed(rows.withColumn("key", _chunked("root", "vertex", F.col("parts"), 0)), similarity, radius), "true")
    if not n:
        return links
    rows = members.join(_small(large, n), "root")
    for deal in range(1, DEALS + 1):
        group = components(links).withColumnRenamed("root", "group")
        known = stored(rows.drop("set").join(group, "vertex", "left").withColumn("group", F.coalesce("group", "vertex")).select("root", "vertex", "group"), "known")
        apart = stored(known.groupBy("root").agg(F.min("group").alias("one"), F.max("group").alias("other")).filter("one <> other").select("root"), "apart")
        left = apart.count()
        if not left:
            break
        still = rows.join(_small(apart, left), "root").join(known.drop("root"), "vertex")
        if deal < DEALS:
            still = still.withColumn("key", _chunked("root", "vertex", F.col("parts"), deal))
        else:
            still = _tiled(still.withColumn("key", F.col("root")), "key", "parts")
        links = links.unionByName(stored(_confirmed(still, similarity, radius), "true"))
        release(members.sparkSession)
    return links


def one_of_each(df: DataFrame, id_column: str = "doc_id", text: str = "text", n: int = 5, similarity: float = 0.8, recall: float = 0.995, bucket: int = BUCKET, sample: int = SAMPLE) -> DataFrame:
    """One row of df for each group of near-duplicates, with df's columns: that with the group's least id.

    Rows link if their sets of distinct n-word shingles are `similarity` alike or more (Jaccard). Fingerprints find
    candidates, a pair just so alike with probability `recall` (drawn pairs of sets with many shingles), more alike ones
    surely; the sets themselves are compared then, so no link is wrong. Null ids rank after all others. Of rows that tie
    for the least id, that with the least hash of its text stays, and of equal rows one. Null and empty texts and texts
    without words are one group. An empty df stays so; columns of any name stay as they are.
    """
    key = F.xxhash64(F.lit(0), F.col(text), F.col(id_column))
    rows = stored(fingerprints(df, text, [F.col(id_column).alias("id"), key.alias("hash")], n).withColumn("vertex", F.xxhash64("fingerprint")), "fingerprints")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "hash")
    vertices = stored(rows.groupBy("vertex").agg(F.first("fingerprint").alias("fingerprint"), F.min(rank).alias("first")), "vertices")
    made = plan(vertices.count(), similarity, recall)
    found = components(candidates(vertices, made, bucket, sample))
    release(df.sparkSession)
    chosen = stored(found.join(vertices.select("vertex", F.col("first.hash").alias("hash")), "vertex"), "chosen")
    whole = df.select(key.alias("hash"), F.col(text).alias("text")).join(_small(chosen, chosen.count()), "hash")
    again = stored(rows.groupBy("hash").count().filter("count > 1").select("hash"), "again")
    repeated = again.count()
    sets = _sets(whole.select("root", "vertex", "text"), n)
    members = stored(sets.dropDuplicates(["vertex"]) if repeated else sets, "members")
    rooted = components(true_links(members, similarity, made.radius_all))
    least = vertices.select("vertex", "first").join(rooted, "vertex", "left").groupBy(F.coalesce("root", "vertex").alias("root")).agg(F.min("first").alias("first"))
    stay = least.select(F.col("first.hash").alias("__stay"))
    release(df.sparkSession)
    columns = [F.col(f"`{c}`") for c in df.columns]
    kept = df.select(F.struct(*columns).alias("row"), key.alias("hash")).join(stored(stay, "stay"), F.col("hash") == F.col("__stay")).drop("__stay")
    own = [F.col(f"row.`{c}`").alias(c) for c in df.columns]
    if not repeated:
        return kept.select(*own)
    once = kept.join(_small(again, repeated), "hash", "left_anti")
    return once.select(*own).unionByName(kept.join(_small(again, repeated), "hash", "left_semi").dropDuplicates(["hash"]).select(*own))
