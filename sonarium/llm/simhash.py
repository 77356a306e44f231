"""SimHash near-duplicates: fingerprints, links between close ones, and the groups they form.

Pairs of fingerprints are looked for only within buckets that agree on a block of bits. In a bucket each fingerprint has a row of distances to fixed reference fingerprints (pivots); a pair
whose rows differ by more than the radius in any place cannot be within it and is discarded, the others are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarium.llm.components import components
from sonarium.llm.shared import pieces, release, stored

SEED = 42
PIVOTS = 16
#: A bucket of more rows than this is split by further bits.
BUCKET = 2048
#: Rows that are compared at once, at least; the last bucket waits for its end.
AT_ONCE = 1 << 15
#: The side of rows that are compared with all others of their bucket.
BOTH = 2
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def spread(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit numbers (splitmix64)."""
    out, mask = [], (1 << 64) - 1
    for i in range(n):
        z = (seed + (i + 1) * 0x9E3779B97F4A7C15) & mask
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        out.append((z ^ (z >> 31)) | 1)
    return np.array(out, np.uint64)


def shingles(text: str | None, n: int) -> list[bytes]:
    """Space-joined n-word shingles of a text with A-Z lower-cased; of fewer words, all of them as one; of none, none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= n:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False)))


def majority(rows: np.ndarray) -> np.ndarray:
    """For each column bit of each row of 64-bit numbers (k, n): whether it is set in more than half of the n.

    Counts are kept as bit planes: three numbers of one weight become a sum and a carry, by bitwise operations.
    """
    n, level, planes = rows.shape[1], rows, []
    while True:
        carries = []
        while (m := level.shape[1]) > 1:
            if m == 2:
                a, b = level[:, 0:1], level[:, 1:2]
                carries.append(a & b)
                level = a ^ b
            else:
                t = m // 3
                a, b, c = level[:, :t], level[:, t : 2 * t], level[:, 2 * t : 3 * t]
                x = a ^ b
                carries.append((a & b) | (x & c))
                level = np.concatenate((x ^ c, level[:, 3 * t :]), axis=1)
        planes.append(level[:, 0])
        if not carries:
            break
        level = np.concatenate(carries, axis=1)
    more, same = np.zeros(len(rows), np.uint64), np.full(len(rows), FULL)
    least = n // 2 + 1
    if least >> len(planes):
        return more
    for k in reversed(range(len(planes))):
        if least >> k & 1:
            same &= planes[k]
        else:
            more |= same & planes[k]
            same &= ~planes[k]
    return more | same


def fingerprint(text: str | None, n: int = 3) -> np.ndarray:
    """The fingerprint of a text's n-word shingles, repeats included: one word; zero without shingles."""
    cut = shingles(text, n)
    if not cut:
        return np.zeros(1, np.uint64)
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(SEED)), np.uint64, len(cut))[None, :])


def fingerprints(df: DataFrame, text: str, keep: list[Column | str], n: int = 3) -> DataFrame:
    """The kept columns and fingerprint, an array of one long, per row. A null text is empty."""
    given = df.select(*keep, F.col(text).alias("__text"))
    schema = given.drop("__text").select("*", F.array().cast("array<long>").alias("fingerprint")).schema
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            flat = np.concatenate([fingerprint(t, n) for t in batch.column(batch.num_columns - 1).to_pylist()]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names)

    return given.mapInArrow(run, schema)


def mixed(keys: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    x = (keys ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _parts(mask: int, n: int) -> list[int]:
    """The set bits of a mask dealt to n masks of nearly equal size."""
    bits = [i for i in range(64) if mask >> i & 1]
    cut = [len(bits) * k // n for k in range(n + 1)]
    return [sum(1 << i for i in bits[a:b]) for a, b in zip(cut, cut[1:], strict=False) if b > a]


ROWS = "key long, mask long, vertex long, c0 long"
NAMES = [f.split()[0] for f in ROWS.split(", ")]


def _rows(columns: list[np.ndarray], names: list[str] = NAMES) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns], names)


def _block_keys(values: np.ndarray, blocks: list[int], t: int) -> Iterator[tuple[int, np.ndarray]]:
    for j, mask in enumerate(blocks):
        yield mask, mixed(values & np.uint64(mask), (t << 8 | j) * 0x5851F42D4C957F2D & (1 << 64) - 1)


def _first_blocks(vertices: DataFrame, blocks: list[int]) -> DataFrame:
    """A row per vertex and block of its only word: the key, the mask agreed on, and the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vertex = batch.column(0).to_numpy().view(np.uint64)
            values = batch.column(1).flatten().to_numpy().view(np.uint64)
            for mask, key in _block_keys(values, blocks, 0):
                yield _rows([key, np.full(len(vertex), mask, np.uint64), vertex, values])

    return vertices.mapInArrow(run, ROWS)


def _split(rows: DataFrame, level: int, parts: int) -> DataFrame:
    """Each row as often as there are parts, keyed by one more part of the bits not agreed on yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_numpy().view(np.uint64) for c in batch.columns]
            for mask in np.unique(columns[1]):
                key, _, vertex, word = (c[columns[1] == mask] for c in columns)
                for j, part in enumerate(_parts(int(~mask & FULL), parts) or [0]):
                    yield _rows([mixed(key ^ mixed(word & np.uint64(part), j + 1), level + 7), np.full(len(key), mask | np.uint64(part), np.uint64), vertex, word])

    return rows.mapInArrow(run, ROWS)


def link_bucket(key: np.ndarray, vertex: np.ndarray, compared: np.ndarray, radius: int, pivots: np.ndarray, side: np.ndarray | None = None, group: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that span, within each run of equal keys, the graph of the pairs at most radius bits apart.

    Pairs are taken by their distance in the run: all neighbours first, then all next but one, and so on. Pairs that
    links already connect are passed over, and so are pairs of one group, where groups are given, and where sides are,
    pairs of one side but BOTH.
    """
    n = len(key)
    run = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
    table = np.stack([np.bitwise_count(compared ^ p).sum(axis=1, dtype=np.int16) for p in pivots], axis=1)
    root = np.arange(n)
    if group is not None:
        _, first, of = np.unique(np.stack((run, group)), axis=1, return_index=True, return_inverse=True)
        root = first[of.ravel()]
    links: list[tuple[int, int]] = []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    left, s = np.arange(n - 1), 0
    while True:
        s += 1
        left = left[left < n - s]
        left = left[run[left] == run[left + s]]
        if not len(left):
            return links
        if s % 16 == 0:  # runs that hang together are done
            while not np.array_equal(flat := root[root], root):
                root[:] = flat
            ends = np.unique(run[left])
            begin, stop = np.searchsorted(run, ends), np.searchsorted(run, ends, "right")
            done = np.array([bool((root[a:b] == root[a]).all()) for a, b in zip(begin, stop, strict=True)])
            left = left[~done[np.searchsorted(ends, run[left])]]
        at = left[root[left] != root[left + s]]
        if side is not None:
            at = at[(side[at] == BOTH) | (side[at] != side[at + s])]
        for column in table.T:
            at = at[np.abs(column[at] - column[at + s]) <= radius]
        at = at[np.bitwise_count(compared[at] ^ compared[at + s]).sum(axis=1) <= radius]
        for i in at.tolist():
            a, b = top(i), top(i + s)
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((int(vertex[i]), int(vertex[i + s])))


def linked(rows: DataFrame, radius: int, words: int) -> DataFrame:
    """Links a, b that span what hangs together within the buckets of rows (key, vertex, words c0..; side and group if
    given): dealt by key, sorted by it, and compared run by run."""
    extra = [c for c in ("side", "group") if c in rows.columns]
    columns = ["key", "vertex", *(f"c{i}" for i in range(words)), *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = spread(PIVOTS * words, 7).reshape(PIVOTS, words)
        held: list[np.ndarray] | None = None

        def links(columns: list[np.ndarray]) -> pa.RecordBatch:
            more = dict(zip(extra, columns[2 + words :], strict=True))
            made = link_bucket(columns[0], columns[1], np.stack(columns[2 : 2 + words], axis=1).view(np.uint64), radius, pivots, **more)
            return pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            held = columns if held is None else [np.concatenate(c) for c in zip(held, columns, strict=True)]
            if len(held[0]) >= AT_ONCE and (cut := int(np.searchsorted(held[0], held[0][-1]))):
                yield links([c[:cut] for c in held])
                held = [c[cut:] for c in held]
        if held is not None and len(held[0]):
            yield links(held)

    return rows.select(*columns).repartition("key").sortWithinPartitions("key", "vertex").mapInArrow(run, "a long, b long")


def link(vertices: DataFrame, blocks: list[int], radius: int, bucket: int = BUCKET) -> DataFrame:
    """Links a, b between vertices (vertex long, fingerprint array<long> of one word) that differ in at most radius bits.

    Blocks have to cover all bits and be one more than the radius. Within a bucket only as many links are given as
    connect it. Buckets of more than `bucket` rows are split by blocks of the bits that their rows don't yet agree on,
    as often as needed: every pair within the radius is connected, whatever the buckets' sizes.
    """
    level, links = 0, None
    rows = _first_blocks(vertices, blocks)
    while True:
        hot = stored(rows.groupBy("key").count().filter(F.col("count") > bucket).select("key"), "hot")
        n = hot.count()
        if not n:
            more = linked(rows, radius, 1)
            return more if links is None else links.unionByName(more)
        side = F.broadcast(hot) if n <= 100_000 else hot
        more = linked(rows.join(side, "key", "left_anti").select(*NAMES), radius, 1)
        links = more if links is None else links.unionByName(more)
        rows = stored(rows.join(side, "key", "left_semi").select(*NAMES), "split")
        rows = stored(_split(rows, level, radius + 1), "blocks")
        level += 1


def near_groups(rows: DataFrame, id_column: str, blocks: list[int], radius: int) -> DataFrame:
    """rows (id, fingerprint) with root, the same for all that links connect, and group, the least id of those.

    Equal fingerprints count as one vertex, made before anything is compared. Null ids rank after all others; a group
    of nothing but null ids has a null group. Every row stays, also repeated ones.
    """
    keyed = rows.withColumn("vertex", F.get("fingerprint", F.lit(0)))
    vertices = stored(keyed.groupBy("vertex").agg(F.first("fingerprint").alias("fingerprint"), F.min(id_column).alias("first")), "vertices")
    rooted = components(link(vertices.select("vertex", "fingerprint"), blocks, radius))
    release(rows.sparkSession)  # the blocks' shuffle files are the largest there are
    known = vertices.select("vertex", "first").join(rooted, "vertex", "left").withColumn("root", F.coalesce("root", "vertex"))
    known = stored(known, "rooted")
    least = known.groupBy("root").agg(F.min("first").alias("group"))
    groups = known.join(least, "root").select("vertex", "root", "group")
    return keyed.join(groups, "vertex").drop("vertex")


def by_radius(df: DataFrame, id_column: str = "doc_id", text: str = "text", n: int = 3, radius: int = 2) -> DataFrame:
    """id, fingerprint (one word) and group of each row: all pairs of fingerprints at most radius bits apart link."""
    rows = stored(fingerprints(df, text, [F.col(id_column)], n), "fingerprints")
    return near_groups(rows, id_column, _parts((1 << 64) - 1, radius + 1), radius).drop("root")
