"""Near-duplicates against all pairs: links, chunks of large buckets and groups, and the recall that plan() promises."""

import itertools
import random

import numpy as np
import pytest

from sonarium.llm import neardup
from sonarium.llm.components import components


def texts(rng, n, length):
    """Base texts, near copies of them from nearly equal to unlike, and chains."""
    word = lambda: f"w{rng.randrange(10**9)}"
    out = [[word() for _ in range(length)] for _ in range(n)]
    for base in out[: n // 2]:
        for share in (0.02, 0.06, 0.1, 0.12, 0.15, 0.2, 0.3):
            k = round(share * length)
            out.append(base[: length - k] + [word() for _ in range(k)])
    rng.shuffle(out)
    return [" ".join(t) for t in out]


def groups_of(docs, similarity, n=5):
    """The least id of each text's group, by all pairs of shingle sets."""
    sets = [set(neardup.hashes_of(t, n).tolist()) for t in docs]
    root = list(range(len(docs)))
    top = lambda i: i if root[i] == i else top(root[i])
    for a, b in itertools.combinations(range(len(docs)), 2):
        if sets[a] & sets[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return [top(i) for i in range(len(docs))]


@pytest.mark.parametrize(("bucket", "sample"), [(2048, 16), (8, 1)])
def test_one_of_each_group_stays(spark, bucket, sample):
    docs = texts(random.Random(bucket), 20, 204)
    want = groups_of(docs, 0.8)
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
    kept = {r["doc_id"] for r in neardup.one_of_each(rows, bucket=bucket, sample=sample).collect()}
    assert kept == {i for i, g in enumerate(want) if i == g}


def test_recall_at_two_sizes():
    """Pairs just at the limit share a block and pass: of drawn sets, not of the bits that plan() itself draws."""
    rng = np.random.default_rng(5)
    factors = neardup.spread(neardup.DRAWN + neardup.COMPARED, neardup.SEED)
    for rows in (40_000, 10_000_000):
        made, found, n = neardup.plan(rows, 0.8), 0, 400
        for _ in range(n):
            own = rng.integers(0, 1 << 63, 400, dtype=np.uint64)  # 320 in common and 40 of each one's own
            a, b = (neardup.fingerprint(np.concatenate((own[:320], x)), factors) for x in (own[320:360], own[360:]))
            apart = a ^ b
            share = ~((apart[None, : neardup.DRAWN] & made.masks) != 0).any(axis=1)
            within = np.bitwise_count(apart[neardup.DRAWN :]).sum() <= made.radius
            found += bool(share.any() and within and np.bitwise_count(apart).sum() <= made.radius_all)
        assert found >= 0.98 * n, (rows, found)


def test_large_buckets_lose_no_link(spark):
    """Pairs that share one block only, the one that all rows share."""
    rng = random.Random(9)
    made = neardup.plan(400, 0.8)
    first = [int(w) for w in made.masks[0]]
    prints = []
    for _ in range(150):
        one = [rng.getrandbits(64) & ~(first[w] if w < neardup.DRAWN else 0) for w in range(neardup.DRAWN + neardup.COMPARED)]
        other = list(one)
        for masks in made.masks[1:]:  # a bit of every other block, out of the first
            w, b = rng.choice([(w, b) for w in range(neardup.DRAWN) for b in range(64) if int(masks[w]) >> b & 1 and not first[w] >> b & 1])
            other[w] ^= 0 if one[w] >> b & 1 != other[w] >> b & 1 else 1 << b
        prints += [one, other]
    signed = [[v - (1 << 64) if v >> 63 else v for v in p] for p in prints]
    vertices = spark.createDataFrame(list(enumerate(signed)), "vertex long, fingerprint array<long>")
    for bucket in (2048, 20):
        links = neardup.candidates(vertices, made, bucket=bucket, sample=1)
        root = {r["vertex"]: r["root"] for r in components(links).collect()}
        assert all(root[2 * i] == root[2 * i + 1] for i in range(150)), bucket


@pytest.mark.parametrize("large", [1000, 6])
def test_true_links_whatever_the_chunks(spark, large):
    docs = texts(random.Random(3), 12, 154)
    sets = [neardup.hashes_of(t, 5) for t in docs]
    rows = [(i % 2, i, s.tobytes(), len(s)) for i, s in enumerate(sets)]
    members = spark.createDataFrame(rows, "root long, vertex long, set binary, size long")
    links = neardup.true_links(members, 0.8, neardup.plan(100, 0.8).radius_all, texts=large).collect()
    got = {r["vertex"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    for half in (0, 1):
        own = [i for i in range(len(docs)) if i % 2 == half]
        want = [own[g] for g in groups_of([docs[i] for i in own], 0.8)]
        assert [got.get(i, i) for i in own] == want


def test_repeated_rows_ties_and_clashing_names(spark):
    long = "a b c d e f g h i j " * 3
    rows = [(1, long, "x"), (1, long, "x"), (1, long + "other", "y"), (None, "something else entirely in here", "z"), (2, None, "n"), (3, "", "e"), (4, " \t", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, hash string").selectExpr("*", "1 AS vertex", "2 AS row", "3 AS root", "4 AS __stay")
    got = neardup.one_of_each(df)
    assert got.columns == df.columns
    ids = sorted(str(r["doc_id"]) for r in got.collect())  # 27 of 28 shingles, or of 26 distinct ones, in common
    assert ids == ["1", "2", "None"]
    assert neardup.one_of_each(df.limit(0)).count() == 0
