"""The language model against one written plainly, and its scores under other files and tasks."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarium.llm import maxent as M


def plain_scores(texts, held):
    """Scores of a model trained in one round and one shard of less than a batch, in plain Python."""
    tokens = [[w.encode() for w in t.lower().split()] + [b""] for t in texts]
    counts = collections.Counter(w for ws, h in zip(tokens, held, strict=True) if not h for w in ws)
    order = sorted(counts, key=lambda w: (-counts[w], w))
    unit = {w: i for i, w in enumerate(order[: M.HEAD])}
    total = collections.Counter()
    kinds = collections.Counter()
    for w in order[M.HEAD :]:
        total[M.bucket(w)] += counts[w]
        kinds[M.bucket(w)] += 1
    units = [[unit.get(w, M.bucket(w)) for w in ws] for ws in tokens]
    of_unit = np.zeros(M.UNITS)
    for w, n in counts.items():
        of_unit[unit.get(w, M.bucket(w))] += n
    table = (of_unit + 0.5).reshape(M.MEMBERS, M.CLASSES).T
    class_bias, member_bias = np.log(table.sum(axis=1) / table.sum()), np.log(table / table.sum(axis=1, keepdims=True))
    n, m = M.rows_for(sum(counts.values()))
    weights = {0: collections.defaultdict(lambda: np.zeros(M.CLASSES)), 1: collections.defaultdict(lambda: np.zeros(M.MEMBERS))}
    turned = lambda x, rows: (x * 2654435761 & 0xFFFFFFFF) >> (32 - (rows.bit_length() - 1))

    def features(u1, u2, u3, kind):
        span, c = M.UNITS + 1, M.CLASSES
        pair = u1 * span + u2
        return [turned(x, n) for x in (u1 + 1, u2 + 7 * span, u3 + 19 * span, pair + 31 * span)], [turned(x, m) for x in (u1 * c + kind + 1, u2 * c + kind + 77 * span * c, pair * c + kind + 131 * span)]

    def chances(u, u1, u2, u3):
        kind = u % M.CLASSES
        f = features(u1, u2, u3, kind)
        logits = class_bias + sum(weights[0][r] for r in f[0]), member_bias[kind] + sum(weights[1][r] for r in f[1])
        return f, [np.exp(x) / np.exp(x).sum() for x in logits], (kind, u // M.CLASSES)

    steps = [collections.defaultdict(dict), collections.defaultdict(dict)]
    for own, h in zip(units, held, strict=True):
        if not h:
            before = [M.START] * 3
            for u in own:
                f, p, at = chances(u, *before)
                for k in (0, 1):
                    p[k][at[k]] -= 1
                    for j, r in enumerate(f[k]):
                        steps[k][j][r] = steps[k][j].get(r, 0) + p[k]
                before = [u, *before[:2]]
    for k in (0, 1):
        past = collections.Counter()
        for j in sorted(steps[k]):  # a feature after another, as in a batch
            for r, s in steps[k][j].items():
                past[r] += (s * s).mean()
                weights[k][r] = weights[k][r] - M.RATE * s / math.sqrt(past[r] + 1)
    out = []
    for ws, own in zip(tokens, units, strict=True):
        score, before = 0.0, [M.START] * 3
        for w, u in zip(ws, own, strict=True):
            _, p, at = chances(u, *before)
            score += math.log10(p[0][at[0]]) + math.log10(p[1][at[1]])
            if w not in unit:
                score += math.log10((counts[w] + 1) / (total[u] + kinds[u] + 1))
            before = [u, *before[:2]]
        out.append(score)
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(1200)]
    return [" ".join(words[int(rng.paretovariate(0.6)) % 1200].upper() if rng.random() < 0.1 else words[int(rng.paretovariate(0.6)) % 1200] for _ in range(rng.randrange(0, 90))) for _ in range(60)]


@pytest.mark.parametrize("frequent", [1 << 17, 30])
def test_score_is_that_of_a_plain_model(spark, texts, frequent):
    rows = spark.createDataFrame([(i, t if t else None) for i, t in enumerate(texts)], "doc_id long, text string")
    held = [i % 5 == 0 for i in range(len(texts))]
    got = {r["doc_id"]: r["score"] for r in M.score(rows, F.col("doc_id") % 5 == 0, rounds=1, frequent=max(frequent, M.HEAD + 300) if frequent == 1 << 17 else 900).collect()}
    for i, want in enumerate(plain_scores(texts, held)):
        assert got[i] == pytest.approx(want, rel=2e-3, abs=2e-2)


def test_scores_do_not_follow_the_layout(spark, texts, monkeypatch):
    monkeypatch.setattr(M, "SHARD_TOKENS", 300)
    monkeypatch.setattr(M, "SHARD_TOKENS_A_ROW", 0)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one, two = ({r["doc_id"]: r["score"] for r in M.score(df, F.col("doc_id") % 5 == 0).collect()} for df in (rows.coalesce(1), rows.repartition(7)))
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], rel=1e-6) for k in one)


def test_rows_grow_with_the_tokens():
    assert M.rows_for(0) < M.rows_for(50_000_000) < M.rows_for(200_000_000) <= (M.MOST_ROWS, M.MOST_ROWS) == M.rows_for(10**12)
