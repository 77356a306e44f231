"""The corpus pipeline, stage by stage through run(), against what each stage has to do, on a small table."""

import collections
import random
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sonarium.llm import neardup, pii, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_failed(text):
    words = WORD.findall(text or "")
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words) < quality.MIN_WORDS or 100 * len(covered) > 50 * len(words)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice(quality.COMMON_WORDS["en"]) if rng.random() < 0.2 else "".join(rng.choice("abcdeilmnorst") for _ in range(rng.randrange(4, 9))) for _ in range(n))
    rows = [(i, text(rng.randrange(60, 95)), "en", f"s{i % 3}") for i in range(30)]
    rows += [(100 + i, rows[i][1] + " and some more", "en", "s1") for i in range(6)]  # near copies
    rows += [(200, rows[7][1], "en", "s2"), (3, rows[3][1], "en", "s0"), (3, rows[3][1], "en", "s0")]  # an exact copy, repeated rows
    rows += [(300 + i, f"{text(60)} write to person{i}@mail.example.com or call Mrs. Weber{chr(97 + i)} at 10.0.0.{i}", "en", None) for i in range(4)]
    rows += [(400, None, None, None), (401, "", "en", "s0"), (402, "too short", "en", "s1"), (403, "again and again and " * 60, "en", "s1"), (None, text(70), "de", "s2"), (404, text(5000), "en", "s0")]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]


@pytest.fixture(scope="module")
def stages(spark, docs, tmp_path_factory):
    """What every stage keeps, and the pieces that run() gives."""
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    seen, given = [], spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, given, folder)
        made.write.parquet(f"{folder}/stage{k}")
        given = spark.read.parquet(f"{folder}/stage{k}")
        seen.append(given)
    return seen, corpus_pipeline.run(spark, folder).collect()


def rows_of(df):
    return [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in df.collect()]


def test_rules_keep_what_does_not_fail(docs, stages):
    want = [d for d in docs if not base_failed(d[1])]
    assert sorted(map(str, rows_of(stages[0][0]))) == sorted(map(str, want))  # histograms judge no text against so few


def test_one_of_each_group_stays(stages):
    before, after = rows_of(stages[0][0]), rows_of(stages[0][1])
    sets = [set(neardup.hashes_of(t, 5).tolist()) for _, t, *_ in before]
    root = list(range(len(before)))
    for a in range(len(before)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root = [min(root[a], root[b]) if x in (root[a], root[b]) else x for x in root]
    groups = collections.defaultdict(list)
    for r, row in zip(root, before, strict=True):
        groups[r].append(row)
    want = [min(g, key=lambda d: (d[0] is None, d[0] or 0)) for g in groups.values()]
    assert len(after) == len(want) < len(before) and sorted(str(d[0]) for d in after) == sorted(str(d[0]) for d in want)


def test_personal_data_goes_and_all_else_stays(stages):
    before, after = ({d[0]: d for d in rows_of(s)} for s in stages[0][1:3])
    assert before.keys() == after.keys()
    for i, (_, text, lang, source, _) in before.items():
        _, fresh, fresh_lang, fresh_source, n = after[i]
        assert (lang, source, len(fresh)) == (fresh_lang, fresh_source, n)
        found = pii.entities(text)
        assert (fresh == text) == (not found) and not any(text[a:b] in fresh for a, b, _ in found)
    assert sum(before[i][1] != after[i][1] for i in before) >= 4


def test_the_mixture_follows_its_weights(stages):
    before, after = rows_of(stages[0][2]), rows_of(stages[0][3])
    copies = collections.Counter(after)
    assert set(copies) <= set(before) and max(copies.values()) <= 3
    sizes, taken = collections.Counter(), collections.Counter()
    for d in before:
        sizes[d[3]] += len(WORD.findall(d[1]))
    for d in after:
        taken[d[3]] += len(WORD.findall(d[1]))
    from sonarium.llm import mixing

    targets = mixing.targets_of(dict(sizes), mixing.weights_of(list(sizes)), sum(sizes.values()))
    largest = {s: max(len(WORD.findall(d[1])) for d in before if d[3] == s) for s in sizes}
    assert all(abs(taken[s] - targets[s]) <= largest[s] + 1 for s in sizes), (taken, targets)


def test_pieces_give_the_texts_back(stages):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter((d[0], tuple([*own.encode(d[1], add_special_tokens=False).ids, 1])) for d in rows_of(stages[0][3]))
    for pieces in (stages[0][4].collect(), stages[1]):
        assert len({(r["sequence_id"], r["offset"]) for r in pieces}) == len(pieces)
        by_document, whole = collections.defaultdict(list), collections.Counter()
        for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
            held = by_document[r["doc_id"]]
            if r["start"] == 0:
                held.append([])
            open_one = next(h for h in reversed(held) if len(h) == r["start"])
            open_one += np.frombuffer(r["ids"], "<u4").tolist()
        for i, texts in by_document.items():
            whole.update((i, tuple(t)) for t in texts)
        assert whole == want


def test_empty_and_wider_tables(spark, docs):
    wide = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS size", "2 AS hash", "3 AS row", "4 AS rank", "5 AS number", "6 AS __quality", "7 AS place")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, wide.limit(0), "")
        assert made.columns == wide.columns and made.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, wide.limit(0), "").count() == 0
    kept = corpus_pipeline.mix(spark, corpus_pipeline.near_dedup(spark, wide, ""), "")
    assert kept.columns == wide.columns and {r["rank"] for r in kept.collect()} == {4}
