"""The registered queries against plain Python over the small tables, and the SQL beside them."""

import base64
import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from sonarium.llm import queries

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, source, lang FROM '{SMALL}/documents.parquet'").fetchall()


def run(spark, name):
    return queries.QUERIES[name](spark, SMALL).collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, duck, name):
    df = queries.QUERIES[name](spark, SMALL)
    want = duck.sql(queries.ORACLE_SQL[name])
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())


def test_op2(spark, docs):
    prints = {}
    for d, text, _, _ in docs:
        words = WORD.findall(text.translate(LOWER))
        cut = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        bits = [sum(h >> k & 1 for h in (xxhash.xxh64_intdigest(s.encode(), 42) for s in cut)) for k in range(64)] if len(cut) < 400 else None
        if bits is None:
            h = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in cut], np.uint64)
            bits = [int((h >> np.uint64(k) & np.uint64(1)).sum()) for k in range(64)]
        prints[d] = sum(1 << k for k in range(64) if 2 * bits[k] > len(cut))
    groups = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and groups[b] < groups[a]:
                    groups[a], changed = groups[b], True
    assert {tuple(r) for r in run(spark, "op2_simhash")} == {(d, f"{p:016x}", groups[d]) for d, p in prints.items()}


def test_op3(spark, docs):
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    got = {r["doc_id"]: r for r in run(spark, "op3_licenses")}
    for d, text, _, _ in docs:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.translate(LOWER))
        found = [(i, label) for label, p in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        r = got[d]
        assert (r["n_words"], r["n_base"]) == (len(words), len(found))
        assert (r["first_word"], r["last_word"]) == ((min(found)[0], max(found)[0]) if found else (None, None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in found})) and 0 <= r["score"] <= 1
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))


def test_op4(spark, docs):
    rows = run(spark, "op4_mixing")
    sizes = collections.Counter()
    for _, text, source, _ in docs:
        sizes[source] += len(WORD.findall(text))
    largest = {s: max(len(WORD.findall(t)) for _, t, x, _ in docs if x == s) for s in sizes}
    source_of = {d: s for d, _, s, _ in docs}
    taken = collections.Counter()
    for r in rows:
        assert r["source_size"] == sizes[source_of[r["doc_id"]]] and r["taken"] <= 3 * r["size"]
        taken[source_of[r["doc_id"]]] += r["taken"]
    targets = {source_of[r["doc_id"]]: r["target"] for r in rows}
    assert sum(targets.values()) == pytest.approx(sum(sizes.values()), abs=1e-3)
    for k, s in enumerate(sorted(sizes)):
        assert targets[s] <= 3 * sizes[s] + 1e-6 and abs(taken[s] - targets[s]) <= largest[s] + 1
        if targets[s] < 3 * sizes[s] - 1e-6:
            assert targets[s] / (k % 3 + 1) == pytest.approx(max(t / (i % 3 + 1) for i, (x, t) in enumerate(sorted(targets.items())) if t < 3 * sizes[x] - 1e-6))
    assert sorted(map(tuple, rows)) == sorted(map(tuple, run(spark, "op4_mixing")))


def test_op5(spark, docs):
    got = {r["doc_id"]: r for r in run(spark, "op5_quality")}
    for d, text, _, _ in docs:
        words = WORD.findall(text)
        windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [line for line in text.split("\n") if WORD.search(line)]
        r = got[d]
        assert [r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)]
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and not (r["base_failed"] and r["kept"])


def test_op6(spark, docs):
    tokens = {d: [*WORD.findall(t.translate(LOWER)), ""] for d, t, _, _ in docs}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    counts = collections.Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    total = sum(counts.values())
    rows = run(spark, "op6_maxent")
    for r in rows:
        ws = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(counts[w] > 0 for w in ws), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in ws))
        assert -1e9 < r["score"] < 0
    assert sum(r["score"] for r in rows if r["held_out"]) > sum(r["base_score"] for r in rows if r["held_out"])


def test_op8(spark, docs):
    got = {r["doc_id"]: r for r in run(spark, "op8_ogg")}
    for d, text, _, _ in docs:
        raw = text.encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_op9(spark, docs):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in run(spark, "op9_packing"):
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for d, text, _, _ in docs:
        ids = [*own.encode(text, add_special_tokens=False).ids, 1]
        at = 0
        for p in sorted(pieces[d], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    padding = total = 0
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
        padding, total = padding + (0 if at & (at - 1) == 0 else 2048 - at), total + at
    assert padding < 0.03 * total


def test_op10(spark):
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SMALL}/labels.parquet'").fetchall())
    right = [r["predicted"] == labels[r["doc_id"]] for r in run(spark, "op10_quality_pu") if r["doc_id"] in labels and r["held_out"]]
    assert sum(right) >= 0.85 * len(right)


def test_op1_payloads(spark):
    pages = dict(duckdb.sql(f"SELECT page_id, html FROM '{SMALL}/pages.parquet'").fetchall())
    for r in run(spark, "op1_warc"):
        raw = (pages[r["page_id"]] or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
