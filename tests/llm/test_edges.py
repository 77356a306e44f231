"""Nulls, empty and very long texts, ties, repeats, empty tables and clashing columns; and the operators' inner parts."""

import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sonarium.llm import licenses, maxent, mixing, neardup, ogg, packing, pii, pu, quality, simhash, warc
from sonarium.llm.components import components

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
KEY = pii.TEST_KEY
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ODD = [
    (1, "one two three four five. " * 30, "en", "a", 1), (1, "one two three four five. " * 30, "en", "a", 1), (2, None, None, None, None), (3, "", "en", "b", 0), (None, "a text without an id", "en", "b", 5),
    (4, LONG, "xx", "c", 9), (5, " \t\n ", "en", None, 4), (6, "\x00 odd K bytes \U0001f600 under the MIT License", "en", "a", 3), (7, "one two three four five. " * 30, "de", "b", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, COLUMNS).withColumns({"kept": F.lit("mine"), "size": F.lit(-1), "group": F.lit(0), "score": F.lit("s"), "labels": F.lit(1)}).cache()


@pytest.mark.parametrize(("task", "small"), [(50_000, 500_000), (9, 500_000), (9, 0)])
def test_components(spark, monkeypatch, task, small):
    monkeypatch.setattr("sonarium.llm.components.TASK_EDGES", task)
    monkeypatch.setattr("sonarium.llm.components.BROADCAST_EDGES", small)
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(200, k) for k in range(201, 240)] + [(5, 5)] + [(-7, 300), (300, 299)]
    root = {v: v for e in edges for v in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["vertex"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert all(root[v] == r for v, r in got.items()) and {v for e in edges if e[0] != e[1] for v in e} == set(got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_majority_counts_bits():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 4, 7, 64, 501):
        h = rng.integers(0, 1 << 63, (2, n), dtype=np.uint64)
        want = [sum(1 << k for k in range(64) if 2 * int((row >> np.uint64(k) & np.uint64(1)).sum()) > n) for row in h]
        assert simhash.majority(h).tolist() == want


@pytest.mark.parametrize("bucket", [4, 2048])
def test_links_are_exact_whatever_the_buckets(spark, bucket):
    rng = random.Random(bucket)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = set(base)
    for b in base[:3]:  # dense balls
        prints |= {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(60)}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    vertices = spark.createDataFrame([(p, [p]) for p in signed], "vertex long, fingerprint array<long>")
    links = simhash.link(vertices, simhash._parts((1 << 64) - 1, 3), 2, bucket=bucket)
    got = {r["vertex"]: r["root"] for r in components(links).collect()}
    root = {p: p for p in signed}
    near = [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2]
    for _ in range(len(near)):
        before = dict(root)
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    assert {p: got.get(p, p) for p in signed} == root


def test_simhash_edges(spark, odd):
    rows = {r["doc_id"]: r for r in simhash.by_radius(odd).collect()}
    assert rows[2]["fingerprint"] == rows[3]["fingerprint"] == [0] and rows[2]["group"] == rows[3]["group"] == rows[5]["group"] == 2 and rows[7]["group"] == 1
    assert simhash.by_radius(odd.limit(0)).count() == 0
    kept = neardup.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(map(str, ids)) == ["1", "2", "4", "6", "None"]
    assert neardup.one_of_each(odd.limit(0)).count() == 0


def test_ogg_round_trips_and_damage():
    rng = random.Random(1)
    for n in (64, 255, 256, 65_024, 65_025, 65_026, 300_000):
        payload = rng.randbytes(n)
        for streams, packet in ((1, 4096), (3, 255), (2, 70_000)):
            assert ogg.read(ogg.mux(payload, streams, packet))[0] == payload
    made = bytearray(ogg.mux(rng.randbytes(9000)))
    made[len(made) // 2] ^= 1
    with pytest.raises(ogg.OggError):
        ogg.read(bytes(made))
    with pytest.raises(ogg.OggError):
        ogg.read(ogg.mux(b"x" * 9000)[:-300])
    crc = 0
    for byte in b"OggS and more":
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if crc >> 31 else crc << 1
    assert ogg.checksum(b"OggS and more") == crc


def test_ogg_edges(spark, odd):
    made = ogg.encode_media(odd)
    assert made.count() == len(ODD)
    rows = {r["doc_id"]: r for r in ogg.read_media(made, keep=("doc_id", "n_bytes")).collect()}
    assert (rows[2]["n_bytes"], rows[2]["payload_bytes"]) == (0, 64) and rows[2]["media_sha256"] == rows[3]["media_sha256"] and rows[4]["n_bytes"] == len(LONG)
    assert ogg.read_media(ogg.encode_media(odd.limit(0))).count() == 0


def test_warc_splits_lose_and_repeat_nothing(spark):
    html = ["<p>same</p>", None, "", "x" * 200_000, "\x1f\x8b\x08 in a page", "<p>same</p>", "é" * 500]
    pages = spark.createDataFrame([(i, f"http://h/{i} \n", h, "t") for i, h in enumerate(html)] + [(None, None, "no id", "t")], "page_id long, url string, html string, size string")
    files = warc.archive(spark, pages.repartition(3))
    want = None
    for split in (64, 1000, 1 << 20):
        got = sorted((r["record_id"], r["warc_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_warc(files, split).collect())
        want = want or got
        assert got == want and len(got) == 8
    kinds = {r[0]: r[1:3] for r in want}
    assert kinds["urn:page:0"] == ("revisit", "urn:page:5") and kinds["urn:page:1"] == ("revisit", "urn:page:2") and kinds["urn:page:5"] == ("response", None)
    assert warc.read_warc(warc.archive(spark, pages.limit(0))).count() == 0
    assert {r["warc_type"] for r in warc.read_warc(warc.archive(spark, pages, least=100)).collect() if r["payload_bytes"] < 100} == {"response"}


def test_damaged_members_are_told(tmp_path):
    made = [warc.record_bytes("response", f"urn:page:{i}", None, b"p%d" % i, warc.digest_of(b"p%d" % i), 2) for i in range(3)]
    spoilt = bytearray(made[1])
    spoilt[len(spoilt) // 2] ^= 0xFF
    path = tmp_path / "a.warc.gz"
    path.write_bytes(made[0] + bytes(spoilt) + made[2])
    with pa.OSFile(str(path)) as file:
        found = [r.get("record_id") for _, r in warc.records_in(warc.Members(file, file.size()), 0, file.size())]
    assert found == ["urn:page:0", None, "urn:page:2"]


def test_long_headers_and_lost_records(spark):
    pages = spark.createDataFrame([(i, "http://h/" + "".join(chr(97 + (k * k + i) % 26) for k in range(1_100_000 if i == 1 else 5)), f"page {i}") for i in range(4)] + [(3, "again", "page 3"), (3, "again", "other")], "page_id long, url string, html string")
    files = warc.archive(spark, pages.coalesce(1))
    for split in (256, 100_000):
        rows = warc.complete(warc.read_warc(files, split), files).collect()
        assert sorted(r["record_id"] for r in rows) == [f"urn:page:{i}" for i in (0, 1, 2, 3, 3, 3)] and max(len(r["target_uri"]) for r in rows) > 1_000_000
    with pytest.raises(ValueError, match="7 records were written, 6 read"):
        warc.complete(warc.read_warc(files), files.withColumn("records", F.col("records") + 1))


def test_license_templates(spark):
    texts = [(i, "some words before. " + text.upper() + " and after") for i, (_, text, _) in enumerate(licenses.TEMPLATES)] + [(99, None), (98, ""), (97, "the license of the software"), (96, "gnu general public license " * 500)]
    df = spark.createDataFrame(texts + [(1000 + i, "nothing here") for i in range(200)], "doc_id long, text string").withColumn("labels", F.lit(0))
    found = {r["doc_id"]: r["__found"] for r in licenses.scan_licenses(df).collect()}
    for i, (label, _, _) in enumerate(licenses.TEMPLATES):
        assert label in found[i]["labels"] and found[i]["score"] == 1.0
    assert [found[k]["score"] for k in (99, 98, 97)] == [0, 0, 0] and licenses.scan_licenses(df.limit(0)).count() == 0


def test_quality_edges(spark, odd):
    measured = quality.measure(odd)
    rows = quality.judge(measured, quality.references(measured)).collect()
    assert len(rows) == len(ODD) and all(r["kept"] == "mine" for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["__quality"]["n_words"] == 0 and by[2]["__verdict"]["base_failed"] and by[2]["__verdict"]["class_distance"] is None
    assert by[4]["__quality"]["n_words"] == 60_000
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r["__verdict"]["kept"] for r in rows)
    assert quality.keep_good(odd.limit(0)).count() == 0


def test_working_columns_do_not_clash(spark, odd):
    names = ["__w", "__t", "__c", "__k", "__v", "__l", "__h", "__row", "row", "q", "whole", "__lang", "__class", "__places", "__own", "__votes", "__words"]
    wide = odd.withColumns({n: F.lit(n) for n in names})
    kept = quality.keep_good(wide)
    assert kept.columns == wide.columns and all(r[n] == n for r in kept.collect() for n in names)
    assert kept.count() == quality.keep_good(odd).count()
    scanned = licenses.scan_licenses(wide, words="words")
    assert scanned.columns == [*wide.columns, "words", "__found"] and all(r[n] == n for r in scanned.collect() for n in names)
    assert sorted(mixing.mix(wide).columns) == sorted([*wide.columns, "__mix"])


def test_rare_words_that_tie_and_repeated_rows(spark):
    rows = [(1, "all rights reserved")] * 3 + [(None, "ALL RIGHTS, reserved!"), (2, "rights reserved all")]
    got = [(r["doc_id"], list(r["__found"]["labels"])) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, ["proprietary"])] * 3 + [(None, ["proprietary"]), (2, [])]))


def test_distances_against_plain_python(spark):
    """Histograms, references and distances of long texts, worked out plainly."""
    rng = random.Random(6)
    words = {"en": quality.COMMON_WORDS["en"] + ["House,", "tree", "The", "runs.", "42"], "de": quality.COMMON_WORDS["de"] + ["Haus", "läuft", "Der,", "(und)"]}
    docs = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(100, 180))), lang) for i in range(80) for lang in [rng.choice(["en", "en", "de"])]]
    measured = quality.measure(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    got = {r["doc_id"]: r["__verdict"] for r in quality.judge(measured, quality.references(measured)).collect()}
    import re

    def shares(text):
        plain = [w for w in re.split(quality.PLAIN_BREAK, text.lower()) if w]
        common = [plain.count(w) for w in quality._vocabulary()]
        left = re.sub("[a-z]+", "", text)
        classes = [len(re.findall(c, left)) for c in quality.CLASSES]
        whole = [len(text) - len(left), *classes, len(left) - sum(classes)]
        return np.array(whole) / len(text), np.array([*common, len(plain) - sum(common)]) / len(plain)

    own = {i: shares(t) for i, t, _ in docs}
    for k, name in enumerate(("class_distance", "word_distance")):
        for lang in words:
            ids = [i for i, _, x in docs if x == lang]
            mean = np.mean([own[i][k] for i in (ids if len(ids) >= quality.GUARD_DOCUMENTS else own)], axis=0)
            for i in ids:
                p, m = own[i][k], (own[i][k] + mean) / 2
                kl = lambda x, m=m: sum(a * math.log2(a / b) for a, b in zip(x, m, strict=True) if a > 0)
                assert got[i][name] == pytest.approx(math.sqrt(max(0, (kl(p) + kl(mean)) / 2)), abs=1e-9)


def test_js_distance(spark):
    df = spark.sql("SELECT array(1.0D, 0.0D) a, array(0.0D, 1.0D) b, array(0.5D, 0.5D) c")
    got = df.select(quality.distance(F.col("a"), F.col("b")), quality.distance(F.col("a"), F.col("a")), quality.distance(F.col("a"), F.col("c"))).first()
    assert got[0] == pytest.approx(1) and got[1] == 0 and got[2] == pytest.approx(0.5579, abs=1e-4)


def test_targets_are_capped_and_shared_out():
    sizes = {"a": 10, "b": 1000, None: 500}
    weights = mixing.weights_of(list(sizes))
    assert weights == {"a": 1, "b": 2, None: 3}
    assert mixing.targets_of(sizes, weights, 1510) == {"a": 30, "b": 592, None: 888}


def test_mixing_edges(spark, odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD) and all(0 <= r["__mix"]["copies"] <= 3 for r in rows) and {r["kept"] for r in rows} == {"mine"}
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.mixed(odd).columns == odd.columns
    few = sorted((str(r["doc_id"]), r["__mix"]["copies"]) for r in mixing.mix(odd.repartition(5)).collect())
    assert few == sorted((str(r["doc_id"]), r["__mix"]["copies"]) for r in rows)


def test_equal_rows_are_taken_one_by_one(spark, duck, tmp_path):
    """100 rows of one id and size in a source, as many in another; null ids; ties of many equal rows in every round."""
    from sonarium.llm import queries

    rows = [(7, "a b c d", "s1")] * 100 + [(8, "a b c d", "s2")] * 100 + [(None, "x y", "s3")] * 50 + [(None, "x", None)] * 70 + [(i, "w " * (i % 9), "s4") for i in range(60)] + [(1, "", "s5")] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"rank": F.lit("r"), "place": F.lit("p"), "n": F.lit(-5)})
    got = mixing.mix(df.repartition(6))
    assert got.columns == [*df.columns, "__mix"]
    rows = got.select("doc_id", "source", "__mix.*").collect()
    taken, targets = {}, {}
    for r in rows:
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
        targets[r["source"]] = r["target"]
    assert all(abs(taken[s] - targets[s]) <= 8 for s in taken), (taken, targets)
    path = str(tmp_path / "ties.parquet")
    df.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}).to_parquet(path)
    own = duck.sql(queries.ORACLE_SQL["op4_mixing"].replace("FROM documents", f"FROM '{path}'"))
    want = sorted(str((r[own.columns.index("doc_id")], r[own.columns.index("size")], r[own.columns.index("taken")])) for r in own.fetchall())
    assert sorted(str((r["doc_id"], r["size"], r["copies"] * r["size"])) for r in rows) == want
    assert mixing.mixed(df).count() == sum(r["copies"] for r in rows)


def test_lm_edges(spark, odd):
    rows = maxent.score(odd, F.col("doc_id") == 7, frequent=3).collect()
    assert len(rows) == len(ODD) and all(np.isfinite(r["score"]) for r in rows)
    null = next(r for r in rows if r["doc_id"] == 2)
    assert (null["n_tokens"], null["n_known"]) == (1, 1)
    assert maxent.score(odd.limit(0), F.lit(False)).count() == 0
    assert {r["n_known"] for r in maxent.score(odd, F.lit(True)).collect()} == {0}


def test_unit_probabilities_add_up():
    rng = np.random.default_rng(0)
    w = maxent.Weights.start(rng.integers(1, 50, maxent.UNITS).astype(float))
    trainer = maxent.Trainer(w)
    trainer.learn(maxent.contexts([rng.integers(0, maxent.UNITS, 500).astype(np.uint16)]))
    n = maxent.UNITS
    flat = (np.arange(n), np.full(n, 3), np.full(n, 9), np.full(n, maxent.START))
    assert (10 ** maxent.log_probabilities(trainer.w, flat)).sum() == pytest.approx(1, abs=1e-4) and not w.of_class.any()


def test_surrogates_keep_type_shape_and_identity():
    for kind, value in (("card", "4111 1111 1111 1111"), ("phone", "+1 (017) 555-7713"), ("ipv4", "97.51.17.173"), ("ssn", "123-45-6789"), ("email", "ann.lee@mail.example.com"), ("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962"), ("iban", "DE89 3704 0044 0532 0130 00")):
        fresh = pii.surrogate(kind, value, KEY)
        assert fresh != value and [k for _, _, k in pii.entities(fresh)] == [kind], (kind, fresh)
        if kind != "email":
            assert [c.isdigit() for c in fresh] == [c.isdigit() for c in value] or kind in ("ipv4", "secret")
    assert pii.surrogate("card", "4111-1111-1111-1111", KEY).replace("-", "") == pii.surrogate("card", "4111111111111111", KEY) and pii._luhn(pii.surrogate("card", "4111111111111111", KEY))
    assert len({pii.permuted(b"k", f"{i:03d}", 10) for i in range(1000)}) == 1000
    whole, short = pii.surrogate("person", "Mrs Anna Smith", KEY), pii.surrogate("person", "Mr. Smith", KEY)
    assert whole.split()[1] in pii.GIVEN[("latin", "f")] and whole.split()[2] == short.split()[1]
    assert pii.script_of(pii.surrogate("person", "Mr Иван Петров", KEY).split()[2]) == "cyrillic"
    assert pii.entities("version 1.2.3.4.5 of 2024-01-01, 12 apples") == []


def test_pii_edges(spark, odd):
    texts = [(1, "write to a.b@c.example or A.B@c.example"), (2, None), (3, ""), (4, "x " * 100_000 + "97.51.17.173"), (4, "97.51.17.173"), (None, "call +1 (017) 555-7713")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("count", F.lit("mine"))
    rows = pii.with_surrogates(df, key=KEY, count="n").collect()
    assert [r["n"] for r in rows] == [2, 0, 0, 1, 1, 1] and {r["count"] for r in rows} == {"mine"}
    first = rows[0]["text"].split()
    assert first[2] == first[4] and rows[3]["text"].split()[-1] == rows[4]["text"] != "97.51.17.173" and (rows[1]["text"], rows[2]["text"]) == (None, "")
    assert pii.with_surrogates(df.limit(0), key=KEY).count() == 0
    assert pii.with_surrogates(odd, key=KEY).columns == odd.columns


def test_colliding_types_are_keyed_anew(spark, monkeypatch):
    real = pii.surrogate
    monkeypatch.setattr(pii, "known_entities", lambda df, text, keys: df.sparkSession.createDataFrame([("person", "a", "same" if keys["person"][1] == 0 else "x"), ("person", "b", "same" if keys["person"][1] == 0 else "y")], "kind string, entity string, surrogate string"))
    keys = pii.settled_keys(spark.createDataFrame([("t",)], "text string"), "text", KEY)
    assert keys["person"][1] == 1 and keys["email"][1] == 0 and real("email", "a.b@c.example", *keys["email"])


def cost_of(path, cost, spots, window):
    at, total = 0, 0
    price = dict(zip(spots.tolist(), cost.tolist(), strict=True))
    for cut in path:
        length = cut - at
        total += (0 if length & (length - 1) == 0 else window - length) + price[cut] + packing.WINDOW_COST
        at = cut
    return total


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(6)
    for _ in range(40):
        spots = np.unique(np.concatenate(([0], np.cumsum(rng.integers(1, 14, rng.integers(1, 13))))))
        cost = rng.choice([0, 8], len(spots))
        inner = spots[1:-1].tolist()
        ways = ([*c, int(spots[-1])] for k in range(len(inner) + 1) for c in itertools.combinations(inner, k))
        best = min(cost_of(w, cost, spots, 16) for w in ways if max(b - a for a, b in zip([0, *w], w, strict=False)) <= 16)
        assert cost_of(packing.cuts(spots, cost, 16), cost, spots, 16) == best


def test_both_encoders_agree():
    import public_tokenizers as P

    fast, slow = packing.Encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")), packing.Encoder(P.path("byte_bpe_50k.json"))
    for text in ["", " ", "a  b\n\n c\t", "it's 12 o'clock…", "\x00\x85 日本 🙂", "<|endoftext|> x", "a <|endoftext|><|endoftext|>  b", "<|endof", LONG[:3000]]:
        assert fast.encode(text) == slow.encode(text)
    assert np.frombuffer(fast.encode("a <|endoftext|> b"), "<u4").tolist() == [64, 220, 50256, 275]


def test_packing_edges(spark, odd):
    import public_tokenizers as P

    rows = packing.pack(odd.coalesce(1), P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), stretch=5000).collect()
    assert sum(r["doc_tokens"] for r in rows if r["start"] == 0) == sum(r["length"] for r in rows)
    assert sum(r["start"] == 0 for r in rows) == len(ODD) and next(r for r in rows if r["doc_id"] == 2)["doc_tokens"] == 1
    assert all(zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"] for r in rows)
    assert packing.pack(odd.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_pu_edges(spark, odd):
    rows = pu.with_figures(odd, "text", [F.col("doc_id")])
    labels = spark.createDataFrame([(1, 1), (1, 1), (3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    model = pu.learn(rows, labels)
    got = pu.scored(rows, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert pu.scored(rows.limit(0), pu.learn(rows.limit(0), labels.limit(0))).count() == 0
    assert {r["score"] for r in pu.scored(rows, pu.learn(rows, labels.limit(0))).collect()} == {0.5}


def test_pu_against_plain_gradients(spark, monkeypatch):
    """The learnt weights lie where the risk, summed plainly over all rows, is flat, at a prior below the planted one;
    that is estimated from above, by no more than twice the shares' errors."""
    rng = np.random.default_rng(0)
    good = rng.random(3000) < 0.7
    x = rng.normal(0, 1, (3000, len(pu.figures("")))) + 1.5 * np.where(good, 1, -1)[:, None] * (np.arange(len(pu.figures(""))) < 3)
    trusted = good & (rng.random(3000) < 0.4)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "doc_id long, figures array<float>")
    labels = spark.createDataFrame([(int(i), int(good[i])) for i in range(3000) if trusted[i] or i % 7 == 0 and not good[i]], "doc_id long, quality int")
    own = pu.learn(rows, labels)
    assert 0.7 <= own.prior < 0.85 and ((own.scores(x) >= 0.5) == good).mean() > 0.9
    monkeypatch.setattr(pu, "class_prior", lambda *_: 0.6)  # here the negatives' part of the risk isn't at its bound
    model = pu.learn(rows, labels)
    u = np.clip((x - model.mean) / model.spread, -6, 6)
    assert model.mean == pytest.approx(x.mean(axis=0), abs=1e-5) and model.spread == pytest.approx(x.std(axis=0) + 1e-3, abs=1e-5)
    p, g = u[trusted], u @ model.weights + model.bias
    assert np.logaddexp(0, g).mean() > 0.6 * np.logaddexp(0, g[trusted]).mean()
    slope = (u / (1 + np.exp(-g))[:, None]).mean(axis=0) - 0.6 * p.mean(axis=0) + pu.RIDGE / trusted.sum() ** 0.5 * model.weights
    assert np.abs(slope).max() < 2e-3


def test_all_licences_of_one_file_are_found(spark):
    text = " and then ".join(text for _, text, _ in licenses.TEMPLATES)
    df = spark.createDataFrame([(0, text), (1, "no notice here")], "doc_id long, text string")
    found = {r["doc_id"]: r["__found"] for r in licenses.scan_licenses(df).collect()}
    assert set(found[0]["labels"]) == {label for label, _, _ in licenses.TEMPLATES} and found[0]["score"] == 1
    print("labels", len(found[0]["labels"]))


@pytest.mark.parametrize(
    ("text", "gone"),
    [
        ("Mr. Smith said so", ["Smith"]), ("then Dr. Weber called", ["Weber"]), ("Mrs. McDonald", ["McDonald"]), ("Mr O'Brien left", ["Brien"]), ("Frau Anna-Maria Weber kam", ["Anna", "Maria", "Weber"]),
        ("Mr. John Paul Smith", ["John", "Smith"]), ("Prof. Dr. Weber", ["Weber"]), ("Herr von Berg ging", ["Berg"]), ("Mr. Smith came. Later Smith left, and Smith's dog.", ["Smith"]), ("Mrs. Anna Lee and Dr. Kim Lee; Anna Lee, Kim", ["Anna", "Lee", "Kim"]),
        ("call +49 30 1234567 now", ["1234567"]), ("call +33 1 23 45 67 89 now", ["23 45 67 89"]), ("at 2001:db8::8a2e:370:7334 or fe80::1, end", ["2001:db8", "fe80"]),
    ],
)
def test_plain_personal_data_goes(text, gone):
    fresh = pii.replaced(text, pii.entities(text), pii.keys_for({}, KEY))
    assert not [g for g in gone if g in fresh], fresh


def test_bare_names_follow_and_code_stays():
    text = "Mrs. Kim Lee came. Kim Lee and Lee sat; the Leeds bus"
    fresh = pii.replaced(text, pii.entities(text), pii.keys_for({}, KEY)).split()
    assert fresh[1:3] == fresh[4:6] and fresh[2] == fresh[7] and fresh[-2] == "Leeds"
    assert pii.entities("x[1::2] std::cout a::b [::-1] 10::20 Mr. and the ms. of 12") == []
    assert pii.normal("ipv6", "2001:db8::1") == pii.normal("ipv6", "2001:0DB8:0:0:0:0:0:1")


def test_many_given_names_of_one_surname_settle(spark):
    names = [f"Mrs. {a}{b}{c} Weber" for a in "ABCDEFGHIJ" for b in "aeiouy" for c in ("na", "lia", "mira", "rosa", "tta", "sia", "bel", "dra", "gund", "linde", "trud", "wig", "hild", "frieda", "berta", "ra", "ka")]
    assert len(names) > 1000
    keys = pii.settled_keys(spark.createDataFrame([(n,) for n in names], "text string"), "text", KEY)
    assert len({pii.normal("person", pii.surrogate("person", n, *keys["person"])) for n in names}) == len(names)


def test_surrogates_need_a_key(spark, odd):
    with pytest.raises(ValueError, match="secret key"):
        pii.with_surrogates(odd)
    assert pii.key_of(spark, KEY) == KEY


def test_checksums_and_untitled_names():
    for iban in ("DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819"):
        fresh = pii.surrogate("iban", iban, KEY)
        assert fresh != iban and pii._mod97(fresh.replace(" ", "")) == 1 and [c == " " for c in fresh] == [c == " " for c in iban]
    text = "Anna Smith met Peter van Dyke. Smith paid; Anna-Lena left Paul"
    fresh = pii.replaced(text, pii.entities(text), pii.keys_for({}, KEY))
    assert not [n for n in ("Smith", "Dyke", "Anna Smith") if n in fresh] and fresh.endswith("left Paul") and fresh.split()[1] == fresh.split(". ")[1].split()[0]
    one, other = (pii.replaced(t, pii.entities(t), pii.keys_for({}, KEY)) for t in ("Dr. Anna Smith", "so Anna Smith"))
    assert one.split()[1:] == other.split()[1:]


def test_replacement_against_planted_entities(spark):
    """Every planted entity goes, equal ones alike and different ones apart, over all rows; all else stays."""
    rng = random.Random(8)
    made = {
        "email": [f"u{i}.x@host{i % 7}.example.org" for i in range(80)], "ssn": [f"{rng.randrange(100, 999)}-{10 + i % 90}-{1000 + i}" for i in range(80)], "ipv4": [f"10.{i}.7.{i % 250}" for i in range(80)],
        "phone": [f"+1 (0{i % 90 + 10}) 555-{1000 + i}" for i in range(80)], "person": [f"Mrs. Zora{chr(97 + i % 26)} Weber{chr(97 + i // 26)}" for i in range(80)],
    }
    docs = [[(k, v) for k in made for v in rng.sample(made[k], 3)] for _ in range(120)]
    rows = spark.createDataFrame([(i, " ; ".join(v for _, v in d) + " ; end") for i, d in enumerate(docs)], "doc_id long, text string")
    fresh = {r["doc_id"]: r["text"].split(" ; ") for r in pii.with_surrogates(rows, key=KEY).collect()}
    of: dict = {}
    for i, d in enumerate(docs):
        assert fresh[i][-1] == "end" and len(fresh[i]) == len(d) + 1
        for (kind, value), new in zip(d, fresh[i], strict=False):
            assert new != value and of.setdefault((kind, value), new) == new
    assert len(set(of.values())) == len(of)
