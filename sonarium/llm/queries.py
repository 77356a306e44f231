"""The subpackage's registered queries: thin reports over its operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarium.llm import licenses, maxent, mixing, ogg, packing, pii, pu, quality, simhash, warc
from sonarium.llm.shared import split_remainder, stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records and read back by byte ranges."""
    files = warc.archive(spark, _table(spark, sf_dir, "pages"))
    records = warc.complete(warc.read_warc(files).drop("payload", "target_uri"), files)
    number = lambda name: F.regexp_extract(name, r"(-?\d+)$", 1).try_cast("long")
    return records.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"),
        F.when(F.col("warc_type") == "revisit", number("refers_to")).alias("refers_to"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints, and the groups that links of at most two bits make."""
    found = simhash.by_radius(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.get("fingerprint", F.lit(0))), 16, "0")).alias("fingerprint"), F.col("group").alias("component_id"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the base phrases stand, and the labels and score of each text."""
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    f = F.col("__found")
    at = lambda places: F.transform(places, lambda p: p["at"])
    base = F.array_distinct(F.transform(f["places"], lambda p: p["label"]))
    joined = lambda labels: F.array_join(F.sort_array(labels), ",")
    return found.select(
        "doc_id", F.size("__w").cast("long").alias("n_words"), F.size(f["places"]).cast("long").alias("n_base"), F.array_min(at(f["places"])).alias("first_word"), F.array_max(at(f["places"])).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.array_union(base, f["labels"])).alias("labels"), f["score"].alias("score"),
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mixture of all sources takes."""
    made = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    m = F.col("__mix")
    return made.select("doc_id", m["size"].alias("size"), m["source_size"].alias("source_size"), F.round(m["target"], 6).alias("target"), (m["copies"] * m["size"]).alias("taken"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain rules' figures, the distances from the language's reference, and the verdict."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    measured = stored(quality.measure(documents).drop("text"), "measured")
    judged = quality.judge(measured, stored(quality.references(measured), "references"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *(F.col("__quality")[n].cast("long").alias(n) for n in names), "__verdict.*")


def op6_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all texts under smoothed unigrams and under the maximum-entropy model."""
    return maxent.score(_table(spark, sf_dir, "documents").select("doc_id", "text"), split_remainder("doc_id", 7) == 2)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data, and how many each has."""
    return pii.with_surrogates(_table(spark, sf_dir, "documents").select("doc_id", "text"), key=pii.key_of(spark, pii.TEST_KEY), count="n_entities")


def op8_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stored as Ogg media, read back and described."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    media = ogg.encode_media(documents).drop("text")
    return ogg.read_media(media, keep=("doc_id", "n_bytes"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    packed = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estimated probability that a text is of good quality."""
    held_out = split_remainder("doc_id", 4) == 2
    rows = stored(pu.with_figures(_table(spark, sf_dir, "documents"), "text", [F.col("doc_id")]), "figures")
    model = pu.learn(rows, _table(spark, sf_dir, "labels"), held_out=held_out)
    return pu.scored(rows, model).select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_simhash": op2_simhash,
    "op3_licenses": op3_licenses,
    "op4_mixing": op4_mixing,
    "op5_quality": op5_quality,
    "op6_maxent": op6_maxent,
    "op7_pii": op7_pii,
    "op8_ogg": op8_ogg,
    "op9_packing": op9_packing,
    "op10_quality_pu": op10_quality_pu,
}

ORACLE_SQL = {
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
        q AS (SELECT page_id, octet_length(encode(t)) AS payload_bytes, sha1(t) AS h FROM p),
        r AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM q)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
            array_to_string(list_transform(range(0, 4), lambda g: array_to_string(list_transform(range(0, 8), lambda k:
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 1 + 10 * g, 10) AS BIGINT) >> CAST(35 - 5 * k AS BIGINT)) & 31 AS INTEGER), 1)), '')), '') AS payload_digest,
            CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
        FROM r
    """,
    "op4_mixing": r"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM documents),
        g AS (SELECT source, CAST(sum(size) AS BIGINT) AS total, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
        b AS (SELECT CAST(sum(total) AS DOUBLE) AS budget FROM g),
        o AS (SELECT *, CAST(3 * total AS DOUBLE) / w AS ratio FROM g, b),
        v AS (SELECT *, (budget - 3 * coalesce(sum(total) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY ratio, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS here FROM o),
        l AS (SELECT here AS level FROM v WHERE here * w <= 3 * total ORDER BY ratio, source LIMIT 1),
        t AS (SELECT source, total, CASE WHEN level * w > 3 * total THEN CAST(3 * total AS DOUBLE) ELSE level * w END AS target FROM g, l),
        c AS (SELECT doc_id, size, total, target, sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS served FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        f AS (SELECT size, (e * total + served) / nullif(target, 0) AS finish FROM c, (SELECT unnest([0, 1, 2]) AS e)),
        u AS (SELECT finish, sum(sum(size)) OVER (ORDER BY finish) AS upto FROM f WHERE finish IS NOT NULL GROUP BY finish),
        x AS (SELECT max(finish) AS last FROM u, b WHERE upto <= budget)
        SELECT doc_id, size, total AS source_size, round(target, 6) AS target,
            CAST(size * coalesce((served / nullif(target, 0) <= last)::INT + ((total + served) / nullif(target, 0) <= last)::INT + ((2 * total + served) / nullif(target, 0) <= last)::INT, 0) AS BIGINT) AS taken FROM c, x
    """,
}
