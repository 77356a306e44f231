"""Quality rules on whole texts, and the divergence of a text's histograms from its language's reference.

Everything here is DataFrame expressions. A document is compared with its language by two histograms, of character
classes and of common words, using the Jensen-Shannon distance (base 2, so 0 to 1). Short documents have histograms
too noisy to judge by and are left to the plain rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarium.llm.shared import stored, words_of

# Frequent function words of four languages.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for"],
    "de": ["der", "die", "und", "den", "das", "von", "zu", "mit"],
    "fr": ["de", "la", "le", "et", "les", "des", "une", "est"],
    "es": ["el", "en", "que", "los", "por", "las", "del", "una"],
}
SYMBOLS = "[#*$%&|<>]"
#: Character classes, counted in what is left of a text without a-z; white space is the last but one.
CLASSES = ["[A-Z]", "[0-9]", r"[^\x00-\x7F]", r"[.,;:!?'\x22()-]", SYMBOLS, r"[\x20\x09-\x0D]"]
#: What separates words, before A-Z are lower-cased, where common words are counted: ASCII but letters and digits.
PLAIN_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
MIN_WORDS = 50
#: Words from which the common-word histogram counts.
GUARD_WORDS = 100
#: Long documents of a language, or of all, from which there is a reference.
GUARD_DOCUMENTS = 30
CLASS_LIMIT = 0.3
#: The limit of the common words' distance at n words is this plus 1 / sqrt(n), as a sample of n words strays by itself.
WORD_LIMIT = 0.2


def _vocabulary() -> list[str]:
    return list(dict.fromkeys(w for words in COMMON_WORDS.values() for w in words))


def _is(word: str) -> Callable[[Column], Column]:
    return lambda w: w == F.lit(word)


def _repeat_words(words: Column) -> list[tuple[str, Column]]:
    """Columns, in order, that end in the number of words within windows of three that occur twice or more.

    Windows are sorted by hash, so that equal ones are neighbours; neighbours with equal hashes are compared by word.
    Texts without two equal hashes have no equal windows and need no more than the hashes.
    """
    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))
    hashes = F.transform(starts, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    order, places = F.col("__s"), F.col("__p")

    def equal(s: Column, other: Column) -> Column:
        at, to = s["i"], other["i"]
        return (s["h"] == other["h"]) & (F.get(words, at) == F.get(words, to)) & (F.get(words, at + 1) == F.get(words, to + 1)) & (F.get(words, at + 2) == F.get(words, to + 2))

    near = lambda s, k: equal(s, F.get(order, k - 1)) | equal(s, F.get(order, k + 1))
    repeated = F.filter(F.transform(order, lambda s, k: F.when(near(s, k), s["i"])), lambda i: i.isNotNull())
    gaps = F.transform(places, lambda p, k: F.least(F.coalesce(F.get(places, k + 1) - p, F.lit(3)), F.lit(3)))
    twice = F.exists(F.transform("__o", lambda h, k: h == F.get("__o", k + 1)), lambda same: F.coalesce(same, F.lit(False)))
    return [
        ("__h", hashes),
        ("__o", F.sort_array("__h")),
        ("__s", F.when(twice, F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))),
        ("__p", F.sort_array(F.coalesce(repeated, F.array().cast("array<int>")))),
        ("__r", F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)),
    ]


def measure(df: DataFrame, text: str = "text", out: str = "__quality", rules: bool = True) -> DataFrame:
    """df with a struct of the text's figures: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_chars,
    classes and common (arrays of counts), n_plain. rules=False leaves out what only the plain rules need.

    A null or empty text has no words and zero everywhere. All columns, whatever their names, and rows stay; only one
    named as out is replaced. Common words are counted in the lower-cased text, without the marks beside them.
    """
    kept = [c for c in df.columns if c != out]
    df = df.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col(f"`{text}`").alias("text"))
    text_of = F.coalesce(F.col("text"), F.lit(""))
    vocabulary = _vocabulary()
    plain = F.split(F.lower(text_of), PLAIN_BREAK)
    df = df.withColumns({"__w": words_of(F.col("text")), "__t": F.regexp_replace(text_of, "[a-z]+", ""), "__a": plain})
    df = df.withColumns({"__c": F.filter("__a", lambda w: w.isin(vocabulary)), "__k": F.array(*(F.regexp_count("__t", F.lit(c)).cast("long") for c in CLASSES))})
    df = df.withColumn("__v", F.array(*(F.size(F.filter("__c", _is(k))).cast("long") for k in vocabulary)))
    figures = {"n_words": F.size("__w").cast("long"), "n_chars": F.length(text_of).cast("long"), "classes": F.col("__k"), "common": F.col("__v"), "n_plain": F.size(F.array_remove("__a", "")).cast("long"), "n_symbols": F.get("__k", F.lit(4)), "word_chars": F.length(text_of) - F.get("__k", F.lit(5)), "left": F.length("__t").cast("long")}
    if rules:
        for name, column in _repeat_words(F.col("__w")):
            df = df.withColumn(name, column)
        df = df.withColumn("__l", F.filter(F.split(text_of, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
        figures |= {"n_repeat_words": F.col("__r"), "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long")}
    # a row number is never negative; as it counts as nondeterministic, no later filter on the figures is moved below this
    # projection, where they would be worked out anew for every word
    made = F.when(F.monotonically_increasing_id() >= 0, F.struct(*(c.alias(n) for n, c in figures.items())))
    return df.select(*(F.col(f"row.`{c}`").alias(c) for c in kept), made.alias(out))


def base_failed(q: Column, min_words: int = MIN_WORDS) -> Column:
    """Too few words, or more than half of them in repeated windows."""
    return (q["n_words"] < min_words) | (100 * q["n_repeat_words"] > 50 * q["n_words"])


def histograms(q: Column) -> tuple[Column, Column]:
    """Shares of the character classes (a-z first, all others last) and of the common words (all others last)."""
    total = F.aggregate(q["classes"], F.lit(0).cast("long"), lambda a, c: a + c)
    classes = F.concat(F.array(q["n_chars"] - q["left"]), q["classes"], F.array(q["left"] - total))
    known = F.aggregate(q["common"], F.lit(0).cast("long"), lambda a, c: a + c)
    common = F.concat(q["common"], F.array(q["n_plain"] - known))
    return F.transform(classes, lambda c: F.try_divide(c, q["n_chars"])), F.transform(common, lambda c: F.try_divide(c, q["n_plain"]))


def references(measured: DataFrame, lang: str = "lang", column: str = "__quality") -> DataFrame:
    """A row per language: __lang, __n, and the mean histograms __class and __word of its documents that are long
    enough; a last row, with __all true, holds those of all languages. Rows grow with the number of languages only."""
    q = F.col(column)
    sizes = (len(CLASSES) + 2, len(_vocabulary()) + 1)
    shares = measured.filter(q["n_words"] >= GUARD_WORDS).select(F.col(lang).alias("__lang"), *(h.alias(n) for h, n in zip(histograms(q), ("c", "w"), strict=True)))
    mean = lambda name, n: F.array(*(F.avg(F.get(name, F.lit(i))) for i in range(n)))  # noqa: E731  nulls where there is no document
    found = [F.count("*").alias("__n"), mean("c", sizes[0]).alias("__class"), mean("w", sizes[1]).alias("__word")]
    return shares.groupBy("__lang").agg(*found).withColumn("__all", F.lit(False)).unionByName(shares.agg(*found).withColumns({"__lang": F.lit(None).cast(measured.schema[lang].dataType), "__all": F.lit(True)}))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares; null if either is null."""
    part = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
    terms = F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, t: a + t) / 2))


def judge(measured: DataFrame, refs: DataFrame, lang: str = "lang", column: str = "__quality", out: str = "__verdict", class_limit: float = CLASS_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """measured with a struct of base_failed, class_distance, word_distance and kept.

    A language with fewer than GUARD_DOCUMENTS long documents, and a null language without a reference, is compared
    with the reference of all, if that has so many. Documents of fewer than GUARD_WORDS words, and all without a
    reference, have null
    distances and are judged by the plain rules alone. Every row and column stays, but one named as out is replaced.
    """
    kept = [c for c in measured.columns if c != out]
    measured = measured.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col(f"`{column}`").alias("q"), F.col(f"`{lang}`").alias("lang"))
    q = F.col("q")
    own = refs.filter((~F.col("__all")) & (F.col("__n") >= GUARD_DOCUMENTS)).drop("__all", "__n")
    overall = refs.filter(F.col("__all")).first()  # one row, of fixed width
    enough_of_all = overall["__n"] >= GUARD_DOCUMENTS
    of_all = {name: F.array(*(F.lit(x if enough_of_all else None).cast("double") for x in overall[name])) for name in ("__class", "__word")}
    df = measured.join(own, F.col("lang").eqNullSafe(F.col("__lang")), "left")
    of_class, of_word = histograms(q)
    enough = q["n_words"] >= GUARD_WORDS
    df = df.withColumns({
        "__dc": F.when(enough, distance(of_class, F.coalesce("__class", of_all["__class"]))),
        "__dw": F.when(enough, distance(of_word, F.coalesce("__word", of_all["__word"]))),
    })
    failed = base_failed(q)
    apart = F.coalesce(F.col("__dc") > class_limit, F.lit(False)) | F.coalesce(F.col("__dw") > word_limit + 1 / F.sqrt(F.greatest(q["n_words"], F.lit(1))), F.lit(False))
    verdict = F.struct(failed.alias("base_failed"), F.col("__dc").alias("class_distance"), F.col("__dw").alias("word_distance"), (~failed & ~apart).alias("kept"))
    return df.select(*(F.col(f"row.`{c}`").alias(c) for c in kept), verdict.alias(out))


def keep_good(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of df that pass the rules, with df's columns and nothing else.

    Null and empty texts have too few words and go; equal rows are judged alike, and all of them stay or go; columns of
    any name stay. Figures are worked out twice, for the references and for the verdicts, as storing texts with them
    would write all of the input once more.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("whole")
    given = df.select(whole, F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    refs = stored(references(measure(given.select("text", "lang"), rules=False)), "references")
    kept = judge(measure(given), refs).filter(F.col("__verdict.kept"))
    return kept.select(*(F.col(f"whole.`{c}`").alias(c) for c in df.columns))
