"""A hashed maximum-entropy language model with a class-factored softmax.

Words are mapped to units: the most frequent words have one each, all others share buckets by hash. The probability of
a unit given its context is that of its class times that of the unit in its class, each a softmax over sums of weight
rows; rows belong to features of the context, the last unit, the last two together, and the second and third last by
themselves (skips), hashed into tables whose rows grow with the tokens counted, up to a bound. A word of a bucket then
has its smoothed share of the bucket.

Training texts are dealt by hash to rounds, and in a round to shards of some millions of tokens, so that each is seen
once, and the model is the same however files and tasks fall. A shard takes gradient steps from the round's weights; the
changes of a weight row are averaged over the shards that touched it, by how often they did.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarium.llm.shared import pieces, release, shared_dir, stored

CLASSES, MEMBERS = 32, 32
UNITS = CLASSES * MEMBERS
BUCKETS = 256
HEAD = UNITS - BUCKETS
#: The unit before a text's first.
START = UNITS
#: Words whose counts every worker holds; the counts of all others are joined.
FREQUENT = 1 << 17
#: Tokens for each weight row of the classes; members have twice as many rows. Of each table at least and at most so
#: many, 32 MB of weights, which every worker holds.
TOKENS_A_ROW, LEAST_ROWS, MOST_ROWS = 4096, 1 << 12, 1 << 18
ROUNDS = 3
#: Tokens that one shard learns from, one after another: so many at least, and so many for each weight row, which keeps
#: the changes that shards hand over (136 bytes for a row that is touched) below the texts' own size.
SHARD_TOKENS, SHARD_TOKENS_A_ROW = 2_000_000, 64
BATCH, RATE = 8192, 0.3
#: Rows of a weight table whose changes are put together by one task.
BLOCK = 1 << 10
END = b""


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts, A-Z lower-cased, one text after another, and where each text's begin and end. Ends of texts
    aren't among them; a null text has no words."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, starts = cut.flatten().cast(pa.binary()), cut.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    whole = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not whole.all():  # white space at a text's ends
        starts = np.concatenate(([0], np.cumsum(whole)))[starts]
        flat = flat.filter(pa.array(whole))
    return flat, starts


def bucket(word: bytes) -> int:
    """The unit that a word without one of its own shares."""
    return HEAD + zlib.crc32(word) % BUCKETS


def count_words(df: DataFrame, text: str) -> DataFrame:
    """word (binary) and count over all texts, the end included; counted a batch at a time before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            if batch.num_rows:
                seen = pc.value_counts(tokens(batch.column(0))[0])
                words = pa.concat_arrays([seen.field(0), pa.array([END], pa.binary())])
                yield pa.RecordBatch.from_arrays([words, pa.concat_arrays([seen.field(1), pa.array([batch.num_rows], pa.int64())])], ["word", "n"])

    return df.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("count"))


@dataclass
class Vocabulary:
    """The most frequent words in order, their counts, and the buckets' words and counts; total and size of all."""

    words: list[bytes]
    counts: np.ndarray
    bucket_total: np.ndarray
    bucket_words: np.ndarray
    total: int
    size: int

    def units(self) -> np.ndarray:
        """The unit of each of the words."""
        return np.array([i if i < HEAD else bucket(w) for i, w in enumerate(self.words)], np.uint16)

    def unit_counts(self) -> np.ndarray:
        """How often each unit occurs."""
        return np.concatenate((np.pad(self.counts[:HEAD], (0, max(0, HEAD - len(self.counts)))), self.bucket_total)).astype(np.float64)

    def bucket_logs(self) -> np.ndarray:
        """log10 of what a bucket's smoothed counts add up to, one unseen word included; zero for units of one word."""
        return np.concatenate((np.zeros(HEAD), np.log10(self.bucket_total + self.bucket_words + 1.0)))


def vocabulary(counts: DataFrame, frequent: int = FREQUENT) -> Vocabulary:
    """The vocabulary of stored counts. At most `frequent` words and BUCKETS sums come to the driver: the words are
    those of the highest steps of frequency that fit together."""
    total, size = counts.agg(F.sum("count"), F.count("*")).first()
    step = F.floor(8 * F.log2("count"))  # some hundred steps of how frequent a word is
    least, left = None, frequent
    for row in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), key=lambda row: -row["step"]):
        left -= row["n"]
        if left < 0:
            break
        least = row["step"]
    top = [] if least is None else sorted(counts.filter(step >= least).collect(), key=lambda row: (-row["count"], row["word"]))
    words = [bytes(r["word"]) for r in top]
    sums = {r["b"]: (r["n"], r["v"]) for r in counts.groupBy((F.crc32("word") % BUCKETS).alias("b")).agg(F.sum("count").alias("n"), F.count("*").alias("v")).collect()}
    bucket_total = np.array([sums.get(b, (0, 0))[0] for b in range(BUCKETS)], np.float64)
    bucket_words = np.array([sums.get(b, (0, 0))[1] for b in range(BUCKETS)], np.float64)
    for r, w in zip(top[:HEAD], words[:HEAD], strict=True):  # words of their own are in no bucket
        bucket_total[zlib.crc32(w) % BUCKETS] -= r["count"]
        bucket_words[zlib.crc32(w) % BUCKETS] -= 1
    return Vocabulary(words, np.array([r["count"] for r in top], np.int64), bucket_total, bucket_words, int(total or 0), size)


ENCODED = "row long, n_tokens long, n_near long, near double, tail double, units binary, rare array<binary>"


def encode(df: DataFrame, text: str, keep: list[Column | str], vocab: Vocabulary) -> DataFrame:
    """The kept columns and, per row: a number of its own, tokens, those with a count at hand, the sum of log10(count
    + 1) over these and over those of them that share a bucket, the units (16 bits each), and the other words."""
    given = df.select(*keep, F.col(text).alias("__text"))
    kept = given.drop("__text").schema
    names = [*(f.name for f in kept.fields), "row", "n_tokens", "n_near", "near", "tail", "units", "rare"]
    held = df.sparkSession.sparkContext.broadcast((vocab.words, vocab.counts, vocab.units()))  # FREQUENT words at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, unit_of = held.value
        known = pa.array(words, pa.binary())
        logs, row = np.log10(counts + 1.0), TaskContext.get().partitionId() << 40
        end = words.index(END) if END in words else -1
        for batch in pieces(batches):
            n = batch.num_rows
            if not n:
                continue
            flat, starts = tokens(batch.column(batch.num_columns - 1))
            of = np.repeat(np.arange(n), np.diff(starts))
            at = np.full(len(flat) + n, end, np.int64)  # a text's words, and its end
            place = np.arange(len(flat)) + of
            found = pc.fill_null(pc.index_in(flat, value_set=known), -1).to_numpy(zero_copy_only=False) if len(known) else np.full(len(flat), -1)
            at[place] = found
            text_of = np.repeat(np.arange(n), np.diff(starts) + 1)
            near = at >= 0
            units = np.full(len(at), bucket(END), np.uint16)
            units[near] = unit_of[at[near]]
            far = flat.filter(pa.array(found < 0))
            if len(far):
                coded = far.dictionary_encode()
                units[place[found < 0]] = np.array([bucket(w) for w in coded.dictionary.to_pylist()], np.uint16)[coded.indices.to_numpy()]
            own = np.where(near, logs[np.maximum(at, 0)], 0.0) if len(logs) else np.zeros(len(at))
            sums = lambda v, k=text_of, n=n: np.bincount(k, v, n)
            ends = starts + np.arange(n + 1)
            raw, cut = units.tobytes(), (2 * ends).astype(np.int32)
            lists = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(cut.tobytes()), pa.py_buffer(raw)])
            rare, rare_starts = far, np.concatenate(([0], np.cumsum(np.bincount(of[found < 0], minlength=n))))
            if end < 0:  # the end itself is joined like any word without a count at hand
                rare = pa.concat_arrays([rare, pa.array([END] * n, pa.binary())])
                order = np.argsort(np.concatenate((of[found < 0], np.arange(n))), kind="stable")
                rare, rare_starts = rare.take(pa.array(order)), rare_starts + np.arange(n + 1)
            made = [pa.array(row + np.arange(n)), pa.array(np.diff(ends)), pa.array(sums(near).astype(np.int64)), pa.array(sums(own)), pa.array(sums(np.where(at >= HEAD, own, 0.0))), lists]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made, pa.ListArray.from_arrays(pa.array(rare_starts.astype(np.int32)), rare)], names)
            row += n

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields]
    return given.mapInArrow(run, ", ".join([*fields, ENCODED]))


def _hash(x: np.ndarray, rows: int) -> np.ndarray:
    return ((x.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(32 - (rows.bit_length() - 1))).astype(np.int64)


def contexts(units: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All units of some texts one after another, and for each the last, second last and third last before it."""
    flat = np.concatenate(units).astype(np.int64)
    starts = np.cumsum([0, *map(len, units[:-1])])
    before = [flat]
    for _ in range(3):
        shifted = np.concatenate(([START], before[-1][:-1]))
        shifted[starts] = START
        before.append(shifted)
    return tuple(before)


def rows_for(tokens: int) -> tuple[int, int]:
    """Weight rows of the classes and of the members, powers of two that grow with the tokens of training."""
    of_class = min(MOST_ROWS, max(LEAST_ROWS, 1 << (tokens // TOKENS_A_ROW).bit_length()))
    return of_class, min(MOST_ROWS, 2 * of_class)


@dataclass
class Weights:
    """Weight rows of the classes and of the classes' members, and the biases of both."""

    of_class: np.ndarray
    of_member: np.ndarray
    class_bias: np.ndarray
    member_bias: np.ndarray

    @staticmethod
    def start(unit_counts: np.ndarray, rows: tuple[int, int] = (LEAST_ROWS, 2 * LEAST_ROWS)) -> Weights:
        """No features yet: units are as likely as they are frequent."""
        table = (unit_counts + 0.5).reshape(MEMBERS, CLASSES).T  # unit = member * CLASSES + class
        return Weights(np.zeros((rows[0], CLASSES), np.float32), np.zeros((rows[1], MEMBERS), np.float32), np.log(table.sum(axis=1) / table.sum()).astype(np.float32), np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32))

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        return self.of_class, self.of_member


def _rows(w: Weights, u1: np.ndarray, u2: np.ndarray, u3: np.ndarray, kind: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Rows of the features in the class table and, together with the class, in the members' table."""
    span, n, m = UNITS + 1, len(w.of_class), len(w.of_member)
    pair = u1 * span + u2
    of_class = [_hash(u1 + 1, n), _hash(u2 + 7 * span, n), _hash(u3 + 19 * span, n), _hash(pair + 31 * span, n)]
    of_member = [_hash(u1 * CLASSES + kind + 1, m), _hash(u2 * CLASSES + kind + 77 * span * CLASSES, m), _hash(pair * CLASSES + kind + 131 * span, m)]
    return of_class, of_member


def _normal(logits: np.ndarray) -> np.ndarray:
    np.clip(logits, -60, 60, out=logits)  # what 32 bits can hold, and their sum
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def _probabilities(w: Weights, u: np.ndarray, u1: np.ndarray, u2: np.ndarray, u3: np.ndarray) -> tuple:
    kind, member = u % CLASSES, u // CLASSES
    of_class, of_member = _rows(w, u1, u2, u3, kind)
    a = w.class_bias + w.of_class[of_class[0]]
    b = w.member_bias[kind]
    row = np.empty_like(a)
    for r in of_class[1:]:
        a += np.take(w.of_class, r, axis=0, out=row, mode="clip")
    for r in of_member:
        b += np.take(w.of_member, r, axis=0, out=row, mode="clip")
    return _normal(a), _normal(b), kind, member, of_class, of_member


def log_probabilities(w: Weights, flat: tuple[np.ndarray, ...], batch: int = BATCH) -> np.ndarray:
    """log10 of the probability of each unit in its context."""
    out = np.empty(len(flat[0]))
    for i in range(0, len(out), batch):
        a, b, kind, member, _, _ = _probabilities(w, *(x[i : i + batch] for x in flat))
        at = np.arange(len(kind))
        out[i : i + batch] = np.log10(np.maximum(a[at, kind], 1e-30)) + np.log10(np.maximum(b[at, member], 1e-30))
    return out


class Trainer:
    """Gradient steps on one shard's texts, from weights that are left as they were."""

    def __init__(self, weights: Weights) -> None:
        self.given, self.tokens = weights, 0
        self.w = Weights(weights.of_class.copy(), weights.of_member.copy(), weights.class_bias, weights.member_bias)
        self.past = [np.zeros(len(t), np.float32) for t in weights.tables()]
        self.seen = [np.zeros(len(t), np.int64) for t in weights.tables()]

    def learn(self, flat: tuple[np.ndarray, ...]) -> None:
        for i in range(0, len(flat[0]), BATCH):
            a, b, kind, member, of_class, of_member = _probabilities(self.w, *(x[i : i + BATCH] for x in flat))
            at = np.arange(len(kind))
            a[at, kind] -= 1
            b[at, member] -= 1
            for k, (slope, features) in enumerate(((a, of_class), (b, of_member))):
                values, columns = slope.ravel().astype(np.float64), np.arange(slope.shape[1])
                for r in features:
                    self._descend(k, r, values, columns)
            self.tokens += len(kind)

    def _descend(self, k: int, rows: np.ndarray, slope: np.ndarray, columns: np.ndarray) -> None:
        """An Adagrad step, row by row, on the sums of the slopes (row-major) of each row."""
        own, of, seen = np.unique(rows, return_inverse=True, return_counts=True)
        width = len(columns)
        sums = np.bincount((of[:, None] * width + columns).ravel(), slope, len(own) * width).reshape(len(own), width).astype(np.float32)
        past, table = self.past[k], self.w.tables()[k]
        past[own] += np.einsum("ij,ij->i", sums, sums) / width
        table[own] -= (RATE / np.sqrt(past[own] + 1.0))[:, None] * sums
        self.seen[k][own] += seen

    def changes(self) -> Iterator[tuple[int, int, bytes, bytes, bytes]]:
        """Of each table and block of rows: the rows that were touched, how often each was, and their changes."""
        for k, (now, before) in enumerate(zip(self.w.tables(), self.given.tables(), strict=True)):
            touched = np.flatnonzero(self.seen[k])
            for own in np.split(touched, np.flatnonzero(np.diff(touched // BLOCK)) + 1) if len(touched) else []:
                yield k, int(own[0] // BLOCK), (own % BLOCK).astype(np.int16).tobytes(), self.seen[k][own].tobytes(), (now[own] - before[own]).tobytes()


def _units(batch: pa.RecordBatch, name: str = "units") -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16) for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


CHANGES = "kind int, block long, shard long, rows binary, seen binary, change binary"
CHANGE_NAMES = [f.split()[0] for f in CHANGES.split(", ")]
CHANGE_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def _changes(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(CHANGE_KINDS)], CHANGE_NAMES)


def train_round(rows: DataFrame, weights: Weights, shards: int) -> Weights:
    """One round over rows (shard, order, units): every shard takes its steps, in order; of each weight row the changes
    are averaged, weighted by how often a shard touched it, by tasks of their own. What is touched comes to the driver,
    no more than the weights' own size."""
    sc = rows.sparkSession.sparkContext
    held = sc.broadcast(weights)  # MOST_ROWS of each table at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, trainer = None, None
        for batch in pieces(batches, 4 << 20):
            shard = batch.column(0).to_numpy()
            for own in np.split(np.arange(len(shard)), np.flatnonzero(np.diff(shard)) + 1):
                if not len(own):
                    continue
                if shard[own[0]] != now:
                    if trainer:
                        yield from (_changes([(k, b, now, *rest)]) for k, b, *rest in trainer.changes())
                    now, trainer = int(shard[own[0]]), Trainer(held.value)
                trainer.learn(contexts(_units(batch.slice(int(own[0]), len(own)))))
        if trainer:
            yield from (_changes([(k, b, now, *rest)]) for k, b, *rest in trainer.changes())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, seen = None, np.zeros((BLOCK, CLASSES)), np.zeros(BLOCK)

        def made() -> pa.RecordBatch:
            own = np.flatnonzero(seen)
            return _changes([(*now, 0, own.astype(np.int16).tobytes(), seen[own].astype(np.int64).tobytes(), (sums[own] / seen[own, None]).astype(np.float32).tobytes())])

        for batch in batches:
            for k, block, _, at, n, change in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (k, block) != now:
                    if now:
                        yield made()
                    now = (k, block)
                    sums[:], seen[:] = 0, 0
                at, n = np.frombuffer(at, np.int16), np.frombuffer(n, np.int64)
                sums[at] += np.frombuffer(change, np.float32).reshape(len(at), -1) * n[:, None].astype(np.float64)
                seen[at] += n
        if now:
            yield made()

    dealt = rows.select("shard", "units", "order").repartitionById(max(1, shards), F.col("shard").cast("int"))  # a task a shard
    changes = dealt.sortWithinPartitions("shard", "order").select("shard", "units").mapInArrow(run, CHANGES)
    total = changes.repartition(16, "kind", "block").sortWithinPartitions("kind", "block", "shard").mapInArrow(add, CHANGES).select("kind", "block", "rows", "change").collect()
    held.unpersist()
    made = Weights(weights.of_class.copy(), weights.of_member.copy(), weights.class_bias, weights.member_bias)
    for r in total:
        at = np.frombuffer(r["rows"], np.int16).astype(np.int64) + r["block"] * BLOCK
        made.tables()[r["kind"]][at] += np.frombuffer(r["change"], np.float32).reshape(len(at), -1)
    return made


def score_rows(encoded: DataFrame, keep: list[str], weights: Weights, vocab: Vocabulary) -> DataFrame:
    """The kept columns, and units_score: log10 probability of the units, less the logs of the buckets' totals."""
    given = encoded.select(*keep, "units")
    schema = given.drop("units").select("*", F.lit(0.0).alias("units_score")).schema
    names = [f.name for f in schema.fields]
    held = encoded.sparkSession.sparkContext.broadcast((weights, vocab.bucket_logs()))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, logs = held.value
        for batch in pieces(batches, 4 << 20):
            if not batch.num_rows:
                continue
            units = _units(batch)
            flat = contexts(units)
            each = log_probabilities(own, flat) - logs[flat[0]]
            sums = np.add.reduceat(each, np.cumsum([0, *map(len, units[:-1])]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums, pa.float64())], names)

    return given.mapInArrow(run, schema)


def score(df: DataFrame, held_out: Column, id_column: str = "doc_id", text: str = "text", rounds: int = ROUNDS, frequent: int = FREQUENT) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row, learnt from those not held out.

    base_score has the smoothed unigram log10 probability, score that of the model. A null or empty text is its end
    alone. Without a training row nothing has a count, and units are equally likely. Repeated rows count each time.
    """
    spark = df.sparkSession
    counts = stored(count_words(df.filter(~held_out), text), "counts")
    vocab = vocabulary(counts, frequent)
    order = F.xxhash64(F.lit(0), id_column, text)
    part = F.when(held_out, -1).otherwise(F.pmod(order, F.lit(rounds)).cast("int")).alias("part")
    rows = rows_for(vocab.total)
    shards = max(1, -(-vocab.total // (rounds * max(SHARD_TOKENS, SHARD_TOKENS_A_ROW * sum(rows)))))
    shard = F.pmod(F.xxhash64(F.lit(1), order), F.lit(shards)).cast("long").alias("shard")
    path = shared_dir(spark, "encoded")
    made = encode(df, text, [F.col(id_column).alias("__id"), held_out.alias("held_out"), order.alias("order"), shard, part], vocab)
    made.write.partitionBy("part").parquet(path)
    encoded = spark.read.schema(made.schema).parquet(path)
    weights = Weights.start(vocab.unit_counts(), rows)
    for k in range(rounds):
        weights = train_round(encoded.filter(F.col("part") == k), weights, shards)
        release(spark)
    rare = encoded.select("row", F.explode("rare").alias("word"))
    known = rare.join(counts, "word").groupBy("row").agg(F.count("*").alias("n_rare"), F.sum(F.log10(F.col("count") + 1.0)).alias("rare"))
    scored = score_rows(encoded, ["row", "__id", "held_out", "n_tokens", "n_near", "near", "tail"], weights, vocab)
    full = scored.join(known, "row", "left").na.fill(0, ["n_rare"]).na.fill(0.0, ["rare"])
    return full.select(
        F.col("__id").alias(id_column), "held_out", "n_tokens", (F.col("n_near") + F.col("n_rare")).alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("near") + F.col("rare") - F.col("n_tokens") * F.log10(F.lit(float(vocab.total + vocab.size + 1)))).alias("base_score"), (F.col("units_score") + F.col("tail") + F.col("rare")).alias("score"),
    )
