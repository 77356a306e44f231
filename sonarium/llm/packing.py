"""Packing token streams into fixed windows, in order, by dynamic programming over places to cut.

The tokens of a task's documents form one stream. Cuts may fall between documents, after sentences, and, where a
sentence is long, every few hundred tokens; the last two cost a penalty. A window of L tokens costs its padding, none
if L is a power of two. The cheapest cut list is found in one pass: among the places within a window's reach the best
has the least cost plus position, which a monotone queue keeps at its head; windows of a power of two are looked up.
"""

from __future__ import annotations

import base64
import json
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sonarium.llm.shared import pieces

WINDOW = 2048
#: The id that ends a document.
END = 1
SENTENCE_PENALTY, FORCED_PENALTY, WINDOW_COST = 8, 96, 4
#: Without a boundary for so many tokens there is a place to cut.
FORCED_EVERY = 256
#: Tokens that are packed together; more documents begin a new stretch.
STRETCH = 1 << 19


class Encoder:
    """Ids of a byte-level BPE vocabulary, as little-endian unsigned 32-bit bytes.

    vocabulary: path of the tokenizer's JSON, as the tokenizers library reads it; ranks: path of the same vocabulary
    as tiktoken's ranks, or None. With ranks the ids are the same and found in a fifth of the time. Special tokens'
    strings in a text become their ids, as in the tokenizers library without more being said.
    """

    def __init__(self, vocabulary: str, ranks: str | None = None) -> None:
        if ranks is None:
            from tokenizers import Tokenizer

            slow = Tokenizer.from_file(vocabulary)
            self.ids = lambda text: slow.encode(text, add_special_tokens=False).ids
        else:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            with open(vocabulary, encoding="utf-8") as file:
                added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=added)
            self.ids = lambda text: fast.encode(text, allowed_special="all", disallowed_special=())

    def encode(self, text: str) -> bytes:
        return np.array(self.ids(text), "<u4").tobytes()


def sentence_ends(vocabulary: str) -> np.ndarray:
    """For each id whether its text ends a sentence: it holds a line break, or ends in a full stop, ! or ?."""
    with open(vocabulary, encoding="utf-8") as file:
        table = json.load(file)["model"]["vocab"]
    ends = np.zeros(max(table.values()) + 1, bool)  # a special token beyond ends none
    for piece, i in table.items():
        ends[i] = piece.endswith((".", "!", "?")) or "Ċ" in piece
    return ends


def _encoder(vocabulary: str, ranks: str | None, held: dict = {}) -> tuple[Encoder, np.ndarray]:  # noqa: B006  one a worker
    key = (vocabulary, ranks)
    if key not in held:
        held[key] = (Encoder(vocabulary, ranks), sentence_ends(vocabulary))
    return held[key]


def places(lengths: np.ndarray, ends: np.ndarray, forced_every: int = FORCED_EVERY) -> tuple[np.ndarray, np.ndarray]:
    """Where a stream may be cut, ascending from 0 to its length, and what each cut costs.

    lengths: of the documents; ends: positions in the stream after which a sentence has ended.
    """
    documents = np.concatenate(([0], np.cumsum(lengths)))
    total = int(documents[-1])
    known = np.union1d(documents, ends)
    far = np.flatnonzero(np.diff(known) > forced_every)
    forced = [np.arange(known[i] + forced_every, known[i + 1], forced_every) for i in far]
    spots = np.union1d(known, np.concatenate(forced)) if forced else known
    cost = np.full(len(spots), FORCED_PENALTY)
    cost[np.searchsorted(spots, ends)] = SENTENCE_PENALTY
    cost[np.searchsorted(spots, documents)] = 0
    return spots[spots <= total], cost[spots <= total]


def cuts(spots: np.ndarray, cost: np.ndarray, window: int = WINDOW, window_cost: int = WINDOW_COST) -> list[int]:
    """The places, from first to last, of the cheapest way to cut a stream into windows.

    Neighbouring spots must be at most a window apart. Of equally cheap ways, that with the earliest cuts is taken
    among those by padding, and windows of a power of two go before padded ones.
    """
    n = len(spots)
    powers = [1 << k for k in range(window.bit_length()) if 1 << k <= window]
    at, to = [], []
    for length in powers:
        found = np.searchsorted(spots, spots - length)
        hit = np.flatnonzero(spots[np.minimum(found, n - 1)] == spots - length)
        at.append(hit)
        to.append(found[hit])
    to_all = np.concatenate(to)
    at_all = np.concatenate(at)
    order = np.argsort(at_all, kind="stable")
    begin = np.searchsorted(at_all[order], np.arange(n + 1)).tolist()
    exact = to_all[order].tolist()
    position, price = spots.tolist(), cost.tolist()
    best, back = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque([(position[0], 0)])  # best + position, ascending; place
    for j in range(1, n):
        here = position[j]
        while position[queue[0][1]] < here - window:
            queue.popleft()
        value, i = queue[0]
        least, come = value + window - here, i
        for i in exact[begin[j] : begin[j + 1]]:
            if best[i] <= least:
                least, come = best[i], i
        best[j] = least = least + price[j] + window_cost
        back[j] = come
        value = least + here
        while queue and queue[-1][0] > value:
            queue.pop()
        queue.append((value, j))
    path, j = [], n - 1
    while j:
        path.append(position[j])
        j = back[j]
    return path[::-1]


def pack_stretch(buffers: list[bytes], is_end: np.ndarray, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces of the documents, in order: document, start, length, window (from 0), offset in it."""
    ids = np.frombuffer(b"".join(buffers), "<u4")
    lengths = np.array([len(b) // 4 for b in buffers])
    ends = np.flatnonzero(is_end[np.minimum(ids, len(is_end) - 1)]) + 1
    path = cuts(*places(lengths, ends, min(FORCED_EVERY, window)), window)
    document, begin, at = 0, 0, 0
    for w, cut in enumerate(path):
        offset = 0
        while at < cut:
            stop = min(cut, begin + int(lengths[document]))
            yield document, at - begin, stop - at, w, offset
            offset, at = offset + stop - at, stop
            if at == begin + lengths[document]:
                begin, document = at, document + 1


def pack(df: DataFrame, vocabulary: str, ranks: str | None = None, id_column: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END, stretch: int = STRETCH) -> DataFrame:
    """A row per piece: the id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Every row of df is a document of its own, also where ids are null or repeat; a null text is empty, and its only id
    is the end. Order is that of df's partitions: each is packed by itself, in stretches of some `stretch` tokens, a
    longer document in one of its own. sequence_id has the partition in its upper bits. Nothing is shuffled. Other
    columns are left out. An empty df has no pieces.
    """
    kind = df.schema[id_column].dataType.simpleString()
    schema = f"{id_column} {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    names = [id_column, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, is_end = _encoder(vocabulary, ranks)
        sequence = TaskContext.get().partitionId() << 40
        keys: list = []
        buffers: list[bytes] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, held
            rows: list[tuple] = []
            last, size = -1, 0
            for d, start, length, w, offset in pack_stretch(buffers, is_end, window):
                rows.append((keys[d], start, length, buffers[d][4 * start : 4 * (start + length)], len(buffers[d]) // 4, sequence + w, offset))
                last, size = w, size + length
                if size > 1 << 20:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)
            sequence += last + 1
            keys.clear()
            buffers.clear()
            held = 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds: list[Callable] = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        id_type = pa.int64()
        for batch in pieces(batches, 4 << 20):
            id_type = batch.schema.field(0).type
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.encode(body or "") + tail
                keys.append(key)
                buffers.append(ids)
                held += len(ids) // 4
                if held >= stretch:
                    yield from flush()
        if buffers:
            yield from flush()

    return df.select(id_column, text).mapInArrow(run, schema)
