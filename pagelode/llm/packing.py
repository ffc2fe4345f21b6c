"""Packing token pieces into sequences of a fixed length by a configuration linear program."""

from __future__ import annotations

import functools
import os
import re
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagelode.llm.common import stored

#: Rounds of multiplicative weights for one linear program, and programs one after the other.
LP_ROUNDS = 120
LP_PASSES = 3
#: The first price of a length is this power of it: above 1, as long pieces are hard to place.
POWER = 1.3
#: How fast the price falls with the share of the pieces that are covered.
RATE = 1.0
#: Pieces of one length that one ranking task may get, on average.
RANK_ROWS = 250_000
#: What the tokenizer separates at in any case, so each stretch between is encoded by itself.
STRETCH = re.compile(r"[^\x20\x09-\x0D]+")
#: Characters of texts, and of stretches, that are looked at together.
GROUP_CHARS, CALL_CHARS = 2 << 20, 1 << 17
#: Bytes of stretches and their ids that a Python worker remembers.
KEPT_BYTES = 320 << 20


class Encoder:
    """Token ids of texts; each stretch without white space is encoded once while it is remembered."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.size = 0

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text; null is empty."""
        group: list[list[str]] = []
        chars = 0
        for text in texts:
            group.append(STRETCH.findall(text or ""))
            chars += len(text or "")
            if chars >= GROUP_CHARS:
                yield from self._grouped(group)
                group, chars = [], 0
        yield from self._grouped(group)

    def _grouped(self, group: list[list[str]]) -> Iterator[np.ndarray]:
        stretches = set(chain.from_iterable(group))
        if self.size > KEPT_BYTES:
            self.known, self.size = {}, 0
        call: list[str] = []
        chars = 0
        for stretch in stretches.difference(self.known):
            call.append(stretch)
            chars += len(stretch)
            if chars >= CALL_CHARS:
                self._learn(call)
                call, chars = [], 0
        self._learn(call)
        for own in group:
            yield np.frombuffer(b"".join(map(self.known.__getitem__, own)), dtype="<u4")

    def _learn(self, stretches: list[str]) -> None:
        """Encode many stretches in one call, which tells for each token whose it is."""
        if not stretches:
            return
        found = self.tokenizer.encode(stretches, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(found.ids, dtype="<u4").tobytes()
        ends = 4 * np.searchsorted(np.array(found.word_ids), np.arange(len(stretches)), "right")
        starts = [0, *ends[:-1].tolist()]
        pieces = map(ids.__getitem__, map(slice, starts, ends.tolist()))
        self.known.update(zip(stretches, pieces, strict=True))
        self.size += 4 * sum(map(len, stretches)) + len(ids) + 180 * len(stretches)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker, which its tasks share one after the other."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """`(id, piece, start, length, ids_crc32)` of all documents, and with `with_ids` the `ids`.

    A document is the ids of its whole text and then `end_id`; null and empty texts are
    `end_id` alone. Documents of more than `capacity` ids are cut into pieces of that
    length, the last one shorter. `tokenizer` is a tokenizer file that every executor can
    open and that separates at ASCII white space, as all do whose pre-tokenizer drops it.
    Repeated rows, and rows without id, are documents each. The checksum is of the ids as
    little-endian unsigned 32-bit numbers.
    """
    schema = "id long, piece int, start long, length int, ids_crc32 long"
    schema += ", ids array<long>" if with_ids else ""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            texts = (text.as_py() for text in batch.column(1))
            found = encoder(tokenizer).encode(texts)
            for doc, own in zip(batch.column(0).to_pylist(), found, strict=True):
                ids = np.append(own, np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start : start + capacity]
                    rows.append((doc, piece, start, len(own), zlib.crc32(own.tobytes()), own))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if with_ids else 5]
            arrays = [pa.array(list(c), kind) for c, kind, _ in zip(columns, kinds, names, strict=False)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(pieces, schema)


# The program. A configuration is a multiset of lengths that fits into one sequence.

Configuration = tuple[tuple[int, int], ...]


def knapsack(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> dict[int, int]:
    """The configuration of the highest price, by dynamic programming over the filled length; of
    equal prices the one with the longest lengths, which leaves short ones for later."""
    best = np.zeros(capacity + 1)
    choice = np.zeros(capacity + 1, dtype=np.int64)
    price = np.full(capacity + 1, -np.inf)
    price[lengths] = prices
    for filled in range(1, capacity + 1):
        worth = price[filled:0:-1] + best[:filled]  # the longest length first
        top = int(worth.argmax())
        if worth[top] > best[filled - 1]:
            best[filled], choice[filled] = worth[top], filled - top
        else:
            best[filled] = best[filled - 1]
    taken: dict[int, int] = defaultdict(int)
    filled = capacity
    while filled:
        taken[int(choice[filled])] += 1
        filled -= max(1, int(choice[filled]))
    taken.pop(0, None)
    return taken


def priced(counts: dict[int, int], prices: np.ndarray, lengths: np.ndarray, capacity: int) -> dict[int, int]:
    """The best configuration, with no length more often than there are pieces of it; the room
    this leaves is filled by the longest pieces that fit."""
    taken = {length: min(n, counts[length]) for length, n in knapsack(prices, lengths, capacity).items()}
    room = capacity - sum(length * n for length, n in taken.items())
    order = lengths.tolist()
    at = bisect_right(order, room) - 1
    while room and at >= 0:
        length = order[at]
        n = min(room // length, counts[length] - taken.get(length, 0))
        if n > 0:
            taken[length] = taken.get(length, 0) + n
            room -= n * length
        at = min(at - 1, bisect_right(order, room) - 1)
    return taken


def fractional(counts: dict[int, int], capacity: int, rounds: int) -> dict[Configuration, float]:
    """How often each configuration is used to cover all pieces, in fractions.

    Multiplicative weights: the price of a length starts as a power of it and falls by a factor
    with the share of its pieces that the configurations so far cover. Each round takes the
    configuration of the highest price, as often as a round's share of all sequences, but no
    more often than any of its lengths has pieces left.
    """
    lengths = np.array(sorted(counts))
    pieces = np.array([counts[int(length)] for length in lengths], dtype=np.float64)
    covered = np.zeros(len(lengths))
    number = {int(length): i for i, length in enumerate(lengths)}
    share = max(1.0, float(lengths @ pieces) / capacity / rounds)
    uses: dict[Configuration, float] = defaultdict(float)
    for _ in range(2 * rounds):
        open_ = pieces - covered > 1e-6
        if not open_.any():
            break
        prices = lengths[open_] ** POWER * np.exp(-RATE * covered[open_] / pieces[open_])
        left = {int(lengths[i]): max(1, int(pieces[i] - covered[i])) for i in np.flatnonzero(open_)}
        taken = priced(left, prices, lengths[open_], capacity)
        at = np.array([number[length] for length in taken])
        often = np.array(list(taken.values()))
        step = min(share, float(((pieces - covered)[at] / often).min()))
        covered[at] += step * often
        uses[tuple(sorted(taken.items()))] += step
    return uses


def configurations(counts: dict[int, int], capacity: int) -> list[tuple[Configuration, int]]:
    """Configurations and how many sequences have each; together they hold every piece once.

    The fractional solution is rounded down, then up where the pieces are there and the
    fraction is a half or more. What is left is a new program, as long as there is much of it;
    the rest, no more pieces than a few configurations have, goes by best fit: longest
    piece first, into the fullest sequence that has room.
    """
    left = {length: n for length, n in counts.items() if n}
    chosen: list[tuple[Configuration, int]] = []

    def take(configuration: Configuration, times: int) -> None:
        times = min([times, *(left.get(length, 0) // n for length, n in configuration)])
        if times > 0:
            chosen.append((configuration, times))
            for length, n in configuration:
                left[length] -= n * times

    if left.get(capacity):
        take(((capacity, 1),), left[capacity])
    for _ in range(LP_PASSES):
        left = {length: n for length, n in left.items() if n}
        if sum(left.values()) <= 2 * LP_ROUNDS:
            break
        uses = fractional(left, capacity, LP_ROUNDS)
        for configuration, times in uses.items():
            take(configuration, int(times))
        for configuration, times in sorted(uses.items(), key=lambda use: (int(use[1]) - use[1], use[0])):
            if times - int(times) >= 0.5:
                take(configuration, 1)
    return chosen + best_fit({length: n for length, n in left.items() if n}, capacity)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Configuration, int]]:
    """Longest piece first, each into the fullest sequence that has room for it."""
    rooms: list[list[dict[int, int]]] = [[] for _ in range(capacity + 1)]
    used: list[int] = []  # rooms with sequences, ascending
    done: list[dict[int, int]] = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            at = bisect_right(used, length - 1)
            room, sequence = (used[at], rooms[used[at]].pop()) if at < len(used) else (capacity, {})
            if at < len(used) and not rooms[room]:
                used.pop(at)
            sequence[length] = sequence.get(length, 0) + 1
            room -= length
            if room:
                if not rooms[room]:
                    used.insert(bisect_right(used, room), room)
                rooms[room].append(sequence)
            else:
                done.append(sequence)
    done += chain.from_iterable(rooms)
    times: dict[Configuration, int] = defaultdict(int)
    for sequence in done:
        times[tuple(sorted(sequence.items()))] += 1
    return list(times.items())


@dataclass
class Slots:
    """Where the pieces of one length go by their rank: runs of ranks, each with the first rank,
    the first sequence, pieces per sequence, and the place of the first of them there."""

    ranks: list[int]
    runs: list[tuple[int, int, int, int]]

    def places(self, ranks: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        own = np.searchsorted(np.array(self.ranks), ranks, side="right") - 1
        first, sequence, per, offset = np.array(self.runs, dtype=np.int64)[own].T
        nth = ranks - first
        return sequence + nth // per, offset + nth % per * length


def slots(chosen: list[tuple[Configuration, int]]) -> dict[int, Slots]:
    found: dict[int, Slots] = defaultdict(lambda: Slots([], []))
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for configuration, times in chosen:
        offset = 0
        for length, n in configuration:
            found[length].ranks.append(used[length])
            found[length].runs.append((used[length], sequence, n, offset))
            used[length] += n * times
            offset += n * length
        sequence += times
    return dict(found)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """`pieces` with `sequence_id` and `offset`: as few sequences of `capacity` ids as it can.

    `pieces` is what `token_pieces` gives, and should be stored, since it is read twice. Only
    the number of pieces of each length comes to the driver, `capacity` numbers at most,
    where the configurations are found. Pieces of a length are numbered in bins by hash, and
    the bins in order, so a length that most pieces have is spread over many tasks; the
    number gives the place by a look-up. Sequences are numbered from 0 and filled from 0
    without gaps. An empty table gives no rows.
    """
    spark = pieces.sparkSession
    counts = {row["length"]: row["count"] for row in pieces.groupBy("length").count().collect()}
    if any(length > capacity for length in counts):
        raise ValueError(f"a piece is longer than {capacity}")
    told = spark.sparkContext.broadcast(slots(configurations(counts, capacity)))
    bins = max(1, -(-sum(counts.values()) // RANK_ROWS))
    names = [name for name in pieces.columns if name != "ids"]
    placed = pieces.select(*names).withColumn("_bin", F.pmod(F.xxhash64("id", "piece"), F.lit(bins)))
    table = placed.groupBy("length", "_bin").count()
    before = Window.partitionBy("length").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    table = table.select(
        "length", "_bin", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before")
    )
    own = Window.partitionBy("length", "_bin").orderBy("id", "piece", "ids_crc32")
    numbered = placed.withColumn("_own", F.row_number().over(own)).join(table, ["length", "_bin"])
    ranked = numbered.select(*names, (F.col("_before") + F.col("_own") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (np.asarray(batch.column(name)) for name in ("length", "rank"))
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths):
                at = lengths == length
                sequence[at], offset[at] = told.value[int(length)].places(ranks[at], int(length))
            columns = [*(batch.column(name) for name in names), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"{name} {pieces.schema[name].dataType.simpleString()}" for name in names)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """`(sequence_id, ids)`: the packed ids, of at most one sequence each.

    `pieces` have their `ids`, `(id, piece)` is unique in them, and no id is null.
    """
    parts = pieces.select("id", "piece", "ids").join(
        placed.select("id", "piece", "sequence_id", "offset"), ["id", "piece"]
    )
    own = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return parts.groupBy("sequence_id").agg(
        F.flatten(F.transform(own, lambda part: part["ids"])).alias("ids")
    )
