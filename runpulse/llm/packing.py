"""Best-fit packing of tokenised documents into sequences of a fixed length.

A document longer than a sequence is cut into pieces of full length, a shorter one first. How many
pieces there are of each length is all that the packing depends on, so a configuration linear
program over that histogram (at most ``capacity`` rows, whatever the corpus) is solved on the
driver: a configuration says how many pieces of each length share a sequence, and the program asks
how often to use each so that all pieces are placed in the fewest sequences. Multiplicative weights
keep a price per length, a knapsack dynamic program finds the configuration of the highest price that
holds each length, and what is covered gets cheaper. The prices of the best round bound the number of sequences from
below; from them, configurations are used a whole number of times until (nearly) no piece is left, the rest goes
best-fit decreasing, and of a few such roundings the one with the fewest sequences
is taken. Pieces then find their places by number: the
k-th piece of length l goes into the k-th slot of that length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runpulse.llm.common import discard, pick, slices, store, texts_of, utf8
from runpulse.llm.tokenizing import token_ids

CAPACITY = 1024
#: Configurations within this share of the dearest one count as dearest.
NEAR = 1e-3
#: Sharpness of the price update, and the most that a round counts as covered (in pieces a piece).
SHARPNESS, WIDTH = 0.5, 3.0
#: Least price of a piece, as a share of its length's share of a sequence.
SMALL = 1e-4
#: Rounds of the search for prices.
ROUNDS = 80
#: A round that places fewer than one in so many pieces loosens ``NEAR``; best-fit places what the last one leaves.
STALLED = 10_000
#: (Share of a length's pieces that one use takes at most, loosest ``NEAR``): tried in turn, the first with prices
#: by length, until the sequences are within ``TOLERANCE`` of the lower bound.
ATTEMPTS, TOLERANCE = ((1.0, 0.03), (1.0, 0.03), (0.25, 0.03), (1.0, NEAR)), 5e-4

PIECES = "doc_id long, piece int, start long, length long, ids array<int>"
NUMBERED = ", _task int, _k long"
DIGESTS = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


@dataclass
class Plan:
    """Rows of (length, first slot, number of slots, per sequence, first sequence, offset) and totals.

    ``by_program`` is the share of pieces that the program's configurations place.
    """

    slots: np.ndarray
    sequences: int
    lower_bound: int
    by_program: float


def knapsack(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room up to ``capacity`` the highest price of pieces that fit, and the piece it takes (-1: none).

    An exact dynamic program in which pieces repeat freely; of equal prices it takes the longest piece.
    ``lengths`` ascend.
    """
    value = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        value[room] = value[room - 1]
        if n := fitting[room]:
            worth = prices[:n] + value[room - lengths[:n]]
            at = n - 1 - int(np.argmax(worth[::-1]))
            if worth[at] > value[room] + 1e-12:
                value[room], choice[room] = worth[at], at
    # Room that no piece uses is given up, so that every room names the piece to take next.
    last = np.maximum.accumulate(np.where(choice >= 0, np.arange(capacity + 1), 0))
    return value, choice[last]


def configurations(choice: np.ndarray, lengths: np.ndarray, forced: np.ndarray, capacity: int) -> list[dict[int, int]]:
    """For each piece of ``forced`` the dearest configuration that holds it, read off one knapsack."""
    found = [{int(at): 1} for at in forced]
    room = capacity - lengths[forced]
    while (open_ := np.flatnonzero(choice[room] >= 0)).size:
        # The piece fills the room as often as the program would take it in a row.
        taken = choice[room[open_]]
        for i, at in zip(open_.tolist(), taken.tolist()):
            found[i][at] = found[i].get(at, 0) + 1
        room[open_] -= lengths[taken]
        room = np.maximum(room, 0)
    return found


def within(
    config: dict[int, int], at: np.ndarray, lengths: np.ndarray, left: np.ndarray, capacity: int
) -> dict[int, int]:
    """``config`` (places in ``at`` to counts) bounded by the pieces ``left``; the longest that fit fill what that frees."""
    bounded = {int(at[i]): min(n, int(left[at[i]])) for i, n in config.items() if left[at[i]]}
    if sum(bounded.values()) == sum(config.values()):
        return bounded
    room = capacity - sum(int(lengths[i]) * n for i, n in bounded.items())
    place = int(np.searchsorted(lengths[at], room, side="right")) - 1
    while place >= 0:
        i = int(at[place])
        if n := min(room // int(lengths[i]), int(left[i]) - bounded.get(i, 0)):
            bounded[i] = bounded.get(i, 0) + n
            room -= n * int(lengths[i])
        place = min(place, int(np.searchsorted(lengths[at], room, side="right"))) - 1
    return bounded


def rounded_prices(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> np.ndarray:
    """The best of such prices: 0 below some size, 1 where only less than that size fits beside, else by length.

    No configuration costs more than 1: beside a piece of price 1 all others are free.
    """
    sizes = np.arange(capacity // 2 + 1)[:, None]
    prices = np.where(lengths > capacity - sizes, 1.0, np.where(lengths < sizes, 0.0, lengths / capacity))
    return prices[int(np.argmax(prices @ counts))]


def dual_prices(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """Prices of which no configuration costs more than 1, and the price of all pieces: a lower bound.

    Multiplicative weights, from ``rounded_prices``. Each round's knapsack gives the dearest configuration that holds each length;
    those within ``NEAR`` of the dearest of all are used in proportion to the counts. Lengths that they
    cover more often than there are pieces get cheaper, others dearer. The round with the best bound counts.
    """
    prices = np.maximum(rounded_prices(lengths, counts, capacity), SMALL * lengths / capacity)
    best, bound = prices, 0.0
    for turn in range(ROUNDS):
        value, choice = knapsack(prices, lengths, capacity)
        top = value[capacity]
        if counts @ prices / top > bound:
            best, bound = prices / top, float(counts @ prices / top)
        near = np.flatnonzero(prices + value[capacity - lengths] >= (1 - NEAR) * top)
        covered, used = np.zeros(len(lengths)), 0.0
        for at, config in zip(near.tolist(), configurations(choice, lengths, near, capacity)):
            often = counts[at] / config[at]
            used += often
            for i, n in config.items():
                covered[i] += n * often
        share = np.minimum(covered / counts * (bound / used), WIDTH)
        prices = prices * np.exp(-SHARPNESS / (1 + turn) ** 0.5 * (share - 1))
    return best, bound


def solve(
    lengths: np.ndarray, counts: np.ndarray, capacity: int, prices: np.ndarray, step: float, loosest: float
) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """Whole uses of configurations, using no length more often than it occurs, and the counts left over.

    Starts from ``prices``. A use takes at most a share ``step`` of a length's pieces; what is covered gets
    cheaper, as in ``dual_prices``. A knapsack counts pieces as unlimited, so ``within`` bounds each
    configuration by the pieces left; it waits if it loses more than ``NEAR`` by that. A round that places fewer
    than one in ``STALLED`` of all pieces doubles that share, at ``loosest`` it is the last.
    """
    left, total = counts.astype(np.int64).copy(), int(counts.sum())
    prices, slack = prices.copy(), NEAR
    used: dict[tuple, int] = {}
    while (at := np.flatnonzero(left > 0)).size:
        value, choice = knapsack(prices[at], lengths[at], capacity)
        worth = prices[at] + value[capacity - lengths[at]]
        near = np.flatnonzero(worth >= (1 - slack) * value[capacity])
        near = near[np.lexsort((-lengths[at][near], -worth[near]))]
        before = left.copy()
        for local in configurations(choice, lengths[at], near, capacity):
            config = within(local, at, lengths, left, capacity)
            if sum(prices[i] * n for i, n in config.items()) < (1 - slack) * value[capacity]:
                continue
            times = min(min(left[i], max(int(step * counts[i]), n)) // n for i, n in config.items())
            key = tuple(sorted(config.items()))
            used[key] = used.get(key, 0) + int(times)
            for i, n in config.items():
                left[i] -= n * times
        placed = before - left
        if placed.sum() * STALLED <= total:
            if slack >= loosest:
                break
            slack *= 2
        prices *= np.exp(-SHARPNESS * placed / counts)
    return [(dict(key), times) for key, times in used.items()], left


def best_fit_decreasing(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Bins as (configuration, how many); equal bins and equal pieces are handled as one, longest first."""
    bins: dict[int, list[tuple[dict[int, int], int]]] = {}
    for at in np.argsort(-lengths, kind="stable"):
        length, left = int(lengths[at]), int(counts[at])
        for room in sorted(r for r in bins if r >= length):
            held, bins[room] = bins[room], []
            for config, many in held:
                most = room // length
                full = min(many, left // most)
                rest = min(left - full * most, most) if full < many else 0
                left -= full * most + rest
                for number, add in ((full, most), (1 if rest else 0, rest), (many - full - bool(rest), 0)):
                    if number > 0:
                        grown = {**config, int(at): add} if add else config
                        bins.setdefault(room - add * length, []).append((grown, number))
        most = capacity // length
        for number, add in ((left // most, most), (1 if left % most else 0, left % most)):
            if number and add:
                bins.setdefault(capacity - add * length, []).append(({int(at): add}, number))
    return [held for group in bins.values() for held in group]


def plan_packing(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """Slots for ``counts[i]`` pieces of ``lengths[i]`` (ascending, all different, none above ``capacity``)."""
    if not len(lengths):
        return Plan(np.zeros((0, 6), np.int64), 0, 0, 1.0)
    prices = lengths / capacity
    lower_bound = int(np.ceil(counts @ rounded_prices(lengths, counts, capacity) * (1 - 1e-9)))
    chosen, sequences, share = [], None, 0.0
    for attempt, (step, loosest) in enumerate(ATTEMPTS):
        solved, left = solve(lengths, counts, capacity, prices, step, loosest)
        bins = solved + best_fit_decreasing(lengths, left, capacity)
        if sequences is None or sum(n for _, n in bins) < sequences:
            chosen, sequences = bins, sum(n for _, n in bins)
            share = 1 - float(left.sum()) / float(counts.sum())
        if sequences <= lower_bound * (1 + TOLERANCE):
            break
        if attempt == 0:
            prices, bound = dual_prices(lengths, counts, capacity)
            lower_bound = max(lower_bound, int(np.ceil(bound * (1 - 1e-9))))
    rows, sequence, next_slot = [], 0, np.zeros(len(lengths), np.int64)
    for config, times in chosen:
        offset = 0
        for i in sorted(config, key=lambda i: -lengths[i]):
            n = config[i]
            rows.append((int(lengths[i]), int(next_slot[i]), n * times, n, sequence, offset))
            next_slot[i] += n * times
            offset += n * int(lengths[i])
        sequence += times
    return Plan(np.array(sorted(rows), np.int64).reshape(-1, 6), sequence, lower_bound, share)


class _Counter:
    """Numbers the pieces of each length that one task meets."""

    def __init__(self, capacity: int):
        self.task = TaskContext.get().partitionId()
        self.seen = np.zeros(capacity + 1, np.int64)

    def columns(self, lengths: np.ndarray) -> list[pa.Array]:
        """The task, and the number of each of its pieces among those of that length."""
        order = np.argsort(lengths, kind="stable")
        counts = np.bincount(lengths, minlength=len(self.seen))
        place = np.empty(len(lengths), np.int64)
        place[order] = np.arange(len(lengths)) - np.repeat(np.cumsum(counts) - counts, counts)
        numbers = self.seen[lengths] + place
        self.seen += counts
        return [pa.array(np.full(len(lengths), self.task), pa.int32()), pa.array(numbers)]


def id_bytes(tokenizer: str) -> int:
    """Bytes that an id of this tokenizer takes in written sequences: 2 if all its ids fit, else 4."""
    return 2 if max(token_ids(tokenizer).tokenizer.get_vocab().values()) < 1 << 16 else 4


def _cut(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, doc_id: str, text: str, width: int = 0) -> DataFrame:
    """The rows of ``token_pieces``; with a ``width`` ids are bytes, and ``_task`` and ``_k`` of a ``_Counter`` follow."""
    rows = pick(docs, doc_id, text).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), utf8("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, counter = token_ids(tokenizer), _Counter(capacity)
        for batch in slices(batches, "text"):
            ids, counts = encoder.encode(texts_of(batch), end_id)
            pieces = -(-counts // capacity)
            owner = np.repeat(np.arange(len(counts)), pieces)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = counts - (pieces - 1) * capacity
            start = np.where(piece == 0, 0, first[owner] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[owner], capacity)
            offsets = np.concatenate([[0], np.cumsum(length)])
            columns = [
                batch["doc_id"].take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
            ]
            if width:
                ends = pa.py_buffer((offsets * width).astype(np.int32))
                values = pa.py_buffer(ids.astype(f"<u{width}"))
                columns += [pa.Array.from_buffers(pa.binary(), len(length), [None, ends, values]), *counter.columns(length)]
            else:
                columns += [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view(np.int32)))]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = PIECES.replace("array<int>", "binary") + NUMBERED if width else PIECES
    names = [field.split()[0] for field in schema.split(", ")]
    return rows.mapInArrow(cut, schema)


def token_pieces(
    docs: DataFrame, tokenizer: str, end_id: int, *, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: (doc_id, piece, start, length, ids).

    Every whole text is encoded and ``end_id`` appended; a null text counts as empty, so each row has
    at least one piece. Repeated rows each get their pieces. An empty table has none.
    """
    return _cut(docs, tokenizer, end_id, capacity, doc_id, text)


def _placed(rows: DataFrame, length: str, capacity: int) -> DataFrame:
    """Stored ``rows`` with ``_task`` and ``_k`` replaced by ``sequence_id`` and ``offset``.

    The driver gets the histogram, at most ``capacity`` rows, and makes the slots from it, a few for each
    length. The counts of earlier tasks are a stored narrow table, sent to all tasks or joined as Spark
    finds by its size; a row finds its slot by its length and number. Wide columns are not shuffled.
    """
    spark, kept = rows.sparkSession, [c for c in rows.columns if c not in ("_task", "_k")]
    size = F.col(length).cast("long").alias("_length")
    per_task = rows.groupBy("_task", size).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    offsets = store(per_task.select("_task", "_length", "_n", before), "piece-counts")
    histogram = offsets.groupBy("_length").agg(F.sum("_n").alias("n")).orderBy("_length").collect()
    lengths, counts = (np.array([r[name] for r in histogram], np.int64) for name in ("_length", "n"))
    slots = plan_packing(lengths, counts, capacity).slots
    held = spark.createDataFrame(
        slots.tolist(), "_length long, _first long, _many long, _each long, _sequence long, _offset long"
    )
    numbered = rows.withColumn("_length", size).join(offsets, ["_task", "_length"])
    numbered = numbered.withColumn("_at", F.col("_k") + F.col("_before"))
    inside = (F.col("_at") >= F.col("_first")) & (F.col("_at") < F.col("_first") + F.col("_many"))
    found = numbered.alias("n").join(F.broadcast(held).alias("s"), (F.col("n._length") == F.col("s._length")) & inside)
    number = F.col("_at") - F.col("_first")
    return found.select(
        *[F.col(f"n.`{c}`") for c in kept],
        (F.col("_sequence") + F.floor(number / F.col("_each"))).alias("sequence_id"),
        (F.col("_offset") + number % F.col("_each") * F.col("n._length")).alias("offset"),
    )


def pack(pieces: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (anything with a whole ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    Columns of these two names are replaced, others may have any name. Repeated rows each get their
    place. An empty table stays empty; any other length, null included, raises ``ValueError``.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    marks = [f"_c{i}" for i in range(len(pieces.columns))]
    marked = pieces.toDF(*marks).select(*[marks[pieces.columns.index(c)] for c in names])
    length = marks[pieces.columns.index("length")]
    kept = marked.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(capacity)
        for batch in filter(len, batches):
            found = batch[length].cast(pa.int64()).fill_null(0).to_numpy()
            valid = (found > 0) & (found <= capacity)
            columns = counter.columns(np.where(valid, found, 0))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), *columns], [*kept, "_task", "_k"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.schema) + NUMBERED
    rows = store(marked.mapInArrow(number, schema), "pieces")
    if odd := rows.where(F.col(length).isNull() | ~F.col(length).between(1, capacity)).count():
        raise ValueError(f"{odd} pieces have no length from 1 to {capacity}")
    return _placed(rows, length, capacity).toDF(*names, "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed token ids: one row per sequence with ``ids`` and its pieces' (offset, length, doc_id, piece, start).

    ``packed`` has these columns and ``ids``, an array or bytes, which are joined in the order of ``offset``. A
    sequence holds at most ``capacity`` tokens, so no group is large. An empty table has no sequences.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "start", "ids")))
    rows = packed.repartition("sequence_id").groupBy("sequence_id").agg(parts.alias("pieces"))
    if packed.schema["ids"].dataType.typeName() == "binary":
        ids = F.reduce("pieces", F.lit(b""), lambda whole, p: F.concat(whole, p["ids"]))
    else:
        ids = F.flatten(F.transform("pieces", lambda p: p["ids"]))
    return rows.select("sequence_id", ids.alias("ids"), F.transform("pieces", lambda p: p.dropFields("ids")).alias("pieces"))


def write_sequences(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, *, capacity: int = CAPACITY,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Cuts ``docs`` as ``token_pieces`` does, packs the pieces, writes ``sequences`` to ``path`` and reads them.

    ``ids`` are bytes there: little-endian unsigned integers of ``id_bytes(tokenizer)`` bytes. They are written
    once as they are cut, shuffled once to their sequences and written there. Null texts count as empty,
    repeated rows each get their place, an empty table gives no sequence.
    """
    rows = store(_cut(docs, tokenizer, end_id, capacity, doc_id, text, id_bytes(tokenizer)), "pieces")
    made = sequences(_placed(rows, "length", capacity))
    made.write.option("compression", "zstd").parquet(path)
    discard(rows)
    return docs.sparkSession.read.schema(made.schema).parquet(path)


def piece_digests(made: DataFrame, width: int) -> DataFrame:
    """The pieces of written sequences, from the ids of ``width`` bytes there: place, length and checksum of each."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            pieces = batch["pieces"]
            each = pieces.value_lengths().to_numpy(zero_copy_only=False).tolist()
            flat = pieces.flatten()
            ends = (flat.field("offset").to_numpy() + flat.field("length").to_numpy()).tolist()
            sums, at = [], 0
            for ids, n in zip(batch["ids"], each):
                values = memoryview(np.frombuffer(ids.as_buffer(), f"<u{width}").astype("<u4")).cast("B")
                borders = [0, *ends[at : at + n]]
                sums += [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(borders, borders[1:])]
                at += n
            columns = [flat.field(c) for c in ("doc_id", "piece", "start", "length")]
            columns += [pa.array(sums, pa.int64()), batch["sequence_id"].take(pa.array(np.repeat(np.arange(len(each)), each)))]
            yield pa.RecordBatch.from_arrays([*columns, flat.field("offset")], names)

    names = [field.split()[0] for field in DIGESTS.split(", ")]
    return made.select("sequence_id", "ids", "pieces").mapInArrow(digest, DIGESTS)
