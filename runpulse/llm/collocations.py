"""Phrase collocations by an FM-index per shard over word ids.

1. Each task numbers the words of its documents and cuts them into shards of about a million words.
2. Words are summed over shards; those found often enough get a number of their own, rare ones end a piece.
3. Each shard is indexed both ways: the Burrows-Wheeler transforms of its words and of its words reversed, sorted as
   deep as the longest phrase. A phrase is a pair of intervals, one in each. A word put in front narrows the first by
   its transform and the second by the number of smaller words; a word put behind does the same the other way round.
4. Phrases grow by a word a level, in front and behind in turn. Their counts are summed over shards, and the next
   level extends only phrases that a bitmap of fixed size does not rule out. The bitmap may let a rare phrase pass,
   never lose one, so counts are exact at every size of the corpus.

What a longer phrase takes away from a shorter one, its best extension to the left and to the right, are the
counts of the next level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runpulse.llm.common import discard, pick, running_totals, slices, store, texts_of

#: Words of a shard; a document that goes beyond it ends its shard. An index takes some 60 bytes a word while it is built.
SHARD_WORDS = 1_000_000
#: Places of an index that are worked on at a time.
BLOCK_PLACES = 1 << 18
#: Bits of the bitmap that every task gets, 8 MB.
BITMAP_BITS = 1 << 26
#: Bits of one row of Spark's bitmaps, a fixed value.
_ROW_BITS = 32768
#: The language of documents without one.
UNKNOWN = "und"
#: All marks that end a piece become the first of them, which stands between blanks and is no word.
_BREAK = b"."
_MARKS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", _BREAK * 9)
_SHARD = "shard long, langs array<string>, words array<binary>, counts array<long>, tokens binary"
_INDEX = "shard long, symbols binary, bwt binary, reverse_bwt binary"


class _Numbers(dict):
    """Word of one language to number, from 1; all languages of a shard share its lists."""

    def __init__(self, lang: str, langs: list[str], words: list[bytes]):
        self.lang, self.langs, self.words = lang, langs, words
        self[_BREAK] = 0

    def __missing__(self, word: bytes) -> int:
        self.langs.append(self.lang)
        self.words.append(word)
        number = self[word] = len(self.words)
        return number


class _Shard:
    """Documents' words as numbers; 0 stands between pieces."""

    def __init__(self):
        self.langs: list[str] = []
        self.words: list[bytes] = []
        self.numbers: dict[str, _Numbers] = {}
        self.tokens: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, raw: bytes) -> None:
        numbers = self.numbers.get(lang) or self.numbers.setdefault(lang, _Numbers(lang, self.langs, self.words))
        # Of all white space only blanks and tabs are left to split at.
        words = raw.lower().translate(_MARKS).replace(_BREAK, b" . ").split()
        found = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
        # One break between pieces is enough.
        found = found[(found != 0) | (np.concatenate([[1], found[:-1]]) != 0)]
        self.tokens += [found, np.zeros(1, np.int32)]
        self.size += len(found) + 1

    def row(self, number: int) -> pa.RecordBatch:
        tokens = np.concatenate(self.tokens)
        counts = np.bincount(tokens, minlength=len(self.words) + 1)[1:]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number]),
                pa.array([self.langs], pa.list_(pa.string())),
                pa.array([self.words], pa.list_(pa.binary())),
                pa.array([counts], pa.list_(pa.int64())),
                pa.array([tokens.tobytes()], pa.binary()),
            ],
            ["shard", "langs", "words", "counts", "tokens"],
        )


def shards(docs: DataFrame, most: int = SHARD_WORDS) -> DataFrame:
    """The whole texts of ``docs`` (``lang, text``) as numbered words, a row per shard of about ``most`` words."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made, shard = TaskContext.get().partitionId() << 32, _Shard()
        for batch in batches:
            for part in slices(iter([batch]), "text"):
                for lang, raw in zip(part["lang"].to_pylist(), texts_of(part)):
                    shard.add(lang, raw)
                    if shard.size >= most:
                        yield shard.row(made)
                        made, shard = made + 1, _Shard()
        if shard.words:
            yield shard.row(made)

    known = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("binary").alias("text"))
    return known.mapInArrow(number, _SHARD)


def sorted_to_depth(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``tokens`` in the order of the ``depth`` tokens that start there, by prefix doubling."""
    rank = tokens.astype(np.int64)
    reach = 1
    while True:
        step = min(reach, depth - reach)
        key = rank * (int(rank.max(initial=0)) + 1)
        key[:-step] += rank[step:]
        order = np.argsort(key)
        reach += step
        if reach >= depth:
            return order
        key = key[order]
        rank[order] = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))


def transform(tokens: np.ndarray, depth: int) -> np.ndarray:
    """The Burrows-Wheeler transform of ``tokens``, which end in a 0, sorted to ``depth`` tokens."""
    return tokens[sorted_to_depth(tokens, depth) - 1]


@dataclass
class Intervals:
    """Phrases of one length: a row of ``words`` each, their places in both indexes, and how often they occur."""

    words: np.ndarray
    first: np.ndarray
    reverse: np.ndarray
    size: np.ndarray

    def at(self, chosen: np.ndarray | slice) -> Intervals:
        return Intervals(self.words[chosen], self.first[chosen], self.reverse[chosen], self.size[chosen])


class FmIndex:
    """A bidirectional index of ``tokens``: numbers from 0, where 0 ends a piece; the last is 0."""

    def __init__(self, bwt: np.ndarray, reverse_bwt: np.ndarray):
        self.bwt, self.reverse_bwt = bwt, reverse_bwt
        self._steps: dict[bool, np.ndarray] = {}

    @classmethod
    def of(cls, tokens: np.ndarray, depth: int) -> FmIndex:
        back = np.concatenate([tokens[-2::-1], tokens[-1:]])
        return cls(transform(tokens, depth), transform(back, depth))

    def words(self) -> Intervals:
        """All words, as phrases of one."""
        counts = np.bincount(self.bwt)
        starts = np.cumsum(counts) - counts
        found = np.flatnonzero(counts[1:]) + 1
        return Intervals(found[:, None], starts[found], starts[found], counts[found])

    def _step(self, front: bool) -> np.ndarray:
        """For each place, the place of the same text with the transform's word put in front."""
        if front not in self._steps:
            bwt = self.bwt if front else self.reverse_bwt
            step = np.empty(len(bwt), np.int64)
            step[np.argsort(bwt, kind="stable")] = np.arange(len(bwt))
            self._steps[front] = step
        return self._steps[front]

    def extended(self, phrases: Intervals, front: bool) -> Intervals:
        """Every phrase with each word that stands before it (``front``) or behind it somewhere."""
        bwt, step = (self.bwt, self._step(True)) if front else (self.reverse_bwt, self._step(False))
        here, there = (phrases.first, phrases.reverse) if front else (phrases.reverse, phrases.first)
        total = int(phrases.size.sum())
        if not total:
            return Intervals(np.zeros((0, phrases.words.shape[1] + 1), np.int64), *[np.zeros(0, np.int64)] * 3)
        ends = np.cumsum(phrases.size)
        # Every place of every interval, and the phrase it belongs to.
        places = np.arange(total) + np.repeat(here - ends + phrases.size, phrases.size)
        owner = np.repeat(np.arange(len(phrases.size)), phrases.size)
        key = owner * (int(bwt.max(initial=0)) + 1) + bwt[places]
        order = np.argsort(key, kind="stable")
        key = key[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, total))
        head = order[start]
        of, word = owner[head], bwt[places[head]]
        # The other interval shrinks to the part that follows all smaller words.
        narrowed = there[of] + start - (ends - phrases.size)[of]
        new = step[places[head]]
        words = np.column_stack([word, phrases.words[of]] if front else [phrases.words[of], word])
        grown = Intervals(words, *((new, narrowed) if front else (narrowed, new)), size)
        return grown.at(word != 0)


def slots(words: np.ndarray, bits: int) -> np.ndarray:
    """A bit of the bitmap for each row of global word numbers."""
    mixed = np.full(len(words), 0x9E3779B97F4A7C15, np.uint64)
    for column in words.T.astype(np.uint64):
        mixed = (mixed ^ column) * np.uint64(0xFF51AFD7ED558CCD)
        mixed ^= mixed >> np.uint64(32)
    return (mixed % np.uint64(bits)).astype(np.int64)


def _phrases(
    index: FmIndex, symbols: np.ndarray, length: int, bitmaps: dict[int, np.ndarray], bits: int, shorter: Intervals | None = None
) -> Iterator[Intervals]:
    """All phrases of ``length`` words whose parts one word shorter may be frequent, in blocks; words by shard number."""
    shorter = index.words() if shorter is None else shorter
    size = shorter.words.shape[1] + 1
    for block in _blocks(shorter):
        longer = index.extended(block, front=size % 2 == 0)
        if size < length:
            passing = _passing(longer, symbols, bitmaps[size], bits, (slice(None),))
            yield from _phrases(index, symbols, length, bitmaps, bits, passing)
        elif size == 2:
            yield longer
        else:
            # The part that was extended is in the bitmap; the other one must be as well.
            yield _passing(longer, symbols, bitmaps[size - 1], bits, (slice(1, None), slice(0, -1)))


def _blocks(found: Intervals) -> Iterator[Intervals]:
    """The phrases in runs of about ``BLOCK_PLACES`` places."""
    block = (np.cumsum(found.size) - found.size) // BLOCK_PLACES
    borders = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(block) else []
    for low, high in zip(borders[:-1], borders[1:]):
        yield found.at(slice(low, high))


def _passing(found: Intervals, symbols: np.ndarray, bitmap: np.ndarray, bits: int, parts: tuple) -> Intervals:
    passing = np.ones(len(found.size), bool)
    for part in parts:
        slot = slots(symbols[found.words[:, part]], bits)
        passing &= (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
    return found.at(passing)


def indexed(numbered: DataFrame, words: DataFrame, depth: int) -> DataFrame:
    """The index of each shard of ``numbered`` over the frequent ``words`` (``lang, word, id``)."""
    listed = numbered.select("shard", F.posexplode(F.arrays_zip("langs", "words")).alias("at", "w"))
    named = listed.select("shard", "at", F.col("w.langs").alias("lang"), F.col("w.words").alias("word"))
    ids = named.join(words.select("lang", "word", "id"), ["lang", "word"])
    by_shard = ids.groupBy("shard").agg(F.collect_list(F.struct("at", "id")).alias("ids"))
    ready = numbered.select("shard", "tokens").join(by_shard, "shard").select("shard", "tokens", "ids.at", "ids.id")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                tokens = np.frombuffer(batch["tokens"][row].as_buffer(), np.int32)
                at, ids = (batch[name][row].values.to_numpy(zero_copy_only=False) for name in ("at", "id"))
                order = np.argsort(ids)
                local = np.zeros(int(tokens.max(initial=0)) + 1, np.int32)
                local[at[order] + 1] = np.arange(1, len(ids) + 1)
                # Rare words end a piece as well, and one break between pieces is enough.
                tokens = np.append(local[tokens], np.int32(0))
                tokens = tokens[(tokens != 0) | (np.concatenate([[1], tokens[:-1]]) != 0)]
                index = FmIndex.of(tokens, depth)
                symbols = np.concatenate([[-1], ids[order]]).astype(np.int64)
                parts = [symbols, index.bwt.astype(np.int32), index.reverse_bwt.astype(np.int32)]
                yield pa.RecordBatch.from_arrays(
                    [batch["shard"].slice(row, 1), *[pa.array([p.tobytes()], pa.binary()) for p in parts]],
                    ["shard", "symbols", "bwt", "reverse_bwt"],
                )

    return ready.mapInArrow(build, _INDEX)


def _counted(indexes: DataFrame, length: int, bitmaps: dict[int, np.ndarray], bits: int, least: int) -> DataFrame:
    """``w0, w1, ..., f``: phrases of ``length`` words found ``least`` times or more over all shards."""
    names = [f"w{i}" for i in range(length)]
    sent = indexes.sparkSession.sparkContext.broadcast(bitmaps)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                symbols = np.frombuffer(batch["symbols"][row].as_buffer(), np.int64)
                both = (np.frombuffer(batch[n][row].as_buffer(), np.int32) for n in ("bwt", "reverse_bwt"))
                for found in _phrases(FmIndex(*both), symbols, length, sent.value, bits):
                    columns = [pa.array(symbols[found.words[:, i]]) for i in range(length)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(found.size, pa.int64())], [*names, "n"])

    kinds = ", ".join(f"{name} long" for name in names)
    found = indexes.mapInArrow(count, f"{kinds}, n long")
    return found.groupBy(*names).agg(F.sum("n").alias("f")).where(F.col("f") >= least)


def _bitmap(phrases: DataFrame, length: int, bits: int) -> np.ndarray:
    """One bit per slot of the phrases: ``bits`` / 8 bytes, however many phrases there are."""
    names = [f"w{i}" for i in range(length)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.column_stack([batch[name].to_numpy() for name in names])
            yield pa.RecordBatch.from_arrays([pa.array(slots(words, bits))], ["slot"])

    slot = phrases.select(*names).mapInArrow(place, "slot long").select(
        F.floor(F.col("slot") / _ROW_BITS).alias("row"), (F.col("slot") % _ROW_BITS).alias("bit")
    )
    rows = slot.groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    bitmap = np.zeros(bits // 8, np.uint8)
    for row in rows:
        at = row["row"] * _ROW_BITS // 8
        bitmap[at : at + _ROW_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
    return bitmap


@dataclass(frozen=True)
class Counts:
    """Frequent words (``lang, word, id, f``), frequent phrases (``words`` by id, ``f``), and words per language."""

    words: DataFrame
    phrases: DataFrame
    totals: DataFrame


def phrase_counts(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = 30, longest: int = 4,
    shard_words: int = SHARD_WORDS, bits: int = BITMAP_BITS,
) -> Counts:
    """How often each phrase of up to ``longest`` words occurs in a language, for those found ``least`` times or more.

    Phrases don't reach over the marks that end a piece, and overlapping occurrences count each. A null
    text has no words, and a null language is ``UNKNOWN``. Repeated rows each count.
    """
    known = pick(docs, lang, text).toDF("lang", "text")
    numbered = store(shards(known, shard_words), "numbered-words")
    each = numbered.select(F.inline(F.arrays_zip("langs", "words", "counts"))).toDF("lang", "word", "n")
    summed = store(each.groupBy("lang", "word").agg(F.sum("n").alias("f")), "summed-words")
    totals = store(summed.groupBy("lang").agg(F.sum("f").alias("n")), "words-per-language")
    frequent = summed.where(F.col("f") >= least)
    placed = running_totals(frequent, [F.col("lang"), F.col("word")], [], "frequent-words")
    words = store(placed.withColumnRenamed("pos", "id"), "frequent-words")
    indexes = store(indexed(numbered, words, longest), "word-indexes")
    discard(numbered, summed)
    levels, bitmaps = [], {}
    for length in range(2, longest + 1):
        found = store(_counted(indexes, length, bitmaps, bits, least), f"phrases-{length}")
        levels.append(found.select(F.array(*[f"w{i}" for i in range(length)]).alias("words"), "f"))
        if length < longest:
            bitmaps[length] = _bitmap(found, length, bits)
    discard(indexes)
    return Counts(words, reduce(DataFrame.unionByName, levels), totals)


def _part(words: str, start: Column | int, size: Column | int) -> Column:
    return F.slice(words, start, size)


def scored(counts: Counts) -> DataFrame:
    """Every phrase with ``a, l, r`` and the ``score`` of its weakest cut; equal cuts go to the shorter first part.

    Products are decimals of 38 digits, so they are exact beyond 64 bits.
    """
    singles = counts.words.select(F.array("id").alias("words"), "f")
    known = singles.unionByName(counts.phrases)
    cuts = counts.phrases.select(
        "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")
    ).select("*", _part("words", 1, F.col("k")).alias("front"), _part("words", F.col("k") + 1, F.size("words")).alias("back"))
    left = known.select(F.col("words").alias("front"), F.col("f").alias("l"))
    right = known.select(F.col("words").alias("back"), F.col("f").alias("r"))
    whole = lambda c: F.col(c).cast("decimal(20,0)")
    both = cuts.join(left, "front").join(right, "back").withColumns(
        {"_up": F.lit(2000000).cast("decimal(7,0)") * whole("a"), "_down": whole("l") + whole("r")}
    )
    best = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("cut")
    found = both.withColumn("score", F.expr("_up div _down")).groupBy("words", "a").agg(best)
    return found.select("words", "a", "cut.l", "cut.r", "cut.score")


def extensions(counts: Counts) -> DataFrame:
    """``words, left_most, right_most``: the highest count of a frequent phrase with one word more in front or behind."""
    longer = counts.phrases.where(F.size("words") > 2)
    size = F.size("words")
    sides = longer.select(
        F.explode(
            F.array(
                F.struct(_part("words", 2, size).alias("words"), F.col("f").alias("left"), F.lit(0).cast("long").alias("right")),
                F.struct(_part("words", 1, size - 1).alias("words"), F.lit(0).cast("long").alias("left"), F.col("f").alias("right")),
            )
        ).alias("side")
    ).select("side.*")
    return sides.groupBy("words").agg(F.max("left").alias("left_most"), F.max("right").alias("right_most"))


def collocations(
    docs: DataFrame, *, top: int = 2000, covered_percent: int = 80, text: str = "text", lang: str = "lang",
    least: int = 30, longest: int = 4, shard_words: int = SHARD_WORDS, bits: int = BITMAP_BITS,
) -> DataFrame:
    """Each language's ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score, left_most, right_most``.

    Phrases have 2 to ``longest`` words and occur ``least`` times or more. One that stands inside a longer such
    phrase with ``covered_percent`` of its count or more is left out; a phrase two words longer is never
    more frequent than the one between, so its own extensions tell. The order is by score and count descending,
    then by the phrase's bytes. Empty tables, and texts without words, give no rows.
    """
    counts = phrase_counts(
        docs, text=text, lang=lang, least=least, longest=longest, shard_words=shard_words, bits=bits
    )
    zero = F.lit(0).cast("long")
    judged = scored(counts).join(extensions(counts), "words", "left").withColumns(
        {"left_most": F.coalesce("left_most", zero), "right_most": F.coalesce("right_most", zero)}
    )
    longer = F.greatest("left_most", "right_most").cast("decimal(20,0)")
    kept = judged.where(longer * 100 < F.col("a").cast("decimal(20,0)") * covered_percent)
    first = F.element_at("words", 1).alias("id")
    langs = counts.words.select("id", "lang")
    spoken = store(kept.select("*", first).join(langs, "id").drop("id"), "collocations")
    # All that tie with the last place are named before the bytes of the phrases decide.
    order = [F.desc("score"), F.desc("a")]
    tied = spoken.withColumn("_at", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("_at") <= top)
    names = counts.words.select("id", F.col("word").cast("string").alias("word"))
    listed = tied.select("lang", "words", F.posexplode("words").alias("pos", "id")).join(names, "id")
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda w: w["word"]), " ")
    named = tied.drop("_at").join(listed.groupBy("lang", "words").agg(phrase.alias("phrase")), ["lang", "words"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).alias("rank")
    ranked = named.select("*", rank).where(F.col("rank") <= top).join(counts.totals, "lang")
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score", "left_most", "right_most")
