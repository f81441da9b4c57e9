"""Quality rules by tokenizer fertility.

A public vocabulary with byte fallback measures how well a text fits what it was built from: characters
per token, the share of tokens that are bare bytes, and the entropy of the text's tokens.
Texts outside the bands of their language or script are rejected. There are fixed bands per script,
and bands around the median of all distinct texts of the same language and size class, as wide as a
number of robust standard deviations. Where a class has few texts, those of its language of any size judge it,
and else those of its script. Words are encoded one by one, each distinct word once per worker.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runpulse.llm.common import add_columns, if_small, remembered, store
from runpulse.llm.tokenizing import _room, segments

#: Words kept per worker; beyond it the memory starts afresh.
KEPT_WORDS = 500_000

# Rules on words and lines, fixed values.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"

# Bands by script: least and most characters per token, most byte-fallback share, least entropy in bits.
# Scripts of which the vocabulary has few words or none take more tokens and bytes.
BANDS = {
    "latin": (1.5, 8.0, 0.10, 4.0),
    "cyrillic": (1.2, 8.0, 0.20, 4.0),
    "greek": (0.8, 8.0, 0.40, 3.5),
    "other": (0.25, 8.0, 1.00, 3.0),
}
#: Bands of a pool reach so many robust standard deviations (1.4826 times the median absolute deviation) to
#: either side of the median; pools of fewer texts have none.
DEVIATIONS = 4.5
CLASS_TEXTS = 30
#: A robust standard deviation counts as so much at least: a share of the median ratio, bits of entropy, and byte share.
#: That is the spread of common classes, and keeps a band open where near copies fill most of a class.
LEAST_SPREAD = {"ratio": 0.02, "entropy": 0.1, "bytes": 0.01}
#: Beyond this share of a pool's texts by size, entropy is not expected to grow any more.
LONGEST = 0.9
#: Equal texts have equal hashes; they count once in the bands.
HASH = "_text_hash"
# First and last code points of the scripts with bands of their own, fixed values.
SCRIPTS = {"latin": (0x41, 0x24F), "greek": (0x370, 0x3FF), "cyrillic": (0x400, 0x52F)}

MEASURES = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
    "base_failed": "boolean", "script": "string", "n_tokens": "long", "chars_per_token": "double",
    "byte_share": "double", "token_entropy": "double", "in_script_bands": "boolean",
}


class _Numbers(dict):
    """Word to number; a new word gets the next one."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class Fertility:
    """Measures of texts by the SentencePiece model at ``path``."""

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.bare = np.array([self.model.is_byte(i) or self.model.is_unknown(i) for i in range(self.size)])
        self.kept = kept
        self._forget()

    def _forget(self) -> None:
        self.words, self.known, self.used = _Numbers(), 0, 0
        self.ids = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int64)

    def _learn(self, waiting: list[bytes]) -> None:
        coded = self.model.encode([w.decode("utf-8", "replace") for w in waiting], num_threads=1)
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.fromiter((i for ids in coded for i in ids), np.int32, int(lengths.sum()))
        to, at = self.known + len(coded), self.used + len(flat)
        self.start, self.length, self.ids = _room(self.start, to), _room(self.length, to), _room(self.ids, at)
        self.ids[self.used : at] = flat
        self.start[self.known : to] = self.used + np.cumsum(lengths) - lengths
        self.length[self.known : to] = lengths
        self.known, self.used = to, at

    def measure(self, raw: bytes) -> tuple:
        """The text's row of ``MEASURES``."""
        if len(self.words) > self.kept or self.used > 8 * self.kept:
            self._forget()
        lookup = self.words.__getitem__
        numbers = np.concatenate([np.array([*map(lookup, part.split())], np.int64) for part in segments(raw)])
        if len(self.words) > self.known:
            self._learn(_last(self.words, len(self.words) - self.known))
        n_words, repeated = len(numbers), repeat_words(numbers)
        data = np.frombuffer(raw, np.uint8)
        kinds = np.bincount(_BYTE_KINDS[data], minlength=3)
        word_chars, n_symbols = int(kinds[1] + kinds[2]), int(kinds[2])
        base_failed = n_words < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n_words
        lengths = self.length[numbers]
        total = int(lengths.sum())
        ends = np.cumsum(lengths)
        ids = self.ids[np.repeat(self.start[numbers] - ends + lengths, lengths) + np.arange(total)]
        script = script_of(raw)
        if total:
            _, counts = np.unique(ids, return_counts=True)
            share = counts / total
            ratio, bare, entropy = word_chars / total, float(self.bare[ids].mean()), float(-(share * np.log2(share)).sum())
        else:
            ratio = bare = entropy = 0.0
        least, most, bytes_most, entropy_least = BANDS[script]
        fits = least <= ratio <= most and bare <= bytes_most and entropy >= entropy_least
        return (n_words, word_chars, n_symbols, duplicate_lines(raw), repeated, base_failed, script, total, ratio, bare,
                entropy, bool(fits))


def _hashed(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def _last(words: dict, n: int) -> list:
    """The ``n`` keys that came last, oldest first."""
    found = [word for word, _ in zip(reversed(words), range(n))]
    return found[::-1]


def _byte_kinds() -> np.ndarray:
    """0 for white space and continuation bytes, 1 for the first byte of a word's character, 2 for symbols."""
    kinds = np.ones(256, np.int64)
    kinds[[0x20, *range(0x09, 0x0E), *range(0x80, 0xC0)]] = 0
    kinds[list(SYMBOLS)] = 2
    return kinds


_BYTE_KINDS = _byte_kinds()


def repeat_words(numbers: np.ndarray) -> int:
    """Words (given as numbers) in windows of three that are found twice or more."""
    if len(numbers) < 4:
        return 0
    _, alike = np.unique(numbers, return_inverse=True)
    width = int(alike.max()) + 1
    pairs = alike[:-2] * width + alike[1:-1]
    if width < 2_000_000:
        windows = pairs * width + alike[2:]
    else:
        _, pairs = np.unique(pairs, return_inverse=True)
        windows = pairs * width + alike[2:]
    order = np.argsort(windows, kind="stable")
    same = np.diff(windows[order]) == 0
    again = np.zeros(len(windows), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(numbers), bool)
    for shift in range(3):
        covered[shift : len(windows) + shift] |= again
    return int(covered.sum())


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    counts = Counter(raw.split(b"\n"))
    return sum(n - 1 for line, n in counts.items() if n > 1 and line.split())


def script_of(raw: bytes) -> str:
    """The script with bands that most of the text's code points above the digits belong to."""
    if raw.isascii():
        return "latin"
    points = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    counts = {name: int(((points >= low) & (points <= high)).sum()) for name, (low, high) in SCRIPTS.items()}
    counts["other"] = int((points > 0x24F).sum()) - counts["greek"] - counts["cyrillic"]
    return max(counts, key=counts.get)


def fertility(path: str) -> Fertility:
    """This worker's measures."""
    return remembered(("fertility", path), lambda: Fertility(path))


def with_quality(df: DataFrame, model: str, *, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with the ``MEASURES`` and the ``HASH`` of each whole text; columns of ``df`` with such a name are dropped.

    A null text counts as empty. A text fails the base rules with fewer than 50 words or with over half
    of them in repeated windows of three words. Ratios of a text without words are 0. Repeated rows
    each get theirs.
    """
    types = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}

    def measure(texts: list[bytes]) -> list[pa.Array]:
        scale = fertility(model)
        rows = [(*scale.measure(raw), _hashed(raw)) for raw in texts]
        return [pa.array(values, types[kind]) for values, kind in zip(zip(*rows), [*MEASURES.values(), "long"])]

    return add_columns(df, text, {**MEASURES, HASH: "long"}, measure, keep_text)


def bands(measured: DataFrame, group: Column) -> DataFrame:
    """Bands of each pool over all its distinct texts that pass the base rules.

    The pools are those of ``pools``. Columns are ``pool``, ``least_ratio``, ``most_ratio``, ``most_bytes`` and
    ``least_entropy``; to the last comes ``slope`` times the text's ``size_beyond`` (``mid_size``, ``top_size``).
    The slope is that between the medians of the smaller and the larger half of the pool's texts, as entropy
    grows with a text's size; it is 0 inside a size class. However many copies a text has, it is one row before
    anything is sent for the medians.
    """
    size, ratio, entropy = size_of(), F.col("chars_per_token"), F.col("token_entropy")
    names = F.array(*[F.struct(F.lit(n).alias("level"), pool.alias("pool")) for n, pool in enumerate(pools(group))])
    texts = measured.where(~F.col("base_failed")).select(
        names.alias("pools"), HASH, size.alias("size"), ratio, F.col("byte_share"), entropy
    )
    texts = store(texts.dropDuplicates(["pools", HASH]), "distinct").select(F.inline("pools"), "*").drop("pools")
    # The same text under two languages is once in its script.
    wide_ones = texts.where(F.col("level") == 2).dropDuplicates(["pool", HASH])
    texts = store(texts.where(F.col("level") < 2).unionByName(wide_ones).drop(HASH), "pooled")
    middle = lambda x: F.percentile_approx(x, 0.5, 10_000)
    centre = texts.groupBy("pool").agg(
        F.count("*").alias("n"), middle("size").alias("mid_size"), F.percentile_approx("size", LONGEST, 10_000).alias("top_size"),
        middle(ratio).alias("mid_ratio"), middle("byte_share").alias("mid_bytes"),
    )
    centre = store(centre.where(F.col("n") >= CLASS_TEXTS).drop("n"), "centres")
    near = texts.join(if_small(centre), "pool")
    away = lambda x, mid: middle(F.abs(F.col(x) - F.col(mid)))
    low, high = F.col("size") <= F.col("mid_size"), F.col("size") > F.col("mid_size")
    rise = middle(F.when(high, entropy)) - middle(F.when(low, entropy))
    run = middle(F.when(high, F.col("size"))) - middle(F.when(low, F.col("size")))
    # Twice as many tokens add one bit at most.
    slope = F.when(F.max("level") == 0, 0.0).otherwise(F.coalesce(F.least(F.greatest(rise / run, F.lit(0.0)), F.lit(1.0)), F.lit(0.0)))
    spread = near.groupBy("pool").agg(
        away("chars_per_token", "mid_ratio").alias("off_ratio"), away("byte_share", "mid_bytes").alias("off_bytes"),
        slope.alias("slope"),
    )
    sloped = store(centre.join(spread, "pool"), "slopes")
    level = texts.join(if_small(sloped), "pool").withColumn("_level", entropy - F.col("slope") * size_beyond("size"))
    mids = store(level.groupBy("pool").agg(middle("_level").alias("mid_entropy")), "levels")
    off = level.join(if_small(mids), "pool").groupBy("pool").agg(away("_level", "mid_entropy").alias("off_entropy"))
    reach = lambda off, least: DEVIATIONS * F.greatest(1.4826 * F.col(off), least)
    reach_ratio = reach("off_ratio", LEAST_SPREAD["ratio"] * F.col("mid_ratio"))
    return store(
        sloped.join(mids, "pool").join(off, "pool").select(
            "pool", (F.col("mid_ratio") - reach_ratio).alias("least_ratio"),
            (F.col("mid_ratio") + reach_ratio).alias("most_ratio"),
            (F.col("mid_bytes") + reach("off_bytes", F.lit(LEAST_SPREAD["bytes"]))).alias("most_bytes"),
            (F.col("mid_entropy") - reach("off_entropy", F.lit(LEAST_SPREAD["entropy"]))).alias("least_entropy"),
            "slope", "mid_size", "top_size",
        ), "bands",
    )


def size_of() -> Column:
    return F.log2(F.greatest(F.col("n_tokens"), F.lit(1)))


def size_beyond(size: str, prefix: str = "") -> Column:
    """How much larger than its pool's median a text is, up to the size from which entropy is not expected to grow."""
    return F.least(F.col(size), F.col(f"{prefix}top_size")) - F.col(f"{prefix}mid_size")


def pools(group: Column) -> list[Column]:
    """The pools of a text, from narrow to wide: its group's texts of its size class (a power of two), its group's, its script's."""
    return [
        F.concat(F.floor(size_of()).cast("int").cast("string"), F.lit(" of "), group),
        F.concat(F.lit("all of "), group),
        F.concat(F.lit("all in "), F.col("script")),
    ]


def judged(measured: DataFrame, lang: str | None = "lang") -> DataFrame:
    """``measured`` (a stored table of ``with_quality``) with ``kept``, the verdict; a column of that name is replaced.

    A text is kept if it passes the base rules, lies in its script's fixed bands and in those of the narrowest
    of its pools that has enough texts: its language (its script, where ``lang`` is null or no column) and size
    class, its language, its script.
    """
    group = F.concat(F.lit("script "), F.col("script"))
    if lang in measured.columns:
        group = F.coalesce(F.concat(F.lit("language "), F.col(lang).cast("string")), group)
    found = if_small(bands(measured, group))
    others = [c for c in measured.columns if c not in ("kept", HASH)]
    joined = measured.select(*others, size_of().alias("_size"), *[p.alias(f"_pool{n}") for n, p in enumerate(pools(group))])
    tests = []
    for n in range(3):
        pre = f"_in{n}_"
        joined = joined.join(found.select(*[F.col(c).alias(pre + c) for c in found.columns]), F.col(f"_pool{n}") == F.col(f"{pre}pool"), "left")
        ratio, entropy = F.col("chars_per_token"), F.col("token_entropy") - F.col(f"{pre}slope") * size_beyond("_size", pre)
        tests.append(
            (ratio >= F.col(f"{pre}least_ratio")) & (ratio <= F.col(f"{pre}most_ratio"))
            & (F.col("byte_share") <= F.col(f"{pre}most_bytes")) & (entropy >= F.col(f"{pre}least_entropy"))
        )
    known = [F.when(F.col(f"_in{n}_pool").isNotNull(), test) for n, test in enumerate(tests)]
    kept = ~F.col("base_failed") & F.col("in_script_bands") & F.coalesce(*known, F.lit(True))
    return joined.select(*others, kept.alias("kept"))


def filtered(docs: DataFrame, model: str, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns as they are."""
    marks = [f"_c{i}" for i in range(len(docs.columns))]
    named = lambda name: marks[docs.columns.index(name)] if name in docs.columns else None
    measured = store(with_quality(docs.toDF(*marks), model, text=named(text)), "measured")
    return judged(measured, named(lang)).where("kept").select(*marks).toDF(*docs.columns)
