"""Alignment of two tokenizers' tokens by the byte offsets where tokens of both end.

The pieces of a text's alignment form a monoid. A ``Fragment`` covers a range of bytes: what comes before its
first common end is open to the left, what follows the last one is open to the right, and the groups in between
are closed. ``compose`` joins two neighbours by closing the group that their open parts make. It is associative, so
fragments of one document can be joined in any grouping.

* Long documents are cut into byte ranges at fixed places, in the middle of words and tokens alike. A token
  belongs to the range its last byte lies in; a range's task is sent the few bytes around it that settle how its outermost
  words are cut. Ranges are dealt over the cluster, and their fragments are joined in rounds of ``FAN_IN``.
* Other documents are one fragment each, put together from the fragments of their words, which a worker remembers.

Both tokenizers cut a text at a blank or line end between two other characters, so a word can be encoded alone.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runpulse.llm.common import discard, pick, remembered, slices, store, texts_of
from runpulse.llm.tokenizing import _HAS_SPACE, _BYTE_LETTERS, TokenIds, _room

#: Longer documents are cut into ranges of so many bytes.
RANGE_BYTES = 1 << 16
#: Fragments that are joined by one call.
FAN_IN = 16
#: Words kept per worker; beyond it the memory starts afresh.
KEPT_WORDS = 300_000
#: Pairs whose counts every task gets: those in more documents than only so many pairs can be in; 9 MB.
COMMON_PAIRS = 1 << 19

#: In front of remembered bytes that are no word after one blank or line end; no UTF-8 starts with it.
_ODD = b"\xff"
_BORDER = re.compile(rb"(?<=[!-~])[ \n](?=[!-~])")
_UNIT = re.compile(r"(?<=\S)(?=[ \n]\S)")

_IDS = pa.list_(pa.int32())
_LONGS = pa.list_(pa.int64())
_ROW = {
    "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "groups_sha256": pa.string(),
    "keys": _LONGS, "links": _LONGS,
}
_ROW_TYPES = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, keys array<long>, links array<long>"
_FRAGMENT = {
    "whole": pa.bool_(), "cut": pa.bool_(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(),
    "left_a": _IDS, "left_b": _IDS, "closed": pa.binary(), "right_a": _IDS, "right_b": _IDS, "keys": _LONGS, "links": _LONGS,
}
_FRAGMENT_TYPES = (
    "row long, doc_id long, place long, whole boolean, cut boolean, n_a long, n_b long, n_groups long, left_a array<int>,"
    " left_b array<int>, closed binary, right_a array<int>, right_b array<int>, keys array<long>, links array<long>"
)

Ids = list[int]


def cut_groups(a: Ids, a_ends: Ids, b: Ids, b_ends: Ids) -> tuple[list[tuple[Ids, Ids]], tuple[Ids, Ids]]:
    """The groups that end where tokens of both end, and the tokens behind the last of them."""
    groups, i, j, i0, j0 = [], 0, 0, 0, 0
    while i < len(a) and j < len(b):
        if a_ends[i] == b_ends[j]:
            i, j = i + 1, j + 1
            groups.append((a[i0:i], b[j0:j]))
            i0, j0 = i, j
        elif a_ends[i] < b_ends[j]:
            i += 1
        else:
            j += 1
    return groups, (a[i0:], b[j0:])


def group_text(group: tuple[Ids, Ids]) -> bytes:
    return b"%s|%s" % tuple(",".join(map(str, side)).encode() for side in group)


def group_links(groups: list[tuple[Ids, Ids]], width: int) -> Counter:
    """How many links each pair has in ``groups``, by ``a * width + b``."""
    links: Counter = Counter()
    for a, b in groups:
        if len(a) == len(b) == 1:
            links[a[0] * width + b[0]] += 1
        else:
            many = Counter(b)
            for x, times in Counter(a).items():
                for y, n in many.items():
                    links[x * width + y] += times * n
    return links


@dataclass
class Fragment:
    """A range's alignment. Without a common end (``cut``) all its tokens are in ``left``."""

    whole: bool = True
    cut: bool = False
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    left: tuple[Ids, Ids] = field(default_factory=lambda: ([], []))
    closed: list[bytes] = field(default_factory=list)
    right: tuple[Ids, Ids] = field(default_factory=lambda: ([], []))
    links: Counter = field(default_factory=Counter)

    @classmethod
    def of(cls, a: Ids, a_ends: Ids, b: Ids, b_ends: Ids, width: int, whole: bool = True) -> Fragment:
        if not whole:
            return cls(whole=False)
        groups, rest = cut_groups(a, a_ends, b, b_ends)
        if not groups:
            return cls(True, False, len(a), len(b), 0, rest)
        first, *inner = groups
        closed = [b";".join(map(group_text, inner))] if inner else []
        return cls(True, True, len(a), len(b), len(inner), first, closed, rest, group_links(inner, width))


def _joined(one: tuple[Ids, Ids], other: tuple[Ids, Ids]) -> tuple[Ids, Ids]:
    return one[0] + other[0], one[1] + other[1]


def compose(one: Fragment, other: Fragment, width: int) -> Fragment:
    """The fragment of both ranges, of which ``other`` follows ``one``. ``Fragment()`` is the neutral element."""
    if not (one.whole and other.whole):
        return Fragment(whole=False)
    n_a, n_b = one.n_a + other.n_a, one.n_b + other.n_b
    if not other.cut:
        if one.cut:
            return Fragment(True, True, n_a, n_b, one.n_groups, one.left, one.closed, _joined(one.right, other.left), one.links)
        return Fragment(True, False, n_a, n_b, 0, _joined(one.left, other.left))
    if not one.cut:
        return Fragment(
            True, True, n_a, n_b, other.n_groups, _joined(one.left, other.left), other.closed, other.right, other.links
        )
    middle = _joined(one.right, other.left)
    closed = [*one.closed, group_text(middle), *other.closed]
    links = one.links + group_links([middle], width) + other.links
    return Fragment(True, True, n_a, n_b, one.n_groups + 1 + other.n_groups, one.left, closed, other.right, links)


def finished(fragment: Fragment, width: int) -> tuple[int, int, int, str, list[int], list[int]]:
    """``n_a, n_b, n_groups, groups_sha256, keys, links`` of a whole document's fragment; keys ascend."""
    if not fragment.whole or not fragment.cut:
        return 0, 0, 0, "", [], []
    digest = hashlib.sha256(group_text(fragment.left))
    for text in fragment.closed:
        digest.update(b";")
        digest.update(text)
    links = fragment.links + group_links([fragment.left], width)
    keys = sorted(links)
    return fragment.n_a, fragment.n_b, fragment.n_groups + 1, digest.hexdigest(), keys, [links[key] for key in keys]


class _Units(dict):
    """Word to number; -1 stands for what is no word between single blanks or line ends."""

    def __init__(self):
        self.waiting: list[bytes] = []
        self.known = 0

    def __missing__(self, word: bytes) -> int:
        bare = word[1:] if word[:1] == b"\n" else word
        if not bare.isalnum() and (not bare or bare[:1] == _ODD or _HAS_SPACE.search(bare.decode("utf-8", "replace"))):
            return -1
        return self.number(word)

    def number(self, word: bytes) -> int:
        if word in self:
            return self[word]
        number = self[word] = self.known + len(self.waiting)
        self.waiting.append(word)
        return number


class Aligner:
    """Alignments by the ``tokenizers`` file ``a_path`` and the SentencePiece model ``b_path``.

    A word's bytes start with the blank or line end before it; the text itself starts with a blank.
    """

    def __init__(self, a_path: str, b_path: str, kept: int = KEPT_WORDS):
        import sentencepiece

        self.a = TokenIds(a_path).tokenizer
        vocabulary = self.a.get_vocab()
        letters = {letter: byte for byte, letter in _BYTE_LETTERS.items()}
        self.a_bytes = {
            number: bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
            for token, number in vocabulary.items()
        }
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.width = self.b.get_piece_size()
        self.b_bytes = [
            bytes([int(piece[1:-1], 16)]) if self.b.is_byte(number) else piece.replace("▁", " ").encode()
            for number, piece in ((n, self.b.id_to_piece(n)) for n in range(self.width))
        ]
        self.a_sizes = {number: len(token) for number, token in self.a_bytes.items()}
        self.a_texts = {number: b"%d" % number for number in self.a_bytes}
        self.b_texts = [b"%d" % number for number in range(self.width)]
        self.b_sizes = [*map(len, self.b_bytes)]
        self.blank = self.b.piece_to_id("▁")
        self.kept = kept
        self._forget()

    def _forget(self) -> None:
        self.units, self.used = _Units(), 0
        self.texts: list[bytes] = []
        # Per word: tokens of A and B, groups, whether its bytes come back, and its pairs.
        self.sizes = np.zeros((1 << 16, 4), np.int64)
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.keys, self.links = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def encode(self, units: list[bytes]) -> list[tuple[Ids, Ids, bool]]:
        """Ids of each word by A and B, and whether both give its bytes back."""
        texts = [u.decode("utf-8", "replace") for u in units]
        coded_a = [code.ids for code in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        # B puts a blank in front of a text by itself.
        coded_b = self.b.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        found, a_bytes, b_bytes, join = [], self.a_bytes.__getitem__, self.b_bytes.__getitem__, b"".join
        for unit, a, b in zip(units, coded_a, coded_b):
            begun = True
            if unit[:1] != b" ":
                begun, b = b[:1] == [self.blank], b[1:]
            found.append((a, b, begun and join(map(a_bytes, a)) == unit and join(map(b_bytes, b)) == unit))
        return found

    def _ends(self, a: Ids, b: Ids) -> tuple[Ids, Ids]:
        """The offset behind each token."""
        return [*accumulate(map(self.a_sizes.__getitem__, a))], [*accumulate(map(self.b_sizes.__getitem__, b))]

    def _word(self, a: Ids, b: Ids) -> tuple[int, bytes, dict[int, int]]:
        """Groups, their text and links of a whole word: ``cut_groups``, ``group_text`` and ``group_links`` in one pass."""
        a_sizes, b_sizes, a_texts, b_texts, width = self.a_sizes, self.b_sizes, self.a_texts, self.b_texts, self.width
        parts, links = [], {}
        i = j = i0 = j0 = 0
        # How much further A's tokens reach than B's.
        ahead = a_sizes[a[0]] - b_sizes[b[0]]
        while True:
            if ahead > 0:
                j += 1
                ahead -= b_sizes[b[j]]
                continue
            if ahead < 0:
                i += 1
                ahead += a_sizes[a[i]]
                continue
            i, j = i + 1, j + 1
            if i - i0 == j - j0 == 1:
                x, y = a[i0], b[j0]
                parts.append(a_texts[x] + b"|" + b_texts[y])
                key = x * width + y
                links[key] = links.get(key, 0) + 1
            else:
                parts.append(b",".join([a_texts[x] for x in a[i0:i]]) + b"|" + b",".join([b_texts[y] for y in b[j0:j]]))
                for x in a[i0:i]:
                    for y in b[j0:j]:
                        key = x * width + y
                        links[key] = links.get(key, 0) + 1
            if i == len(a):
                return len(parts), b";".join(parts), links
            i0, j0 = i, j
            ahead = a_sizes[a[i]] - b_sizes[b[j]]

    def _learn(self) -> None:
        units = self.units
        if not units.waiting:
            return
        words = [w[1:] if w[:1] == _ODD else w if w[:1] == b"\n" else b" " + w for w in units.waiting]
        sizes, texts, lengths, keys, links = [], [], [], [], []
        for a, b, whole in self.encode(words):
            n_groups, text, pairs = self._word(a, b) if whole else (0, b"", {})
            sizes.append((len(a), len(b), n_groups, whole))
            texts.append(text)
            lengths.append(len(pairs))
            keys += pairs
            links += pairs.values()
        to, at = units.known + len(words), self.used + len(keys)
        if to > len(self.sizes):
            self.sizes = np.concatenate([self.sizes, np.zeros((max(to, 2 * len(self.sizes)) - len(self.sizes), 4), np.int64)])
        self.start, self.length = _room(self.start, to), _room(self.length, to)
        self.keys, self.links = _room(self.keys, at), _room(self.links, at)
        self.sizes[units.known : to] = sizes
        self.texts += texts
        self.length[units.known : to] = lengths
        self.start[units.known : to] = self.used + np.cumsum(lengths) - lengths
        self.keys[self.used : at] = keys
        self.links[self.used : at] = links
        self.used, units.known, units.waiting = at, to, []

    def _numbers(self, raw: bytes) -> np.ndarray:
        """The words of the blank and the text ``raw``, as numbers."""
        units = self.units
        keys = raw.replace(b"\n", b" \n").split(b" ")
        # A first word behind a line end does not follow the blank at once.
        numbers = [*map(units.__getitem__, keys)] if raw[:1] != b"\n" else [-1]
        if min(numbers) < 0:
            numbers = [units.number(_key(unit)) for unit in split_units(b" " + raw)]
        return np.array(numbers, np.int64)

    def align(self, texts: list[bytes]) -> list[tuple]:
        """``finished`` rows of whole texts; an empty one has no tokens."""
        if len(self.units) > self.kept or self.used > 8 * self.kept:
            self._forget()
        numbers = [self._numbers(raw) if raw else None for raw in texts]
        self._learn()
        rows = []
        for each in numbers:
            if each is None or not (sizes := self.sizes[each])[:, 3].all():
                rows.append((0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)))
                continue
            n_a, n_b, n_groups, _ = sizes.sum(axis=0).tolist()
            digest = hashlib.sha256(b";".join(map(self.texts.__getitem__, each.tolist()))).hexdigest()
            lengths = self.length[each]
            ends = np.cumsum(lengths)
            flat = np.repeat(self.start[each] - ends + lengths, lengths) + np.arange(ends[-1])
            rows.append((n_a, n_b, n_groups, digest, *_summed(self.keys[flat], self.links[flat])))
        return rows

    def fragment(self, body: bytes, lead: int, keep: int) -> Fragment:
        """The fragment of the ``keep`` bytes of ``body`` behind its first ``lead`` bytes."""
        a, b = [], []
        for unit_a, unit_b, whole in self.encode(split_units(body)):
            if not whole:
                return Fragment(whole=False)
            a += unit_a
            b += unit_b
        a_ends, b_ends = self._ends(a, b)
        sides = []
        for ids, ends in ((a, a_ends), (b, b_ends)):
            first, last = np.searchsorted(ends, [lead, lead + keep], "right")
            sides += [ids[first:last], ends[first:last]]
        return Fragment.of(*sides, self.width)


def _key(unit: bytes) -> bytes:
    """A word after one blank goes without it, and one after a line end as it is; all else is marked."""
    bare = unit[1:]
    plain = bare and bare[:1] != _ODD and not _HAS_SPACE.search(bare.decode("utf-8", "replace"))
    return _ODD + unit if not plain else bare if unit[:1] == b" " else unit


def _summed(keys: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their links."""
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(links[order], starts)


def split_units(body: bytes) -> list[bytes]:
    """``body`` cut before every single blank or line end between two characters that are no white space."""
    return [unit.encode("utf-8", "surrogateescape") for unit in _UNIT.split(body.decode("utf-8", "surrogateescape"))]


def ranges(body: bytes, size: int) -> Iterator[tuple[int, int, bytes]]:
    """``lead, keep, bytes`` of the ranges of about ``size`` bytes that ``body`` is cut into.

    A range's bytes reach from the last border at or before its start to the first at or after its end. Of the
    multiples of ``size`` inside one unbroken stretch only the first is a place to cut, so no stretch is sent more than twice.
    """
    start, before, done = 0, 0, 0
    for place in range(size, len(body), size):
        if place < done:
            continue
        found = _BORDER.search(body, place)
        done = found.start() if found else len(body)
        back = max(size >> 4, 16)
        while True:
            low = max(before, place - back)
            last = [m.start() for m in _BORDER.finditer(body, low, place + 2) if m.start() <= place]
            if last or low == before:
                break
            back *= 4
        here = last[-1] if last else before
        yield start - before, place - start, body[before:done]
        start, before = place, here
    yield start - before, len(body) - start, body[before:]


def _fragment_rows(rows: list[tuple[int, int | None, int, Fragment]]) -> pa.RecordBatch:
    """Fragments as rows: the document's row and id, the range's place, and the fragment."""
    parts = []
    for row, doc_id, place, f in rows:
        sides = (f.left[0], f.left[1], b";".join(f.closed), f.right[0], f.right[1], [*f.links], [*f.links.values()])
        parts.append((row, doc_id, place, f.whole, f.cut, f.n_a, f.n_b, f.n_groups, *sides))
    columns = zip(*parts) if parts else [[]] * (3 + len(_FRAGMENT))
    types = {"row": pa.int64(), "doc_id": pa.int64(), "place": pa.int64()} | _FRAGMENT
    arrays = [pa.array(list(column), kind) for column, kind in zip(columns, types.values())]
    return pa.RecordBatch.from_arrays(arrays, list(types))


def _fragment_of(row: dict) -> Fragment:
    closed = [row["closed"]] if row["n_groups"] else []
    links = Counter(dict(zip(row["keys"], row["links"])))
    left, right = (row["left_a"], row["left_b"]), (row["right_a"], row["right_b"])
    return Fragment(row["whole"], row["cut"], row["n_a"], row["n_b"], row["n_groups"], left, closed, right, links)


def _rows(ids: list, found: list[tuple]) -> pa.RecordBatch:
    columns = [ids, *(zip(*found) if found else [[]] * 6)]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _ROW.values())], list(_ROW))


def aligned(
    docs: DataFrame, a_path: str, b_path: str, width: int, *, size: int = RANGE_BYTES, fan_in: int = FAN_IN
) -> DataFrame:
    """``docs`` (``doc_id, text``) as rows of ``doc_id``, counts, digest, and the distinct pairs with their links.

    A pair's key is ``a * width + b``. ``row`` tells rows with equal ids apart.
    """

    def aligner() -> Aligner:
        return remembered(("aligner", a_path, b_path), lambda: Aligner(a_path, b_path))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield _rows(batch["doc_id"].to_pylist(), aligner().align(texts_of(batch)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            for row, doc_id, raw in zip(batch["row"].to_pylist(), batch["doc_id"].to_pylist(), texts_of(batch)):
                for place, (lead, keep, body) in enumerate(ranges(b" " + raw, size)):
                    values = (row, doc_id, place, lead, keep, body)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v], t) for v, t in zip(values, [pa.int64()] * 5 + [pa.binary()])],
                        ["row", "doc_id", "place", "lead", "keep", "body"],
                    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body"):
            yield _fragment_rows([
                (r["row"], r["doc_id"], r["place"], aligner().fragment(r["body"], r["lead"], r["keep"]))
                for r in batch.to_pylist()
            ])

    def join(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["place"])
        total = Fragment()
        for row in rows:
            total = compose(total, _fragment_of(row), width)
        first = rows[0]
        return pa.Table.from_batches([_fragment_rows([(first["row"], first["doc_id"], first["place"] // fan_in, total)])])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield _rows([r["doc_id"] for r in rows], [finished(_fragment_of(r), width) for r in rows])

    known = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    is_long = F.coalesce(F.octet_length("text") > size, F.lit(False))
    short = known.where(~is_long).mapInArrow(whole, _ROW_TYPES)
    parts = known.where(is_long).withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        cut, "row long, doc_id long, place long, lead long, keep long, body binary"
    )
    # Neighbouring ranges go to different tasks.
    fragments = store(parts.repartition("row", "place").mapInArrow(measure, _FRAGMENT_TYPES), "fragments")
    last = fragments.agg(F.max("place")).head()[0] or 0
    while last > 0:
        joined = fragments.groupBy("row", F.floor(F.col("place") / fan_in)).applyInArrow(join, _FRAGMENT_TYPES)
        shorter, last = store(joined, "fragments"), last // fan_in
        discard(fragments)
        fragments = shorter
    both = short.unionByName(fragments.mapInArrow(finish, _ROW_TYPES))
    rows = store(both.withColumn("row", F.monotonically_increasing_id()), "aligned")
    discard(fragments)
    return rows


def alignment(
    docs: DataFrame, a_path: str, b_path: str, *, doc_id: str = "doc_id", text: str = "text", size: int = RANGE_BYTES,
    fan_in: int = FAN_IN, common: int = COMMON_PAIRS,
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A pair of ids counts once for each row that links it. Counts of the pairs found in the most rows go to
    every task: more than ``rows with pairs / common`` rows have them, so there are fewer than ``common`` such
    pairs. The links of all other pairs join their counts, where no pair has many rows. A null or empty text, and one
    that either tokenizer's tokens do not give back byte by byte, has no tokens: zeros, and an empty digest. Repeated rows
    each get theirs and count each.
    """
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    known = pick(docs, doc_id, text).toDF("doc_id", "text")
    rows = aligned(known, a_path, b_path, width, size=size, fan_in=fan_in)
    counts = rows.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    counts = store(counts.withColumn("a", F.floor(F.col("key") / width)), "pair-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    judged = store(counts.join(most, "a").select("key", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")
    discard(counts)
    least = (rows.agg(F.sum(F.size("keys"))).head()[0] or 0) // common + 1
    usual = judged.where(F.col("n") >= least).toArrow().sort_by("key")
    sent = docs.sparkSession.sparkContext.broadcast([usual[name].to_numpy() for name in ("key", "n", "best")])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counted, best = sent.value
        for batch in batches:
            each = batch["keys"].value_lengths().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(batch.num_rows), each)
            flat, links = (batch[name].flatten().to_numpy(zero_copy_only=False) for name in ("keys", "links"))
            at = np.searchsorted(keys, flat)
            known = np.zeros(len(flat), bool)
            inside = at < len(keys)
            known[inside] = keys[at[inside]] == flat[inside]
            sums = np.zeros((3, batch.num_rows), np.int64)
            np.add.at(sums[0], owner, links)
            some, at, n = owner[known], at[known], links[known]
            np.add.at(sums[1], some, n * best[at])
            np.add.at(sums[2], some, n * counted[at])
            rare = np.bincount(owner[~known], minlength=batch.num_rows)
            offsets = pa.array(np.concatenate([[0], np.cumsum(rare)]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(values[~known])) for values in (flat, links)]
            kept = [batch[name] for name in names]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, sums), *lists], [*names, *new])

    names, new = ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256"], ["n_links", "n_best", "count_sum", "keys", "links"]
    types = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string"
    looked = rows.select(*names, "keys", "links").mapInArrow(
        look_up, f"{types}, n_links long, n_best long, count_sum long, keys array<long>, links array<long>"
    )
    first = store(looked, "looked-up")
    discard(rows)
    rare = first.select("row", F.inline(F.arrays_zip("keys", "links"))).toDF("row", "key", "links")
    found = rare.join(judged.where(F.col("n") < least), "key").groupBy("row").agg(
        F.sum(F.col("links") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("links") * F.col("n")).alias("more")
    )
    total = lambda one, more: (F.col(one) + F.coalesce(more, F.lit(0).cast("long"))).alias(one)
    return first.drop("keys", "links").join(found, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", total("n_best", "more_best"), total("count_sum", "more"), "groups_sha256"
    )
