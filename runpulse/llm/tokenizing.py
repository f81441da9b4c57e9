"""Token ids of whole texts by a public tokenizer, each distinct word encoded once per worker.

A BPE tokenizer first cuts a text into words and then encodes each word on its own, so the ids
of a text are those of its words in order. ``TokenIds`` keeps the ids of words it has met (a
bounded number of them) and sends only new words to the ``tokenizers`` library. Two layouts:

* ``lower_words``: white space is dropped and letters are lower-cased by the tokenizer itself.
* ``spaced_words``: byte-level BPE, where a word takes the one space in front of it along. A text
  with any other white space than single spaces and single line ends is cut by ``_CHUNK``, which
  states the tokenizer's own rule for runs of white space. Arrow splits a slice of texts and names its distinct
  words, of which each is looked up once. New words of Latin letters go to the tokenizer's own model many in a
  string, where the vocabulary shows that no token can reach from one into the next; ids are told apart by their bytes.

Added tokens such as ``<|endoftext|>`` are found before that, as the library does by default: a text is
cut at them, and what lies between is encoded like texts of its own.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from runpulse.llm.common import remembered

#: Words kept per worker; beyond it the memory starts afresh. About 170 MB.
KEPT_WORDS = 800_000
#: Longer texts are cut at a space between two words, so that one text's word list stays small.
SEGMENT_BYTES = 4_000_000
#: Longer words are encoded but not kept.
KEPT_WORD_BYTES = 200
#: New words that the model gets in one string.
JOINED_WORDS = 128

# White space as Unicode defines it, which is what the tokenizers' patterns call \s.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_HAS_SPACE = re.compile(f"[{_SPACE}]")
_CHUNK = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
# Latin letters below U+0250, then at most one mark: one or two words to either tokenizer.
_PLAIN = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc5-\xc8][\x80-\xbf])+)([.,;:!?]?)")
# For Arrow: the same letters, then any ASCII punctuation; one or two words to a byte-level tokenizer, also after a line end.
_JOINABLE = r"^\n?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc5-\xc8][\x80-\xbf])+[!-/:-@\[-`{-~]*$"
_BORDER = re.compile(rb"(?<=[!-~]) (?=[!-~])")
_FIRST = re.compile(rb"[^ \n]*")


def segments(raw: bytes, most: int = SEGMENT_BYTES) -> list[bytes]:
    """``raw`` in parts of about ``most`` bytes, each later one starting with the space before a word."""
    parts, start = [], 0
    while len(raw) - start > most and (border := _BORDER.search(raw, start + most)):
        parts.append(raw[start : border.start()])
        start = border.start()
    return [*parts, raw[start:]] if start else [raw]


def _groups(parts: list[tuple[int, int, bytes]]) -> Iterator[list[tuple[int, int, bytes]]]:
    """``parts`` (of which the last item is the text) in groups of one or of at most ``SEGMENT_BYTES``."""
    start = size = 0
    for at, (*_, part) in enumerate(parts):
        if at > start and size + len(part) > SEGMENT_BYTES:
            yield parts[start:at]
            start, size = at, 0
        size += len(part)
    if parts:
        yield parts[start:]


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()
_LETTER_CODES = np.array([ord(_BYTE_LETTERS[b]) for b in range(256)], "<u2")


def _crossing() -> tuple[re.Pattern, re.Pattern]:
    """Tokens of nothing but what ``_JOINABLE`` words, joined, hold; and those that reach over a border in between."""
    marks = [b for b in range(ord("!"), 127) if not chr(b).isalnum()]
    letters = [*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3, *range(0xC5, 0xC9)]
    m, s, a = (re.escape("".join(_BYTE_LETTERS[b] for b in some)) for some in (marks, b" \n", letters))
    return re.compile(f"[{m}{s}{a}]+"), re.compile(f"[{a}{m}][{s}]|{_BYTE_LETTERS[10]}[{a}]|[{a}][{m}]")


_JOINED, _CROSSING = _crossing()


class _Words(dict):
    """Word to number; a new word gets the next number and waits to be encoded."""

    def __init__(self):
        self.waiting: list[bytes] = []
        self.known = 0

    def __missing__(self, word: bytes) -> int:
        number = self[word] = self.known + len(self.waiting)
        self.waiting.append(word)
        return number


class _SpacedWords(_Words):
    """Keys without a space stand for a word after a space or a line end, other keys for themselves.

    Of the words that wait, ``joinable`` says which are ``_JOINABLE`` and short enough to keep.
    """

    def __init__(self):
        super().__init__()
        self.joinable: list[bool] = []

    def __missing__(self, word: bytes) -> int:
        if word[:1] != b" ":
            bare = word[1:] if word[:1] == b"\n" else word
            if not bare or _HAS_SPACE.search(bare.decode("utf-8", "replace")):
                return -1
        self.joinable.append(False)
        return super().__missing__(word)

    def numbers(self, keys: pa.Array) -> np.ndarray:
        """The numbers of ``keys``, all different; -1 for one that is no word."""
        listed = keys.to_numpy(zero_copy_only=False).tolist()
        found = np.fromiter(map(self.get, listed, repeat(-1)), np.int64, len(listed))
        new = np.flatnonzero(found < 0)
        unknown = keys.take(pa.array(new))
        short = pc.less_equal(pc.binary_length(unknown), KEPT_WORD_BYTES)
        joinable = pc.and_(short, pc.match_substring_regex(unknown, _JOINABLE)).to_numpy(zero_copy_only=False)
        words = [listed[at] for at in new[joinable].tolist()]
        found[new[joinable]] = self.known + len(self.waiting) + np.arange(len(words))
        self.update(zip(words, found[new[joinable]].tolist()))
        self.waiting += words
        self.joinable += [True] * len(words)
        others = new[~joinable]
        found[others] = [self[listed[at]] for at in others.tolist()]
        return found


class TokenIds:
    """Token ids by the ``tokenizers`` file at ``path``.

    With ``added`` the ids are those of the library's defaults, where the contents of an added token become
    its id; without, such contents are words like others (``encode_special_tokens``).
    """

    def __init__(self, path: str, kept: int = KEPT_WORDS, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # between added tokens there is none
        tokens = self.tokenizer.get_added_tokens_decoder() if added else {}
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in tokens.values()):
            raise ValueError(f"{path} has added tokens that are not matched by their bare contents")
        self.added = {t.content.encode(): number for number, t in tokens.items()}
        longest_first = sorted(map(re.escape, self.added), key=len, reverse=True)
        self._cuts = re.compile(b"(" + b"|".join(longest_first) + b")")
        self.spaced = self.tokenizer.normalizer is None
        self._bare = Tokenizer(self.tokenizer.model) if self.spaced and self._model_keeps_words_apart() else None
        self.kept = kept
        alone = {m.encode(): self.tokenizer.encode(m, add_special_tokens=False).ids for m in ".,;:!?\n"}
        self._marks = {b"": [], **alone}
        self._forget()

    def _forget(self) -> None:
        self.words = _SpacedWords() if self.spaced else _Words()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int64)
        self.used = 0

    def _model_keeps_words_apart(self) -> bool:
        """Whether the model alone gives joined ``_JOINABLE`` words the ids that each has by itself.

        Every merge makes a token of the vocabulary, so words that no token reaches over are merged apart.
        """
        model, vocab = self.tokenizer.model, self.tokenizer.get_vocab(with_added_tokens=False)
        changed = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
        if any(getattr(model, name, True) for name in changed) or not vocab.keys() >= set(_BYTE_LETTERS.values()):
            return False
        self._sizes = np.zeros(max(vocab.values()) + 1, np.int64)
        self._sizes[[*vocab.values()]] = [*map(len, vocab)]
        return not any(_CROSSING.search(token) for token in vocab if _JOINED.fullmatch(token))

    def _lower_numbers(self, raw: bytes) -> np.ndarray:
        """The text's words as numbers."""
        words = self.words
        found = [np.array([*map(words.__getitem__, part.lower().split())], np.int64) for part in segments(raw)]
        return found[0] if len(found) == 1 else np.concatenate(found)

    def _spaced_numbers(self, texts: list[bytes]) -> list[np.ndarray]:
        """The words of each text as numbers."""
        found: list[list[np.ndarray]] = [[] for _ in texts]
        parts = [(n, at, part) for n, raw in enumerate(texts) for at, part in enumerate(segments(raw))]
        for group in _groups(parts):
            for (n, _, _), numbers in zip(group, self._group_numbers(group)):
                found[n].append(numbers)
        return [one[0] if len(one) == 1 else np.concatenate(one) for one in found]

    def _group_numbers(self, group: list[tuple[int, int, bytes]]) -> Iterator[np.ndarray]:
        """The words of each part as numbers; each distinct word of the group is looked up once."""
        words, firsts, rests = self.words, [], []
        for _, at, part in group:
            # A text's first word has no space in front of it; what follows starts with a space or a line end.
            first = b"" if at else _FIRST.match(part)[0]
            plain = at or first and not _HAS_SPACE.search(first.decode("utf-8", "replace"))
            firsts.append(([words[b" " + first]] if first else []) if plain else None)
            rests.append(part[len(first) :] if plain else b"")
        lines = pc.replace_substring(pa.array(rests, pa.large_binary()), "\n", " \n")
        keys = pc.split_pattern(lines, " ")
        named = keys.values.dictionary_encode()
        each = words.numbers(named.dictionary)[named.indices.to_numpy()]
        ends = keys.offsets.to_numpy().tolist()
        for (_, _, part), first, start, end in zip(group, firsts, ends, ends[1:]):
            numbers = each[start + 1 : end]  # before the first space there is nothing
            if first is None or len(numbers) and numbers.min() < 0:
                chunks = _CHUNK.findall(part.decode("utf-8", "replace"))
                numbers = np.array([words[b" " + chunk.encode()] for chunk in chunks], np.int64)
            elif first:
                numbers = np.concatenate([first, numbers])
            yield numbers

    def _code(self, word: bytes) -> list[int] | None:
        """Ids of a word of Latin letters, by the model alone; None if it takes the whole tokenizer."""
        after_line = self.spaced and word[:1] == b"\n"
        if not (plain := _PLAIN.fullmatch(word, after_line)):
            return None
        letters, mark = plain.groups()
        if mark and not after_line and (number := self.words.get(letters, self.words.known)) < self.words.known:
            start = self.start[number]
            return [*self.ids[start : start + self.length[number]].tolist(), *self._marks[mark]]
        if not letters.isascii():
            if not self.spaced:
                letters = letters.decode().lower().encode()
            letters = letters.decode("latin-1").translate(_BYTE_LETTERS)
        else:
            letters = letters.decode()
        if self.spaced and not after_line:
            letters = _BYTE_LETTERS[ord(" ")] + letters
        ids = [t.id for t in self.tokenizer.model.tokenize(letters)]
        return [*self._marks[b"\n"], *ids, *self._marks[mark]] if after_line else ids + self._marks[mark]

    def _joined_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``_JOINABLE`` words in a row, and the number of ids of each, by the model from strings of many."""
        keyed = [w if w[:1] == b"\n" else b" " + w for w in words]
        ends = np.cumsum([*map(len, keyed)])
        letters = _LETTER_CODES[np.frombuffer(b"".join(keyed), np.uint8)].tobytes().decode("utf-16-le")
        borders = [0, *ends[JOINED_WORDS - 1 : -1 : JOINED_WORDS].tolist(), len(letters)]
        strings = [letters[a:b] for a, b in zip(borders, borders[1:])]
        codes = self._bare.encode_batch_fast(strings, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(code.ids for code in codes), np.uint32)
        # A token has as many letters as bytes, and one ends where a word ends.
        counts = np.searchsorted(np.cumsum(self._sizes[ids]), ends, side="right")
        return ids, np.diff(counts, prepend=0)

    def _piece(self, word: bytes) -> str:
        if self.spaced:
            word = word[1:] if word[:1] == b" " else word if word[:1] == b"\n" else b" " + word
        return word.decode("utf-8", "replace")

    def _learn(self) -> None:
        """Encodes the words that wait."""
        words = self.words
        if not words.waiting:
            return
        waiting, joined, others = words.waiting, [], range(len(words.waiting))
        if self._bare:
            joinable = np.array(words.joinable)
            joined, others = np.flatnonzero(joinable).tolist(), np.flatnonzero(~joinable).tolist()
        coded = [self._code(waiting[at]) for at in others]
        rest = [n for n, ids in enumerate(coded) if ids is None]
        pieces = [self._piece(waiting[others[n]]) for n in rest]
        for n, code in zip(rest, self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)):
            coded[n] = code.ids
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.fromiter((i for ids in coded for i in ids), np.uint32, int(lengths.sum()))
        if joined:
            ids, counts = self._joined_ids([waiting[at] for at in joined])
            flat, lengths = np.concatenate([ids, flat]), np.concatenate([counts, lengths])
        to, at = words.known + len(waiting), self.used + len(flat)
        self.start, self.length = _room(self.start, to), _room(self.length, to)
        self.ids = _room(self.ids, at)
        self.ids[self.used : at] = flat
        numbers = words.known + np.array([*joined, *others], np.int64)
        self.start[numbers] = self.used + np.cumsum(lengths) - lengths
        self.length[numbers] = lengths
        self.used, words.known = at, to
        words.waiting = []
        if self.spaced:
            words.joinable = []

    def encode(self, texts: list[bytes], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` in a row, and the number of ids of each; ``end_id`` follows each text.

        An empty text has no ids but ``end_id``. Bytes that are no UTF-8 count as U+FFFD.
        """
        parts = [self._cuts.split(raw) if any(token in raw for token in self.added) else [raw] for raw in texts]
        # Every second part of a text is an added token.
        found = [(at, part) for at, part in enumerate(p for cut in parts for p in cut) if part in self.added]
        if found:
            ids, counts = self._encode([b"" if n % 2 else part for cut in parts for n, part in enumerate(cut)])
            places = np.array([at for at, _ in found], np.int64)
            ids = np.insert(ids, np.cumsum(counts)[places], [self.added[part] for _, part in found])
            counts[places] += 1
            each = np.array([*map(len, parts)], np.int64)
            counts = np.add.reduceat(counts, np.cumsum(each) - each)
        else:
            ids, counts = self._encode(texts)
        if end_id is not None:
            ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
        return ids.astype("<u4", copy=False), counts

    def _encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts``, none with an added token, in a row, and the number of ids of each."""
        if len(self.words) > self.kept or self.used > 8 * self.kept:
            self._forget()
        numbers = self._spaced_numbers(texts) if self.spaced else [*map(self._lower_numbers, texts)]
        long_words = [w for w in self.words.waiting if len(w) > KEPT_WORD_BYTES]
        self._learn()
        each = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        lengths = self.length[each]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.start[each] - ends + lengths, lengths) + np.arange(total)]
        text_ends = np.concatenate([[0], ends])[np.cumsum([len(n) for n in numbers], dtype=np.int64)]
        counts = np.diff(text_ends, prepend=0)
        for word in long_words:
            del self.words[word]
        return ids, counts


def _room(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    return np.concatenate([array, np.zeros(max(size, 2 * len(array)) - len(array), array.dtype)])


def token_ids(path: str) -> TokenIds:
    """This worker's encoder, which gives the ids of the library's defaults."""
    return remembered(("token ids", path), lambda: TokenIds(path, added=True))
