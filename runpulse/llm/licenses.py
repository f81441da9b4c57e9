"""License scans: exact phrases, and short notices with a bounded number of edits.

A notice with at most k edits still holds one of k + 1 consecutive parts of it unchanged
(pigeonhole). Those parts are the seeds: an Aho-Corasick automaton finds them all in one pass over a
text's normalized words, the text around a seed is the candidate, and the ``regex`` library's
bounded-error matching decides whether the notice stands there and with how many edits.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from runpulse.llm.common import pick, slices, texts_of, utf8

#: Phrases that are counted wherever their words stand consecutively, and their labels. Fixed values.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Short notices by label, in normalized words. The wording of the licenses.
NOTICES = {
    "mit": (
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
    ),
    "apache": (
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license",
    ),
    "gpl": (
        "licensed under the gnu general public license version",
        "under the terms of the gnu general public license as published by the free software foundation",
    ),
    "lgpl": ("gnu lesser general public license",),
    "agpl": ("gnu affero general public license",),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted",),
    "mpl": ("subject to the terms of the mozilla public license",),
    "cc": (
        "licensed under cc by nc 4 0",
        "licensed under a creative commons attribution",
        "creative commons attribution noncommercial",
    ),
    "no-warranty": ("the software is provided as is without warranty of any kind",),
    "reserved": ("all rights reserved no part of this",),
}
#: One edit is allowed for so many characters of a notice, and so many edits at most.
CHARS_PER_EDIT, MAX_EDITS = 12, 5
#: A normalized text is searched in windows of so many bytes, which overlap by the longest notice.
WINDOW = 1_000_000

_NOT_WORD = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90))
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else 32 if b in _NOT_WORD else b for b in range(256))


@dataclass(frozen=True)
class Match:
    """A notice found in a text: words ``first_word`` to ``last_word`` (from 0), ``edits`` away."""

    label: str
    notice: str
    first_word: int
    last_word: int
    edits: int
    text: str


def seeds(notice: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` consecutive parts of ``notice`` with their places, as equal in length as can be."""
    borders = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(borders, borders[1:])]


def edits_for(notice: str) -> int:
    return min(MAX_EDITS, max(1, len(notice) // CHARS_PER_EDIT))


class Scanner:
    """All notices' seeds in one automaton, and each notice's bounded-error pattern."""

    def __init__(self, notices: Mapping[str, Sequence[str]], phrases: Mapping[str, str]):
        import ahocorasick
        import regex

        self.phrases = {tuple(p.encode().split()): label for p, label in phrases.items()}
        self.rare = [p.encode() for p in phrases]
        self.notices = [(label, notice, edits_for(notice)) for label, all_ in notices.items() for notice in all_]
        self.patterns = [
            regex.compile(rf"(?<!\S)(?:{regex.escape(notice)}){{e<={edits}}}(?!\S)", regex.BESTMATCH)
            for _, notice, edits in self.notices
        ]
        held: dict[str, list[tuple[int, int]]] = {}
        for number, (_, notice, edits) in enumerate(self.notices):
            for place, part in seeds(notice, edits):
                held.setdefault(part, []).append((number, place))
        self.automaton = ahocorasick.Automaton()
        for part, where in held.items():
            self.automaton.add_word(part, (len(part), where))
        self.automaton.make_automaton()
        self.overlap = 2 * max((len(n) for _, n, _ in self.notices), default=1) + 64

    def phrase_places(self, words: bytes) -> list[tuple[int, str]]:
        """(start word, label) of each place where a phrase's words stand, in normalized ``words``."""
        found = []
        for phrase, (parts, label) in zip(self.rare, self.phrases.items()):
            at = words.find(phrase)
            while at >= 0:
                to = at + len(phrase)
                if words[at - 1 : at] in (b"", b" ") and words[to : to + 1] in (b"", b" "):
                    found.append((at, label))
                at = words.find(phrase, at + 1)
        numbers = word_numbers(words, [at for at, _ in found])
        return [(number, label) for number, (_, label) in zip(numbers, found)]

    def notices_in(self, words: bytes) -> list[Match]:
        """The notices in normalized ``words``: of overlapping finds of one notice the one with the fewest edits."""
        hits: list[tuple[int, int, int, str]] = []
        for base in _windows(words):
            text = words[base : base + WINDOW + self.overlap].decode("utf-8", "replace")
            # Where the seeds say that each notice starts.
            starts: dict[int, list[int]] = {}
            for end, (length, where) in self.automaton.iter(text):
                for number, place in where:
                    starts.setdefault(number, []).append(end + 1 - length - place)
            here = []
            for number, places in starts.items():
                _, notice, edits = self.notices[number]
                for low, high in _nearby(places, edits):
                    region = max(0, low - edits - 1), min(len(text), high + len(notice) + edits + 1)
                    for hit in self.patterns[number].finditer(text, *region):
                        here.append((number, hit.start(), sum(hit.fuzzy_counts), hit.group()))
            ends = byte_offsets(text, [at for _, at, _, _ in here])
            hits += [(number, base + at, edits, group) for at, (number, _, edits, group) in zip(ends, here)]
        found: dict[tuple[int, int], tuple[int, int, str]] = {}
        for first, (number, _, edits, group) in zip(word_numbers(words, [at for _, at, _, _ in hits]), hits):
            if (number, first) not in found or edits < found[number, first][0]:
                found[number, first] = (edits, group.count(" "), group)
        out: list[Match] = []
        for (number, first), (edits, more, text) in sorted(found.items()):
            label, notice, _ = self.notices[number]
            match = Match(label, notice, first, first + more, edits, text)
            if out and out[-1].notice == notice and out[-1].last_word >= first:
                if edits < out[-1].edits:
                    out[-1] = match
            else:
                out.append(match)
        return out

    def scan(self, raw: bytes) -> dict:
        """The text's row: word and phrase counts, labels, score and the notices' spans.

        A phrase scores 1, a notice one less its edits by its length; the text has the highest, else 0.
        """
        words = normalize(raw)
        places = self.phrase_places(words)
        notices = self.notices_in(words)
        starts = [at for at, _ in places]
        score = max([1.0 if places else 0.0, *(1 - m.edits / len(m.notice) for m in notices)])
        base = {label for _, label in places}
        return {
            "n_words": words.count(b" ") + 1 if words else 0,
            "n_base": len(places),
            "first_word": min(starts, default=None),
            "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | {m.label for m in notices})),
            "score": score,
            "notices": [vars(m) for m in notices],
        }


def _nearby(places: list[int], edits: int) -> list[tuple[int, int]]:
    """Seeds of one occurrence name places at most ``edits`` apart to either side: first and last place of each such run.

    Notices that stand side by side are further apart, so each gets a region of its own, as long as a notice.
    """
    runs: list[list[int]] = []
    for place in sorted(places):
        if runs and place - runs[-1][0] <= 2 * edits:
            runs[-1][1] = place
        else:
            runs.append([place, place])
    return [(low, high) for low, high in runs]


def word_numbers(words: bytes, places: list[int]) -> list[int]:
    """The number of the word that each byte of ``places`` is in; the text is read once for all."""
    if not places:
        return []
    return np.searchsorted(np.flatnonzero(np.frombuffer(words, np.uint8) == 32), places).tolist()


def byte_offsets(text: str, places: list[int]) -> list[int]:
    """The UTF-8 offsets of characters; the text is read once for all."""
    if not places or text.isascii():
        return places
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    sizes = 1 + (points > 0x7F) + (points > 0x7FF).astype(np.int64) + (points > 0xFFFF)
    return (np.cumsum(sizes) - sizes)[places].tolist()


def _windows(words: bytes) -> list[int]:
    """Where the windows over ``words`` start: each at a word, or after ``WINDOW`` bytes without a space."""
    starts = [0]
    while len(words) - starts[-1] > WINDOW:
        space = words.rfind(b" ", starts[-1] + 1, starts[-1] + WINDOW)
        starts.append(space + 1 if space >= 0 else starts[-1] + WINDOW)
    return starts


def normalize(raw: bytes) -> bytes:
    """Words (runs of 0-9, a-z and anything beyond ASCII, A-Z as a-z) with single spaces between."""
    return b" ".join(raw.translate(_NORMAL).split())


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner(NOTICES, PHRASES)


NOTICE = pa.struct(
    [("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()),
     ("edits", pa.int64()), ("text", pa.string())]
)
FOUND = {
    "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
    "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "notices": pa.list_(NOTICE),
}
SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "notices array<struct<label: string, notice: string, first_word: long, last_word: long, edits: long, text: string>>"
)


def scan_licenses(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row its id, the exact phrases' counts and places, labels, score, and ``notices`` with their spans.

    Whole texts are scanned; a null text counts as empty and has no labels (empty text) and score 0.
    Repeated rows each get theirs. Other columns are not read.
    """
    rows = pick(docs, doc_id, text).toDF("doc_id", "text").select("doc_id", utf8("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [scanner().scan(raw) for raw in texts_of(batch)]
            columns = [pa.array([f[name] for f in found], kind) for name, kind in FOUND.items()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", *FOUND])

    return rows.mapInArrow(find, f"doc_id {kind}, {SCHEMA}")
