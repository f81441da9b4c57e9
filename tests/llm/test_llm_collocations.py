"""Collocations against counting by hand, and the index against plain search."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_fixtures import ODD, documents, prose
from runpulse.llm.collocations import FmIndex, collocations, slots

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score", "left_most", "right_most"]


def brute(rows, least, top, longest=4):
    """(text, lang) rows to the operator's rows, every phrase of every piece counted."""
    counts, totals = defaultdict(Counter), Counter()
    table = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b"." * 9)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in (text or "").encode().lower().translate(table).split(b"."):
            words = [w for w in piece.replace(b"\t", b" ").split(b" ") if w]
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, found in counts.items():
        found = {p: f for p, f in found.items() if f >= least}
        kept = []
        for phrase, a in found.items():
            if len(phrase) < 2:
                continue
            longer = [
                f for q, f in found.items()
                if len(q) > len(phrase) and any(q[i : i + len(phrase)] == phrase for i in range(len(q)))
            ]
            if any(100 * f >= 80 * a for f in longer):
                continue
            cuts = [(2000000 * a // (found[phrase[:k]] + found[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            sides = [max([f for q, f in found.items() if part(q) == phrase], default=0) for part in (lambda q: q[1:], lambda q: q[:-1])]
            kept.append((-score, -a, b" ".join(phrase), found[phrase[:k]], found[phrase[k:]], *sides))
        for rank, (score, a, phrase, l, r, *sides) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode("utf-8", "replace"), -a, l, r, totals[lang], -score, *sides))
    return sorted(out)


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=60))
def test_index_finds_every_phrase(tokens):
    tokens = np.array([*tokens, 0], np.int32)
    index = FmIndex.of(tokens, 4)
    for turns in ((True, False, True), (False, True, True), (False, False, False), (True, True, False)):
        found = index.words()
        for size, front in enumerate(turns, 2):
            found = index.extended(found, front)
            windows = [tuple(tokens[i : i + size].tolist()) for i in range(len(tokens) - size + 1)]
            expected = Counter(w for w in windows if 0 not in w)
            assert dict(zip(map(tuple, found.words.tolist()), found.size.tolist())) == expected


def test_slots_do_not_depend_on_the_batch():
    words = np.arange(60).reshape(20, 3)
    assert (slots(words, 1 << 20)[5:9] == slots(words[5:9], 1 << 20)).all()


@pytest.mark.parametrize("shard_words,bits", [(2_000_000, 1 << 20), (50, 1 << 15), (1, 1 << 16)])
def test_small_corpus_matches_counting(spark, shard_words, bits):
    rows = [(prose(seed, 120) + "\nthe quiet GLASS window, of light\x0bthe quiet glass window", lang)
            for seed, lang in enumerate(["en", "en", "de", None, "en", "und"] * 3)]
    docs = documents(spark, [(i, text, lang, "a", 1) for i, (text, lang) in enumerate(rows)]).repartition(3)
    found = rows_of(collocations(docs, least=2, top=40, shard_words=shard_words, bits=bits))
    assert found == brute(rows, 2, 40) and len(found) > 60


def test_odd_documents(spark, odd):
    rows = [(r[1], r[2]) for r in ODD]
    assert rows_of(collocations(odd, least=30, top=25)) == brute(rows, 30, 25)


def test_ties_repeated_rows_and_overlaps(spark):
    rows = [("a a a a a a", "en")] * 4 + [("b c. c b", "en")] * 5 + [("\x01x y é", "fr"), ("\x01x y é", "fr"), ("y\x01 x", "fr")] * 2
    docs = documents(spark, [(1, text, lang, "a", 1) for text, lang in rows])
    for top in (1, 2, 100):
        assert rows_of(collocations(docs, least=2, top=top)) == brute(rows, 2, top)


def test_no_documents(spark, empty):
    assert collocations(empty).collect() == []
