"""Alignment of two tokenizers against whole-text encodings, and the laws of its monoid."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from llm_fixtures import ODD, documents, prose
from runpulse.llm.alignment import Aligner, Fragment, alignment, compose, finished, ranges, split_units
from runpulse.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ALIGNER = Aligner(A, B)
WHOLE_A = Tokenizer.from_file(A)
WHOLE_A.encode_special_tokens = True
WHOLE_B = sentencepiece.SentencePieceProcessor(model_file=B)
TEXTS = ["one <|endoftext|> two", "a▁b", "  x  y ", "\nline\n\nline\n", "tab\tand hard", "日本語の文章 and more", "<s> it's 'tis \x1c x",
         "naïve élan où wide", "x" * 700, "é" * 300 + " " + "\U0001f600" * 90, " ", "\n", "a", "\x00"]


def plain(text):
    """Groups of a text by the whole encodings: [(a ids, b ids)], or None where bytes do not come back."""
    if not text:
        return None
    raw = b" " + text.encode()
    a, b = WHOLE_A.encode(" " + text, add_special_tokens=False).ids, WHOLE_B.encode(text)
    sides = [(a, [ALIGNER.a_bytes[x] for x in a]), (b, [ALIGNER.b_bytes[x] for x in b])]
    if any(b"".join(parts) != raw for _, parts in sides):
        return None
    ends = []
    for _, parts in sides:
        at, here = 0, []
        for part in parts:
            at += len(part)
            here.append(at)
        ends.append(here)
    groups, low = [], [0, 0]
    for cut in sorted(set(ends[0]) & set(ends[1])):
        high = [ee.index(cut, at) + 1 for ee, at in zip(ends, low)]
        groups.append(tuple(ids[i:j] for (ids, _), i, j in zip(sides, low, high)))
        low = high
    return groups


def digest(groups):
    return hashlib.sha256(";".join("|".join(",".join(map(str, side)) for side in g) for g in groups).encode()).hexdigest()


def brute(texts):
    """Rows by the contract, from whole encodings: every link spelled out."""
    links = []
    for text in texts:
        groups = plain(text or "")
        links.append(Counter((x, y) for a, b in groups or [] for x in a for y in b))
    counts = Counter(pair for each in links for pair in each)
    most = Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    rows = []
    for text, each in zip(texts, links):
        groups = plain(text or "") or []
        rows.append((
            sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(each.values()),
            sum(n for p, n in each.items() if counts[p] == most[p[0]]), sum(n * counts[p] for p, n in each.items()),
            digest(groups) if groups else "",
        ))
    return rows


def row_of(groups):
    if groups is None:
        return (0, 0, 0, "")
    return (sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), digest(groups))


def by_ranges(text, size):
    fragments = [ALIGNER.fragment(body, lead, keep) for lead, keep, body in ranges(b" " + text.encode(), size)]
    while len(fragments) > 1:
        pairs = [fragments[i : i + 2] for i in range(0, len(fragments), 2)]
        fragments = [compose(*p, ALIGNER.width) if len(p) == 2 else p[0] for p in pairs]
    return finished(fragments[0], ALIGNER.width)


@pytest.mark.parametrize("text", TEXTS)
def test_texts(text):
    assert ALIGNER.align([text.encode()])[0][:4] == row_of(plain(text))
    for size in (1, 3, 16):
        assert by_ranges(text, size)[:4] == row_of(plain(text))


words = st.text(st.characters(codec="utf-8"), min_size=0, max_size=9)


@settings(max_examples=150, deadline=None)
@given(st.lists(words, max_size=12), st.sampled_from([" ", "\n", "  ", " \n", "\t"]), st.integers(1, 40))
def test_any_text(parts, blank, size):
    text = blank.join(parts)
    expected = row_of(plain(text))
    assert ALIGNER.align([text.encode()])[0][:4] == expected
    if text:
        assert by_ranges(text, size)[:4] == expected


def test_ranges_cover_the_text_and_stay_small():
    body = (" " + prose(3, 3000)).encode()
    found = [*ranges(body, 512)]
    assert len(found) > 20 and sum(keep for _, keep, _ in found) == len(body)
    at = 0
    for lead, keep, part in found:
        assert body[at - lead : at - lead + len(part)] == part and len(part) < 2 * 512
        at += keep
    assert [*ranges(b" " + b"x" * 10_000, 100)][0][2] == b" " + b"x" * 10_000
    assert sum(len(part) for _, _, part in ranges(b" " + b"x" * 10_000 + b" y", 100)) < 30_000


def test_compose_is_associative():
    text = "größer 日本語 it's 'x' naïve \U0001f600\U0001f601 " + prose(4, 60)
    rng = random.Random(2)
    fragments = [ALIGNER.fragment(body, lead, keep) for lead, keep, body in ranges(b" " + text.encode(), 5)]
    straight = Fragment()
    for fragment in fragments:
        straight = compose(straight, fragment, ALIGNER.width)
    assert any(not f.cut for f in fragments) and any(f.right[0] or f.right[1] for f in fragments)
    for _ in range(20):
        some = list(fragments)
        while len(some) > 1:
            i = rng.randrange(len(some) - 1)
            some[i : i + 2] = [compose(some[i], some[i + 1], ALIGNER.width)]
        assert finished(some[0], ALIGNER.width) == finished(straight, ALIGNER.width)


def rows_of(df):
    return [tuple(r)[1:] for r in sorted(df.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, tuple(r)[1:]))]


@pytest.mark.parametrize("common,size,fan_in", [(1 << 19, 1 << 16, 16), (40, 7000, 3), (1, 1000, 16)])
def test_odd_documents_match_brute_force(spark, odd, common, size, fan_in):
    rows = [(r[0], r[1]) for r in ODD]
    expected = sorted(zip([r[0] for r in rows], brute([r[1] for r in rows])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    found = rows_of(alignment(odd, A, B, common=common, size=size, fan_in=fan_in))
    assert found == [
        (n_a, n_b, n_groups, n_links, n_best, count_sum, sha)
        for _, (n_a, n_b, n_groups, n_links, n_best, count_sum, sha) in expected
    ]


def test_no_documents(spark, empty):
    assert alignment(empty, A, B).collect() == []


def test_special_texts_and_copies(spark):
    texts = [*TEXTS, *TEXTS[:3], "the same line", "the same line"]
    docs = documents(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)])
    assert rows_of(alignment(docs, A, B, size=40, common=20)) == brute(texts)


def test_query_matches_brute_force(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    assert rows_of(QUERIES["op13_alignment"](spark, "/root/testdata/sf0.001")) == brute(texts)
    assert split_units(b" a b\nc  d") == [b" a", b" b", b"\nc  d"]
