"""The license scan on repeated, edited and neighbouring notices."""

import random
import time

import pytest

from llm_fixtures import prose
from runpulse.llm import licenses

SCANNER = licenses.Scanner(licenses.NOTICES, licenses.PHRASES)
EXACT = "licensed under the apache license version 2 0"
EDITED = "licensed under the apache licence versin 2 0"


def spans(text):
    return [(m.notice, m.first_word, m.last_word, m.edits) for m in SCANNER.notices_in(licenses.normalize(text.encode()))]


@pytest.mark.parametrize("between", [" ", " and ", " x ", " é日 ", " and then we go on to say "])
@pytest.mark.parametrize("order", [(EDITED, EXACT), (EXACT, EDITED), (EDITED, EDITED), (EDITED, EXACT, EDITED)])
def test_neighbours_are_all_found(between, order):
    text, at, want = between.join(order), 0, []
    for notice in order:
        want.append((EXACT, at, at + 7, 0 if notice == EXACT else 2))
        at += 8 + len(between.split())
    assert spans(text) == want
    assert spans(f"é {prose(1, 40)} {text} {prose(2, 40)}") == [(n, a + 41, b + 41, e) for n, a, b, e in want]


def edited(notice, edits, rng):
    """``notice`` with letters changed, dropped or doubled inside its words."""
    letters = list(notice)
    inner = [i for i in range(1, len(letters) - 1) if " " not in letters[i - 1 : i + 2]]
    for i in sorted(rng.sample(inner, edits), reverse=True):
        letters[i : i + 1] = rng.choice([["q"], [], [letters[i], "q"]])
    return "".join(letters)


def distance(a, b):
    """Letters to change, drop or add between two texts."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_planted_notices_are_found_once():
    """Every planted notice has one span, and every span is within its edits of the notice by a plain edit distance."""
    rng = random.Random(9)
    for _ in range(60):
        parts, at, want = [], 0, []
        for _ in range(rng.randrange(1, 6)):
            filler = prose(rng.randrange(1000), rng.randrange(1, 30)).replace(".", "")
            number = rng.randrange(len(SCANNER.notices))
            _, notice, allowed = SCANNER.notices[number]
            planted = edited(notice, rng.randrange(min(3, allowed) + 1), rng)
            parts += [filler, planted]
            first = at + len(filler.split())
            at = first + len(planted.split())
            want.append((notice, first, at - 1))
        text = " ".join(parts)
        found = spans(text)
        for notice, first, last in want:
            same = [s for s in found if s[0] == notice and s[1] <= last and s[2] >= first]
            assert len(same) == 1, (notice, first, last, found)
        words = licenses.normalize(text.encode()).decode().split(" ")
        for notice, first, last, edits in found:
            assert distance(" ".join(words[first : last + 1]), notice) <= edits <= licenses.edits_for(notice)


@pytest.mark.parametrize("piece", ["mit license ", EXACT + " ", EDITED + " é ", "permission is hereby granted "])
def test_repeats_take_linear_time(piece):
    times = []
    for repeats in (2_000, 20_000):
        raw = (piece * repeats).encode()
        started = time.perf_counter()
        row = SCANNER.scan(raw)
        times.append(time.perf_counter() - started)
    assert times[1] < 25 * max(times[0], 0.02)
    if piece == "mit license ":
        assert row["n_base"] == 20_000 and row["last_word"] == 39_998 and times[1] < 1
    if "apache" in piece:
        assert len(row["notices"]) == 20_000
