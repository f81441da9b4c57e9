"""Sharding and mixing against brute force; both native."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from llm_fixtures import ODD, documents, prose
from runpulse.llm import mixing, sharding


def python_nodes(df):
    return re.findall(r"\w*(?:Python|Pandas|Arrow)\w*", df._jdf.queryExecution().executedPlan().toString())


def sizes(rows):
    out = []
    for i, t, *_ in rows:
        raw = (t or "").encode()
        out.append((i is not None, i or 0, zlib.crc32(raw), len(raw) + 8))
    return sorted(out)


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_shards(odd, shards):
    found = sharding.shard_by_bytes(odd, shards)
    assert not python_nodes(found)
    total, before, want, slots = sum(s for *_, s in sizes(ODD)), 0, [], Counter()
    for known, i, crc, size in sizes(ODD):
        shard = (2 * before + size) * shards // (2 * total)
        want.append((i if known else None, size, crc, shard, slots[shard]))
        before, slots[shard] = before + size, slots[shard] + 1
    rows = [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in found.collect()]
    assert sorted(rows, key=lambda r: r[3:]) == want


def test_hot_id_is_split(spark):
    rows = [(5 if i % 3 == 0 else i, f"text {i % 2}", "en", "a", 1) for i in range(3000)]
    held = Counter(r.shard for r in sharding.shard_by_bytes(documents(spark, rows), 24).collect())
    assert sorted(held) == list(range(24)) and set(held.values()) == {125}


def test_no_rows(empty):
    assert sharding.shard_by_bytes(empty, 24).collect() == []
    assert mixing.mix(empty).collect() == []
    assert mixing.mixed(empty).collect() == []


def brute_targets(by_source, weights=(5, 2, 1), share=1.5, most=2):
    """Excess reshared by weight until none is above."""
    names = sorted(by_source, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    done, mix = {}, share * sum(by_source.values())
    while len(done) < len(names):
        rest, left = mix - sum(done.values()), [s for s in names if s not in done]
        aims = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        above = {s: most * by_source[s] for s in left if aims[s] > most * by_source[s]}
        if not above:
            return done | aims
        done |= above
    return done


def brute_mix(rows):
    sized = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _, s, _ in rows]
    by_source = Counter()
    for _, s, n in sized:
        by_source[s] += n
    target = brute_targets(by_source)
    out = []
    for source, total in by_source.items():
        key = lambda r: (hashlib.md5(f"mix|{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, r[2])
        budget, before = int(target[source] + 0.5), 0
        epochs = budget // total if total else 0
        for i, _, n in sorted((r for r in sized if r[1] == source), key=key):
            out.append((i, n, total, epochs * n + max(0, min(n, budget - epochs * total - before))))
            before += n
    return out, target


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x or 0) for x in r))


@pytest.mark.parametrize("case", ["odd", "skew"])
def test_mix(spark, odd, case):
    rows = ODD if case == "odd" else [(i, prose(i, i % 40), "en", "s" + "0129"[min(i % 7, 3)], 1) for i in range(300)]
    found = mixing.mix(odd if case == "odd" else documents(spark, rows))
    assert not python_nodes(found)
    got = found.collect()
    want, target = brute_mix(rows)
    assert order((r.doc_id, r.size, r.source_size, r.taken) for r in got) == order(want)
    aims = defaultdict(float, {t: t for t in target.values()})
    for r in got:
        assert min(abs(r.target - t) for t in aims) < 1e-6 and r.taken <= 2 * r.size
    words = sum(r.size for r in got)
    assert abs(sum(r.taken for r in got) - 1.5 * words) <= len(target)


def test_the_mix_itself(spark):
    rows = [(i, prose(i, 10 + i % 5), "en", "abc"[i % 3], 1) for i in range(60)]
    docs = documents(spark, rows)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and not python_nodes(out)
    copies = Counter(r[0] for r in out.collect())
    want, target = brute_mix(rows)
    assert max(copies.values()) <= 2
    for s, name in enumerate("abc"):
        words = sum(copies[i] * (10 + i % 5) for i in range(60) if i % 3 == s)
        assert abs(words - target[name]) <= 8  # whole documents: half of one at most
