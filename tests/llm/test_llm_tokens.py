"""Token ids, their ORC files, and packing."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from llm_fixtures import ODD, documents, prose
from runpulse.llm import packing, token_orc
from runpulse.llm.tokenizing import _BYTE_LETTERS, TokenIds, segments
from runpulse.session import scratch_path

PATHS = {name: public_tokenizers.path(f"{name}.json") for name in ("byte_bpe_50k", "word_bpe_49k")}
CODERS = {name: TokenIds(path) for name, path in PATHS.items()}
PLAIN = {name: Tokenizer.from_file(path) for name, path in PATHS.items()}
for plain in PLAIN.values():
    plain.encode_special_tokens = True


def direct(name, text):
    return PLAIN[name].encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", PATHS)
@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from("abZé ß\n\t\r\x0b\x85\xa0 '.,1<|>Σİ日́")), max_size=4))
def test_ids_are_the_tokenizers_own(name, texts):
    ids, counts = CODERS[name].encode([t.encode() for t in texts], 2)
    ends = np.cumsum(counts)
    got = [ids[e - n : e].tolist() for e, n in zip(ends, counts)]
    assert got == [[*direct(name, t), 2] for t in texts]


@pytest.mark.parametrize("name", PATHS)
def test_long_texts_and_a_small_memory(name):
    text = prose(9, 30_000).replace(". ", ".\n", 50) + "  end <|endoftext|> "
    coder = TokenIds(PATHS[name], kept=3)
    for _ in range(2):
        ids, _ = coder.encode([text.encode()])
        assert ids.tolist() == direct(name, text)


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.lists(st.text(st.sampled_from("aZéçÑĀšƀȿɐ×÷ª'._&$^`~0st"), max_size=6), max_size=9), max_size=4), line=st.booleans())
def test_joined_words_get_the_ids_that_each_has(texts, line):
    coder = CODERS["byte_bpe_50k"]
    coder._forget()
    texts = [("\n" if line else " ").join(words) for words in texts]
    ids, counts = coder.encode([t.encode() for t in texts])
    wanted = [direct("byte_bpe_50k", t) for t in texts]
    assert ids.tolist() == [i for one in wanted for i in one] and counts.tolist() == [*map(len, wanted)]


class Calls:
    """``held`` but for counting the texts that it is given; ``model`` is counted too."""

    def __init__(self, held, seen):
        self.held, self.seen = held, seen

    def __getattr__(self, name):
        return Calls(self.held.model, self.seen) if name == "model" else getattr(self.held, name)

    def encode_batch_fast(self, texts, **options):
        self.seen += texts
        return self.held.encode_batch_fast(texts, **options)

    def tokenize(self, text):
        self.seen.append(text)
        return self.held.tokenize(text)


def test_new_words_reach_the_library_many_at_once():
    coder, seen = TokenIds(PATHS["byte_bpe_50k"]), []
    words = ["".join(chr(ord("a") + n // 17**k % 17) for k in range(4)) + "é" * (n % 2) + ["", ".", "&&&"][n % 3] for n in range(20_000)]
    text = " ".join(words[:10_000]) + "\n" + "\n".join(words[10_000:])
    coder.tokenizer, coder._bare = Calls(coder.tokenizer, seen), Calls(getattr(coder, "_bare", None), seen)
    assert coder.encode([text.encode()])[0].tolist() == direct("byte_bpe_50k", text)
    assert len(seen) < 500


@pytest.mark.parametrize("merge", [("a", ","), ("a", "Ġ"), ("Ċ", "a"), ("e", "&")])
def test_words_stay_apart_where_a_token_reaches_into_the_next(merge, tmp_path):
    letters = [*_BYTE_LETTERS.values(), "ae"]
    vocab = {token: n for n, token in enumerate([*letters, "".join(merge)])}
    made = Tokenizer(models.BPE(vocab, [merge, ("a", "e")]))
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    made.save(str(tmp_path / "made.json"))
    text = "ae a, ae a ae,\na, ae&& a\nae"
    ids, _ = TokenIds(str(tmp_path / "made.json")).encode([text.encode()])
    assert ids.tolist() == made.encode(text, add_special_tokens=False).ids


UNTOUCHED = {name: Tokenizer.from_file(path) for name, path in PATHS.items()}
ADDING = {name: TokenIds(path, added=True) for name, path in PATHS.items()}


@pytest.mark.parametrize("name", PATHS)
@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|end", "oftext|>", "one", " ", "\n", "é", "́", "<|ENDOFTEXT|>"])).map("".join), max_size=4))
def test_added_tokens_are_found_as_by_default(name, texts):
    ids, counts = ADDING[name].encode([t.encode() for t in texts], 2)
    ends = np.cumsum(counts)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, counts)] == [
        [*UNTOUCHED[name].encode(t, add_special_tokens=False).ids, 2] for t in texts
    ]


def test_queries_operators_find_added_tokens(spark):
    text = "one <|endoftext|> two <|startoftext|>"
    docs, path = documents(spark, [(1, text, "en", "a", 1)]), scratch_path(spark, "orc")
    token_orc.write_token_orc(docs, path, PATHS["word_bpe_49k"], 2)
    (row,) = token_orc.read_token_orc(spark, path).collect()
    assert list(row.ids) == [*UNTOUCHED["word_bpe_49k"].encode(text, add_special_tokens=False).ids, 2]
    (piece,) = packing.token_pieces(docs, PATHS["byte_bpe_50k"], 2).collect()
    assert list(piece.ids) == [*UNTOUCHED["byte_bpe_50k"].encode(text, add_special_tokens=False).ids, 2]


def test_segments_join_to_the_text():
    raw = prose(3, 5000).encode()
    parts = segments(raw, 1000)
    assert b"".join(parts) == raw and len(parts) > 20 and all(p[:1] == b" " for p in parts[1:])


def by_id(rows):
    return sorted((r for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[-1]))


def test_orc_round_trip(spark, odd):
    path = scratch_path(spark, "orc")
    token_orc.write_token_orc(odd, path, PATHS["word_bpe_49k"], 2)
    read = token_orc.read_token_orc(spark, path)
    rows = read.orderBy("part", "place").collect()
    want = [(i, [*direct("word_bpe_49k", t), 2]) for i, t, *_ in ODD]
    assert by_id([(r.doc_id, list(r.ids)) for r in rows]) == by_id(want)
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    digests = token_orc.token_digests(read).orderBy("start").collect()
    assert [(d.doc_id, d.n_tokens, d.ids_crc32) for d in digests] == [(r.doc_id, len(r.ids), crc(r.ids)) for r in rows]
    assert [d.start for d in digests] == np.cumsum([0, *[len(r.ids) for r in rows]])[:-1].tolist()
    some = token_orc.read_token_orc(spark, path, [6, 9])
    assert sorted(r.doc_id for r in some.collect()) == [6, 6, 6, 9]
    assert "PushedFilters: [In(doc_id, [6,9])]" in some._jdf.queryExecution().executedPlan().toString()


def test_orc_of_no_documents(spark, empty):
    path = scratch_path(spark, "orc")
    token_orc.write_token_orc(empty, path, PATHS["word_bpe_49k"], 2)
    assert token_orc.token_digests(token_orc.read_token_orc(spark, path)).collect() == []


def test_packing(spark, odd):
    pieces = packing.token_pieces(odd, PATHS["byte_bpe_50k"], 2)
    packed = packing.pack(pieces).cache()
    rows = packed.collect()
    texts = defaultdict(list)
    assert all(r.length == len(r.ids) for r in rows)
    for i, t, *_ in ODD:
        texts[i].append([*direct("byte_bpe_50k", t), 2])
    for i, wanted in texts.items():
        wanted_pieces = []
        for ids in wanted:
            first = len(ids) - (len(ids) - 1) // 1024 * 1024
            borders = [0, *range(first, len(ids) + 1, 1024)]
            wanted_pieces += [(n, a, ids[a:b]) for n, (a, b) in enumerate(zip(borders, borders[1:]))]
        assert sorted((r.piece, r.start, list(r.ids)) for r in rows if r.doc_id == i) == sorted(wanted_pieces)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        ends = 0
        for offset, length in sorted(places):
            assert offset == ends
            ends += length
        assert ends <= 1024
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    assert {s: sum(n for _, n in places) for s, places in held.items()} == {s: len(ids) for s, ids in whole.items()}
    for one in rows:
        assert whole[one.sequence_id][one.offset : one.offset + one.length] == one.ids


@pytest.mark.parametrize("name, width", [("byte_bpe_50k", 2), ("byte_bpe_50k", 4)])
def test_digests_come_from_the_written_sequences(spark, odd, name, width, monkeypatch):
    assert packing.id_bytes(PATHS[name]) == 2
    monkeypatch.setattr(packing, "id_bytes", lambda tokenizer: width)
    made = packing.write_sequences(odd, scratch_path(spark, "sequences"), PATHS[name], 2)
    whole = {r.sequence_id: np.frombuffer(r.ids, f"<u{width}") for r in made.collect()}
    rows = packing.piece_digests(made, width).collect()
    assert sum(r.length for r in rows) == sum(map(len, whole.values())) and max(map(len, whole.values())) <= 1024
    for r in rows:
        assert r.ids_crc32 == crc(whole[r.sequence_id][r.offset : r.offset + r.length])
    want = packing.token_pieces(odd, PATHS[name], 2).collect()
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
    direct_rows = [(r.doc_id, r.piece, r.start, r.length, crc(r.ids)) for r in want]
    assert sorted(map(str, got)) == sorted(map(str, direct_rows))


def test_packing_no_documents(spark, empty):
    assert packing.pack(packing.token_pieces(empty, PATHS["byte_bpe_50k"], 2)).collect() == []
    made = packing.write_sequences(empty, scratch_path(spark, "sequences"), PATHS["byte_bpe_50k"], 2)
    assert made.collect() == [] and packing.piece_digests(made, 2).collect() == []


def test_packing_clashing_names_and_lengths_out_of_range(spark):
    names = ["length", "Length", "_k", "_task", "_c0", "_length", "_n", "offset", "sequence_id"]
    rows = spark.createDataFrame([(n, *["x"] * 8) for n in (3, 3, 1024, 1021)], ", ".join(f"c{i} {'int' if i == 0 else 'string'}" for i in range(9))).toDF(*names)
    packed = packing.pack(rows)
    assert packed.columns == [*names[:-2], "sequence_id", "offset"]
    assert sorted((r[0], r[-1]) for r in packed.collect()) == [(3, 0), (3, 1021), (1021, 0), (1024, 0)]
    for odd_length in (None, 0, 1025, -1):
        with pytest.raises(ValueError, match="no length"):
            packing.pack(spark.createDataFrame([(odd_length,), (5,)], "length long"))


def test_packing_a_hot_length(spark):
    pieces = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 700).otherwise(F.col("id") % 300 + 1).alias("length"))
    rows = packing.pack(pieces.select(F.col("length").cast("long"))).collect()
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        assert [a for a, _ in sorted(places)] == np.cumsum([0, *[n for _, n in sorted(places)]])[:-1].tolist()
    assert len(rows) == 3000 and max(sum(n for _, n in p) for p in held.values()) <= 1024
    assert len(held) == 1000  # one per piece of 700, and the others fit beside them


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 60), min_size=1, max_size=20))
def test_plan_places_every_piece_once(counts):
    lengths = np.array(sorted(counts))
    plan = packing.plan_packing(lengths, np.array([counts[n] for n in lengths]), 64)
    filled = defaultdict(list)
    for length in counts:
        at = 0
        for n, first, slots, each, sequence, offset in plan.slots.tolist():
            if n == length:
                assert first == at and slots % each == 0
                at += slots
                for k in range(slots):
                    filled[sequence + k // each].append((offset + k % each * length, length))
        assert at == counts[length]
    assert len(filled) == plan.sequences >= plan.lower_bound
    for places in filled.values():
        assert [a for a, _ in sorted(places)] == np.cumsum([0, *[n for _, n in sorted(places)]])[:-1].tolist()
        assert sum(n for _, n in places) <= 64


def test_plan_is_close_to_the_bound():
    rng = np.random.default_rng(0)
    lengths = np.arange(1, 1025)
    plan = packing.plan_packing(lengths, rng.integers(1, 200, 1024))
    small = packing.plan_packing(lengths[:400], rng.integers(50, 200, 400))
    assert small.sequences <= 1.002 * small.lower_bound
    assert plan.sequences <= 1.02 * plan.lower_bound
    assert plan.slots.shape[0] < 20_000  # what is sent to every task


@pytest.mark.parametrize("shape", ["uniform", "zipf", "lognormal"])
def test_the_program_places_the_pieces(shape):
    lengths = np.arange(1, 1025)
    weight = {
        "uniform": np.ones(1024),
        "zipf": 1 / lengths,
        "lognormal": np.exp(-((np.log(lengths) - np.log(200)) ** 2) / 1.28) / lengths,
    }[shape]
    counts = np.maximum(1, (500_000 * weight / weight.sum()).astype(int))
    plan = packing.plan_packing(lengths, counts)
    assert plan.by_program >= 0.9 and plan.sequences <= (1 + packing.TOLERANCE) * plan.lower_bound
    plain = sum(n for _, n in packing.best_fit_decreasing(lengths, counts, 1024))
    assert plan.sequences <= plain


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), min_size=1, max_size=5))
def test_the_lower_bound_holds(counts):
    sizes = sorted((n for n, k in counts.items() for _ in range(k)), reverse=True)

    def fits(at, rooms):
        if at == len(sizes):
            return True
        for i in {r: i for i, r in enumerate(rooms) if r >= sizes[at]}.values():
            if fits(at + 1, [r - sizes[at] * (i == j) for j, r in enumerate(rooms)]):
                return True
        return False

    lengths = np.array(sorted(counts))
    plan = packing.plan_packing(lengths, np.array([counts[n] for n in lengths]), 12)
    least = next(n for n in range(1, len(sizes) + 1) if fits(0, [12] * n))
    assert plan.lower_bound <= least <= plan.sequences
