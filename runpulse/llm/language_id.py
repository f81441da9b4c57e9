"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram of letters is bound into one vector by
multiplying its letters' vectors, each rotated by its place, and a text is the bundle (sum) of its
trigrams' vectors. The bundle of a language's training texts is its prototype, and a text gets the
language whose prototype has the largest cosine with the text's own bundle.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runpulse.llm.common import hashed_sample, pick, slices, texts_of, utf8

DIMENSIONS = 512
SEED = 20
#: Training rows per language at most: those with the smallest hash of their id.
SAMPLE_PER_LANGUAGE = 2000
#: Code points of one text that are bundled at a time.
CHUNK = 500_000
UNDETERMINED = "und"
#: Bits of a code point; a trigram takes three times as many.
_BITS = 21


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """Symbol of each code point: 0 for what is no letter, else the code point of the letter in lower case."""
    table = np.zeros(0x110000, np.uint32)
    for point in range(0x110000):
        if unicodedata.category(letter := chr(point))[0] == "L":
            table[point] = ord(letter.lower()[0])
    return table


@lru_cache(maxsize=None)
def _letter(symbol: int) -> np.ndarray:
    """The random vector of a symbol, by its number alone: each letter of Unicode has its own."""
    return np.random.default_rng([SEED, symbol]).choice(np.array([-1, 1], np.int8), DIMENSIONS)


def _bound(trigrams: np.ndarray) -> np.ndarray:
    """The vector of each trigram: its letters' vectors, rotated by 2, 1 and 0 places, multiplied."""
    parts = [(trigrams >> np.uint64(shift * _BITS)) & np.uint64((1 << _BITS) - 1) for shift in (2, 1, 0)]
    used, columns = np.unique(np.concatenate(parts), return_inverse=True)
    base = np.stack([_letter(int(symbol)) for symbol in used])
    a, b, c = np.split(columns, 3)
    return np.roll(base, 2, axis=1)[a] * np.roll(base, 1, axis=1)[b] * base[c]


def bundles(texts: list[bytes]) -> np.ndarray:
    """The bundled trigram vectors of each text (float64); zeros for a text without letters.

    Runs of anything but letters count as one gap, which is a symbol too, also around the text.
    """
    out = np.zeros((len(texts), DIMENSIONS))
    keys, owners, held = [], [], 0
    for at, raw in enumerate(texts):
        text = raw.decode("utf-8", "replace")
        tail = np.zeros(1, np.uint32)
        for start in range(0, len(text), CHUNK):
            points = np.frombuffer(text[start : start + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
            symbols = np.concatenate([tail, _symbols()[points], np.zeros(int(start + CHUNK >= len(text)), np.uint32)])
            symbols = symbols[(symbols > 0) | (np.concatenate([[1], symbols[:-1]]) > 0)].astype(np.uint64)
            trigrams = symbols[:-2] << np.uint64(2 * _BITS) | symbols[1:-1] << np.uint64(_BITS) | symbols[2:]
            keys.append(trigrams)
            owners.append(np.full(len(trigrams), at, np.uint32))
            tail = symbols[-2:].astype(np.uint32)
            held += len(trigrams)
            if held >= CHUNK:
                _bundle(out, keys, owners)
                keys, owners, held = [], [], 0
    _bundle(out, keys, owners)
    return out


def _bundle(out: np.ndarray, keys: list[np.ndarray], owners: list[np.ndarray]) -> None:
    """Adds the trigrams' vectors to their owners' rows: counts of (owner, trigram) times trigram vectors."""
    if not keys or not sum(map(len, keys)):
        return
    owner = np.concatenate(owners)
    first = owner[0]
    trigrams, number = np.unique(np.concatenate(keys), return_inverse=True)
    both = np.sort((owner - first).astype(np.int64) * len(trigrams) + number)
    edges = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    counts = np.diff(np.concatenate([edges, [len(both)]])).astype(np.float32)
    row, column = np.divmod(both[edges], len(trigrams))
    for at in range(0, int(row[-1]) + 1, 64):
        some = slice(*np.searchsorted(row, [at, at + 64]))
        used = np.unique(column[some])
        table = np.zeros((64, len(used)), np.float32)
        table[row[some] - at, np.searchsorted(used, column[some])] = counts[some]
        vectors = _bound(trigrams[used])
        rows = min(64, len(out) - int(first) - at)
        out[int(first) + at : int(first) + at + rows] += (table @ vectors.astype(np.float32))[:rows]


@dataclass(frozen=True)
class Profiles:
    """Languages and their prototypes, one unit row each: as many rows as there are languages."""

    languages: tuple[str, ...]
    prototypes: np.ndarray

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """The language of each text and the cosine with its prototype, 0 if that is negative."""
        found = bundles(texts)
        norms = np.linalg.norm(found, axis=1)
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        cosines = (found @ self.prototypes.T) / np.maximum(norms, 1e-12)[:, None]
        best = np.argmax(cosines, axis=1)
        known = norms > 0
        names = [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best, known)]
        return names, np.where(known, np.clip(cosines[np.arange(len(best)), best], 0, 1), 0.0)


def learn(
    docs: DataFrame, usable: Column, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
    sample: int = SAMPLE_PER_LANGUAGE,
) -> Profiles:
    """Prototypes from rows with a language that are ``usable`` (a condition on ``doc_id``).

    Of each language the ``sample`` rows with the smallest hash of their id are used. Tasks add up their
    bundles by language before anything is shuffled; what arrives here is one vector per language.
    """
    rows = pick(docs, doc_id, text, lang).toDF("doc_id", "text", "lang").where(F.col("lang").isNotNull() & usable)
    key = F.xxhash64("doc_id")
    ids = hashed_sample(rows.select("doc_id", "lang"), "lang", sample)
    # One number per language tells its sample, far less than the prototypes that come to the driver: no text is shuffled.
    last = ids.groupBy("lang").agg(F.max(key).alias("last"))
    chosen = rows.join(F.broadcast(last), "lang").where(key <= F.col("last")).select("lang", utf8("text"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            for name, bundle in zip(batch["lang"].to_pylist(), bundles(texts_of(batch))):
                sums[name] = sums.get(name, 0) + bundle
        if sums:
            langs = np.repeat(list(sums), DIMENSIONS)
            places = np.tile(np.arange(DIMENSIONS, dtype=np.int32), len(sums))
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs), pa.array(places), pa.array(np.concatenate([*sums.values()]))], ["lang", "place", "x"]
            )

    summed = chosen.mapInArrow(add, "lang string, place int, x double").groupBy("lang", "place").agg(F.sum("x").alias("x"))
    vectors: dict[str, np.ndarray] = {}
    for row in summed.collect():
        vectors.setdefault(row["lang"], np.zeros(DIMENSIONS))[row["place"]] = row["x"]
    names = sorted(name for name, v in vectors.items() if v.any())
    matrix = np.array([vectors[n] / np.linalg.norm(vectors[n]) for n in names]).reshape(len(names), DIMENSIONS)
    return Profiles(tuple(names), matrix)


def identify(docs: DataFrame, profiles: Profiles, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from its whole text alone.

    ``lang_pred`` is a learned language, or ``und`` where the text is null or has no letter (score 0) or
    nothing was learned. ``score`` is the cosine, from 0 to 1; equal cosines go to the first
    language by name. Repeated rows each get theirs. Other columns are not read.
    """
    rows = pick(docs, doc_id, text).toDF("doc_id", "text").select("doc_id", utf8("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            names, scores = profiles.predict(texts_of(batch))
            columns = [batch["doc_id"], pa.array(names, pa.string()), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")
