"""Toxicity by a factorization machine over hashed terms.

A text's terms are its words and their first letters, hashed into buckets; a term counts once however
often it occurs. The machine adds a weight for each term and, for each pair of terms, the inner product of
their factors, so that an insult weighs more beside the mention of a group than the two do apart.
Only terms that the labels depend on enter it, so long texts do not drown a few telling words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runpulse.llm.common import add_columns, hashed_sample, pick, remembered, slices, store, texts_of
from runpulse.llm.licenses import normalize
from runpulse.llm.tokenizing import segments

BUCKETS = 1 << 20
#: Letters of a word that are terms of their own.
STEMS = (4, 5)
#: Labelled rows per label that are learned from: those with the smallest hash of their id.
SAMPLE_PER_LABEL = 5000
#: Terms in the machine: those with the highest G statistic, found in at least so many sampled texts.
TERMS, LEAST_TEXTS = 1024, 4
FACTORS = 8
EPOCHS, BATCH, RATE, DECAY, SEED = 40, 256, 0.02, 2e-3, 7
#: Words kept per worker; beyond it the memory starts afresh.
KEPT_WORDS = 500_000


def terms(word: bytes) -> list[int]:
    """The buckets of a word and of its stems."""
    found = [zlib.crc32(b"w" + word) % BUCKETS]
    letters = word if word.isascii() else word.decode("utf-8", "replace")
    for n in STEMS:
        if len(letters) > n:
            stem = letters[:n] if isinstance(letters, bytes) else letters[:n].encode()
            found.append(zlib.crc32(b"s" + stem) % BUCKETS)
    return found


class _Numbers(dict):
    """Word to number, and the buckets of new words' terms in rows of three; -1 is no term."""

    def __init__(self):
        self.fresh: list[list[int]] = []

    def __missing__(self, word: bytes) -> int:
        self.fresh.append((terms(word) + [-1, -1])[:3])
        number = self[word] = len(self)
        return number


class Terms:
    """Distinct buckets of texts, among the ``wanted`` (all, if None); remembers words between texts."""

    def __init__(self, wanted: np.ndarray | None = None):
        self.place = None
        if wanted is not None:
            self.place = np.full(BUCKETS + 1, -1, np.int32)
            self.place[wanted] = np.arange(len(wanted))
        self.words, self.table = _Numbers(), np.zeros((0, 3), np.int32)

    def of(self, raw: bytes) -> np.ndarray:
        """The text's buckets, or their places among the wanted ones, ascending."""
        if len(self.words) > KEPT_WORDS:
            self.words, self.table = _Numbers(), np.zeros((0, 3), np.int32)
        lookup, found = self.words.__getitem__, []
        for part in segments(raw):
            numbers = np.unique(np.array([*map(lookup, normalize(part).split())], np.int64))
            if self.words.fresh:
                fresh = np.array(self.words.fresh, np.int32)
                self.words.fresh = []
                fresh = fresh if self.place is None else self.place[fresh]
                self.table = _grown(self.table, fresh)
            buckets = self.table[numbers].ravel()
            found.append(buckets[buckets >= 0])
        return np.unique(np.concatenate(found))


def _grown(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """``table`` with ``rows`` below, in a buffer that doubles."""
    size = len(table) + len(rows)
    whole = table.base if table.base is not None and len(table.base) >= size else None
    if whole is None:
        whole = np.empty((2 * size + 1024, 3), np.int32)
        whole[: len(table)] = table
    whole[len(table) : size] = rows
    return whole[:size]


@dataclass(frozen=True)
class Machine:
    """The learned terms (buckets), bias, weights and factors: at most ``TERMS`` rows."""

    name: str
    buckets: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, places: np.ndarray) -> float:
        """Probability of a text with the terms at ``places``."""
        v = self.factors[places]
        pairs = 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        logit = self.bias + float(self.weights[places].sum()) + pairs
        return float(1 / (1 + np.exp(-np.clip(logit, -60, 60))))


def fit(rows: list[tuple[float, np.ndarray]], buckets: np.ndarray, name: str) -> Machine:
    """A machine from (label, places) by Adam on the logistic loss, both labels weighing the same."""
    rng = np.random.default_rng(SEED)
    n = len(buckets)
    labels = np.array([label for label, _ in rows])
    shares = [max(1, int((labels == y).sum())) for y in (0, 1)]
    weight = np.where(labels == 1, len(rows) / (2 * shares[1]), len(rows) / (2 * shares[0]))
    params = {"b": np.zeros(1), "w": np.zeros(n), "v": rng.normal(0, 0.01, (n, FACTORS))}
    first = {k: np.zeros_like(p) for k, p in params.items()}
    second = {k: np.zeros_like(p) for k, p in params.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            some = order[at : at + BATCH]
            x = np.zeros((len(some), n))
            for i, row in enumerate(some):
                x[i, rows[row][1]] = 1
            xv = x @ params["v"]
            logit = params["b"] + x @ params["w"] + 0.5 * (xv**2 - x @ params["v"] ** 2).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(logit, -60, 60))) - labels[some]) * weight[some] / len(some)
            grads = {
                "b": np.array([error.sum()]),
                "w": x.T @ error + DECAY * params["w"],
                "v": x.T @ (error[:, None] * xv) - params["v"] * (x.T @ error)[:, None] + DECAY * params["v"],
            }
            step += 1
            for key, grad in grads.items():
                first[key] += 0.1 * (grad - first[key])
                second[key] += 0.001 * (grad**2 - second[key])
                scale = np.sqrt(second[key] / (1 - 0.999**step)) + 1e-8
                params[key] -= RATE * first[key] / (1 - 0.9**step) / scale
    return Machine(name, buckets, float(params["b"][0]), params["w"], params["v"])


def learn(
    docs: DataFrame, labels: DataFrame, usable: Column, *, doc_id: str = "doc_id", text: str = "text",
    label: str = "toxic", sample: int = SAMPLE_PER_LABEL,
) -> Machine | None:
    """A machine from the texts of ``docs`` with a ``label`` (0 or 1) and an id that is ``usable``.

    Of each label the ``sample`` ids with the smallest hash are used. Their texts' terms are counted and
    selected in Spark; what arrives here are the selected terms and, for each sampled text, those it has.
    None if there is no usable label.
    """
    marked = pick(labels, doc_id, label).toDF("doc_id", "label").where(F.col("label").isin(0, 1) & usable)
    marked = marked.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = hashed_sample(marked, "label", sample)
    texts = pick(docs, doc_id, text).toDF("doc_id", "text")
    taken = texts.join(F.broadcast(chosen), "doc_id").select("label", F.col("text").cast("binary").alias("text"))

    def list_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Terms()
        for batch in slices(batches, "text"):
            found = [memory.of(raw).astype(np.int32) for raw in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch["label"].cast(pa.int32()), pa.array(found, pa.list_(pa.int32()))], ["label", "terms"]
            )

    rows = store(taken.mapInArrow(list_terms, "label int, terms array<int>"), "toxic-terms")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    counted = rows.select("label", F.explode("terms").alias("term")).groupBy("term").agg(
        F.sum("label").alias("in1"), F.sum(1 - F.col("label")).alias("in0")
    )
    counted = counted.where(F.col("in1") + F.col("in0") >= LEAST_TEXTS)
    best = counted.orderBy(_g_statistic(sizes.get(0, 0), sizes.get(1, 0)).desc(), "term").limit(TERMS)
    buckets = np.sort(np.array([r["term"] for r in best.select("term").collect()], np.int64))
    wanted = {int(b): i for i, b in enumerate(buckets)}
    kept = F.array_intersect("terms", F.array(*map(F.lit, wanted)) if wanted else F.array().cast("array<int>"))
    held = rows.select("label", kept.alias("terms")).orderBy(F.xxhash64("terms"), "label").collect()
    name = f"{rows.stored_at}"
    return fit([(r["label"], np.array([wanted[t] for t in r["terms"]], np.int64)) for r in held], buckets, name)


def _g_statistic(n0: int, n1: int) -> Column:
    """How much knowing a term tells of the label, from its counts ``in0`` of ``n0`` and ``in1`` of ``n1`` texts."""
    total = float(n0 + n1)
    inside = F.col("in0") + F.col("in1")

    def part(seen: Column, row: Column, column: int) -> Column:
        return F.when(seen > 0, seen * F.log(seen * total / (row * F.lit(float(column))))).otherwise(0.0)

    outside = F.lit(total) - inside
    return (
        part(F.col("in0"), inside, n0) + part(F.col("in1"), inside, n1)
        + part(F.lit(n0) - F.col("in0"), outside, n0) + part(F.lit(n1) - F.col("in1"), outside, n1)
    )


def with_toxicity(df: DataFrame, machine: Machine | None, *, text: str = "text", name: str = "score", keep_text: bool = True) -> DataFrame:
    """``df`` with the probability that each whole text is toxic, from its text alone.

    A null or empty text has no terms and gets the machine's bias; without a machine all get 0. A column
    called ``name`` is replaced. Repeated rows each get theirs.
    """

    def score(texts: list[bytes]) -> list[pa.Array]:
        if machine is None:
            return [pa.array([0.0] * len(texts))]
        memory = remembered(("toxic terms", machine.name), lambda: Terms(machine.buckets))
        return [pa.array([machine.score(memory.of(raw)) for raw in texts], pa.float64())]

    return add_columns(df, text, {name: "double"}, score, keep_text)


def filtered(docs: DataFrame, machine: Machine | None, *, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under ``limit``, with their columns as they are."""
    marks = [f"_c{i}" for i in range(len(docs.columns))]
    scored = with_toxicity(docs.toDF(*marks), machine, text=marks[docs.columns.index(text)], name="_toxicity")
    return scored.where(F.col("_toxicity") < limit).select(*marks).toDF(*docs.columns)
