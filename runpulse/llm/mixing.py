"""Mixing sources to target weights: random order within each source, cut at its exact budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runpulse.llm.common import pick, running_totals, store

WEIGHTS = (5, 2, 1)
#: Size of the mix as a multiple of all sizes, and the times a source is taken at most.
SHARE = 1.5
MOST_EPOCHS = 2
SEED = "mix"


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) with ``target``: each source's share of ``share`` times all sizes.

    Sources in code point order, null last, take the weights in turn. No target exceeds ``most`` times its
    source; what is cut off there is shared among the others by weight until none exceeds. So a
    target is the smaller of that bound and weight times level, one level for all. With sources
    ordered by bound / weight, (mix - bounds so far) / (weights from here on) rises as long as a source
    is cut off and falls from then on: the level is its maximum. Prefix sums are distributed.
    """
    ranked = running_totals(sizes, [F.col("source").isNull(), F.col("source")], [], "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    bounded = ranked.select("source", "source_size", weight.alias("weight"), (most * F.col("source_size")).alias("bound"))
    bounded = store(bounded, "bounds")
    lined = running_totals(bounded, [F.col("bound") / F.col("weight"), F.col("source")], ["bound", "weight"], "levels")
    size, weight_sum = bounded.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(share * (size or 0)) - F.col("bound_before")) / (F.lit(weight_sum) - F.col("weight_before"))
    top = lined.agg(F.max(level)).first()[0]
    target = F.least(F.col("bound").cast("double"), F.col("weight") * F.lit(top))
    return bounded.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED,
    weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS, whole: bool = False,
) -> DataFrame:
    """(doc_id, size, source_size, target, taken): per row the words that the mix takes of it.

    The size is the number of words. Rows of a source are ordered by a hash of seed and id (then by id, size and
    reading order), and prefix sums of sizes run over that order. A source's budget is its target
    rounded to whole words: every row is taken as often as the source fits in, and the rest is cut
    off the order at exactly its last word; with ``whole``, the row that is cut goes in whole or not,
    whichever is nearer. A null source is a source of its own; a null text has size 0 and is never
    taken. The result depends on ids, sizes and sources only, so reruns agree. An empty table has no
    rows. Other columns are not read.
    """
    rows = pick(docs, doc_id, source, text).toDF("doc_id", "source", "text")
    # A range sort reads its input twice: the words are counted once.
    rows = store(rows.select("doc_id", "source", word_count(F.col("text")).alias("size")), "word-counts")
    return _taken(rows, seed, weights, share, most, whole)


def mixed(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix itself: all columns of ``docs``, a row as many times as ``mix`` with ``whole`` takes it."""
    marks = [f"_c{i}" for i in range(len(docs.columns))]
    mark = {name: F.col(marks[docs.columns.index(name)]) for name in (doc_id, text, source)}
    rows = store(docs.toDF(*marks).withColumn("_at", F.monotonically_increasing_id()), "documents")
    narrow = rows.select(
        "_at", mark[doc_id].alias("doc_id"), mark[source].alias("source"), word_count(mark[text]).alias("size")
    )
    rules = {"seed": SEED, "weights": WEIGHTS, "share": SHARE, "most": MOST_EPOCHS} | how
    times = _taken(narrow, rules["seed"], rules["weights"], rules["share"], rules["most"], True)
    times = times.where("taken > 0").select("_at", F.expr("cast(taken div size as int)").alias("_times"))
    copies = rows.join(times, "_at").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return copies.select(*marks).toDF(*docs.columns)


def _taken(rows: DataFrame, seed: str, weights: Sequence[int], share: float, most: int, whole: bool) -> DataFrame:
    """``rows`` (doc_id, source, size and others) with source_size, target and taken; without source."""
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    order = [F.col("source").isNull(), F.col("source"), F.col("_key"), F.col("doc_id"), F.col("size")]
    placed = store(running_totals(rows.withColumn("_key", key), order, ["size"], "mix").drop("_key"), "mixed")
    per_source = placed.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("size_before").alias("_start"))
    per_source = store(per_source, "sources")
    starts = per_source.select(F.col("source").alias("_source"), "_start")
    aimed = targets(per_source.select("source", "source_size"), weights, share, most)
    known = aimed.join(starts, F.col("source").eqNullSafe(F.col("_source"))).drop("source")
    joined = placed.join(known, F.col("source").eqNullSafe(F.col("_source")))
    joined = joined.withColumn("_budget", F.round("target").cast("long"))
    joined = joined.withColumn("_epochs", F.expr("if(source_size > 0, _budget div source_size, 0)"))
    rest = F.col("_budget") - F.col("_epochs") * F.col("source_size") - (F.col("size_before") - F.col("_start"))
    if whole:
        last = F.when(2 * rest > F.col("size"), F.col("size")).otherwise(0)
    else:
        last = F.greatest(F.lit(0).cast("long"), F.least(rest, F.col("size")))
    taken = (F.col("_epochs") * F.col("size") + last).cast("long").alias("taken")
    kept = [c for c in rows.columns if c not in ("source", "size")]
    return joined.select(*kept, "size", "source_size", "target", taken)
