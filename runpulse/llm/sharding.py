"""Contiguous shards of near equal bytes, by prefix sums over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runpulse.llm.common import pick, running_totals, store

#: Bytes that a document takes beside its text.
OVERHEAD = 8


def shard_by_bytes(docs: DataFrame, shards: int, *, doc_id: str = "doc_id", text: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): documents in ascending order of their id, cut into ``shards``.

    The size is the text's UTF-8 bytes (a null text has none) plus ``overhead``. Prefix sums come from
    per-partition totals; the total is cut at equal targets, and a document belongs to the shard that
    its middle byte falls in, so a shard misses its target by half a document at each end at most. ``slot``
    counts from 0 in each shard. Documents without an id come first; rows of one id are ordered by
    checksum and size, and those equal in both may be split between shards. A document larger than
    a target leaves shards empty. An empty table has no rows. Other columns are not read.
    """
    bytes_of = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    narrow = pick(docs, doc_id, text).toDF("doc_id", "text")
    narrow = narrow.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(bytes_of) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(bytes_of).alias("text_crc32"),
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    # A range sort reads its input twice: the texts are read once, for these few numbers.
    narrow = store(narrow, "sizes")
    placed = store(running_totals(narrow, order, ["size"], "sizes"), "placed")
    total = placed.agg(F.sum("size")).first()[0] or 1
    dealt = placed.withColumn("shard", F.expr(f"cast((2 * size_before + size) * {shards}L div {2 * total}L as int)"))
    firsts = dealt.groupBy("shard").agg(F.min("pos").alias("_first"))
    return dealt.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("pos") - F.col("_first")).alias("slot")
    )
