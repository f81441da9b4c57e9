"""Token ids of documents as ORC files, in ascending order of the document id.

Spark's ORC writer stores integers run-length encoded (RLEv2), keeps a row index per stride and,
here, a Bloom filter on the document id. A stripe is the unit of a parallel read; statistics and
Bloom filters let a reader skip the stripes that hold none of the wanted ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runpulse.llm.common import pick, slices, store, texts_of, utf8
from runpulse.llm.tokenizing import token_ids

STRIPE_BYTES = 16 << 20
INDEX_STRIDE = 1000
BLOOM_FALSE_POSITIVES = 0.01
FORMAT = "doc_id long, part int, place long, n_tokens long, ids array<int>"


def write_token_orc(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, *, doc_id: str = "doc_id", text: str = "text"
) -> None:
    """Encodes every whole text and writes (doc_id, part, place, n_tokens, ids) as ORC.

    Rows are range partitioned by id: ``part`` numbers the ranges upwards and ``place`` the rows in
    one. ``end_id`` follows each text; a null text counts as empty. Null ids come first. Repeated
    ids stay, in the order of their texts' hashes, and may be split between parts; of rows equal in
    both, the order is that of reading. Other columns of ``docs`` are not read. An empty table
    makes a folder without rows.
    """
    rows = pick(docs, doc_id, text).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    rows = rows.select("doc_id", utf8("text"), F.monotonically_increasing_id().alias("_tie"))
    order = ["doc_id", F.xxhash64("text"), "_tie"]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = sorted_rows.select(
        "doc_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"), "text"
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = token_ids(tokenizer)
        for batch in slices(batches, "text"):
            ids, counts = encoder.encode(texts_of(batch), end_id)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            listed = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))
            columns = [batch["doc_id"], batch["part"], batch["place"], pa.array(counts, pa.int64()), listed]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "place", "n_tokens", "ids"])

    (
        numbered.mapInArrow(encode, FORMAT)
        .write.option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.row.index.stride", INDEX_STRIDE)
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", BLOOM_FALSE_POSITIVES)
        .option("compression", "zstd")
        .orc(path)
    )


def read_token_orc(spark: SparkSession, path: str, doc_ids: Sequence[int] | None = None) -> DataFrame:
    """The files' rows; with ``doc_ids``, only theirs, where stripes without any of them are skipped."""
    rows = spark.read.schema(FORMAT).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin([int(i) for i in doc_ids]))


def token_digests(tokens: DataFrame) -> DataFrame:
    """Per document its id, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids_crc32``.

    The checksum is the unsigned CRC-32 of the ids as little-endian 32-bit integers.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["ids"]
            offsets = lists.offsets.to_pylist()
            values = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
            sums = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets, offsets[1:])]
            counts = np.diff(np.array(offsets, np.int64))
            columns = [batch["doc_id"], batch["part"], batch["place"], pa.array(counts), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "place", "n_tokens", "ids_crc32"])

    read = tokens.select("doc_id", "part", "place", "ids")
    rows = store(
        read.mapInArrow(digest, "doc_id long, part int, place long, n_tokens long, ids_crc32 long"), "digests"
    )
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("_total"))
    offsets = parts.select("part", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.join(offsets, "part").select(
        "doc_id", (F.col("_offset") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32"
    )
