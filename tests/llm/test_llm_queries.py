"""The registered queries: those with SQL against DuckDB, the others by their contracts, and the pipeline."""

import os
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from oracle import connect, duck_rows, spark_rows
from runpulse.llm.queries import ORACLE, QUERIES
from runpulse.session import shared_folder

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


def test_thirteen_queries():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    assert spark_rows(QUERIES[name](spark, SF_DIR)) == duck_rows(con, ORACLE[name])


def test_token_files(spark, texts):
    rows = {r.doc_id: r for r in QUERIES["op3_token_orc"](spark, SF_DIR).collect()}
    coder, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    for i in sorted(texts):
        ids = coder.encode(texts[i], add_special_tokens=False).ids + [2]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (at, len(ids), crc)
        at += len(ids)
    assert rows.keys() == texts.keys()


def test_labels_and_folds(spark, con, texts):
    rows = QUERIES["op10_toxicity"](spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.predicted == (r.score >= 0.5) for r in rows)


def test_language_on_held_out(spark, con, texts):
    langs = dict(con.execute("SELECT doc_id, lang FROM documents").fetchall())
    rows = QUERIES["op1_language_id"](spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    tested = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in tested) >= 0.95 * len(tested)


def test_pipeline(spark, texts):
    assert [stage for stage, _ in corpus_pipeline.STAGES] == [
        "toxicity", "quality rules", "SimHash near-dedup", "mixing", "best-fit packing"
    ]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, docs, SF_DIR).cache()
        assert after.dtypes == docs.dtypes
        kept.append(sorted(r.doc_id for r in after.collect()))
        docs = after
    assert all(set(b) <= set(a) for a, b in zip(kept, kept[1:])) and len(kept[2]) == len(set(kept[2]))
    toxic = {r.doc_id for r in QUERIES["op10_toxicity"](spark, SF_DIR).collect() if r.predicted}
    assert set(kept[0]) == set(texts) - toxic
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r.doc_id for r in rows} == set(kept[3])
    tokens = defaultdict(int)
    for r in rows:
        tokens[r.sequence_id] += r.length
    assert max(tokens.values()) <= 1024


@pytest.mark.parametrize("at", range(5))
def test_stages_take_odd_and_no_documents(spark, odd, empty, at):
    name, stage = corpus_pipeline.STAGES[at]
    out = stage(spark, odd, SF_DIR)
    rows = out.collect()
    assert rows and stage(spark, empty, SF_DIR).collect() == []
    if at < 4:
        assert out.columns == odd.columns


def test_stages_delete_what_the_one_before_left(spark, tmp_path):
    """Once the result is written; a result that is handed on unwritten, cached or not, keeps its tables."""
    shared = Path(shared_folder(spark).removeprefix("file:"))
    stored = lambda: {p.name for p in shared.iterdir() if p.name.startswith(("measured-", "printed-", "documents-"))}
    stages = [stage for _, stage in corpus_pipeline.STAGES[1:4]]

    def ids(df):
        return sorted(str(r.doc_id) for r in df.select("doc_id").collect())

    given = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    start, docs, results = stored(), given, []
    for n, stage in enumerate(stages):
        stage(spark, docs, SF_DIR).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        results.append(ids(docs))
        assert len(stored() - start) == 1
    for hold in (lambda df: df, lambda df: df.cache()):
        docs = given
        for n, stage in enumerate(stages):
            docs = hold(stage(spark, docs, SF_DIR))
            assert ids(docs) == results[n]
        assert len(stored() - start) >= 3
        assert ids(docs) == results[-1]
