"""The registered queries: against SQL where there is some, and the pipeline."""

from __future__ import annotations

import duckdb
import pytest
from tests.llm.conftest import SF_DIR, has_tables
from tests.llm.test_text_operators import brute_quotations, sequences_of

import __spark_entry__ as entry_points
import corpus_pipeline
from wayside.llm import compression_quality, grace_dedup, minhash_join, packing
from wayside.llm import queries as llm_queries

pytestmark = pytest.mark.skipif(not has_tables(), reason="no test tables")
TABLES = ["documents", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return con


def test_all_are_registered():
    names = entry_points.queries()
    assert {*llm_queries.QUERIES, "pipeline"} <= set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in llm_queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(llm_queries.ORACLES))
def test_query_equals_sql(llm, tables, name):
    df = llm_queries.QUERIES[name](llm, SF_DIR)
    columns = sorted(df.columns)
    got = sorted(map(tuple, df.select(*columns).collect()), key=repr)
    want = tables.execute(f"select {', '.join(columns)} from ({llm_queries.ORACLES[name]})").fetchall()
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("name", sorted(set(llm_queries.QUERIES) - {"op5_license_scan", "op13_source_divergence"}))
def test_one_row_per_document(llm, name):
    found = llm_queries.QUERIES[name](llm, SF_DIR)
    if name == "op7_chat_windows":
        ids = llm.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id").distinct()
        assert found.count() == ids.count() + 1 and found.filter("conv_id = -1").count() == 1
    else:
        documents = llm.read.parquet(f"{SF_DIR}/documents.parquet").count()
        assert found.select("doc_id").distinct().count() == documents
        assert name == "op9_packing" or found.count() == documents


def test_stages_keep_what_their_operators_say(llm):
    docs = llm.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = llm.read.parquet(f"{SF_DIR}/labels.parquet")
    items = [tuple(r) for r in llm.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "exact dedup", "near dedup", "decontamination", "packing"]
    rules = [
        lambda d: compression_quality.score_quality(d, labels).filter("predicted = 1"),
        lambda d: grace_dedup.find_copies(d).filter("kept"),
        lambda d: minhash_join.find_near_copies(d).filter("kept"),
        None,
    ]
    for (_, stage), rule in zip(corpus_pipeline.STAGES[:4], rules):
        kept = stage(llm, docs, SF_DIR).checkpoint()
        assert kept.columns == docs.columns
        ids = {r.doc_id for r in kept.collect()}
        if rule is None:
            for row in docs.collect():
                n_words, n_hit, _ = brute_quotations(row.text, items)
                assert (row.doc_id in ids) == (not (n_hit and 20 * n_hit >= n_words))
        else:
            assert ids == {r.doc_id for r in rule(docs).collect()}
        assert 0 < len(ids) < docs.count()
        docs = kept
    pieces = corpus_pipeline.STAGES[4][1](llm, docs, SF_DIR).collect()
    assert {r.doc_id for r in pieces} == ids
    sequences_of(pieces, packing.CAPACITY)
    whole = corpus_pipeline.run(llm, SF_DIR).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, pieces))
