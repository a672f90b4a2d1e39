"""A cross-section of the registered queries against their SQL; the driver checks them all."""
import os

import pytest

from attest.catalog import load

DATA = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()
SAMPLE = ("doc_token_counts", "chunks", "html_blocks", "vector_topk", "lexical_web_match", "corpus_relevant", "citation_validation",
          "prompt_summary", "case_summary", "registry_refresh", "constraint_rejects", "daily_volume", "index_postings", "index_common_topk", "cells_topk",
          "split_chunks", "shuffled_batches", "embedding_recovery", "structured_parts", "neighbours", "weighting_rejects")


def _canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(str([r[i] for i in order]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    registered, oracles = load()
    df = registered[name](spark, DATA)
    got = _canonical(df.columns, [tuple(r) for r in df.collect()])
    answer = con.execute(oracles[name])
    assert got == _canonical([c[0] for c in answer.description], answer.fetchall())


def test_every_oracle_has_a_query():
    registered, oracles = load()
    assert set(oracles) <= set(registered) and len(registered) >= 100
