"""Queries over chunks give their counterparts' rows where a text is longer than any cap of the reference."""

import os
from collections import Counter

import duckdb
import pytest
from test_oracle import SF, TABLES, plain

from corvid.plans import registry

NAMES = "bm25_topk bm25_scoped bm25_kind_filter token_stats corpus_stats hybrid_rrf search_collapse search_envelope engine_search benchmark_retrieval grep_chain_union upsert_chunks stream_sync".split()


@pytest.fixture(scope="module")
def long_dir(spark, tmp_path_factory):
    """Tables in which one English document's text has 140,000 characters, the query's words and a benchmark item at its end only."""
    path = tmp_path_factory.mktemp("long")
    for t in TABLES:
        if t != "documents":
            os.symlink(f"{SF}/{t}.parquet", path / f"{t}.parquet")
    item = duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet' ORDER BY item_id LIMIT 1").fetchall()[0][0]
    tail = f" lateword tion the rely {item}"
    duckdb.execute(f"""COPY (SELECT * REPLACE (CASE WHEN doc_id = (SELECT min(doc_id) FROM '{SF}/documents.parquet' WHERE lang = 'en') THEN repeat('filler words ', 10770) || $1 ELSE text END AS text)
        FROM '{SF}/documents.parquet') TO '{path}/documents.parquet'""", [tail])
    return str(path)


@pytest.mark.parametrize("name", NAMES)
def test_rows_match_with_a_long_text(spark, long_dir, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{long_dir}/{t}.parquet'")
    df = registry.QUERIES[name](spark, long_dir)
    want = duck.sql(registry.ORACLE[name])
    assert sorted(want.columns) == sorted(df.columns)
    order = [want.columns.index(c) for c in sorted(df.columns)]
    got = Counter(tuple(map(plain, r)) for r in df.select(*sorted(df.columns)).collect())
    assert got == Counter(tuple(plain(r[i]) for i in order) for r in want.fetchall())
    if name == "token_stats":
        assert df.where("term = 'lateword'").collect() == [("lateword", 1, 1)]
