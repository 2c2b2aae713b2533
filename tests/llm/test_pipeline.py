"""The stages on the smallest tables: what each keeps follows from its operator."""

import corpus_pipeline
import pytest

import __spark_entry__ as entry
from compare import compare, connect
from rollcall.session import materialize
from rollcall.tables import Tables

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = Tables(spark, SMALL).documents
    kept = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SMALL), "stage")
        assert docs.columns == corpus_pipeline.COLUMNS, name
        now = {r.doc_id for r in docs.collect()}
        assert now and now <= kept, name
        kept = now
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {p.doc_id for p in pieces} == kept


def test_registered(spark):
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


@pytest.mark.parametrize("name", ["op5_hierarchical_mix", "op6_nra_topk"])
def test_sql_agrees(spark, name):
    assert compare(entry.queries()[name](spark, SMALL), connect(SMALL), entry.oracle_sql()[name]) in (None, "empty")


def test_near_copies_of_four_fifths_go(spark, prose):
    from test_documents import brute_components

    rows = []
    for k in range(10):
        words = prose(200, 300 + k).split()
        rows.append((2 * k, " ".join(words)))
        for at in (30, 80, 130, 180)[: 2 + k % 3]:  # five shingles each: 186/206, 181/211 and 176/216
            words[at] = f"other{at}"
        rows.append((2 * k + 1, " ".join(words)))
    docs = spark.createDataFrame([(*r, "en", "a", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.minhash_near_dedup(spark, docs, SMALL).collect()}
    want = brute_components(rows, 80)
    assert want != brute_components(rows, 85)
    assert kept == {d for d, c in want.items() if d == c}
