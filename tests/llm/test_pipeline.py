"""The pipeline against the same steps taken over all rows in plain Python, and every query against its SQL."""

import os
import re

import pytest
from oracle_compare import compare, connect
from test_duplicates import brute

import __spark_entry__ as entry
import corpus_pipeline
from tallywatch.llm import quality
from tallywatch.llm.common import read
from tallywatch.llm.queries import ORACLE

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    assert compare(entry.queries()[name](spark, SF), connect(SF), ORACLE[name]) == ""


def test_every_operator_is_registered():
    names = entry.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {re.match(r"op\d+_", n)[0] for n in names if re.match(r"op\d+_", n)}
    assert "pipeline" in names and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "secrets", "packing"]


def test_stages_in_turn(spark, odd_docs):
    docs = read(spark, SF, "documents")
    left = {r.doc_id: r.text or "" for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    scored = quality.score_documents(docs, quality.train(docs, read(spark, SF, "labels"))).collect()
    left = {d: t for d, t in left.items() if {r.doc_id: r.predicted for r in scored}[d]}
    good = stages["quality"](spark, docs, SF)
    assert {r.doc_id: r.text for r in good.collect()} == left and good.columns == docs.columns
    first = {}
    for d in sorted(left):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", left[d]), d)
    left = {d: left[d] for d in first.values()}
    single = stages["exact_dedup"](spark, good, SF)
    assert {r.doc_id: r.text for r in single.collect()} == left
    left = {d: left[d] for d, (_, c) in brute(left, 80).items() if d == c}
    apart = stages["near_dedup"](spark, single, SF)
    assert {r.doc_id: r.text for r in apart.collect()} == left
    masked = stages["secrets"](spark, apart, SF)
    assert masked.columns == docs.columns and {r.doc_id for r in masked.collect()} == set(left)
    packed = stages["packing"](spark, masked, SF)
    assert {r.doc_id for r in packed.collect()} == set(left)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_take_odd_rows(spark, odd_docs, tmp_path):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd_docs, SF).count() >= 1, name
        assert stage(spark, odd_docs.limit(0), SF).count() == 0, name
    assert os.path.isdir(SF)
