"""Registered queries against their SQL on the smallest tables, and the entry contract."""

import pytest

import __spark_entry__ as contract
import compare

QUICK = (
    "d2_classify", "f1_money", "f8_tax_id_valid", "c14_all_candidates", "t5_table_tax_lines", "x10_xml_evidence",
    "m2_proposed_fields", "r9_resolved_documents", "v5_all_warnings", "e8_field_results", "a9_corpus_records",
)


@pytest.fixture(scope="module")
def db(sf):
    return compare.connect(sf)


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", QUICK)
def test_agrees_with_sql(spark, db, sf, name):
    ok, note = compare.compare(spark, db, sf, name)
    assert ok, note


def test_entry(spark):
    assert contract.entry(spark).limit(5).count() == 5
