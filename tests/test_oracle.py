"""Registered queries against DuckDB on the smallest tables: one of each family; ``tests.compare`` runs all of them."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from estatelens.plans import oracle
from estatelens.plans import queries as registered
from tests.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"
SAMPLE = [
    "x03_bare_refs", "x05_external_proxies", "x12_physical_source", "x14_step_kinds", "x16_capped_bodies", "j09_broken_references", "j13_source_map", "g05_source_index",
    "g06_status_by_table", "w01_deduped_bindings", "w03_column_order", "r01_measure_status_compat", "r02_column_status", "r05_cycle_paths", "r06_lineage", "r08_transitive_impact", "u01_glossary", "k01_csv_measures", "d14_broken_links", "d14_link_targets", "k03_document_files", "x07_native_query", "x15_step_summaries",
    "s03_pairs_by_name", "s04_pairs_on_disk", "s09_formatting_bindings", "s11_json_columns", "s13_text_measures", "s14_text_partitions",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the generated tables")


def test_every_query_has_an_oracle():
    assert set(registered.queries()) == set(oracle.oracle_sql())
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, name):
    ok, text = compare(spark, connect(SF_DIR), name, queries()[name], oracle_sql()[name], SF_DIR)
    assert ok, text


def test_compare_sees_a_difference(spark):
    ok, _ = compare(spark, connect(SF_DIR), "j03", queries()["j03_dependencies"], oracle_sql()["x04_compat_dependencies"], SF_DIR)
    assert not ok


def test_entry(spark):
    counts = [sum(r[c] for r in entry(spark).collect()) for c in ("direct", "indirect", "unused")]
    assert counts == [28, 58, 114]
