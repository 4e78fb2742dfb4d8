"""Every registered query against its SQL, on the smallest given tables."""

import os

import pytest

import __spark_entry__ as contract
from compare import connect, differences
from sqltrail.plans.queries import REGISTRY

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")

EXPECTED = """
src_lines_explode file_info catalog_owner_filter catalog_known_types catalog_relations_only catalog_by_type
refs_report_columns refs_report_rw sql_file_hierarchy workspace_text usage_report_lines refs_owner_filter
refs_type_presets literals_by_ext strip_lines vw_domain vw_subdomain map_columns empty_to_null map_columns_cast
object_type_lookup string_vars_filter method_class methods_with_strings literals_java literals_sql literals_js
literals_php literals_single tokenize sticky_operation read_targets modify_targets line_tags upper_identifiers
file_usage_flags package_class string_fields join_literals string_locals string_builders scopes imports
type_decls statements methods fields annotations annotation_class entity_tables repositories
keywords_in_quotes domain_paths code_refs code_refs_references known_tables_semi resolve_priority parent_join
catalog_wide edges_named fk_orphans catalog_dedup object_index table_usage lineage_edges usage_by_file
usage_simple file_documents constraint_report upsert_customers
code_refs_shuffled
load_bucketed method_scopes method_text file_scopes
""".split()


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_every_operator_has_a_query_and_sql():
    assert set(EXPECTED) <= set(contract.queries())
    assert all(query.sql is not None for query in REGISTRY.values())


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_equals_sql(spark, connection, name):
    problem, rows, _ = differences(
        spark, connection, name, contract.queries()[name], contract.oracle_sql()[name], SF_DIR
    )
    assert problem is None
    assert rows > 0


def test_entry_has_rows(spark):
    assert contract.entry(spark).limit(1).count() == 1
