from __future__ import annotations

import pytest

from lakemill.plans import catalogue, checks
from lakemill.sources.contracts import CONTRACTS, row_rules
from tests.comparing import SF, same


@pytest.mark.parametrize("name", ["dq14_all_rules", "dq15_more_natural_keys", "dq10_product_financials", "dq16_tax_rule", "dq02_more_unique", "dq01_all_columns"])
def test_whole_check_equals_its_counterpart(spark, name):
    same(spark, catalogue.queries()[name], catalogue.oracle_sql()[name])


def test_every_rule_of_every_table_has_sql(spark):
    for t in CONTRACTS:
        assert set(row_rules(t)) == set(checks.SQL_RULES.get(t, {})) | set(checks.MORE_RULES.get(t, {}))


@pytest.mark.parametrize("name", ["dq05_version_overlaps", "rec3_untouched"])
def test_checks_of_the_untouched_tables_equal_their_counterparts(spark, name):
    same(spark, catalogue.queries()[name], catalogue.oracle_sql()[name])


def test_nothing_is_missing_in_the_untouched_bronze(spark):
    row = catalogue.queries()["rec3_untouched"](spark, SF).first()
    assert row["passed"] and row["missing_in_bronze"] == 0 and row["source_keys"] == row["bronze_keys"] > 0
