from __future__ import annotations

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from lakemill.sources import adapters
from lakemill.sources.contracts import CONTRACTS
from lakemill.sources.tables import read_table
from tests.comparing import SF


def test_the_declared_tables_are_those_that_stand_in_the_files(spark):
    for name, contract in adapters.DECLARED.items():
        found = dict(read_table(spark, SF, name).dtypes)
        assert {c: found.get(c) for c in contract.fields} == contract.fields


def test_sources_under_declared_schemas_equal_sources_under_found_ones(spark, monkeypatch):
    digest = F.sum(F.xxhash64("*").cast("decimal(38,0)"))
    digests = lambda: {t: adapters.source(spark, SF, t).agg(F.count(F.lit(1)), digest).first() for t in CONTRACTS}
    declared = digests()
    monkeypatch.setattr(adapters, "_declared", read_table)
    assert declared == digests() and all(r[0] for r in declared.values())


def test_filters_and_columns_reach_the_declared_scan(spark):
    plan = adapters.source(spark, SF, "orders").filter("order_id = 7")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderkey,7)" in plan and "o_orderpriority" not in plan


def test_a_file_of_another_type_is_an_error(spark, tmp_path):
    spark.sql("select 'x' r_regionkey, 'y' r_name").write.parquet(f"{tmp_path}/region.parquet")
    with pytest.raises(Py4JJavaError, match="r_regionkey"):
        adapters.source(spark, str(tmp_path), "regions").collect()
