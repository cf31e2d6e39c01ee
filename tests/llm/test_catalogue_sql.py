from __future__ import annotations

import __spark_entry__ as entry


def test_every_counterpart_is_sql_text():
    assert {name for name, sql in entry.oracle_sql().items() if not isinstance(sql, str)} == set()
