from __future__ import annotations

from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lakemill.plans import catalogue, movement
from lakemill.sources import ingest
from lakemill.sources.adapters import bronze
from lakemill.sources.contracts import CONTRACTS
from tests.comparing import SF, same


@pytest.mark.parametrize("name", ["snk6_replayed", "snk6_replayed_days"])
def test_the_replay_builds_every_day(spark, monkeypatch, name):
    seen = []
    real = ingest.replay_all
    monkeypatch.setattr(movement.ingest, "replay_all", lambda *a: seen.append(real(*a)) or seen[-1])
    same(spark, catalogue.queries()[name], catalogue.oracle_sql()[name])
    assert seen == [bronze(spark, SF, "orders").count()]


def test_days_land_in_one_write_and_each_file_is_verified(spark, tmp_path):
    contract, root = CONTRACTS["areas"], str(tmp_path)
    rows = spark.createDataFrame([(i, 1, "x", date(2026, 1, 1 + i % 3)) for i in range(7)], "area_id long, region_id long, area_name string, _ingestion_date date")
    ingest.write_landing_days(ingest.with_extract_metadata(rows, "b", "full", F.lit(datetime(2026, 1, 9)), "areas", F.col("_ingestion_date")), root, contract)
    manifest = ingest.build_manifest_days(spark, root, "areas", rows, "b").cache()
    assert {(r["dt"].day, r["parquet_rows"]) for r in manifest.collect()} == {(1, 3), (2, 2), (3, 2)}
    assert ingest.verify_landing_days(spark, root, manifest, "areas").count() == 0
    file = next(Path(f"{root}/areas/dt=2026-01-02").glob("*.parquet"))
    file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    file.unlink()
    assert [r["dt"].day for r in ingest.verify_landing_days(spark, root, manifest, "areas").collect()] == [2]
    with pytest.raises(ValueError, match="instead of 7"):
        ingest.replay_all(spark, root, f"{root}/bronze", "areas", manifest, F.lit(datetime(2026, 1, 9)))
