"""Replay coverage against plain loops over events and artifacts."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from lakemill.operators.intervals import blocks_of_day, blocks_of_span
from lakemill.sources import coverage
from lakemill.sources.windows import day_window

FIRST = date(2026, 1, 1)
MANIFEST = "table_name string, dt date, batch_id string, source_rows long, parquet_rows long, window_start timestamp_ntz, window_end timestamp_ntz, finished_at timestamp_ntz, file string"
AUDIT = "event string, table_name string, extract_batch_id string, load_batch_id string, run_mode string, window_start timestamp_ntz, window_end timestamp_ntz, started_at timestamp_ntz, finished_at timestamp_ntz, status string, parquet_rows long, bronze_rows long, dt date"


def test_a_day_is_in_a_span_if_they_share_a_block(spark):
    rng = random.Random(4)
    spans = [(a := date(1960, 1, 1) + timedelta(rng.randint(0, 30_000)), a + timedelta(rng.choice([0, 1, 2, 31, 64, 4000, -3]))) for _ in range(80)] + [(None, FIRST)]
    days = [date(1960, 1, 1) + timedelta(i * 17) for i in range(2000)] + [d for s in spans for d in s if d]
    s = spark.createDataFrame([(i, *x) for i, x in enumerate(spans)], "i int, a date, z date").select("i", F.explode(blocks_of_span(F.col("a"), F.col("z"))).alias("b"))
    assert s.groupBy("i").count().agg(F.max("count")).first()[0] <= 24
    d = spark.createDataFrame([(x,) for x in sorted(set(days))], "d date").select("d", F.explode(blocks_of_day(F.col("d"))).alias("b"))
    got = s.join(d, "b").select("i", "d").collect()
    want = {(i, x) for i, (a, z) in enumerate(spans) for x in set(days) if a and a <= x < z}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def world(seed):
    """Artifacts and events: days are extracted in turn, loaded now and then, and everything so far is replayed now and then."""
    rng = random.Random(seed)
    manifest, audit = [], []
    clock = datetime(2026, 1, 2, 18)
    for n in range(60):
        day, window = FIRST + timedelta(n), day_window(FIRST + timedelta(n))
        for table in ("orders", "stores"):
            rows = rng.randint(0, 9)
            clock += timedelta(minutes=rng.randint(1, 9))
            manifest.append((table, day, f"{table}-{n}", rows, rows - (rng.random() < 0.05), window.start, window.end, clock, "f"))
            if rng.random() < 0.3:
                manifest.append((*manifest[-1][:-1], "g"))
        for _ in range(rng.randint(0, 4)):
            clock += timedelta(minutes=1)
            m = rng.choice(manifest)
            status = rng.choice(["loaded", "replayed", "mismatch", "failed", None])
            if rng.random() < 0.3:
                a, z = sorted((rng.randint(-2, n), rng.randint(-2, n)))
                shift = timedelta(hours=rng.choice([0, 0, 0, 3]))
                span = (day_window(FIRST + timedelta(a)).start + shift, day_window(FIRST + timedelta(z)).end - shift) if rng.random() < 0.9 else (None, None)
                audit.append(("load", m[0], None, f"r{len(audit)}", "replay_all", *span, clock - timedelta(minutes=rng.choice([0, 15])), clock, status, 9, rng.choice([9, 9, 8]), None))
            else:
                audit.append(("load", m[0], m[2], f"l{len(audit)}" if rng.random() < 0.95 else None, "load", m[5], m[6], clock, clock, status, m[4], m[4] - (rng.random() < 0.2), m[1]))
    return manifest, audit


def covering(m, audit):
    out = []
    for e in audit:
        if e[1] != m[0] or e[3] is None:
            continue
        if e[4] == "replay_all":
            if e[5] and e[5] <= m[5] and m[6] <= e[6] and e[7] >= m[7]:
                out.append(e)
        elif e[2] == m[2]:
            out.append(e)
    return sorted(out, key=lambda e: (e[7], e[8], e[3]))


def frames(spark, manifest, audit):
    return spark.createDataFrame(manifest, MANIFEST), spark.createDataFrame(audit, AUDIT)


def test_the_last_covering_event_and_the_verdict(spark):
    problem = [("orders", FIRST + timedelta(3), "changed file"), ("orders", FIRST + timedelta(3), "row count differs")]
    for seed in range(3):
        manifest, audit = world(seed)
        m, a = frames(spark, manifest, audit)
        p = spark.createDataFrame(problem + ([("stores", None, "embedded schema differs")] if seed == 2 else []), "table_name string, dt date, problem string")
        got = {(r["table_name"], r["dt"]): r for r in coverage.reconcile_covered(m, a, p).collect()}
        assert len(got) == 120
        for row in manifest:
            events = covering(row, audit)
            last = events[-1] if events else None
            wrong = 2 * (row[:2] == ("orders", FIRST + timedelta(3))) + (seed == 2 and row[0] == "stores")
            ok = row[3] == row[4] and not wrong
            if last:
                ok = ok and last[9] in coverage.PASSED and last[11] == (last[10] if last[4] == "replay_all" else row[4])
            r = got[row[0], row[1]]
            assert (r["last_load"], r["last_mode"], r["landing_problems"], r["passed"]) == (last and last[3], last and last[4], wrong, ok)


def test_a_load_is_a_replay_after_any_good_load_or_replay_of_the_artifact(spark):
    for seed in range(3, 6):
        manifest, audit = world(seed)
        got = {r["load_batch_id"]: r["status"] for r in coverage.load_statuses(*frames(spark, manifest, audit)).collect()}
        want = {}
        for e in audit:
            if e[4] == "replay_all" or e[3] is None:
                continue
            row = next(m for m in manifest if m[2] == e[2])
            before = [x for x in covering(row, audit) if (x[7] <= e[7] if x[4] == "replay_all" else (x[7], x[3]) < (e[7], e[3]))]
            good = any(x[9] in coverage.PASSED if x[4] == "replay_all" else x[11] == row[4] for x in before)
            want[e[3]] = "mismatch" if e[11] != row[4] else "replayed" if good else "loaded"
        assert got == want


def test_no_events_and_no_artifacts(spark):
    manifest, audit = world(0)
    none = spark.createDataFrame([], "table_name string, dt date, problem string")
    m, a = frames(spark, manifest, audit)
    quiet = coverage.reconcile_covered(m, a.limit(0), none)
    assert quiet.filter("last_load is null").count() == 120 and quiet.filter("passed = (source_rows = parquet_rows)").count() == 120
    assert coverage.reconcile_covered(m.limit(0), a, none).count() == 0 and coverage.load_statuses(m.limit(0), a).count() == 0
