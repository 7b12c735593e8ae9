"""Streams against the same functions on the whole table, for windows that are closed."""

import datetime as dt
import random
import shutil

import pytest
from pyspark.sql import functions as F

from caseloom.operators import windows
from caseloom.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def feed(spark, tmp_path, batches):
    schema = "case_id string, activity string, ts timestamp"
    for i, rows in enumerate(batches):
        spark.createDataFrame([(c, a, T0 + dt.timedelta(minutes=m)) for c, a, m in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), spark.read.schema(schema).parquet(str(tmp_path / "in"))


def drained(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
        late = sum(int(o["numRowsDroppedByWatermark"]) for p in q.recentProgress for o in p["stateOperators"])
    finally:
        q.stop()
    return df.sparkSession.table(name), late


ROWS = [[(f"c{i % 5}", "ab"[i % 2], i * 17) for i in range(k, k + 100)] for k in (0, 100, 200)]


@pytest.mark.parametrize("job", [lambda e: jobs.tumbling_counts(e, "6 hours"), lambda e: jobs.sliding_rate(e), lambda e: jobs.bursts(e, "10 minutes", "case_id")])
def test_streams_equal_batches(spark, tmp_path, job):
    stream, table = feed(spark, tmp_path, ROWS)
    got, late = drained(job(stream), f"t{abs(hash(str(tmp_path)))}")
    seen = {tuple(r) for r in got.collect()}
    whole = {tuple(r) for r in job(table).collect()}
    assert seen and seen <= whole and late == 0
    assert len(seen) >= 0.7 * len(whole)


def test_late_rows_are_dropped(spark, tmp_path):
    stream, _ = feed(spark, tmp_path, [[("a", "x", 0), ("a", "x", 3000)], [("a", "x", 3100)], [("b", "x", 1)]])
    got, late = drained(jobs.tumbling_counts(stream, "1 hour"), "late")
    assert late == 1 and got.where(F.col("start") == T0).agg(F.sum("events")).first()[0] == 1


def test_running_cases_end_in_their_last_state(spark, tmp_path):
    stream, _ = feed(spark, tmp_path, [[("a", "x", 0), ("b", "x", 5)], [("a", "y", 10)], [("c", "z", 9000)], [("c", "z", 9100)]])
    got, _ = drained(jobs.running_cases(stream, silence=3600), "running")
    rows = got.collect()
    ended = {r.case_id: (r.activity, r.events, r.elapsed_us, r.gap_us) for r in rows if r.ended}
    assert ended == {"a": ("y", 2, 600_000_000, 600_000_000), "b": ("x", 1, 0, None)}
    assert max(r.events for r in rows if r.case_id == "c") == 2


def test_alarm(spark, tmp_path):
    rows = [[("a", "x" if m < 2880 else "y", m) for m in range(0, 5760, 60)], [("a", "y", 9000)], [("a", "y", 9001)]]
    stream, _ = feed(spark, tmp_path, rows)
    found = []
    q = jobs.drift_alarm(jobs.tumbling_counts(stream, "1 day"), lambda df, n: found.extend(r.bucket for r in df.collect()))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert T0 + dt.timedelta(days=2) in found


def test_alarm_across_batches_and_restarts(spark, tmp_path):
    """One window a batch; the change from day 1 to day 2 lies between batches, that from day 3 to day 4 between two runs of the query."""
    days = ["x", "x", "y", "y", "x", "x"]
    schema, found = "case_id string, activity string, ts timestamp", []

    def run(numbers):
        for i in numbers:
            rows = [("a", days[i], T0 + dt.timedelta(days=i, hours=h)) for h in range(24)]
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            if i == numbers[0]:
                q = jobs.drift_alarm(jobs.tumbling_counts(stream, "1 day"), lambda df, n: found.append([r.bucket for r in df.collect()]), checkpoint=str(tmp_path / "checkpoint"))
            q.processAllAvailable()
        q.stop()

    run([0, 1, 2, 3])
    run([4, 5])
    assert [x for x in found if x] == [[T0 + dt.timedelta(days=2)], [T0 + dt.timedelta(days=4)]]


def test_late_order_leaves_the_right_gap(spark, tmp_path):
    stream, _ = feed(spark, tmp_path, [[("a", "x", 0)], [("a", "z", 100)], [("a", "y", 50)], [("b", "x", 9000)], [("b", "x", 9001)]])
    got, _ = drained(jobs.running_cases(stream, silence=3600, late="2 hours"), "late_order")
    (row,) = [r for r in got.collect() if r.ended and r.case_id == "a"]
    assert (row.activity, row.events, row.gap_us, row.elapsed_us) == ("z", 3, 50 * 60_000_000, 100 * 60_000_000)


def test_ordered_cases_equal_the_windows_of_the_whole_table(spark, tmp_path):
    """Events shuffled within the watermark, two microseconds and none apart."""
    rng = random.Random(6)
    us = sorted(rng.randrange(0, 6 * 3_600_000_000) for _ in range(240))
    us[10:13] = [us[10], us[10], us[10] + 2]
    rows = [(f"c{rng.randrange(6)}", rng.choice("abc"), i, t) for i, t in enumerate(us)]
    order = sorted(rows, key=lambda r: r[3] + rng.randrange(0, 1_800_000_000))
    schema = "case_id string, activity string, event_id long, ts timestamp"
    at = lambda t: T0 + dt.timedelta(microseconds=t)
    batches = [order[i : i + 30] for i in range(0, 240, 30)] + [[("end", "x", 1000, 40 * 3_600_000_000)], [("end", "x", 1001, 41 * 3_600_000_000)]]
    for b in batches:
        spark.createDataFrame([(c, a, i, at(t)) for c, a, i, t in b], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got, late = drained(jobs.ordered_cases(stream, last=3), "ordered")
    table = spark.createDataFrame([(c, a, i, at(t)) for c, a, i, t in rows], schema).withColumn("ts_us", F.unix_micros("ts"))
    want = windows.prefix_counts(windows.prefix(windows.elapsed_in_case(windows.time_since_previous(table)), 3), ["a", "b", "c"])
    want = want.select("case_id", "event_id", "idx", "gap_us", "elapsed_us", "prefix", F.expr("CASE activity WHEN 'a' THEN n_a WHEN 'b' THEN n_b ELSE n_c END").alias("seen"))
    assert late == 0
    assert sorted(map(tuple, got.where("case_id != 'end'").select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def slow_drift(day):
    """40 events a day; from day 10 on, the share of y grows by 3 % a day."""
    share = 0.1 + 0.03 * max(0, day - 10)
    return ["y" if h < round(40 * share) else "x" for h in range(40)]


def test_slow_drift_alarms_and_restarts_change_nothing(spark, tmp_path):
    schema, days = "case_id string, activity string, ts timestamp", 32
    for i in range(days):
        rows = [("a", x, T0 + dt.timedelta(days=i, minutes=30 * h)) for h, x in enumerate(slow_drift(i))]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "all" / f"{i:02}"))

    def run(name, stops):
        found = []
        for stop in stops:
            (tmp_path / name).mkdir(exist_ok=True)
            for i in range(stop):
                for f in (tmp_path / "all" / f"{i:02}").glob("*.parquet"):
                    if not (tmp_path / name / f"{i:02}.parquet").exists():
                        shutil.copy(f, tmp_path / name / f"{i:02}.parquet")
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(str(tmp_path / name))
            q = jobs.drift_alarm(jobs.tumbling_counts(stream, "1 day"), lambda df, n: found.extend((r.bucket, r.tv, round(r.cusum, 9), r.alarm) for r in df.collect()), limit=0.3, checkpoint=str(tmp_path / f"{name}-state"), slack=0.05, limit_cusum=0.5)
            try:
                q.processAllAvailable()
            finally:
                q.stop()
        return sorted(found)

    whole = run("whole", [days])
    assert whole and all(r[3] and r[1] < 0.05 for r in whole), "neighbours never differ by 5 %, yet it alarms"
    assert T0 + dt.timedelta(days=12) < whole[0][0] <= T0 + dt.timedelta(days=24)
    assert run("parts", [9, 17, days]) == whole
