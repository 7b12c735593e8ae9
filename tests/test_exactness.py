"""Null resources, borders, numerics, names, whole prefixes and exact quantiles, against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.operators import drift, log, ocel, quantiles, resources, stage, states, windows
from caseloom.plans import queries, views

DAY = log.DAY
SCHEMA = "case_id string, activity string, ts_us long, start_us long, resource string, pool int, event_id long"


def events(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_workload_counts_every_event_once(spark):
    rows = [("a", "x", 0, 0, "r", 0, 1), ("b", "x", DAY, DAY, "r", 0, 2), ("b", "y", DAY, DAY - 10, "r", 0, 3), ("c", "x", 2 * DAY + 5, 2 * DAY + 5, None, 0, 4)]
    got = {(r.resource, r.bucket): (r.events, r.cases, r.busy_us) for r in resources.resource_workload(events(spark, rows)).collect()}
    assert got == {("r", 0): (2, 2, 10), ("r", 1): (1, 1, 0), (None, 2): (1, 1, 0)}
    days = [(f"c{i}", "x", i * DAY, i * DAY, "r", 0, i) for i in range(5)]
    assert resources.resource_workload(events(spark, days)).agg(F.sum("events")).first()[0] == 5


def test_null_resource_is_a_key_like_any_other(spark):
    """Filling the nulls first gives the same rows."""
    rng = random.Random(4)
    rows = [(f"c{rng.randrange(12)}", rng.choice("xy"), t, t - rng.randrange(0, DAY // 3), rng.choice(["r", None, None]), 0, i) for i, t in enumerate(sorted(rng.randrange(0, 4 * DAY) for _ in range(150)))]
    some = events(spark, rows)
    full = some.na.fill("none", ["resource"])
    jobs = [
        resources.batching, resources.resource_workload, resources.overlapping_cases, lambda x: resources.resource_contention(x), lambda x: windows.cross_case_edges(x, DAY), lambda x: windows.resource_idle(x).select("event_id", "idle_us"),
        lambda x: states.resource_state(x).drop("handovers"), lambda x: states.attach_state(x, states.resource_state(x).withColumn("at", (F.col("bucket") + 1) * DAY), "resource", "at").select("event_id", "state"),
    ]
    for job in jobs:
        plain = lambda df: Counter(tuple("none" if v is None and c == "resource" else v for c, v in zip(df.columns, r, strict=True)) for r in df.collect())
        a, b = plain(job(some)), plain(job(full))
        assert a == b and a
        assert len({k[:2] for k in a}) <= sum(a.values())


def test_profile_of_constant_and_large_features(spark):
    rows = [("ab"[i % 2], 0.1, 1_700_000_000_000_000 + 1_000_000 * i, None if i % 3 else float(i)) for i in range(1000)]
    got = {(r.state, r.feature): r for r in states.state_profile(spark.createDataFrame(rows, "state string, c double, t long, n double"), ["c", "t", "n"]).collect()}
    assert got["a", "c"].difference is None and got["a", "c"].inside == pytest.approx(0.1)
    t = np.array([r[2] for r in rows], float)
    assert got["a", "t"].difference == pytest.approx((t[::2].mean() - t[1::2].mean()) / t.std(ddof=1), abs=2e-6)
    n = np.array([i for i in range(1000) if i % 3 == 0], float)
    assert got["a", "n"].difference == pytest.approx((n[n % 2 == 0].mean() - n[n % 2 == 1].mean()) / n.std(ddof=1), rel=1e-5)
    assert got["a", "n"].rest == pytest.approx(n[n % 2 == 1].mean())


def test_names_that_operators_once_used(spark):
    rows = [("r", i, "ab"[i % 2], float(i), 1, "z") for i in range(6)]
    df = spark.createDataFrame(rows, "resource string, bucket long, state string, f double, _border int, `a.b` string")
    assert states.border_conditions(df, ["resource"], ["f"]).count() == 2
    z = states.zscores(df.withColumns({"_m_f": F.lit("x"), "_d_f": F.lit("y")}), ["f"])
    assert z.columns == [*df.columns, "_m_f", "_d_f", "z_f"] and z.agg(F.sum("z_f")).first()[0] == pytest.approx(0)
    e = events(spark, [("c", "x", i * DAY + 5, i * DAY, "r", 0, i) for i in range(3)]).withColumns({"_s": F.lit(1), "_t": F.lit(2), "state": F.lit("old"), "a.b": F.lit(3)})
    out = states.attach_state(e, df.withColumn("at", F.col("bucket") * DAY), "resource", "at")
    assert sorted(out.columns) == sorted(e.columns) and {r.event_id: r.state for r in out.collect()} == {0: "a", 1: "b", 2: "a"}
    v = states.state_vectors(df.withColumns({"_raw": F.lit(1), "_x": F.lit(1)}), ["f"])
    assert states.som_states(v, (2, 2), 2).columns == [*v.columns, "cell"]


def test_active_cases_by_bucket(spark):
    """A case of three years is two steps, not a row for each bucket."""
    rows = [("long", "x", t, t, "r", 0, i) for i, t in enumerate((0, 1000 * DAY))] + [(f"c{i}", "x", i * DAY * 7 + 5, i * DAY * 7, "r", 0, 10 + i) for i in range(100)]
    job = states.active_by_bucket(events(spark, rows), DAY)
    got = {r.bucket: (r.arrivals, r.active) for r in job.collect()}
    assert len(got) == 1001 and got[0] == (2, 2) and got[7] == (1, 2) and got[8] == (0, 1) and got[1000] == (0, 1)


def test_phases_span_cases_only(spark):
    rows = [("a", "x", 10, 10, "r", 0, 1), ("b", "x", 20, 20, "r", 0, 2), ("c", "x", 40, 40, "r", 0, 3), (None, "x", 10_000, 0, "r", 0, 4)]
    assert {r.case_id: r.phase for r in log.phases(events(spark, rows)).collect()} == {"a": 0, "b": 1, "c": 2}


def test_prefix_tree(spark):
    rng = random.Random(1)
    cases = {f"c{i}": [rng.choice(["a", "b", None]) for _ in range(rng.randint(1, 20))] for i in range(80)} | {"long": ["a", "b"] * 5000}
    rows = [(c, a, t, t, "r", 0, n * 20_000 + t) for n, (c, path) in enumerate(cases.items()) for t, a in enumerate(path)] + [(None, "a", 5, 5, "r", 0, -1)]
    df = events(spark, rows)
    nodes = {r.event_id: r.node for r in windows.prefix_nodes(df).select("event_id", "node").collect()}
    names, passed, ended = {}, Counter(), Counter()
    for n, (c, path) in enumerate(cases.items()):
        prefix = 0
        for t, a in enumerate(path):
            prefix = names.setdefault((prefix, a), len(names) + 1)
            passed[prefix] += 1
            cases[c] = prefix
            nodes[n * 20_000 + t] = (nodes[n * 20_000 + t], prefix)
    ended = Counter(cases.values())
    pairs = {v for v in nodes.values()}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(names)
    tree = windows.prefix_tree(df)
    rows = tree.collect()
    of = dict(pairs)
    assert len(rows) == len(names) and all(r.cases == passed[of[r.node]] and r.ends == ended[of[r.node]] for r in rows)
    assert all((of[r.parent] if r.parent else 0, r.activity) in names and names[of[r.parent] if r.parent else 0, r.activity] == of[r.node] for r in rows)
    assert sorted(r.ends for r in rows if r.ends) == sorted(r.n for r in log.variants(df.na.fill("null", ["activity"])).collect())


@pytest.mark.parametrize("most", [5, 100_000])
def test_exact_quantiles(spark, most):
    rng = random.Random(2)
    values = {"skew": [rng.paretovariate(0.5) for _ in range(3000)], "ties": [float(rng.randrange(3)) for _ in range(3000)], "same": [7.5] * 500, "one": [3.0], "two": [1.0, 2.0], None: [rng.gauss(0, 1) for _ in range(999)]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("none", None)], "k string, v double").repartition(4)
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {r.k: tuple(r)[1:] for r in quantiles.exact_quantiles(df, ["k"], F.col("v"), shares, most=most, accuracy=50).collect()}
    assert got.keys() == values.keys()
    for k, vs in values.items():
        assert got[k] == pytest.approx(np.quantile(vs, shares).tolist(), rel=1e-12)
    whole = quantiles.exact_quantiles(df, [], F.col("v"), [0.5], most=most).first()
    assert whole.q0 == pytest.approx(np.median([v for vs in values.values() for v in vs]))


def test_no_group_of_values_in_one_task(spark):
    """No plan of the statistics holds a percentile() aggregate."""
    df = events(spark, [(f"c{i % 9}", "x", i * 7 % 1000, i, "r", 0, i) for i in range(300)])
    for job in (log.duration_stats(df), windows.gap_stats(df)):
        assert "percentile(" not in job._jdf.queryExecution().executedPlan().toString()
    assert log.duration_stats(df).first().median_s == pytest.approx(log.duration_stats(df, accuracy=100_000).first().median_s, abs=1e-5)


def test_match_drifts_is_a_join_on_equal_buckets(spark):
    known = spark.createDataFrame([(3,), (10,)], "known long")
    found = spark.createDataFrame([(4, 1.0), (9, 1.0), (12, 1.0)], "bucket long, score double")
    out = drift.match_drifts(found, known, 2)
    assert sorted(map(tuple, out.collect())) == [(3, 4, 1), (10, 12, 2)]
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_approximate_variant_count_and_columns(spark):
    df = events(spark, [(f"c{i}", "xy"[i % 2], i, i, "r", 0, i) for i in range(50)])
    assert log.variant_count(df, approximate=True).first()[0] == 2
    assert df.columns == SCHEMA.replace(" string", "").replace(" long", "").replace(" int", "").split(", ")


def test_windows_are_written_once_and_read_alone(spark, tmp_path):
    rng = random.Random(7)
    df = events(spark, [(f"c{i % 13}", "x", rng.randrange(0, 9 * DAY), 0, "r", 0, i) for i in range(300)] + [("c0", "x", None, None, "r", 0, 999)]).repartition(3)
    path, cuts = str(tmp_path / "split"), (6 * DAY, 3 * DAY)
    log.write_windows(df, cuts, path)
    back = spark.read.parquet(path)
    assert sorted(map(tuple, back.select(df.columns).collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    one = log.read_window(spark, path, 1)
    assert {r.event_id for r in one.collect()} == {r.event_id for r in df.where(f"ts_us >= {3 * DAY} AND ts_us < {6 * DAY}").collect()}
    assert len({f.rsplit("/", 2)[1] for f in one.inputFiles()}) == 1 or "PartitionFilters: [isnotnull(window" in one._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in one._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in line)
    assert "window" in scan.split("PartitionFilters: [")[1].split("]")[0]
    log.write_windows(df.where(f"ts_us >= {6 * DAY}").withColumn("activity", F.lit("new")), cuts, path)
    assert {(r.window, r.activity) for r in spark.read.parquet(path).select("window", "activity").distinct().collect()} == {(0, "x"), (1, "x"), (2, "new"), (None, "x")}
    log.write_windows(df, cuts, path + "-cases", by_case=True)
    assert spark.read.parquet(path + "-cases").where("window IS NOT NULL").groupBy("case_id").agg(F.countDistinct("window").alias("n")).where("n > 1").count() == 0
    assert log.split_names([1_624_267_324_000_000], "sudden_drift") == [(0, "sudden_drift_window_0", "1970-01-01 00:00:00", "2021-06-21 09:22:03"), (1, "sudden_drift_window_1", "2021-06-21 09:22:04", "2099-12-30 23:59:59")]


def test_shapes_and_matching_one_to_one(spark):
    df = events(spark, [(f"c{i:03}", "x", i * DAY + e, i * DAY, "r", 0, 2 * i + e) for i in range(100) for e in (0, 1)])
    got = {(r.shape, r.part): (r.from_us // DAY, r.to_us // DAY) for r in drift.drift_intervals(df).collect()}
    assert got[("sudden", 1)] == (50, 50) and got[("gradual", 1)] == (40, 60) and [got["recurring", i][0] for i in (1, 2, 3, 4)] == [20, 40, 60, 80] and [got["incremental", i][0] for i in (1, 2, 3)] == [25, 50, 75]
    known = spark.createDataFrame([("s", 1, 10, 10), ("s", 2, 12, 14), ("t", 1, 50, 50)], "shape string, part int, `from` long, `to` long")
    found = spark.createDataFrame([(11, 1.0), (12, 1.0), (15, 1.0), (30, 1.0)], "bucket long, score double")
    assert sorted(map(tuple, drift.match_intervals(found, known, 2).collect())) == [("s", 1, 11, 1), ("s", 2, 15, 3)]
    rows = {r.shape: (r.detected, r.known, r.matched, r.precision, r.recall) for r in drift.shape_evaluation(found, known, 2).collect()}
    assert rows == {"s": (4, 2, 2, 0.5, 1.0), "t": (4, 1, 0, 0.0, 0.0)}


def test_overlaps_of_months_and_minutes(spark):
    """All pairs, and two rows held for each interval, however long."""
    rng = random.Random(9)
    minute = 60_000_000
    rows = []
    for i in range(800):
        a, long = rng.randrange(0, 20 * DAY), rng.choice([1, 2, 4**13, 4**13 + 1, minute, minute, 10 * minute, DAY, 30 * DAY if i % 20 == 0 else 0, -5])
        rows.append((f"c{rng.randrange(40)}" if i % 50 else None, "x", a + long, a, rng.choice(["r", "r", "s", None]), 0, i % 390))
    rows += [(f"d{i}", "x", -5 * DAY + i * minute, -9 * DAY, "r", 0, 1000 + i) for i in range(5)]
    df = events(spark, rows)
    want = Counter()
    for i, (c, _, b, a, r, _, n) in enumerate(rows):
        for c2, _, b2, a2, r2, _, n2 in rows[:i]:
            if c is not None and c2 is not None and c != c2 and r == r2 and n != n2 and a <= b and a2 <= b2 and a < b2 and a2 < b:
                want[r, min(n, n2), max(n, n2), max(a, a2), min(b, b2) - max(a, a2)] += 1
    got = resources.overlapping_cases(df)
    assert Counter(map(tuple, got.collect())) == want and len(want) > 500
    spans = df.where("start_us < ts_us").withColumn("level", F.ceil(F.log(4.0, F.col("ts_us") - F.col("start_us"))).cast("int"))
    assert resources.touched_buckets(spans, "level").groupBy(*df.columns).count().agg(F.max("count")).first()[0] <= 2
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    """Keys and parts of the hash exchanges of a plan, and whether their number is given."""
    found = (line.split("Exchange hashpartitioning(")[1] for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning(" in line)
    return [([k.strip().split("#")[0] for k in x.split(")")[0].split(",")], "REPARTITION_BY_NUM" in x) for x in found]


def test_objects_per_event_in_parts_by_rows(spark, monkeypatch):
    """Parts grow with the rows, each table that is grouped by its many keys is dealt into them, and the rows are those of a plain count."""
    assert stage.parts(spark, 100 * stage.TASK_ROWS + 1) == 101 and stage.parts(spark, 5) == spark.sparkContext.defaultParallelism
    rng = random.Random(5)
    rows = [(rng.choice([None, *(f"e{i}" for i in range(30))]), rng.choice([None, "part", "order"]), rng.choice([None, *(f"o{i}" for i in range(6))])) for _ in range(400)] + [("hot", "part", f"o{i}") for i in range(500)] + [("none", "part", None)] * 3
    want = Counter((t, n) for (_, t), n in {(e, t): len({o for a, b, o in rows if (a, b) == (e, t)} - {None}) for e, t, _ in rows}.items())
    relations = spark.createDataFrame(rows, "eid string, type string, oid string").repartition(3)
    for parts in (None, 1, 9):
        assert {(r.type, r.objects): r.events for r in ocel.objects_per_event(relations, parts).collect()} == want
    monkeypatch.setattr(views, "parts", lambda spark, rows: 9)
    got = exchanges(queries.QUERIES["objects_per_event"](spark, "/root/testdata/sf0.001"))
    assert sorted(got) == [(["eid", "type", "9"], True), (["eid", "type", "oid", "9"], True), (["l_orderkey", "l_partkey", "9"], True), (["type", "objects", "4"], False)]
