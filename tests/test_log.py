"""Small logs made by hand: boundaries, nulls, ties, drift, and plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.operators import drift, log, ocel, resources, states, windows

S = 1_000_000
DAY = 86_400 * S


@pytest.fixture
def make(spark):
    schema = "case_id string, activity string, ts_us long, event_id long, start_us long, resource string, pool long"

    def build(rows):
        return spark.createDataFrame([(c, a, t, i, t if len(x) < 2 else x[1], x[0] if x else "r", 0) for i, (c, a, t, *x) in enumerate(rows)], schema)

    return build


def test_split_keeps_what_the_closed_form_loses(make):
    cut = 1_700_000_000 * S
    df = make([("a", "x", cut - S), ("a", "y", cut - S // 2), ("a", "z", cut)])
    assert [r.window for r in log.split_log(df, [cut]).orderBy("ts_us").collect()] == [0, 0, 1]
    assert [(r.activity, r.window) for r in log.split_log(df, [cut], half_open=False).orderBy("ts_us").collect()] == [("x", 0), ("z", 1)]
    assert log.split_by_last_event(df, [cut]).first().window == 1


def test_null_case_ids_are_no_case_but_count_as_events(make):
    df = make([(None, "x", 1), ("a", "x", 2), ("a", "y", 3)])
    assert log.event_count(df).first()[0] == 3
    assert [tuple(r) for r in log.trace_length_distribution(df).collect()] == [(2, 1)]
    assert log.sorted_log(df).collect()[-1].case_id is None


def test_null_case_ids_are_no_case_anywhere(make):
    """Events without case id change nothing that is about cases, and keep their rows with nulls."""
    rows = [("a", "x", 10 * S), ("a", "y", 20 * S), ("b", "x", 2 * DAY), ("b", "x", 2 * DAY + S)]
    plain, df = make(rows), make(rows + [(None, "x", 5 * S), (None, "x", 6 * S), (None, "z", 3 * DAY)])
    cut = [DAY]
    for fn in (
        log.case_ids, log.variants, log.rework, log.arrivals, windows.active_cases, windows.directly_follows, windows.gap_stats, windows.handover, states.intra_case_state, lambda x: log.split_by_last_event(x, cut), lambda x: log.phases(x, cuts=cut),
        lambda x: log.cases_with(x, "x"), lambda x: log.cases_without(x, "y"), lambda x: log.arrival_profile(x, "day"), lambda x: log.precedes_rate(x, "x", "y"), lambda x: windows.termination_point(x, "y"),
    ):
        assert sorted(map(str, fn(df).collect())) == sorted(map(str, fn(plain).collect()))
    assert log.phase_report(df, "y", "x", ("x", "y")).agg(F.sum("cases")).first()[0] == log.phase_shares(df, "pool").agg(F.sum("cases")).first()[0] == 2
    for fn, col in ((windows.time_since_previous, "gap_us"), (windows.elapsed_in_case, "elapsed_us"), (windows.prefix, "idx"), (windows.queue_wait, "wait_us"), (lambda x: windows.prefix_counts(x, ["x"]), "n_x"), (lambda x: log.split_traces_by_last_event(x, cut), "window")):
        out = fn(df)
        assert out.count() == 7 and {r[col] for r in out.where("case_id IS NULL").collect()} == {None}
    assert [r.window for r in log.split_traces_by_last_event(df, [15 * S]).where("case_id = 'a'").collect()] == [1, 1]


def test_buckets_without_rows_have_shares_of_zero(spark):
    rows = spark.createDataFrame([(0, "a"), (1, "b"), (5, "a"), (6, "a")], "bucket long, state string")
    freq = states.state_frequency(rows)
    assert {(r.bucket, r.state): r.n for r in freq.collect()} == {(b, s): int((b, s) in {(0, "a"), (1, "b"), (5, "a"), (6, "a")}) for b in range(7) for s in "ab"}
    got = {r.bucket: r.tv for r in drift.window_distance(freq).collect()}
    assert got == {1: 1.0, 2: 0.5, 3: 0.0, 4: 0.0, 5: 0.5, 6: 0.0}


def test_batches_across_days(make):
    """A batch that runs over midnight is one, whatever bucket its events are in."""
    df = make([(f"c{i}", "x", DAY - 2 * S + i * S) for i in range(5)] + [("c9", "x", 3 * DAY), ("c8", "x", 3 * DAY + S), ("c7", "x", 9 * DAY)])
    assert sorted((r.from_us, r.events, r.cases) for r in resources.batching(df).collect()) == [(DAY - 2 * S, 5, 5), (3 * DAY, 2, 2)]


def test_approximate_quantiles(make):
    df = make([("c", "x", i * S, "r", 0) for i in range(1001)])
    exact, rough = log.duration_stats(df).first(), log.duration_stats(df, accuracy=10_000).first()
    assert exact.median_s == 500 and abs(rough.median_s - 500) <= 1 and abs(rough.p90_s - exact.p90_s) <= 1


def test_states_of_teams_and_more_features(make):
    df = make([(f"c{i % 3}", "ab"[i % 2], i * S, f"r{i % 4}") for i in range(40)]).withColumn("team", F.substring("resource", 1, 1)).withColumn("kind", F.lit("k"))
    assert states.resource_state(df, by="team").first().events == 40
    last = states.intra_case_state(df, ["a", "b"], ["kind"]).orderBy(F.desc("ts_us")).first()
    assert last.n_a + last.n_b == last.idx and last.kind == "k"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.3, (60, 4)) for c in ((0, 0, 0, 0), (4, 0, 1, 0), (0, 5, 0, 2))]) * [1, 2, 3, 4]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double, d double")
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    return states.state_vectors(df, ["a", "b", "c", "d"]).persist(), z


def test_pca_equals_numpy(vectors):
    df, z = vectors
    values = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
    assert [r.variance for r in states.pca(df, 3)[1].orderBy("component").collect()] == pytest.approx((values / values.sum())[:3], abs=1e-9)


def test_clusters_are_those_of_the_nearest_means(vectors):
    df, z = vectors
    got = np.array([r.cluster for r in states.cluster_states(df, 3).orderBy("id").collect()])
    means = np.stack([z[got == k].mean(0) for k in range(3)])
    assert (((z[:, None] - means) ** 2).sum(2).argmin(1) == got).all()
    assert [len(set(got[i : i + 60])) for i in (0, 60, 120)] == [1, 1, 1] and len(set(got)) == 3


def test_som_equals_numpy(vectors):
    df, z = vectors
    got = [r.cell for r in states.som_states(df, (2, 2), 4).orderBy("id").collect()]
    place = np.array([(0, 0), (0, 1), (1, 0), (1, 1)], float)
    far, book = ((place[:, None] - place) ** 2).sum(2), np.random.default_rng(7).normal(0, 0.5, (4, 4))
    for epoch in range(4):
        cell = ((z[:, None] - book) ** 2).sum(2).argmin(1)
        reach = np.exp(-far / (2 * (1 - epoch / 4 + 0.3) ** 2))
        total, count = np.stack([z[cell == k].sum(0) for k in range(4)]), np.bincount(cell, minlength=4)
        book = (reach @ total) / (reach @ count)[:, None]
    assert got == ((z[:, None] - book) ** 2).sum(2).argmin(1).tolist()


@pytest.mark.parametrize("n, first, last", [(9_999, "0001", "9999"), (10_000, "00001", "10000")])
def test_width_of_case_numbers(spark, n, first, last):
    df = spark.range(n).select(F.format_string("k%06d", "id").alias("case_id"), F.floor(F.col("id") * DAY / 500).alias("ts_us"))
    got = log.assign_case_ids(df).orderBy("number").collect()
    assert (got[0].padded, got[-1].padded) == (first, last) and [r.number for r in got] == list(range(1, n + 1))
    assert [r.case_id for r in got] == sorted(r.case_id for r in got)


def test_overlap_is_half_open_and_needs_two_cases(make):
    df = make([("a", "x", 100, "r", 0), ("b", "x", 200, "r", 100), ("c", "x", 150, "r", 50), ("c", "y", 160, "r", 60)])
    got = {(r.event_a, r.event_b, r.overlap_us) for r in resources.overlapping_cases(df).collect()}
    assert got == {(0, 2, 50), (0, 3, 40), (1, 2, 50), (1, 3, 60)}


def test_windows_without_one_task_equal_the_plain_ones(make):
    df = make([(f"c{i % 7}", "ab"[i % 2], (i * i * 37 % 9973) * DAY // 1500, f"r{i % 3}") for i in range(300)])
    got = {r.event_id: r.gap_us for r in windows.global_gap(df).collect()}
    rows = sorted((r.ts_us, r.event_id) for r in df.collect())
    assert got == {i: (None if n == 0 else t - rows[n - 1][0]) for n, (t, i) in enumerate(rows)}
    assert windows.active_cases(df).orderBy("instant_us").collect()[-1].active == 0
    for r in windows.trailing_rate(df, DAY).collect():
        assert r.in_window == sum(1 for x in df.collect() if x.resource == r.resource and r.ts_us - DAY <= x.ts_us <= r.ts_us) if r.event_id % 50 == 0 else True


def test_attach_state_takes_the_latest_across_days(spark, make):
    df = make([("a", "x", 5 * S, "r"), ("a", "x", 3 * DAY, "r"), ("a", "x", 5 * S, "q")])
    st = spark.createDataFrame([("r", 5 * S, "one"), ("r", 2 * DAY, "two"), ("r", 9 * DAY, "late")], "resource string, at long, state string")
    assert {r.event_id: r.state for r in states.attach_state(df, st, "resource", "at").collect()} == {0: "one", 1: "two", 2: None}


def test_drift_is_found_at_the_injected_boundary(spark):
    rows = [(b, s, share) for b in range(20) for s, share in (("qc", 0.873 if b < 10 else 0.579), ("none", 0.127 if b < 10 else 0.421))]
    signal = drift.window_distance(spark.createDataFrame(rows, "bucket long, state string, share double"))
    points = drift.change_points(signal, "tv")
    assert [r.bucket for r in points.collect()] == [10]
    known = spark.createDataFrame([(10,)], "known long")
    assert drift.drift_evaluation(points, known, 2).first().asDict() == {"detected": 1, "known": 1, "precision": 1.0, "recall": 1.0, "mean_delay": 0.0}


def test_shares_sum_to_one_and_windows_to_the_log(make):
    df = make([(f"c{i % 11}", "abc"[i % 3], i * DAY // 9, f"r{i % 4}") for i in range(200)])
    freq = states.state_frequency(states.resource_state(df))
    assert all(abs(r.s - 1) < 1e-9 for r in freq.groupBy("bucket").agg(F.sum("share").alias("s")).collect())
    assert log.split_report(log.split_log(df, [5 * DAY, 9 * DAY])).agg(F.sum("events")).first()[0] == 200
    assert log.variants(df).agg(F.sum("n")).first()[0] == 11


def test_value_map_leaves_nulls_out(spark):
    df = spark.createDataFrame([("e1", 1, None), ("e2", None, "x")], "`ocel:eid` string, n int, t string")
    assert {r["ocel:eid"]: r.vmap for r in ocel.to_value_map(df).collect()} == {"e1": {"n": "1"}, "e2": {"t": "x"}}


def plan(df):
    return df._jdf.queryExecution().toString()


def test_plans(spark, make, tmp_path):
    make([("a", "x", 100, "r", 0)]).write.parquet(str(tmp_path / "log"))
    df = spark.read.parquet(str(tmp_path / "log"))
    assert "NestedLoop" not in plan(resources.overlapping_cases(df)) and "Cartesian" not in plan(resources.overlapping_cases(df))
    assert "GreaterThanOrEqual(ts_us" in plan(log.filter_time_range(df, 1, 5, col="ts_us"))


@pytest.mark.parametrize("fn", [log.variants, log.variant_pareto, log.assign_case_ids, log.phases, log.rework, windows.global_gap, windows.active_cases, windows.directly_follows, resources.overlapping_cases, resources.resource_workload, resources.batching, states.intra_case_state])
def test_empty_logs_give_empty_results(make, fn):
    assert fn(make([]).withColumn("extra", F.lit(1))).count() == 0
