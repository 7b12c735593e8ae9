"""Running logs: counts by time, sessions, and the state of running cases, with Structured Streaming.

Each job is a function of a streaming (or batch) DataFrame with ts (a timestamp with zone), case_id and activity. Rows later than the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle



def tumbling_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, activity, events."""
    n = events.withWatermark("ts", late).groupBy(F.window("ts", width), "activity").agg(F.count(F.lit(1)).alias("events"))
    return n.select(F.col("window.start").alias("start"), "activity", "events")


def sliding_rate(events: DataFrame, width: str = "6 hours", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """start, end, events: the events of each window of that width, one beginning every slide."""
    n = events.withWatermark("ts", late).groupBy(F.window("ts", width, slide)).agg(F.count(F.lit(1)).alias("events"))
    return n.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "events")


def bursts(events: DataFrame, gap: str = "30 minutes", key: str | None = None, late: str = "1 hour") -> DataFrame:
    """Stretches without a pause of gap, of the whole log or of each key."""
    n = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), *([key] if key else [])).agg(F.count(F.lit(1)).alias("events"))
    return n.select(*([key] if key else []), F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


RUNNING = "case_id string, activity string, events long, elapsed_us long, gap_us long, ended boolean"


class RunningCase(StatefulProcessor):
    """Last activity, events, time since the first event and between the last two in time, whatever order they came in; a case ends after a time without events."""

    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("case", "activity string, events long, first_us long, last_us long, before_us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["ts_us", "activity"])
        held = self.state.get() if self.state.exists() else None
        activity, n, first, last, before = held if held else (None, 0, None, None, None)
        for ts, a in zip(new["ts_us"].tolist(), new["activity"].tolist(), strict=True):
            first = ts if first is None else min(first, ts)
            if last is None or ts >= last:
                before, last, activity = last, ts, a
            elif before is None or ts > before:
                before = ts
            n += 1
        self.state.update((activity, n, first, last, before))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last // 1000 + self.silence_ms)
        yield self._row(key, activity, n, first, last, before, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        row = self._row(key, *self.state.get(), True)
        self.state.clear()
        yield row

    def _row(self, key, activity, n, first, last, before, ended) -> pd.DataFrame:
        gap = None if before is None else last - before
        return pd.DataFrame({"case_id": [key[0]], "activity": [activity], "events": [n], "elapsed_us": [last - first], "gap_us": pd.array([gap], "Int64"), "ended": [ended]})

    def close(self) -> None:
        pass


def running_cases(events: DataFrame, silence: int = 86_400, late: str = "1 hour") -> DataFrame:
    """The state of each case after each batch that brings it events, and once more when it ends. Needs the RocksDB state store."""
    e = events.withWatermark("ts", late).select("case_id", "activity", "ts", F.unix_micros("ts").alias("ts_us"))
    return e.groupBy("case_id").transformWithStateInPandas(statefulProcessor=RunningCase(silence * 1000), outputStructType=RUNNING, outputMode="Append", timeMode="EventTime")


ORDERED = "case_id string, activity string, event_id long, ts_us long, idx long, gap_us long, elapsed_us long, seen long, prefix string"


class OrderedCase(StatefulProcessor):
    """Holds a case's events back until the watermark has passed them, then takes them in order; what only depends on the past is kept in a few numbers."""

    def __init__(self, last: int):
        self.last = last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts_us long, event_id long, activity string")
        self.past = handle.getValueState("past", "idx long, first_us long, last_us long, prefix string")
        self.seen = handle.getMapState("seen", "activity string", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            new = [(int(ts), int(i), a) for ts, i, a in zip(part["ts_us"], part["event_id"], part["activity"], strict=True)]
            self.waiting.appendList(new)
            for at in {self._due(ts) for ts, _, _ in new}:
                self.handle.registerTimer(at)
        yield pd.DataFrame(columns=[c.split()[0] for c in ORDERED.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All events of up to that time are there: later ones would be dropped as late."""
        now = expiredTimerInfo.getExpiryTimeInMs()
        held = [tuple(r) for r in self.waiting.get()]
        ready = sorted((r for r in held if self._due(r[0]) <= now), key=lambda r: r[:2])
        if not ready:
            return
        rest = [r for r in held if self._due(r[0]) > now]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        idx, first, last, prefix = self.past.get() if self.past.exists() else (0, ready[0][0], None, "")
        out = []
        for ts, event, activity in ready:
            name = (activity or "",)
            seen = (self.seen.getValue(name)[0] if self.seen.containsKey(name) else 0) + 1
            self.seen.updateValue(name, (seen,))
            idx += 1
            prefix = ">".join([*(prefix.split(">") if prefix else []), activity or ""][-self.last :])
            out.append((key[0], activity, event, ts, idx, None if last is None else ts - last, ts - first, seen, prefix))
            last = ts
        self.past.update((idx, first, last, prefix))
        table = pd.DataFrame(out, columns=[c.split()[0] for c in ORDERED.split(", ")])
        yield table.assign(gap_us=table["gap_us"].astype("Int64"))

    @staticmethod
    def _due(ts_us: int) -> int:
        """The watermark, in milliseconds, at which no event of that time can come any more."""
        return ts_us // 1000 + 1

    def close(self) -> None:
        pass


def ordered_cases(events: DataFrame, last: int = 10, late: str = "1 hour") -> DataFrame:
    """Each event of a case with its place, the time since the event before and since the first, how often its activity has occurred, and the last activities up to it.

    Events (case_id, activity, event_id, ts) may come in any order within the watermark: each waits in state until the watermark has passed it, so results are those of the
    same functions on the whole table. Ties are in order of event_id. Events without case, time or event_id take no part; a null activity counts as an empty one.
    """
    e = events.where("case_id IS NOT NULL AND ts IS NOT NULL AND event_id IS NOT NULL").withWatermark("ts", late)
    e = e.select("case_id", "activity", "event_id", "ts", F.unix_micros("ts").alias("ts_us"))
    return e.groupBy("case_id").transformWithStateInPandas(statefulProcessor=OrderedCase(last), outputStructType=ORDERED, outputMode="Append", timeMode="EventTime")


DRIFT = "bucket timestamp, events long, tv double, reference_tv double, cusum double, alarm boolean"


class DriftDetector(StatefulProcessor):
    """Compares each closed window with the one before and with a reference learnt from the first windows; a CUSUM of the latter finds drift that is slow."""

    def __init__(self, learn: int, slack: float, limit: float):
        self.learn, self.slack, self.limit = learn, slack, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.reference = handle.getMapState("reference", "activity string", "n long")
        self.last = handle.getMapState("last", "activity string", "n long")
        self.sums = handle.getValueState("sums", "learnt int, cusum double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        learnt, cusum = self.sums.get() if self.sums.exists() else (0, 0.0)
        out = []
        for start, window in sorted(new.groupby("start"), key=lambda x: x[0]):
            counts = {a or "": int(n) for a, n in zip(window["activity"], window["events"], strict=True)}
            before, reference = self._held(self.last), self._held(self.reference)
            tv, far = _distance(counts, before), None
            alarm = False
            if learnt < self.learn:
                for a, n in counts.items():
                    self.reference.updateValue((a,), (reference.get(a, 0) + n,))
                learnt += 1
            else:
                far = _distance(counts, reference)
                cusum = max(0.0, cusum + far - self.slack)
                alarm = cusum > self.limit
            out.append((start, sum(counts.values()), tv, far, cusum, alarm))
            if alarm:  # the process as it is now becomes the reference
                learnt, cusum = 0, 0.0
                self.reference.clear()
            self.last.clear()
            for a, n in counts.items():
                self.last.updateValue((a,), (n,))
        self.sums.update((learnt, cusum))
        table = pd.DataFrame(out, columns=[c.split()[0] for c in DRIFT.split(", ")])
        yield table.assign(tv=table["tv"].astype("Float64"), reference_tv=table["reference_tv"].astype("Float64"))

    @staticmethod
    def _held(state) -> dict[str, int]:
        return {k[0]: v[0] for k, v in state.iterator()}

    def close(self) -> None:
        pass


def _distance(a: dict[str, int], b: dict[str, int]) -> float | None:
    """Total variation of two counts; None if one is empty."""
    m, n = sum(a.values()), sum(b.values())
    return sum(abs(a.get(k, 0) / m - b.get(k, 0) / n) for k in {*a, *b}) / 2 if m and n else None


def drift_monitor(counts: DataFrame, key: str | None = None, learn: int = 5, slack: float = 0.05, limit_cusum: float = 0.5) -> DataFrame:
    """bucket, events, tv (from the window before), reference_tv, cusum, alarm: a row for each closed window of tumbling_counts (start, activity, events).

    The first windows are the reference (learn of them, summed); then each window's distance from it, beyond slack, is summed up and falls no lower than zero. Beyond limit_cusum it
    alarms, and the windows that follow are the new reference. So a drift that is small from one window to the next is found too. With key (a column of counts) there is
    a detector for each value. Its state is Spark's: a restarted query goes on where it was. A window without events has no row; a null activity counts as an empty one.
    """
    c = counts.withColumn("__key", F.col(key).cast("string") if key else F.lit("all"))
    return c.groupBy("__key").transformWithStateInPandas(statefulProcessor=DriftDetector(learn, slack, limit_cusum), outputStructType=DRIFT, outputMode="Append", timeMode="None")


def drift_alarm(counts: DataFrame, alarm: Callable[[DataFrame, int], None], limit: float = 0.3, checkpoint: str | None = None, **monitor):
    """Start a query on tumbling_counts that calls alarm with the windows that are further than limit (total variation) from the window before, or that drift_monitor alarms at.

    What is known of earlier windows is state of the query: with checkpoint it outlives the query.
    """
    def check(batch: DataFrame, number: int) -> None:
        alarm(batch.where((F.col("tv") > limit) | F.col("alarm")), number)

    out = drift_monitor(counts, **monitor).writeStream.outputMode("append").foreachBatch(check)
    return (out.option("checkpointLocation", checkpoint) if checkpoint else out).start()
