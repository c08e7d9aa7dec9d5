"""Jobs followed with timers: as the table has them, and forgotten in the end."""

import random
import uuid
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from listingloom.streaming import jobs as S
from listingloom.streaming import tracker as K

T0 = datetime(2025, 1, 1)
SCHEMA = "batch_id STRING, job_id STRING, event STRING, event_ts TIMESTAMP"


def events_of(*rows):
    return [(b, j, e, T0 + timedelta(seconds=s)) for b, j, e, s in rows]


@pytest.fixture
def follow(spark, tmp_path):
    """Run a stream over parts of a table, one micro-batch each; give rows and checkpoint."""

    def run(parts, job, mode="update", known=None):
        for key, value in S.STATE_STORE_CONF.items():
            spark.conf.set(key, value)
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        folder = tmp_path / uuid.uuid4().hex
        out = []
        try:
            for part in parts:
                spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "in"))
                query = (
                    job(spark.readStream.schema(SCHEMA).parquet(str(folder / "in")))
                    .writeStream.outputMode(mode)
                    .foreachBatch(lambda df, _: out.extend(df.collect()))
                    .option("checkpointLocation", str(folder / "checkpoint"))
                    .trigger(availableNow=True).start()
                )
                query.awaitTermination()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        return out, str(folder / "checkpoint")

    return run


def some_events(n, jobs, seed):
    rng = random.Random(seed)
    kinds = ["active", "active", "progress", "waiting", "completed", "failed"]
    rows = [("b", f"j{rng.randrange(jobs)}", rng.choice(kinds), rng.randrange(3000)) for _ in range(n)]
    # the last one moves the watermark over all of them
    return rows, events_of(*rows)


def test_as_the_table(spark, follow):
    """States, results and stalls of a stream in any order are those of the table."""
    _, rows = some_events(150, 25, 1)
    rows = sorted(rows, key=lambda r: r[3])
    mixed = [rows[0::3], rows[1::3], rows[2::3]]  # each part reaches over the whole time
    mixed.append(events_of(("end", "end", "waiting", 20_000)))
    table = spark.createDataFrame([r for p in mixed for r in p], SCHEMA)
    job = lambda e: K.track_jobs(e, silence_ms=60_000, keep_ms=10**9, late="2 hours")
    out, _ = follow(mixed, job)
    want = {r.job_id: (r.state, r.last_event_at) for r in S.job_states(table).collect()}
    got = {}
    for r in out:
        if r.kind == "state":
            got[r.job_id] = (r.state, r.at)
    assert got == want
    results = [r.job_id for r in out if r.kind == "result"]
    assert sorted(results) == sorted(r.job_id for r in S.finished_once(table).collect())
    stalls = {(r.job_id, r.stalled_at) for r in S.stalled_spells(table, silence="60 seconds").collect()}
    found = [(r.job_id, r.at) for r in out if r.kind == "stall"]
    assert set(found) == stalls and len(found) == len(stalls) and len(stalls) > 5


def test_late_news_is_no_stall(follow):
    parts = [
        events_of(("b", "x", "active", 0), ("b", "x", "completed", 10), ("b", "y", "active", 0)),
        events_of(("b", "x", "active", 400), ("b", "y", "completed", 400)),
        events_of(("b", "z", "waiting", 9000)),
    ]
    out, _ = follow(parts, lambda e: K.track_jobs(e, late="10 minutes"))
    assert [(r.job_id, r.at) for r in out if r.kind == "stall"] == [("y", T0 + timedelta(seconds=30))]
    assert sorted(r.job_id for r in out if r.kind == "result") == ["x", "y"]


def test_state_ends_with_the_job(spark, follow):
    done = [("b", f"j{i}", "completed", i) for i in range(40)]
    live = [("b", "live", "active", 5)]
    job = lambda e: K.track_jobs(e, keep_ms=60_000, late="1 minute")

    def states(checkpoint):
        reader = spark.read.format("statestore").option("stateVarName", "standing")
        return reader.load(checkpoint).count()

    _, before = follow([events_of(*done, *live)], job)
    _, after = follow([events_of(*done, *live), events_of(("b", "live", "progress", 5000))], job)
    assert states(before) == 41 and states(after) == 1


class CountingHandle:
    """State of one job in memory; counts what would leave the Python worker."""

    def __init__(self):
        self.calls, self.value = 0, None

    def _counted(self, value=None):
        self.calls += 1
        return value

    def getValueState(self, *_):
        return self

    def getMapState(self, *_):
        return CountingHandle()

    def registerTimer(self, _):
        self._counted()

    def exists(self):
        return self._counted(self.value is not None)

    def get(self):
        return self._counted(self.value)

    def update(self, value):
        self.value = self._counted(value)

    def updateValue(self, *_):
        self._counted()


def test_a_job_is_read_and_written_once():
    """Calls to the state go up with the timers of a job's rows and with nothing else."""
    tracker, handle = K.JobTracker(30_000, 3_600_000), CountingHandle()
    tracker.init(handle)
    calls = []
    for event, second in (("active", 0), ("progress", 1), ("completed", 2)):
        before = handle.calls
        rows = [{"event_ts": T0 + timedelta(seconds=second), "event": event}]
        list(tracker.handleInputRows(("b", "j"), iter(rows), None))
        calls.append(handle.calls - before)
    # read, write, and a timer; the end has one more
    assert calls == [3, 3, 4]


def test_jobs_taken_over_from_a_table(spark, follow):
    """A restart from a table of states goes on as if the events had been seen."""
    first = events_of(("b", "a", "active", 0), ("b", "d", "completed", 3))
    second = events_of(("b", "d", "active", 50), ("b", "a", "failed", 60), ("b", "n", "waiting", 61))
    whole, _ = follow([first, second], K.track_jobs)
    states = S.job_states(spark.createDataFrame(first, SCHEMA)).withColumnRenamed("last_event_at", "at")
    known = spark.createDataFrame(states.collect(), states.schema)
    resumed, _ = follow([second], lambda e: K.track_jobs(e, known=known))
    last = [{r.job_id: r.state for r in out if r.kind == "state"} for out in (whole, resumed)]
    assert last[0] == {"a": "failed", "d": "completed", "n": "waiting"}
    assert {**{"d": "completed"}, **last[1]} == last[0]
    assert [r.job_id for r in resumed if r.kind == "result"] == ["a"]


def test_completions_come_once(spark, follow):
    totals = spark.createDataFrame([("b", 2), ("c", 1), ("d", 2)], "batch_id STRING, total LONG")
    parts = [
        events_of(("b", "1", "completed", 0), ("c", "1", "failed", 0), ("d", "1", "completed", 1)),
        events_of(("b", "2", "failed", 1), ("b", "1", "completed", 2)),
        events_of(("b", "2", "active", 5), ("b", "1", "waiting", 6), ("c", "1", "failed", 7)),
    ]
    out, _ = follow(parts, lambda e: K.completions(e, totals))
    assert sorted((r.batch_id, r.completed, r.total) for r in out) == [("b", 2, 2), ("c", 1, 1)]


def test_results_meet_their_events(spark, tmp_path):
    """Streams of ends and of results, in either order, and an end without a result."""
    for key, value in S.STATE_STORE_CONF.items():
        spark.conf.set(key, value)
    records = "batch_id STRING, job_id STRING, result_ts TIMESTAMP, name STRING"
    first = events_of(("b", "1", "completed", 0), ("b", "2", "failed", 5), ("b", "lost", "completed", 6))
    steps = [
        (first, [("b", "3", T0 + timedelta(seconds=60), "three")]),
        (events_of(("b", "3", "completed", 60)), [("b", "1", T0, "one"), ("b", "2", T0 + timedelta(seconds=5), "two")]),
        (events_of(("b", "9", "waiting", 9000)), [("b", "9", T0 + timedelta(seconds=9000), "nine")]),
    ]
    out = []
    for no, (events, results) in enumerate(steps):
        spark.createDataFrame(events, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
        spark.createDataFrame(results, records).coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
        joined = K.result_payload_events(
            spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "e")),
            spark.readStream.schema(records).parquet(str(tmp_path / "r")),
        )
        joined.writeStream.outputMode("append").foreachBatch(
            lambda df, _, no=no: out.extend((no, r.job_id, r.name, r.has_result) for r in df.collect())
        ).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(out) == [(1, "1", "one", True), (1, "2", "two", True), (1, "3", "three", True), (2, "lost", None, False)]
    tables = [
        spark.createDataFrame([r for step in steps for r in step[side]], schema)
        for side, schema in ((0, SCHEMA), (1, records))
    ]
    rows = K.result_payload_events(*tables).collect()
    assert sorted((r.job_id, r.name, r.has_result) for r in rows) == sorted(o[1:] for o in out)


class SliceHandle(CountingHandle):
    """With the timers that are set."""

    def __init__(self):
        super().__init__()
        self.timers = set()

    def registerTimer(self, at):
        self._counted()
        assert at not in self.timers
        self.timers.add(at)

    def deleteTimer(self, at):
        self._counted()
        self.timers.remove(at)

    def clear(self):
        self.value = self._counted()


class At:
    """A watermark and a timer's moment, for all that a processor asks of them."""

    def __init__(self, ms):
        self.ms = ms

    def getExpiryTimeInMs(self):
        return self.ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def frame(*rows):
    """Rows of ``events_of`` as a slice gets them."""
    return pd.DataFrame([(b, j, e, K._micros(t)) for b, j, e, t in rows], columns=["batch_id", "job_id", "event", "at"])


def slice_told(frames):
    return [tuple(r) for f in frames for r in f.itertuples(index=False)]


def test_a_slice_is_read_and_written_once():
    """Whatever the number of its jobs, a slice's rows take three calls: read, write, timer."""
    tracker, handle = K.SliceTracker(30_000, 3_600_000), SliceHandle()
    tracker.init(handle)
    rows = frame(*events_of(*(("b", f"j{i}", "active", i) for i in range(500))))
    told = slice_told(tracker.handleInputRows((0,), iter([rows[:200], rows[200:]]), None))
    assert len(told) == 500 and handle.calls == 3
    # later news of some: the first job due is the same, so its timer stays
    more = frame(*events_of(*(("b", f"j{i}", "completed", 20 + i) for i in range(100, 200))))
    told = slice_told(tracker.handleInputRows((0,), iter([more]), None))
    assert len(told) == 200 and handle.calls == 5


def test_a_slice_is_woken_once():
    """All that a watermark has passed in a slice is told by one timer, in one frame."""
    tracker, handle = K.SliceTracker(30_000, 3_600_000), SliceHandle()
    tracker.init(handle)
    rows = frame(*events_of(*(("b", f"j{i}", "active", i) for i in range(500))))
    list(tracker.handleInputRows((0,), iter([rows]), None))
    first = K._micros(T0) // 1000 + 30_000
    assert handle.timers == {first}
    handle.calls = 0
    told = list(tracker.handleExpiredTimer((0,), At(first + 399_000), At(first)))
    assert len(told) == 1 and [r[1:4] for r in slice_told(told)] == [(f"j{i}", "stall", "active") for i in range(400)]
    # read, write, and the timer of the first job whose silence is not over
    assert handle.calls == 3 and handle.timers == {first, first + 400_000}


@pytest.mark.parametrize("seed", range(5))
def test_slices_as_jobs(seed):
    """A slice tells of its jobs what a tracker of each tells, whatever the watermark."""
    rng = random.Random(seed)
    kinds = list(S.EVENT_STATES)
    whole, handle = K.SliceTracker(60_000, 600_000), SliceHandle()
    whole.init(handle)
    jobs = {}
    got, want, seconds, mark = [], [], 0, 0
    for _ in range(40):
        names = [(rng.choice(["b", None]), f"j{rng.randrange(12)}") for _ in range(rng.randrange(1, 15))]
        # no event is later than the watermark lets through, and some moments are shared
        rows = events_of(*((*n, rng.choice(kinds), seconds + rng.randrange(0, 200, 5)) for n in names))
        got += slice_told(whole.handleInputRows((0,), iter([frame(*rows)]), None))
        for name in set(names):
            tracker, _ = jobs.setdefault(name, (K.JobTracker(60_000, 600_000), SliceHandle()))
            jobs[name][1].timers.clear()
            tracker.init(jobs[name][1])
            some = [{"event_ts": t, "event": e} for b, j, e, t in rows if (b, j) == name]
            want += [(*r[:4], K._micros(r.at)) for r in tracker.handleInputRows(name, iter(some), None)]
        seconds += rng.randrange(0, 120)
        mark = K._micros(T0 + timedelta(seconds=seconds)) // 1000
        while due := sorted(t for t in handle.timers if t <= mark):
            got += slice_told(whole.handleExpiredTimer((0,), At(mark), At(due[0])))
            handle.timers.discard(due[0])
        for name, (tracker, _) in jobs.items():
            want += [(*r[:4], K._micros(r.at)) for r in tracker.handleExpiredTimer(name, At(mark), At(mark))]
        assert len(handle.timers) <= 1
        left = dict(zip(zip(*handle.value[:2]), zip(*handle.value[2:]))) if handle.value else {}
        kept = {name: h.value for name, (_, h) in jobs.items() if h.value is not None}
        assert {n: (*j[:5], dict(zip(*j[5:]))) for n, j in left.items()} == {
            n: (*j[:5], dict(zip(*j[5:]))) for n, j in kept.items()
        }
    order = lambda r: [str(x) for x in r]
    assert sorted(got, key=order) == sorted(want, key=order)
    assert {r[2] for r in got} == {"state", "result", "stall"}


def test_jobs_share_slices(spark, follow):
    """With two slices for all jobs a stream tells what the table has, and keeps two values."""
    _, rows = some_events(150, 25, 2)
    rows = sorted(rows, key=lambda r: r[3])
    mixed = [rows[0::2], rows[1::2], events_of(("end", "end", "waiting", 20_000))]
    table = spark.createDataFrame([r for p in mixed for r in p], SCHEMA)
    job = lambda e: K.track_jobs(e, silence_ms=60_000, keep_ms=10**9, late="2 hours", slices=2)
    out, checkpoint = follow(mixed, job)
    got = {r.job_id: (r.state, r.at) for r in out if r.kind == "state"}
    assert got == {r.job_id: (r.state, r.last_event_at) for r in S.job_states(table).collect()}
    first = {r.job_id: (r.event, r.event_ts) for r in S.finished_once(table).collect()}
    results = {r.job_id: (r.state, r.at) for r in out if r.kind == "result"}
    assert results.keys() == first.keys() and len(results) == sum(r.kind == "result" for r in out)
    stalls = {(r.job_id, r.stalled_at) for r in S.stalled_spells(table, silence="60 seconds").collect()}
    found = [(r.job_id, r.at) for r in out if r.kind == "stall"]
    assert set(found) == stalls and len(found) == len(stalls) and len(stalls) > 5
    states = spark.read.format("statestore").option("stateVarName", "standing").option("flattenCollectionTypes", "false")
    assert states.load(checkpoint).count() == 2


def test_known_jobs_share_slices(spark, follow):
    """Jobs of one slice taken over from a table: all of them are known, those without news too."""
    known = spark.createDataFrame(
        [("b", "a", "active", T0), ("b", "d", "completed", T0), ("b", "s", "active", T0), ("c", None, "waiting", T0)],
        "batch_id STRING, job_id STRING, state STRING, at TIMESTAMP",
    )
    far = 250_000_000_000  # in the year 9947, which nanoseconds do not reach
    parts = [events_of(("b", "a", "failed", 9), ("b", "d", "failed", 9)), events_of(("b", "n", "waiting", far))]
    out, _ = follow(parts, lambda e: K.track_jobs(e, known=known, slices=1))
    told = sorted((r.job_id, r.kind, r.state, r.at) for r in out)
    assert told == [
        ("a", "result", "failed", T0 + timedelta(seconds=9)), ("a", "state", "failed", T0 + timedelta(seconds=9)),
        ("d", "state", "failed", T0 + timedelta(seconds=9)), ("n", "state", "waiting", T0 + timedelta(seconds=far)),
        ("s", "stall", "active", T0 + timedelta(seconds=30)),
    ]
