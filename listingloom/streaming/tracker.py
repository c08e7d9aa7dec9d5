"""Jobs followed one by one with event-time timers and state that ends.

``job_events`` as in :mod:`listingloom.streaming.jobs`. State is kept per job: where it
stands, the events that may still turn out to be its last for a while, and, once it has
ended, when. An hour after its end (or as long as is asked for) a timer drops all of it.
The jobs are dealt out over slices, and a slice is what is read, written and woken.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from listingloom.streaming.jobs import EVENT_STATES, TERMINAL

TRACKED = "batch_id STRING, job_id STRING, kind STRING, state STRING, at LONG"
# moment and number of the deciding event, moment of the last, moment and number of the first
# that ended the job, and, for the events before it whose silence is not over, their moments
# and the numbers that decide there
STANDING = (
    "at LONG, event INT, last_at LONG, ended_at LONG, ended INT, open_at ARRAY<LONG>, open_event ARRAY<INT>"
)
_STATES = list(EVENT_STATES.values())
_NUMBERS = {event: no for no, event in enumerate(EVENT_STATES)}
_TERMINAL = {_NUMBERS[event] for event in TERMINAL}
_EPOCH = datetime(1970, 1, 1)


def _micros(at: datetime) -> int:
    if at.tzinfo:
        at = at.astimezone(timezone.utc).replace(tzinfo=None)
    return (at - _EPOCH) // timedelta(microseconds=1)


def _moment(micros: int) -> datetime:
    return _EPOCH.replace(tzinfo=timezone.utc) + timedelta(microseconds=micros)


def _row(key: tuple, kind: str, state: str, at: datetime) -> Row:
    return Row(batch_id=key[0], job_id=key[1], kind=kind, state=state, at=at)


class JobTracker(StatefulProcessor):
    """Per job: its state whenever that changes, once its result, and its stalls.

    A job stalls when it was active and nothing was heard for ``silence``; it is told when
    the watermark has passed that moment, so every event before it is known, in whatever
    order events came. News of a job that has ended changes nothing.
    """

    def __init__(self, silence_ms: int, keep_ms: int) -> None:
        self.silence, self.keep = silence_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # all of it is one value, read once and written once for a job's rows: every call to
        # the state leaves the Python worker
        self.job = handle.getValueState("standing", STANDING)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        """Take a job over from a table of jobs: ``state`` and ``at``, where it stands."""
        self._take(None, [_standing_of(initialState)])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.job.get()
        news = sorted((_micros(row["event_ts"]), _NUMBERS[row["event"]]) for row in rows)
        for kind, state, at in self._told(before, self._take(before, news)):
            yield _row(key, kind, state, _moment(at))

    def _take(self, before: tuple | None, news: list[tuple[int, int]]) -> tuple:
        """Take events in their order, keep what they make of the job, and set its timers."""
        after = self._follow(before, news)
        due = {-(-at // 1000) + self.silence for at, _ in news}
        if after[3] is not None and (before is None or after[3] != before[3]):
            due.add(after[3] // 1000 + self.keep)
        for moment in due:
            self.handle.registerTimer(moment)
        self.job.update(after)
        return after

    def _follow(self, job: tuple | None, news: list[tuple[int, int]]) -> tuple:
        """What events, in their order, make of a job."""
        at_now, now, last_at, ended_at, ended, open_at, open_event = job or (-1, -1, None, None, None, (), ())
        silent = dict(zip(open_at, open_event))
        for at, event in news:
            terminal = event in _TERMINAL
            if now < 0 or (terminal, at, event) > (ended_at is not None, at_now, now):
                at_now, now = at, event
            # the job's first end by event time counts; nothing after it matters for long
            if terminal and (ended_at is None or (at, event) < (ended_at, ended)):
                ended_at, ended = at, event
            last_at = at if last_at is None else max(last_at, at)
            silent[at] = max(event, silent.get(at, event))
        if ended_at is not None:
            # what is heard from the end on is no stall, nor does it keep one from being told:
            # any silence it breaks has the end in it
            silent = {at: event for at, event in silent.items() if at < ended_at}
        return at_now, now, last_at, ended_at, ended, list(silent), list(silent.values())

    def _told(self, before: tuple | None, after: tuple) -> Iterator[tuple[str, str, int]]:
        """``kind``, ``state`` and moment of what is new of a job."""
        if before is None or _shown(before) != _shown(after):
            yield "state", *_shown(after)
        if after[3] is not None and (before is None or before[3] is None):
            yield "result", _STATES[after[4]], after[3]

    def _passed(self, job: tuple, now: int) -> tuple[list[int], tuple | None]:
        """The ends of a job's silences that ``now`` (ms) has passed, and what is left of it."""
        ended_at, silent = job[3], sorted(zip(job[5], job[6]))
        stalls, gone = [], 0
        for no, (at, event) in enumerate(silent, start=1):
            until = at + self.silence * 1000
            if until > now * 1000:
                break
            gone = no
            heard = no < len(silent) and silent[no][0] < until
            ended = ended_at is not None and ended_at <= until
            if not heard and not ended and _STATES[event] == "active":
                stalls.append(until)
        if ended_at is not None and now >= ended_at // 1000 + self.keep:
            return stalls, None
        if gone:
            job = (*job[:5], [at for at, _ in silent[gone:]], [event for _, event in silent[gone:]])
        return stalls, job

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # all that the watermark has passed is told at once; the job's other timers that are
        # due find nothing left
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        before = self.job.get()
        if before is None:
            return
        stalls, after = self._passed(before, now)
        for until in stalls:
            yield _row(key, "stall", "active", _moment(until))
        if after is None:
            self.job.clear()
        elif after is not before:
            self.job.update(after)


class SliceTracker(JobTracker):
    """The jobs of a slice, each followed as by :class:`JobTracker`, in pandas.

    A group costs far more than a job's rows: its key, its calls to the state and the Arrow
    batch of what it tells. So the group is a slice of the jobs. Their states are one value of
    arrays, read once and written once for the rows of all of them, and they have one timer,
    for the job that is due first.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = (field.split() for field in f"batch_id STRING, job_id STRING, {STANDING}".split(", "))
        self.jobs = handle.getValueState("standing", ", ".join(f"{name} ARRAY<{kind}>" for name, kind in fields))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        jobs = {}
        for known in initialState["jobs"]:
            for job in known:
                jobs[job["batch_id"], job["job_id"]] = self._follow(None, [(job["at"], _NUMBERS[job["state"]])])
        self.handle.registerTimer(self._keep(jobs))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        news = defaultdict(list)
        for some in rows:
            for batch_id, job_id, event, at in zip(*(some[c].tolist() for c in ("batch_id", "job_id", "event", "at"))):
                news[batch_id, job_id].append((int(at), _NUMBERS[event]))
        jobs = self._jobs()
        due = self._first_due(jobs)
        told = []
        for name, of_job in news.items():
            before = jobs.get(name)
            after = jobs[name] = self._follow(before, sorted(of_job))
            told += [(*name, *new) for new in self._told(before, after)]
        first = self._keep(jobs)
        if due is not None and due != first:
            self.handle.deleteTimer(due)
        if first is not None and due != first:
            self.handle.registerTimer(first)
        yield from _frame(told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        jobs = self._jobs()
        due = [name for name, job in jobs.items() if (moment := self._due(job)) is not None and moment <= now]
        if not due:
            return
        told = []
        for name in due:
            stalls, job = self._passed(jobs.pop(name), now)
            told += [(*name, "stall", "active", until) for until in stalls]
            if job is not None:
                jobs[name] = job
        # the timer that fired is dropped by the caller
        if (first := self._keep(jobs)) is not None:
            self.handle.registerTimer(first)
        yield from _frame(told)

    def _jobs(self) -> dict[tuple, tuple]:
        return {job[:2]: job[2:] for job in zip(*(self.jobs.get() or ()))}

    def _keep(self, jobs: dict[tuple, tuple]) -> int | None:
        """Write the jobs down; when the first of them is due."""
        if jobs:
            self.jobs.update(tuple(map(list, zip(*((*name, *job) for name, job in jobs.items())))))
        else:
            self.jobs.clear()
        return self._first_due(jobs)

    def _due(self, job: tuple) -> int | None:
        """When the first silence of a job is over, or it is to be forgotten (ms)."""
        due = [-(-min(job[5]) // 1000) + self.silence] if job[5] else []
        if job[3] is not None:
            due.append(job[3] // 1000 + self.keep)
        return min(due, default=None)

    def _first_due(self, jobs: dict[tuple, tuple]) -> int | None:
        return min((due for job in jobs.values() if (due := self._due(job)) is not None), default=None)


def _frame(told: list[tuple]) -> Iterator[pd.DataFrame]:
    if told:
        yield pd.DataFrame(told, columns=["batch_id", "job_id", "kind", "state", "at"])


def _shown(job: tuple) -> tuple[str, int]:
    return _STATES[job[1]], job[2]


def _standing_of(row: Row) -> tuple[int, int]:
    """Moment and number of the event that left a job of a table in its ``state``."""
    return _micros(row["at"]), _NUMBERS[row["state"]]


def track_jobs(
    events: DataFrame, silence_ms: int = 30_000, keep_ms: int = 3_600_000,
    late: str = "10 minutes", known: DataFrame | None = None, slices: int = 4096,
) -> DataFrame:
    """``batch_id, job_id, kind, state, at`` from a stream of job events (update mode).

    ``kind`` is ``state`` with a job's state and its last event, ``result`` once for a job
    that ends, or ``stall`` with the moment its silence was over. ``known`` takes jobs over
    from a table ``batch_id, job_id, state, at``. Events later than ``late`` are dropped; a
    job is forgotten ``keep_ms`` after its end, so repeats of its events within ``late``
    are still known if that is longer. Jobs are dealt out over ``slices`` by their hash, a
    number that stays with a stream's checkpoint: a slice is read and written as a whole, so
    more of them suit a stream in which many more jobs are known than are heard of at a time.
    """
    keys = ["batch_id", "job_id"]
    part = F.pmod(F.xxhash64(*keys), F.lit(slices)).cast("int").alias("part")
    initial = None
    if known is not None:
        job = F.struct(*keys, "state", F.unix_micros("at").alias("at"))
        initial = known.groupBy(part).agg(F.collect_list(job).alias("jobs")).groupBy("part")
    # the stream's time is a moment that pandas can hold, whatever the event's own is
    ts, (first, last) = F.col("event_ts"), (F.lit(year).cast("timestamp") for year in ("1678", "2262"))
    held = F.when(ts < first, first).when(ts > last, last).otherwise(ts).alias("event_ts")
    kept = events.select(part, *keys, "event", F.unix_micros(ts).alias("at"), held)
    told = kept.withWatermark("event_ts", late).groupBy("part").transformWithStateInPandas(
        SliceTracker(silence_ms, keep_ms), TRACKED, "Update", "EventTime", initial
    )
    return told.withColumn("at", F.timestamp_micros("at"))


def result_payload_events(events: DataFrame, results: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Ends of runs with what the runs left: terminal events joined with results.

    ``results``: ``batch_id, job_id, result_ts`` and what else a result has; ``result_ts`` is
    the moment of the event it belongs to. As streams (append mode) an end comes out with
    its result as soon as both are there, in whatever order; an end whose result has not
    come when the watermark is past it comes out without one. State on either side ends
    with the watermark.
    """
    if events.isStreaming:
        events, results = events.withWatermark("event_ts", late), results.withWatermark("result_ts", late)
    # told by the moment, so that the test is not moved before the watermark: every event,
    # whatever it is, is to move the watermark
    moment = F.when(F.col("event").isin(TERMINAL), F.col("event_ts"))
    ended = events.where(moment.isNotNull()).alias("e")
    found = results.alias("r")
    same = (
        (F.col("e.batch_id") == F.col("r.batch_id"))
        & (F.col("e.job_id") == F.col("r.job_id"))
        & (F.col("e.event_ts") == F.col("r.result_ts"))
    )
    others = [c for c in results.columns if c not in ("batch_id", "job_id", "result_ts")]
    return ended.join(found, same, "left").select(
        "e.*", *(F.col(f"r.{c}").alias(c) for c in others), F.col("r.job_id").isNotNull().alias("has_result")
    )


def completions(events: DataFrame, totals: DataFrame) -> DataFrame:
    """``batch_id, completed, total`` of every batch once, when the last of its jobs ends.

    A batch's count moves only with a job's first end, and each of its values comes out
    once, so the total comes out once, whatever else is heard of the batch. Counts are
    combined before they meet.
    """
    ended = events.where(F.col("event").isin(TERMINAL)).dropDuplicates(["batch_id", "job_id"])
    counts = ended.groupBy("batch_id").agg(F.count(F.lit(1)).alias("completed"))
    return counts.join(totals, "batch_id").where("completed = total").select("batch_id", "completed", "total")
