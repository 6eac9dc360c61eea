"""The state of jobs from what workers report, as a stream with leases, retries and backoff.

A job is submitted, offered, claimed by one worker, reported on and finished. A claim holds for `lease` seconds after
the worker's last report; an attempt that fails or whose lease runs out is offered again after a wait that doubles with
each attempt, `retries` attempts in all. Each report is answered by a row: what the job is now, or why the report is
refused. A report names its attempt, so a worker whose lease ran out can't finish what another one works on.

- Reports wait in the state store until the watermark (`delay` seconds behind the latest) has passed them and are then
  taken in order of `at` and `seq`, so the answers don't depend on how reports are dealt over batches. Later ones are
  dropped by Spark. Of reports equal in id, at and seq one counts.
- Null ids or times can't be placed and are dropped; null or unknown kinds, attempts or workers are refused. Progress
  never falls and is 99 at most before the end; null counts as none.
- State is in RocksDB, checkpointed to the folder given; a stream that was stopped or lost executors goes on from there
  and answers each report once. Jobs are dealt over buckets by their id, and a bucket's jobs share state, timer and
  calls to the store. All reports of a bucket pass through one task, which holds its jobs and
  the reports of a slot at once: slots should be as long as that allows, as each costs calls to the store, and buckets as
  many as jobs ask for (`buckets_for`). A checkpoint keeps the slot and the buckets that it began with.
"""

from __future__ import annotations

import json
import time
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

REPORTS = "id string, at timestamp, seq long, kind string, attempt int, worker string, progress int, error string"
ANSWERS = "id string, at long, seq long, status string, attempts int, progress_pct int, worker string, due long, error_message string, refused string"
STATE = "status string, attempts int, progress_pct int, worker string, due long, error_message string"
#: What a report says, besides its id, at and seq.
TOLD = ("kind", "attempt", "worker", "progress", "error")
#: Seconds of a slot, whose reports of one bucket wait together and are in memory at once; reports of a batch held before they are put there; buckets.
SLOT, MOST, BUCKETS = 60, 4096, 256
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"

#: status, attempts, progress_pct, worker, due (queued: when it may be claimed; running: when the lease ends), error_message
Job = tuple[str, int, int, str | None, int | None, str | None]


class Rules:
    """What reports and time do to a job; times in microseconds."""

    def __init__(self, lease: float, retries: int, backoff: float):
        self.lease, self.retries, self.backoff = round(lease * 1e6), retries, round(backoff * 1e6)

    def lost(self, job: Job, at: int, error: str | None) -> Job:
        """After an attempt that came to nothing."""
        attempts, progress = job[1:3]
        if attempts >= self.retries:
            return "failed", attempts, progress, None, None, error
        return "queued", attempts + 1, 0, None, at + (self.backoff << (attempts - 1)), error

    def expired(self, job: Job | None, now: int) -> Job | None:
        """The job after its lease ran out at its `due`, if it has by now."""
        return self.lost(job, job[4], "lease expired") if job and job[0] == "running" and job[4] <= now else None

    def told(self, job: Job | None, at: int, kind: str, attempt: int, worker: str, progress: int, error: str) -> Job | str:
        """The job after a report, or why it is refused."""
        if kind == "submitted":
            return "known" if job else ("queued", 1, 0, None, at, None)
        if not job:
            return "unknown job"
        if kind == "claimed":
            if worker is None or job[0] != "queued" or attempt != job[1]:
                return "not offered"
            return "not due" if at < job[4] else ("running", attempt, 0, worker, at + self.lease, job[5])
        if kind not in ("progress", "finished", "failed"):
            return "unknown kind"
        if job[0] != "running" or (attempt, worker) != (job[1], job[3]):
            return "not held"
        if kind == "finished":
            return "complete", attempt, 100, worker, None, None
        if kind == "failed":
            return self.lost(job, at, error)
        return "running", attempt, max(job[2], min(99, progress or 0)), worker, at + self.lease, job[5]


class _Jobs(StatefulProcessor):
    """The jobs of a bucket: a call to the store costs far more than a report, so they share their calls and one timer."""

    def __init__(self, rules: Rules, slot: float):
        self.rules, self.slot = rules, round(slot * 1e6)

    def init(self, handle) -> None:
        self.handle = handle
        self.jobs = handle.getValueState("jobs", "jobs string")
        self.wake = handle.getValueState("wake", "at long, parts long")
        self.waiting = handle.getMapState("waiting", "slot long, part long", "reports string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        slots, held, first = defaultdict(list), 0, None
        at, parts = self._woken()
        for batch in rows:
            for micros, report in zip(batch["micros"].tolist(), batch["report"].tolist(), strict=True):
                slots[micros // self.slot].append(report)
                first, held = micros if first is None else min(first, micros), held + 1
                if held == MOST:
                    parts, held = self._put(slots, parts), 0
        self._wake_at(first, at, self._put(slots, parts))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Takes all reports that the watermark has passed, and what runs out between them, slot by slot."""
        now, parts = timerValues.getCurrentWatermarkInMs() * 1000, self._woken()[1]
        jobs: dict[str, Job] = json.loads(self.jobs.get()[0]) if self.jobs.exists() else {}
        slots, left, changed = defaultdict(list), None, False
        for k in self.waiting.keys():
            slots[k[0]].append(k[1])
        for slot in sorted(s for s in slots if s <= now // self.slot):
            texts = (r for part in sorted(slots[slot]) for r in self.waiting.getValue((slot, part))[0].split("\n"))
            reports = {(r["at"], r["seq"], r["id"]): r for r in map(json.loads, texts)}
            order, answers = sorted(reports), []
            due = bisect_right(order, now, key=lambda k: k[0])
            for k in order[:due]:
                (at, seq, name), job, report = k, jobs.get(k[2]), [reports[k].get(c) for c in TOLD]
                if (after := self.rules.expired(job, at)) is not None:
                    answers.append(_answer(name, job[4], None, after, None))
                    jobs[name] = job = after
                    changed = True
                after = self.rules.told(job, at, *report)
                if isinstance(after, str):
                    answers.append(_answer(name, at, seq, job, after))
                else:
                    answers.append(_answer(name, at, seq, after, None))
                    jobs[name], changed = after, True
            yield from _frame(answers)
            if due:
                for part in slots[slot]:
                    self.waiting.removeKey((slot, part))
                parts = self._put({slot: [json.dumps(reports[k]) for k in order[due:]]}, parts)
            if due < len(order):
                left = order[due][0]
        ended = [(name, job[4], after) for name, job in jobs.items() if (after := self.rules.expired(job, now)) is not None]
        for name, _, after in ended:
            jobs[name], changed = after, True
        yield from _frame([_answer(name, at, None, after, None) for name, at, after in ended])
        if changed:
            self.jobs.update((json.dumps(jobs),))
        # a slot that hasn't begun wakes the bucket at its beginning
        ends = [job[4] for job in jobs.values() if job[0] == "running"]
        ahead = [left] if left is not None else sorted(s * self.slot for s in slots if s > now // self.slot)[:1]
        self._wake_at(min(ahead + ends, default=None), None, parts)

    def _woken(self) -> tuple[int | None, int]:
        """When the bucket's timer is set for, in milliseconds, and how many parts were put."""
        return tuple(self.wake.get()) if self.wake.exists() else (None, 0)

    def _put(self, slots: dict[int, list[str]], parts: int) -> int:
        """Adds reports to what waits in their slots, as further parts, so none is read or written again; gives the parts so far."""
        for slot, reports in slots.items():
            for i in range(0, len(reports), MOST):
                self.waiting.updateValue((slot, parts), ("\n".join(reports[i : i + MOST]),))
                parts += 1
        slots.clear()
        return parts

    def _wake_at(self, micros: int | None, set_to: int | None, parts: int) -> None:
        """One timer a bucket: for the first of what waits. set_to: what it is set for until now."""
        ms = None if micros is None else -(-micros // 1000)
        if ms is not None and (set_to is None or ms < set_to):
            if set_to is not None:
                self.handle.deleteTimer(set_to)
            self.handle.registerTimer(ms)
            set_to = ms
        self.wake.update((set_to, parts))

    def close(self) -> None:
        pass


def _answer(name: str, at: int, seq: int | None, job: Job | None, refused: str | None) -> tuple:
    """A row of ANSWERS."""
    return name, at, seq, *(job or (None,) * 6), refused


def _frame(answers: list[tuple]) -> Iterator[pd.DataFrame]:
    """Answers as a frame, if there are any; objects, as numbers may be null."""
    if answers:
        yield pd.DataFrame(answers, columns=[c.split()[0] for c in ANSWERS.split(", ")], dtype=object)


def buckets_for(reports: int) -> int:
    """Buckets for a stream of that many reports: some 4096 in each, 256 buckets at least."""
    return max(BUCKETS, reports >> 12)


def answered(reports: DataFrame, lease: float, retries: int, backoff: float, delay: float, slot: float = SLOT, buckets: int = BUCKETS) -> DataFrame:
    """The stream of answers (ANSWERS, times in microseconds) to a stream of REPORTS; slot is in seconds, as the rest."""
    placed = reports.where("id IS NOT NULL AND at IS NOT NULL").withColumns({"micros": F.unix_micros("at"), "seq": F.coalesce("seq", F.lit(0).cast("long"))})
    # a report goes to Python and to the store as a line of JSON, which is read when its turn comes
    line = F.to_json(F.struct(F.col("micros").alias("at"), "seq", "id", *TOLD))
    dealt = placed.select("at", "micros", F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket"), line.alias("report"))
    timed = dealt.withWatermark("at", f"{round(delay * 1000)} milliseconds")
    return timed.groupBy("bucket").transformWithStateInPandas(_Jobs(Rules(lease, retries, backoff), slot), ANSWERS, "Append", "EventTime")


def follow(spark: SparkSession, reports: DataFrame, folder: str, checkpoint: str, lease: float = 60, retries: int = 3, backoff: float = 10, delay: float = 0, slot: float = SLOT, buckets: int = BUCKETS, until: Callable[[], bool] | None = None, every: float = 1) -> None:
    """Answer a stream of reports into a Parquet folder: all there are, or, given `until`, what comes until it says so.

    It ends after the batch at work, with all reports answered that were there when it was told to.
    """
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        writer = answered(reports, lease, retries, backoff, delay, slot, buckets).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
        stream = (writer.trigger(processingTime=f"{every} seconds") if until else writer.trigger(availableNow=True)).start()
    finally:
        spark.conf.set(_PROVIDER, before)
    while until and stream.isActive and not until():
        time.sleep(every)
    if until and stream.isActive:
        stream.processAllAvailable()
        stream.stop()
    stream.awaitTermination()


def answers(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(ANSWERS).parquet(folder)


def current(given: DataFrame) -> DataFrame:
    """The jobs as their last answers leave them (id and STATE), how often they changed and how many reports were refused.

    A lease's end, which has no seq, comes before a report of the same time.
    """
    change = F.col("refused").isNull()
    last = F.max(F.when(change, F.struct("at", F.coalesce("seq", F.lit(-(2**63))).alias("_s"), "status", "attempts", "progress_pct", "worker", "due", "error_message"))).alias("l")
    counts = [F.count(F.when(c, 1)).alias(n) for n, c in (("changes", change), ("refusals", ~change))]
    return given.groupBy("id").agg(last, *counts).select("id", "l.*", "changes", "refusals").drop("at", "_s")


def offered(given: DataFrame, now: int) -> DataFrame:
    """id and attempt of jobs that may be claimed now (microseconds)."""
    return current(given).where((F.col("status") == "queued") & (F.col("due") <= now)).select("id", F.col("attempts").alias("attempt"))


def held(given: DataFrame, worker: str, now: int) -> DataFrame:
    """id and attempt of jobs whose claim by this worker was granted and still holds: only these may be worked on."""
    mine = (F.col("status") == "running") & (F.col("worker") == worker) & (F.col("due") > now)
    return current(given).where(mine).select("id", F.col("attempts").alias("attempt"))
