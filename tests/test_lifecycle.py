"""Jobs followed as a stream: leases, retries, progress, and that batches don't matter."""

import json
import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import pandas as pd
import pytest
from loomstead.streaming import lifecycle

T0 = datetime(2024, 1, 1)
LEASE, RETRIES, BACKOFF = 60, 3, 10


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def report(job, seconds, kind, attempt=None, worker=None, progress=None, error=None, seq=0):
    return job, at(seconds), seq, kind, attempt, worker, progress, error


class Follower:
    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder
        (folder / "in").mkdir()

    def hear(self, *reports):
        self.spark.createDataFrame(list(reports), lifecycle.REPORTS).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")

    def follow(self, delay=0, **more):
        reports = self.spark.readStream.schema(lifecycle.REPORTS).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in")
        lifecycle.follow(self.spark, reports, f"{self.folder}/out", f"{self.folder}/checkpoint", LEASE, RETRIES, BACKOFF, delay, **more)

    def answers(self):
        return lifecycle.answers(self.spark, f"{self.folder}/out")

    def current(self):
        return {r["id"]: r for r in lifecycle.current(self.answers()).collect()}


@pytest.fixture
def few(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_lease_retries_and_resume(few, tmp_path):
    """The stream stops midway and goes on; a worker that was too slow can't finish, and none works on a job twice."""
    f = Follower(few, tmp_path)
    f.hear(report("a", 0, "submitted"), report("b", 0, "submitted"), report("c", 0, "submitted"), report("a", 1, "claimed", 1, "w1"), report("a", 2, "claimed", 1, "w2"), report("a", 30, "progress", 1, "w1", 40))
    f.hear(report("clock", 40, "submitted"))
    f.follow()
    now = f.current()
    assert (now["a"]["status"], now["a"]["worker"], now["a"]["progress_pct"], now["a"]["refusals"]) == ("running", "w1", 40, 1)
    micros = int((at(40) - datetime(1970, 1, 1)).total_seconds() * 1e6)
    assert {r["id"] for r in lifecycle.offered(f.answers(), micros).collect()} == {"b", "c", "clock"}
    assert [tuple(r) for r in lifecycle.held(f.answers(), "w1", micros).collect()] == [("a", 1)] and lifecycle.held(f.answers(), "w2", micros).isEmpty()
    # a's lease ends at 90, it is offered again from 100; b fails three times; c is done at once
    f.hear(report("a", 95, "claimed", 2, "w2"), report("a", 99, "finished", 1, "w1"), report("a", 101, "claimed", 2, "w2"), report("a", 102, "finished", 1, "w1"), report("a", 110, "finished", 2, "w2"))
    f.hear(*[x for k, t in ((1, 120), (2, 140), (3, 170)) for x in (report("b", t, "claimed", k, "w"), report("b", t + 1, "failed", k, "w", error=f"e{k}"))], report("c", 130, "claimed", 1, "w"), report("c", 131, "finished", 1, "w"))
    f.hear(report("clock", 500, "progress", 1, "w"))
    f.follow()
    now = f.current()
    assert {k: tuple(now[k])[1:4] for k in "abc"} == {"a": ("complete", 2, 100), "b": ("failed", 3, 0), "c": ("complete", 1, 100)}
    assert now["b"]["error_message"] == "e3"
    refused = {(r["at"] - micros) // 1_000_000 + 40: r["refused"] for r in f.answers().where("id = 'a' AND refused IS NOT NULL").collect()}
    assert refused == {2: "not offered", 95: "not due", 99: "not held", 102: "not held"}
    assert f.answers().where("id = 'a' AND status = 'complete' AND refused IS NULL").count() == 1
    told = f.answers().count()
    f.follow()
    assert f.answers().count() == told


def test_clean_stop(few, tmp_path):
    """Told to stop at once, it answers what is there."""
    f = Follower(few, tmp_path)
    f.hear(report("a", 0, "submitted"), report("a", 1, "claimed", 1, "w"), report("z", 5, "submitted"))
    f.follow(until=lambda: True)
    assert f.current()["a"]["status"] == "running"


def plain(reports, now):
    """The same rules over sorted reports, job by job."""
    out = {}
    for job in {r[0] for r in reports if r[0] and r[1]}:
        s = None
        mine = sorted({(r[1], r[2]): r for r in reports if r[0] == job and r[1] and r[1] <= now}.items())
        for t, r in [*[(k[0], v) for k, v in mine], (now, None)]:
            if s and s["status"] == "running" and s["due"] <= t:
                lose(s, s["due"])
            if r is None:
                continue
            kind, attempt, worker, progress = r[3:7]
            if kind == "submitted":
                s = s or {"status": "queued", "n": 1, "p": 0, "w": None, "due": t}
            elif s and kind == "claimed" and s["status"] == "queued" and attempt == s["n"] and worker and t >= s["due"]:
                s.update(status="running", p=0, w=worker, due=t + timedelta(seconds=LEASE))
            elif s and s["status"] == "running" and attempt == s["n"] and worker == s["w"]:
                if kind == "progress":
                    s.update(p=max(s["p"], min(99, progress or 0)), due=t + timedelta(seconds=LEASE))
                elif kind == "finished":
                    s.update(status="complete", p=100)
                elif kind == "failed":
                    lose(s, t)
        if s:
            out[job] = s["status"], s["n"], s["p"]
    return out


def lose(s, t):
    if s["n"] >= RETRIES:
        s["status"] = "failed"
    else:
        s.update(status="queued", due=t + timedelta(seconds=BACKOFF * 2 ** (s["n"] - 1)), n=s["n"] + 1, p=0, w=None)


def test_any_batches(few, tmp_path):
    """Shuffled over files within the delay, with nulls, repeats and unknown kinds: as the plain fold; one job has half of all."""
    rng = random.Random(3)
    kinds = ["submitted", "claimed", "claimed", "progress", "progress", "finished", "failed", "dance", None]
    reports = [report("hot" if rng.random() < 0.5 else f"j{rng.randrange(8)}", rng.randrange(2000), rng.choices(kinds, [2, 4, 4, 6, 6, 1, 3, 1, 1])[0], rng.choice([1, 1, 2, 2, 3, None]), rng.choice(["w1", "w1", "w1", "w2", None]), rng.choice([None, 5, 50, 150]), "e", seq) for seq in range(600)]
    reports += reports[:5] + [(None, at(5), 1, "submitted", None, None, None, None), ("j1", None, 1, "submitted", None, None, None, None)]
    rng.shuffle(reports)
    f = Follower(few, tmp_path)
    for i in range(0, len(reports), 250):
        f.hear(*reports[i : i + 250])
    f.hear(report("clock", 4000, "submitted"))
    f.follow(delay=2500)
    want = plain(reports, at(1500))
    got = {k: tuple(v)[1:4] for k, v in f.current().items() if v["status"]}
    assert got == want and len(got) > 5 and len({s for s, _, _ in got.values()}) > 1


class Store:
    """A bucket's state in memory, which counts the calls."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def getValueState(self, name, *schemas):
        return Cell(self)

    getMapState = getValueState

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.calls += 1
        self.timers.discard(ms)


class Cell:
    def __init__(self, store):
        self.store, self.value, self.map = store, None, {}

    def __getattribute__(self, name):
        if name in ("exists", "get", "update", "keys", "getValue", "updateValue", "removeKey"):
            object.__getattribute__(self, "store").calls += 1
        return object.__getattribute__(self, name)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def keys(self):
        return iter(list(self.map))

    def getValue(self, key):
        return self.map[key]

    def updateValue(self, key, value):
        self.map[key] = value

    def removeKey(self, key):
        del self.map[key]


def micros(when):
    return (when - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def heard(jobs, reports):
    lines = [json.dumps(dict(zip(("id", "at", "seq", *lifecycle.TOLD), (r[0], micros(r[1]), *r[2:]), strict=True))) for r in reports]
    list(jobs.handleInputRows((0,), iter([pd.DataFrame({"micros": [micros(r[1]) for r in reports], "report": lines})]), None))


def wake(jobs, store, seconds):
    """Answers at a watermark, if the bucket's timer is due by then."""
    ms, out = micros(at(seconds)) // 1000, []
    if due := {t for t in store.timers if t <= ms}:
        out = [tuple(r) for f in jobs.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: ms), None) for r in f.itertuples(index=False)]
        store.timers -= due
    assert len(store.timers) <= 1
    return out


def bucket(slot=60):
    store = Store()
    jobs = lifecycle._Jobs(lifecycle.Rules(LEASE, RETRIES, BACKOFF), slot)
    jobs.init(store)
    return jobs, store


def test_jobs_share_calls():
    """Hundreds of jobs take no more calls to the store than a few: those of their bucket's slot."""
    for n in (2, 500):
        jobs, store = bucket()
        heard(jobs, [report(f"j{i}", k, kind, 1, "w") for i in range(n) for k, kind in enumerate(("submitted", "claimed", "finished"))])
        given = wake(jobs, store, 50)
        assert len(given) == 3 * n and sum(r[3] == "complete" for r in given) == n and store.calls < 20


def test_bucket_as_plain_fold(monkeypatch):
    """Jobs of one bucket, in parts of few reports, over batches and watermarks amid slots: as the plain fold of each."""
    monkeypatch.setattr(lifecycle, "MOST", 7)
    rng = random.Random(5)
    kinds = ["submitted", "claimed", "claimed", "progress", "finished", "failed", "dance", None]
    reports = [report(f"j{rng.randrange(6)}", rng.randrange(900), rng.choices(kinds, [2, 5, 5, 6, 1, 3, 1, 1])[0], rng.choice([1, 1, 2, 3, None]), rng.choice(["w1", "w1", "w2", None]), rng.choice([None, 5, 150]), "e", seq) for seq in range(400)]
    jobs, store = bucket(slot=100)
    ends, given, done = [0, 130, 170, 480, 481, 1000], [], []
    for low, mark in zip(ends, ends[1:], strict=False):
        # half of what comes is ahead of the watermark
        mine = [r for r in reports if r[1] > at(low) or low == 0 and r[1] == at(0)]
        now = [r for r in mine if r[1] <= at(mark) or rng.random() < 0.5]
        reports = [r for r in reports if r not in now]
        done += now
        if now:
            heard(jobs, now)
        given += wake(jobs, store, mark)
        want = plain(done, at(mark))
        got = {}
        for r in sorted((r for r in given if r[-1] is None), key=lambda r: (r[1], -1 if r[2] is None else r[2])):
            got[r[0]] = tuple(r[3:6])
        assert got == want
    assert len(got) == 6 and len({s for s, _, _ in got.values()}) > 1
    assert not jobs.waiting.map
