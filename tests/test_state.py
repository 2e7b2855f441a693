"""Folds and timers: leases that lapse and are recovered, nudges that are forgotten, and keys of any size."""

import datetime as dt
import random

import pytest

from assaykit.streaming import sessions

EVENTS = "assignment long, at_ms long, action string, worker string, generation long"
START = 1_700_000_000_000


def brute_watch(events, until, ttl=sessions.LEASE_MS):
    out = []
    for key in {e[0] for e in events}:
        lease = None
        for _, at, action, worker, told in sorted((e for e in events if e[0] == key), key=lambda e: e[1:]):
            if lease and lease["status"] == "active" and lease["end"] <= at:
                lease["status"] = "stale"
                out.append((key, lease["end"], "lapse", lease["who"], "STALE", lease["gen"]))
            gen = lease["gen"] if lease else 0
            if action in ("claim", "recover"):
                if lease and lease["status"] == "active":
                    out.append((key, at, action, worker, "LEASE_LIVE", gen))
                else:
                    lease = {"gen": gen + 1, "status": "active", "end": at + ttl, "who": worker}
                    out.append((key, at, action, worker, "CLAIMED", gen + 1))
            elif not lease or lease["status"] != "active" or told != gen:
                out.append((key, at, action, worker, "STALE_FENCE", gen))
            else:
                lease["end"] = at + ttl if action == "heartbeat" else at
                lease["status"] = "active" if action == "heartbeat" else action
                out.append((key, at, action, worker, "OK", gen))
        if lease and lease["status"] == "active" and lease["end"] <= until:
            out.append((key, lease["end"], "lapse", lease["who"], "STALE", lease["gen"]))
    return sorted(out)


def random_events(n=300):
    rnd, at, rows = random.Random(7), START, []
    for _ in range(n):
        at += rnd.choice([1_000, 30_000, 90_000])
        rows.append((rnd.randrange(5), at, rnd.choice(["claim", "heartbeat", "heartbeat", "recover", "completed"]), f"w{rnd.randrange(3)}", rnd.randrange(1, 9)))
    return rows


def test_watched_leases_against_brute_force(spark):
    events = random_events()
    frame = spark.createDataFrame(events, EVENTS).repartition(4)
    assert sorted(map(tuple, sessions.watched_leases(frame).collect())) == brute_watch(events, max(e[1] for e in events))
    assert sessions.watched_leases(spark.createDataFrame([], EVENTS)).count() == 0


def test_recovery_raises_the_generation():
    lease, rows = sessions.NO_LEASE, []
    for at, action, worker, told in [(0, "claim", "a", None), (60_000, "recover", "b", None), (130_000, "heartbeat", "a", 1), (140_000, "recover", "b", None), (150_000, "completed", "a", 1), (160_000, "completed", "b", 2)]:
        lease, new = sessions.watched_event(lease, at, action, worker, told)
        rows += new
    assert [(r[1], r[3], r[4]) for r in rows] == [("claim", "CLAIMED", 1), ("recover", "LEASE_LIVE", 1), ("lapse", "STALE", 1), ("heartbeat", "STALE_FENCE", 1), ("recover", "CLAIMED", 2), ("completed", "STALE_FENCE", 2), ("completed", "OK", 2)]


def streamed(spark, tmp_path, rows, schema, stream, files):
    source = str(tmp_path / "in")
    for k in range(files):
        spark.createDataFrame(rows[k * len(rows) // files : (k + 1) * len(rows) // files], schema).coalesce(1).write.mode("append").parquet(source)
    got = []
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    sessions.run_available(stream(reader), lambda df, _: got.extend(df.collect()), str(tmp_path / "state"))
    return sorted(map(tuple, got))


def test_timers_end_leases_as_the_fold_does(spark, tmp_path):
    events = random_events(120)
    quiet = max(e[1] for e in events) + 3_600_000
    events.append((99, quiet, "claim", "w", None))  # time passes, so that all older leases lapse
    got = streamed(spark, tmp_path, events, EVENTS, lambda s: sessions.lease_stream(s, watch=True, delay="1 minute"), 4)
    assert got == brute_watch(events, quiet - 60_000)
    assert sum(r[4] == "STALE" for r in got) >= 5
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != sessions.STORE


def test_nudges_are_forgotten_after_two_weeks(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    rows = [(s, day + dt.timedelta(days=d), tokens, None) for s, d, tokens in [(1, 0, 200_000), (2, 1, 130_000), (1, 10, 205_000), (1, 20, 206_000), (2, 21, 131_000), (1, 22, 236_000), (2, 60, 1)]]
    schema = "session long, at timestamp, tokens long, handoff_at timestamp"
    want = [(1, 0, 200_000), (1, 20, 206_000), (1, 22, 236_000), (2, 1, 130_000), (2, 21, 131_000)]
    want = [(s, day + dt.timedelta(days=d), t) for s, d, t in want]
    assert sorted(map(tuple, sessions.nudges(spark.createDataFrame(rows, schema)).collect())) == want
    assert streamed(spark, tmp_path, rows, schema, sessions.nudge_stream, len(rows)) == want


@pytest.mark.parametrize("n", [200_000])
def test_a_key_of_many_events_is_folded_in_batches(spark, n):
    x = spark.range(n).selectExpr("1L AS session", "timestamp_millis(id * 1000) AS at", "id AS tokens", "CAST(NULL AS TIMESTAMP) AS handoff_at")
    assert [r.tokens for r in sessions.nudges(x).orderBy("at").collect()] == [120_000, 150_000, 180_000]


def test_a_key_calls_its_state_once_and_lists_no_timers():
    import pandas as pd

    class Held:
        value, calls = None, []

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

    class Handle:
        calls = []

        def registerTimer(self, at):
            self.calls.append(("register", at))

        def deleteTimer(self, at):
            self.calls.append(("delete", at))

    state = sessions.LeaseState(100, True)
    state.handle, state.lease = Handle(), Held()
    events = pd.DataFrame([(30, "completed", "a", None), (10, "claim", "a", None), (20, "heartbeat", "a", 1)], columns=list(sessions.LEASE_IN[1:]))
    first = pd.concat(state.handleInputRows((7,), iter([events]), None))
    assert list(first["outcome"]) == ["CLAIMED", "OK", "STALE_FENCE"] and state.handle.calls == [("register", 120)]
    rest = pd.concat(state.handleInputRows((7,), iter([events.tail(1).assign(at_ms=40), events.head(1).assign(at_ms=50)]), None))
    assert list(rest["outcome"]) == ["OK", "STALE_FENCE"] and state.handle.calls[1:] == [("delete", 120), ("register", 140)]
    assert state.lease.calls == ["get", "update"] * 2 and state.lease.value == (1, "active", 140, "a")
