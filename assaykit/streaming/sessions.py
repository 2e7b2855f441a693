"""Keyed state over time: usage nudges and worker leases, as folds over tables and as streams with timers.

Each is one step function, from a key's state and an event to the next state and what the event causes. Over a table the
events are dealt by key and sorted, and a task folds them as they come, holding one key's state, not its events. As a
stream each key's state is kept in the state store; timers of event time let a lease lapse and forget a nudge.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from assaykit.functions.shared import setting, shared_folder

#: First nudge, tokens until the next, seconds of silence after a handoff, days after which a nudge is forgotten (fixed values).
THRESHOLD, STEP, QUIET_SECONDS, FORGET_DAYS = 120_000, 30_000, 900, 14
#: Milliseconds that a lease lives without a heartbeat (fixed value).
LEASE_MS = 120_000
#: How far events of a stream may come out of order, by default.
DELAY = "10 minutes"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def folded(events: DataFrame, key: str, order: tuple[str, ...], out: str, start: Callable[[], tuple], step: Callable[[tuple, dict], tuple[tuple, list[tuple]]], end: Callable[[tuple], list[tuple]] = lambda state: []) -> DataFrame:
    """The rows (key first, then what `step` and, after a key's last event, `end` give) of an ordered fold within each key.

    The events are dealt by key and sorted by order within it, which spills, so a key's events needn't fit a task's memory.
    """
    schema = events.sparkSession.createDataFrame([], out).schema
    names, kinds = schema.names, [pa.int64() if f.dataType.typeName() == "long" else pa.string() for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, rows = None, None, []
        for batch in batches:
            for event in batch.to_pylist():
                if state is None or event[key] != now:
                    if state is not None:
                        rows += [(now, *r) for r in end(state)]
                    now, state = event[key], start()
                state, told = step(state, event)
                rows += [(now, *r) for r in told]
            yield table_of(rows)
            rows = []
        if state is not None:
            yield table_of([(now, *r) for r in end(state)])

    def table_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return events.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, out)


# Nudges

Nudge = tuple[int, int]


def nudge_event(state: Nudge, at_us: int, tokens: int | None, handoff_us: int | None, threshold: int = THRESHOLD, step: int = STEP) -> tuple[Nudge, bool]:
    """The last nudge (tokens, microseconds; 0: none) after a usage record, and whether it is a nudge itself.

    A nudge is forgotten after FORGET_DAYS; the session starts anew then.
    """
    last, when = state
    if last and at_us - when > FORGET_DAYS * 86_400_000_000:
        last = 0
    silent = handoff_us is not None and at_us - handoff_us < QUIET_SECONDS * 1_000_000
    if tokens is None or tokens < threshold or silent or (last and tokens < last + step):
        return (last, when), False
    return (tokens, at_us), True


def nudge_step(last: int, rows: pd.DataFrame, threshold: int = THRESHOLD, step: int = STEP) -> tuple[int, pd.DataFrame]:
    """The nudges that one session's records (at, tokens, handoff_at) cause, in time order, and the tokens at the last one."""
    micros = lambda t: None if pd.isna(t) else pd.Timestamp(t).value // 1000
    rows, fired = rows.sort_values(["at", "tokens"], kind="stable"), []
    state = (last, micros(rows["at"].min()) if len(rows) else 0)
    for at, tokens, handoff in zip(rows["at"], rows["tokens"], rows["handoff_at"], strict=True):
        state, is_nudge = nudge_event(state, micros(at), None if pd.isna(tokens) else int(tokens), micros(handoff), threshold, step)
        if is_nudge:
            fired.append((at, state[0]))
    return state[0], pd.DataFrame(fired, columns=["at", "tokens"])


def nudges(usage: DataFrame, threshold: int = THRESHOLD, step: int = STEP) -> DataFrame:
    """session, at, tokens of each nudge. usage: session, at, tokens, handoff_at; a null `tokens` says nothing."""

    def one(state: Nudge, e: dict) -> tuple[Nudge, list[tuple]]:
        state, fired = nudge_event(state, e["at_us"], e["tokens"], e["handoff_us"], threshold, step)
        return state, [(e["at_us"], e["tokens"])] if fired else []

    x = usage.select(F.col("session").cast("long").alias("session"), F.unix_micros("at").alias("at_us"), F.col("tokens").cast("long").alias("tokens"), F.unix_micros("handoff_at").alias("handoff_us"))
    out = folded(x, "session", ("at_us", "tokens", "handoff_us"), "session long, at_us long, tokens long", lambda: (0, 0), one)
    return out.select("session", F.timestamp_micros("at_us").alias("at"), "tokens")


class NudgeState(StatefulProcessor):
    """The last nudge of a session; a timer of event time forgets it."""

    def __init__(self, threshold: int, step: int):
        self.threshold, self.step = threshold, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "tokens long, at_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, fired = tuple(self.last.get()) if self.last.exists() else (0, 0), []
        new = pd.concat(list(rows)).sort_values(["at_us", "tokens", "handoff_us"], kind="stable")
        whole = lambda x: None if pd.isna(x) else int(x)
        for at_us, tokens, handoff_us in zip(new["at_us"], new["tokens"], new["handoff_us"], strict=True):
            state, is_nudge = nudge_event(state, int(at_us), whole(tokens), whole(handoff_us), self.threshold, self.step)
            if is_nudge:
                fired.append((key[0], pd.Timestamp(state[1], unit="us"), state[0]))
        if fired:
            self.last.update(state)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(state[1] // 1000 + FORGET_DAYS * 86_400_000 + 1)
            yield pd.DataFrame(fired, columns=["session", "at", "tokens"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def nudge_stream(usage: DataFrame, threshold: int = THRESHOLD, step: int = STEP, delay: str = DELAY) -> DataFrame:
    """Streaming form of nudges(): the same on events in order; such that are late by more than `delay` are dropped."""
    x = usage.withWatermark("at", delay).select("session", "at", F.unix_micros("at").alias("at_us"), "tokens", F.unix_micros("handoff_at").alias("handoff_us"))
    return x.groupBy("session").transformWithStateInPandas(NudgeState(threshold, step), "session long, at timestamp, tokens long", "Append", "EventTime")


# Leases

LEASE_IN = ("assignment", "at_ms", "action", "worker", "generation")
LEASE_OUT = "assignment long, at_ms long, action string, worker string, outcome string, generation long"
Lease = tuple[int, str, int, str]
NO_LEASE: Lease = (0, "none", 0, "")


def lease_event(lease: Lease, at: int, action: str, worker: str, told: int | None, ttl: int = LEASE_MS) -> tuple[Lease, str]:
    """An assignment's lease (generation, status, end in ms, holder) after an event, and the event's outcome.

    A claim or recovery succeeds unless a live lease stands (LEASE_LIVE) and raises the generation. A heartbeat or conclusion
    with another generation, or after the end, changes nothing (STALE_FENCE).
    """
    generation, status, expires, holder = lease
    if action in ("claim", "recover"):
        if status == "active" and expires > at:
            return lease, "LEASE_LIVE"
        return (generation + 1, "active", at + ttl, worker), "CLAIMED"
    if status != "active" or told != generation:
        return lease, "STALE_FENCE"
    if action == "heartbeat":
        return (generation, status, at + ttl, holder), "OK"
    return (generation, action, at, holder), "OK"


def lease_step(lease: tuple[int, str, int], rows: pd.DataFrame, ttl: int = LEASE_MS) -> tuple[tuple[int, str, int], pd.DataFrame]:
    """Outcomes of one assignment's events in time order, and its lease (generation, status, end) afterwards."""
    now, out = (*lease, ""), []
    for at, action, worker, told in rows.sort_values(["at_ms", "action"], kind="stable")[["at_ms", "action", "worker", "generation"]].itertuples(index=False):
        now, outcome = lease_event(now, at, action, worker, told, ttl)
        out.append((at, action, worker, outcome, now[0]))
    return (int(now[0]), now[1], int(now[2])), pd.DataFrame(out, columns=["at_ms", "action", "worker", "outcome", "generation"])


def lapsed(lease: Lease, now: int) -> tuple[Lease, list[tuple]]:
    """The lease, ended if its time is over by `now`, and the row that says so."""
    generation, status, expires, holder = lease
    if status != "active" or expires > now:
        return lease, []
    return (generation, "stale", expires, holder), [(expires, "lapse", holder, "STALE", generation)]


def watched_event(lease: Lease, at: int, action: str, worker: str, told: int | None, ttl: int = LEASE_MS) -> tuple[Lease, list[tuple]]:
    """As lease_event(), but a lease whose time is over has lapsed before: its heartbeats come too late."""
    lease, rows = lapsed(lease, at)
    lease, outcome = lease_event(lease, at, action, worker, told, ttl)
    return lease, [*rows, (at, action, worker, outcome, lease[0])]


def _in_order(events: DataFrame) -> DataFrame:
    return events.select(F.col("assignment").cast("long").alias("assignment"), F.col("at_ms").cast("long").alias("at_ms"), "action", "worker", F.col("generation").cast("long").alias("generation"))


def leases(events: DataFrame, ttl: int = LEASE_MS) -> DataFrame:
    """An outcome for each event: LEASE_OUT. events: assignment, at_ms, action, worker, generation."""

    def one(lease: Lease, e: dict) -> tuple[Lease, list[tuple]]:
        lease, outcome = lease_event(lease, e["at_ms"], e["action"], e["worker"], e["generation"], ttl)
        return lease, [(e["at_ms"], e["action"], e["worker"], outcome, lease[0])]

    return folded(_in_order(events), "assignment", LEASE_IN[1:], LEASE_OUT, lambda: NO_LEASE, one)


def watched_leases(events: DataFrame, until_ms: int | None = None, ttl: int = LEASE_MS) -> DataFrame:
    """As leases(), with a row of outcome STALE for each lease that lapses without a heartbeat or conclusion by `until_ms`
    (null: the last event of all); after that a claim or recovery gets a higher generation."""
    until = until_ms if until_ms is not None else events.agg(F.max("at_ms")).first()[0] or 0

    def one(lease: Lease, e: dict) -> tuple[Lease, list[tuple]]:
        return watched_event(lease, e["at_ms"], e["action"], e["worker"], e["generation"], ttl)

    return folded(_in_order(events), "assignment", LEASE_IN[1:], LEASE_OUT, lambda: NO_LEASE, one, lambda lease: lapsed(lease, until)[1])


def in_order(rows: Iterator[pd.DataFrame]) -> list[tuple]:
    """A key's events (at_ms, action, worker, generation) in order, nulls last: a frame of few rows takes longer to sort."""
    none = lambda x: None if x is None or x != x else x
    events = [tuple(map(none, e)) for part in rows for e in zip(*(part[c].tolist() for c in LEASE_IN[1:]), strict=True)]
    events.sort(key=lambda e: [(x is None, x) if x is not None else (True,) for x in e])
    return [(int(at), action, worker, None if told is None else int(told)) for at, action, worker, told in events]


class LeaseState(StatefulProcessor):
    """The lease of an assignment. If `watch`, a timer of event time ends it when no heartbeat comes.

    The state of an ended lease stays, as its generation must never come again.
    """

    def __init__(self, ttl: int, watch: bool):
        self.ttl, self.watch = ttl, watch

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "generation long, status string, expires_ms long, holder string")

    def _held(self) -> Lease:
        # one call of the state store instead of two
        held = self.lease.get()
        return NO_LEASE if held is None else tuple(held)

    def _told(self, key, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["assignment", "at_ms", "action", "worker", "outcome", "generation"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        lease, out = self._held(), []
        before = lease
        for at, action, worker, told in in_order(rows):
            if self.watch:
                lease, more = watched_event(lease, at, action, worker, told, self.ttl)
                out += more
            else:
                lease, outcome = lease_event(lease, at, action, worker, told, self.ttl)
                out.append((at, action, worker, outcome, lease[0]))
        if lease != before:
            self.lease.update(lease)
        if self.watch and lease[1:3] != before[1:3]:
            # an active lease has one timer, at its end; others have none
            if before[1] == "active":
                self.handle.deleteTimer(before[2])
            if lease[1] == "active":
                self.handle.registerTimer(lease[2])
        yield self._told(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        lease, rows = lapsed(self._held(), expiredTimerInfo.getExpiryTimeInMs())
        if rows:
            self.lease.update(lease)
            yield self._told(key, rows)

    def close(self) -> None:
        pass


def lease_stream(events: DataFrame, ttl: int = LEASE_MS, watch: bool = False, delay: str = DELAY) -> DataFrame:
    """Streaming form of leases(), or if `watch` of watched_leases(): a lease lapses once the watermark, the latest event less
    `delay`, passes its end, and events behind the watermark are dropped. Later events are judged by the state as it is, so a
    stale fence can't undo a claim."""
    if watch:
        events = events.withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", delay)
    return events.groupBy("assignment").transformWithStateInPandas(LeaseState(ttl, watch), LEASE_OUT, "Append", "EventTime" if watch else "None")


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs a stream over what its source has now, handing each batch to `write`."""
    with setting(stream.sparkSession, "spark.sql.streaming.stateStore.providerClass", STORE):
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


def streamed(stream: DataFrame) -> DataFrame:
    """The rows that a stream gives for what its source has now, as a table: a folder for each batch, so that a batch which is
    tried again replaces what it wrote."""
    folder = f"{shared_folder(stream.sparkSession).rstrip('/')}/streamed-{uuid.uuid4().hex}"
    run_available(stream, lambda df, batch: df.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}"), f"{folder}/state")
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out/batch=*")


def newest_valid(handoffs: DataFrame, now_ms: int, skew_ms: int = 900_000, tolerance_ms: int = 3_600_000) -> DataFrame:
    """folder, name, newer, older: each folder's newest handoff without a fault, with how many others there are.

    handoffs: folder, name (yyyyMMdd-HHmmssZ-xxxxxxxx-handoff.md), written_ms, faults. A name must be a real time, not
    ahead of the clock by more than the skew, and near the time written inside.
    """
    stamp = F.regexp_extract("name", "^(\\d{8}-\\d{6})Z-[A-Za-z0-9]{8}-handoff\\.md$", 1)
    x = handoffs.withColumn("stamp", stamp).where("stamp <> ''").withColumn("ms", F.unix_millis(F.try_to_timestamp("stamp", F.lit("yyyyMMdd-HHmmss"))))
    good = F.col("ms").isNotNull() & (F.col("ms") - now_ms <= skew_ms) & (F.col("written_ms").isNull() | (F.abs(F.col("written_ms") - F.col("ms")) <= tolerance_ms)) & (F.coalesce("faults", F.lit(0)) == 0)
    x = x.withColumn("good", good)
    best = x.where("good").groupBy("folder").agg(F.max("name").alias("best"))
    return x.join(best, "folder").groupBy("folder").agg(F.max("best").alias("name"), F.count_if(F.col("name") > F.col("best")).alias("newer"), F.count_if(F.col("name") < F.col("best")).alias("older"))
