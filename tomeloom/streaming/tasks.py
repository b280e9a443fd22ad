"""The life of tasks as a fold over their events: one rule, as a column expression and as a stateful stream.

events: task_id, at (timestamp), seq (long, orders events of one time), kind, stage.

| kind | effect |
|---|---|
| create | a task that isn't there waits (pending, queued) |
| claim | a waiting task that nobody wants stopped runs (running, prune) |
| stage | a running task goes on to the named stage |
| cancel | a waiting task is cancelled; any other only gets the mark |
| delete | a running task gets both marks and is deleting; any other goes |
| done, error | a running task ends so; cancelled instead if a stop was asked for; it goes if it is being deleted |
| retry | a failed or cancelled task waits again, without marks |
| recover | a restart: see :func:`ledger.recovered` |

A running task without an event for ``lease`` is recovered at that time, as after a restart. Events
that fit no rule change nothing but the time of the last event. Equal (at, seq) of a task are one
event; which of them counts is left open if they differ. A null stage is the empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

KINDS = ("create", "claim", "stage", "cancel", "delete", "done", "error", "retry", "recover")
STATE = "struct<at:long,status:string,stage:string,cancel_requested:boolean,delete_requested:boolean>"
GONE = "absent"
LEASE = timedelta(days=1)


def _state(at: Column, status: Column | str, stage: Column | str, cancel: Column, delete: Column) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(at.alias("at"), lit(status).alias("status"), lit(stage).alias("stage"), cancel.alias("cancel_requested"), delete.alias("delete_requested")).cast(STATE)


def _recovered(s: Column, at: Column) -> Column:
    """After a restart, for a state at a time."""
    no, running = F.lit(False), s["status"] == "running"
    gone = _state(at, GONE, "", no, no)
    stopped = _state(at, "cancelled", "cancelled", F.lit(True), no)
    again = _state(at, "pending", "resume", no, no)
    same = _state(at, s["status"], s["stage"], s["cancel_requested"], s["delete_requested"])
    return F.when(s["delete_requested"], gone).when(running & s["cancel_requested"], stopped).when(running, again).otherwise(same)


def _applied(s: Column, e: Column) -> Column:
    """The state after an event."""
    yes, no, kind, at = F.lit(True), F.lit(False), e["kind"], e["at"]
    status, cancel, delete = s["status"], s["cancel_requested"], s["delete_requested"]
    waiting, running, ended = status == "pending", status == "running", status.isin("done", "error", "cancelled")
    gone = _state(at, GONE, "", no, no)
    finished = F.when(delete, gone).when(cancel, _state(at, "cancelled", "cancelled", yes, no)).otherwise(_state(at, kind, kind, no, no))
    rules = [
        ((kind == "create") & (status == GONE), _state(at, "pending", "queued", no, no)),
        ((kind == "claim") & waiting & ~cancel & ~delete, _state(at, "running", "prune", no, no)),
        ((kind == "stage") & running & ~delete, _state(at, "running", F.coalesce(e["stage"], F.lit("")), cancel, delete)),
        ((kind == "cancel") & waiting, _state(at, "cancelled", "cancelled", yes, delete)),
        ((kind == "cancel") & (status != GONE), _state(at, status, s["stage"], yes, delete)),
        ((kind == "delete") & running, _state(at, "running", "deleting", yes, yes)),
        ((kind == "delete") & (status != GONE), gone),
        (kind.isin("done", "error") & running, finished),
        ((kind == "retry") & ended & (status != "done"), _state(at, "pending", "queued", no, no)),
        ((kind == "recover") & (status != GONE), _recovered(s, at)),
    ]
    out = F.when(*rules[0])
    for holds, then in rules[1:]:
        out = out.when(holds, then)
    return out.otherwise(_state(at, status, s["stage"], cancel, delete))


def _micros(events: DataFrame) -> DataFrame:
    """events with ``at`` as a number and what may be null filled in."""
    return events.select("task_id", F.unix_micros("at").alias("at"), F.col("seq").cast("long").alias("seq"), F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("stage", F.lit("")).alias("stage"))


def states(events: DataFrame, lease: timedelta = LEASE, until: Column | None = None) -> DataFrame:
    """task_id, at, status, stage and both marks of every task that is there after its events, in built-in expressions.

    until: a time (timestamp); leases that ran out by then are recovered, too. By default none beyond a task's last event.
    """
    item = F.struct("at", "seq", "kind", "stage")
    logs = _micros(events).groupBy("task_id").agg(F.array_sort(F.collect_list(item)).alias("_log"))
    once = F.filter("_log", lambda e, i: (i == 0) | (F.get(F.col("_log"), i - 1)["seq"] != e["seq"]) | (F.get(F.col("_log"), i - 1)["at"] != e["at"]))
    span, no = int(lease / timedelta(microseconds=1)), F.lit(False)

    def lapsed(s: Column, now: Column) -> Column:
        """The state with its lease recovered, if it ran out by now."""
        return F.when((s["status"] == "running") & (s["at"] + span <= now), _recovered(s, s["at"] + span)).otherwise(s).cast(STATE)

    def step(s: Column, e: Column) -> Column:
        return _applied(lapsed(s, e["at"]), e).cast(STATE)

    end = (lambda s: s) if until is None else (lambda s: lapsed(s, F.unix_micros(until)))
    folded = F.aggregate(once, _state(F.lit(None), GONE, "", no, no), step, end)
    return logs.select("task_id", folded.alias("s")).select("task_id", F.timestamp_micros("s.at").alias("at"), "s.status", "s.stage", "s.cancel_requested", "s.delete_requested").where(F.col("status") != GONE)


State = tuple[int, str, str, bool, bool]


def recovered(s: State, at: int) -> State:
    _, status, stage, cancel, delete = s
    if delete:
        return at, GONE, "", False, False
    if status == "running":
        return (at, "cancelled", "cancelled", True, False) if cancel else (at, "pending", "resume", False, False)
    return at, status, stage, cancel, delete


def applied(s: State, at: int, kind: str, name: str) -> State:
    """The same rule for the stream, where a state is a tuple."""
    _, status, stage, cancel, delete = s
    gone, same = (at, GONE, "", False, False), (at, status, stage, cancel, delete)
    if status == GONE:
        return (at, "pending", "queued", False, False) if kind == "create" else same
    match kind:
        case "claim" if status == "pending" and not (cancel or delete):
            return at, "running", "prune", False, False
        case "stage" if status == "running" and not delete:
            return at, status, name, cancel, delete
        case "cancel":
            return (at, "cancelled", "cancelled", True, delete) if status == "pending" else (at, status, stage, True, delete)
        case "delete":
            return (at, status, "deleting", True, True) if status == "running" else gone
        case "done" | "error" if status == "running":
            return gone if delete else (at, "cancelled", "cancelled", True, False) if cancel else (at, kind, kind, False, False)
        case "retry" if status in ("error", "cancelled"):
            return at, "pending", "queued", False, False
        case "recover":
            return recovered(s, at)
    return same


class TaskLife(StatefulProcessor):
    """Keeps each task's state and the events that the watermark hasn't passed.

    Events wait until the watermark has passed them and are then applied by time and number, so
    what arrives late, but within the watermark's delay, takes its place. A timer stands at each
    waiting event and at the end of a running task's lease.
    """

    def __init__(self, lease: timedelta):
        self.lease = int(lease / timedelta(microseconds=1))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "at long, status string, stage string, cancel boolean, delete boolean")
        self.waiting = handle.getMapState("waiting", "at long, seq long", "kind string, stage string")

    def _timer(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))  # the first whole millisecond that isn't before

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        for r in rows:
            self.waiting.updateValue((r.micros, r.seq), (r.kind, r.stage))
            self._timer(r.micros)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = self.state.get() if self.state.exists() else None
        state: State = tuple(held) if held is not None else (0, GONE, "", False, False)
        before = state
        for (at, seq), (kind, stage) in sorted((tuple(k), tuple(v)) for k, v in self.waiting.iterator()):
            if at <= now:
                state = applied(self._lapsed(state, at), at, kind, stage)
                self.waiting.removeKey((at, seq))
        state = self._lapsed(state, now)
        if state == before:
            return
        if state[1] == GONE:
            self.state.clear()
        else:
            self.state.update(state)
        if state[1] == "running":
            self._timer(state[0] + self.lease)
        yield Row(task_id=key[0], at=state[0], status=state[1], stage=state[2], cancel_requested=state[3], delete_requested=state[4])

    def _lapsed(self, s: State, now: int) -> State:
        return recovered(s, s[0] + self.lease) if s[1] == "running" and s[0] + self.lease <= now else s

    def close(self) -> None:
        pass


def live_states(events: DataFrame, lease: timedelta = LEASE, delay: str = "1 hour") -> DataFrame:
    """A stream of the states that tasks take on as the watermark passes their events; ``absent`` for those that go.

    The session's state store must be RocksDB (:func:`use_rocksdb`).
    """
    kind = events.schema["task_id"].dataType.simpleString()
    rows = events.select("task_id", "at", F.unix_micros("at").alias("micros"), F.col("seq").cast("long").alias("seq"), F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("stage", F.lit("")).alias("stage"))
    out = rows.withWatermark("at", delay).groupBy("task_id").transformWithState(
        statefulProcessor=TaskLife(lease),
        outputStructType=f"task_id {kind}, at long, status string, stage string, cancel_requested boolean, delete_requested boolean",
        outputMode="Update",
        timeMode="EventTime",
    )
    return out.withColumn("at", F.timestamp_micros("at"))


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def kept(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes what a stream of states brings, batch by batch; :func:`latest` reads it."""
    return stream.writeStream.outputMode("update").foreachBatch(batch_writer(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batch_writer(out: str, work: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Callable[[DataFrame, int], None]:
    """A foreachBatch body: what ``work`` makes of a batch is written under the batch's number.

    A batch that is run again, after a failure in the middle or before its commit, replaces what it
    had written, so every batch counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return write


def latest(spark: SparkSession, out: str, *keys: str) -> DataFrame:
    """The row of each key that the last batch with that key wrote; of several in it the one of the largest ``at``."""
    rows = spark.read.parquet(out)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    last = F.max_by(F.struct(*values), F.struct(F.col("batch").cast("long"), *([F.col("at")] if "at" in values else [])))
    return rows.groupBy(*keys).agg(last.alias("_r")).select(*keys, "_r.*")


def requests_once(requests: DataFrame, keys: list[str], at: str = "at", delay: str = "1 hour") -> DataFrame:
    """A stream of requests without those that repeat one of the same keys within ``delay``.

    The state of a key is dropped when the watermark has passed its first request by the delay.
    Rows that come later than the watermark allows are dropped.
    """
    return requests.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def first_requests(requests: DataFrame, keys: list[str], at: str = "at", delay: timedelta = timedelta(hours=1)) -> DataFrame:
    """The batch form: of requests of one key, each no later than ``delay`` after the one before it, the first."""
    before = F.lag(F.unix_micros(at)).over(Window.partitionBy(*keys).orderBy(at))
    gap = F.unix_micros(at) - before
    return requests.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") > int(delay / timedelta(microseconds=1)))).drop("_gap")
