"""Streams that remember something of each key, by state and timers: transitions, verdicts on enqueueing, due messages, silence.

Each is one stateful operator. Keys are dealt out to `GROUPS` groups, as a call
for each key would cost more than its work: of a group the state is one text,
with a short list for each key, and one timer, the earliest of its keys'. Both
are in the checkpoint, so that a restarted stream goes on where it was; it can
not go on from a checkpoint with another number of groups. They need a state
store with timers; `keyed` chooses it for streams that are started from then on.

Of one key, the rows of a micro-batch are taken in the order of their time
(of equal times, of their content). A group's rows of a micro-batch, and its
keys, are held together: a task holds one of `GROUPS` parts of them at a time.
Inside, instants are microseconds.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from queuelens.operators.lifecycle import channels

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups that keys are dealt out to.
GROUPS = 4096


class _Keys(StatefulProcessor):
    """The keys of a group. What is remembered of a key is a list in `known`; a key that is not in it is a new one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", "known string, timer long")

    def seen(self, id: str, rows: list[Row], known: dict[str, list], now: int) -> Iterator[Row]:
        """Results of the rows of one key; `now` is the watermark in milliseconds."""
        raise NotImplementedError

    def timer(self, last: list) -> int | None:
        """When, in milliseconds, `expired` is to be called for a key."""
        return None

    def expired(self, id: str, known: dict[str, list]) -> Iterator[Row]:
        raise NotImplementedError

    def _load(self) -> tuple[dict[str, list], int | None]:
        known, timer = self.held.get() if self.held.exists() else ("{}", None)
        return json.loads(known), timer

    def _store(self, known: dict[str, list], old: int | None) -> None:
        new = min((t for t in map(self.timer, known.values()) if t is not None), default=None)
        if old is not None and old != new:
            self.handle.deleteTimer(old)
        if new is not None and old != new:
            self.handle.registerTimer(new)
        self.held.update((json.dumps(known, ensure_ascii=False, separators=(",", ":")), new))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        known, timer = self._load()
        of: dict[str, list[Row]] = {}
        for row in rows:
            of.setdefault(row["id"], []).append(row)
        for id, own in of.items():
            yield from self.seen(id, own, known, timerValues.getCurrentWatermarkInMs())
        self._store(known, timer)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        known, _ = self._load()
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        for id in [i for i, last in known.items() if (t := self.timer(last)) is not None and t <= now]:
            yield from self.expired(id, known)
        self._store(known, None)

    def close(self) -> None:
        pass


def keyed(df: DataFrame, processor: _Keys, schema: str, time_mode: str = "none") -> DataFrame:
    """`df` by its column `id` through a processor, in append mode."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return df.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(GROUPS))).groupBy("group").transformWithState(processor, schema, "append", time_mode)


def _instants(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.timestamp_micros(column))


class _Transitions(_Keys):
    """Of a key: its state, and since when."""

    def seen(self, id, rows, known, now) -> Iterator[Row]:
        status, at = known.get(id, (None, None))
        for row in sorted(rows, key=lambda r: (r["at"], r["status"])):
            if at is not None and row["at"] < at:
                continue
            if row["status"] != status:
                yield Row(id=id, was=status, status=row["status"], queue_name=row["queue_name"], at=row["at"])
            status, at = row["status"], row["at"]
        known[id] = [status, at]


def transitions(rows: DataFrame, key: str = "id", time: str = "updated_at") -> DataFrame:
    """(id, was, status, queue_name, at): each change of state in a stream of rows as they are after their updates.

    The first row of a key has no state before it. Rows without a change, and
    rows older than the last one seen, give none.
    """
    queue = F.col("queue_name") if "queue_name" in rows.columns else F.lit(None).cast("string")
    seen = rows.filter(F.col(key).isNotNull() & F.col(time).isNotNull() & F.col("status").isNotNull()).select(F.col(key).cast("string").alias("id"), "status", queue.alias("queue_name"), F.unix_micros(time).alias("at"))
    return _instants(keyed(seen, _Transitions(), "id string, was string, status string, queue_name string, at long"), "at")


def messages(changes: DataFrame, kind: str) -> DataFrame:
    """(channel, payload, was, status, at) of `transitions` of tasks ("task"), workflows ("workflow") or workers ("worker")."""
    told = F.explode(F.array_compact(channels(kind, F.col("was"), F.col("status"), F.col("queue_name"))))
    return changes.select(told.alias("channel"), F.col("id").alias("payload"), "was", "status", "at")


class _Enqueued(_Keys):
    """Of a key: the hash that it was first sent with."""

    def seen(self, id, rows, known, now) -> Iterator[Row]:
        for row in sorted(rows, key=lambda r: (r["at"], r["enqueue_sha"])):
            (sha,) = known.get(id, (None,))
            yield Row(id=id, enqueue_sha=row["enqueue_sha"], at=row["at"], verdict="new" if sha is None else "same" if sha == row["enqueue_sha"] else "mismatch")
            known.setdefault(id, [row["enqueue_sha"]])


def enqueued(incoming: DataFrame, time: str = "sent_at") -> DataFrame:
    """(id, enqueue_sha, at, verdict) of a stream of tasks that are sent: new, same (sent again), or mismatch (other content under a known id)."""
    seen = incoming.filter(F.col("id").isNotNull() & F.col("enqueue_sha").isNotNull() & F.col(time).isNotNull()).select(F.col("id").cast("string").alias("id"), "enqueue_sha", F.unix_micros(time).alias("at"))
    return _instants(keyed(seen, _Enqueued(), "id string, enqueue_sha string, at long, verdict string"), "at")


class _Due(_Keys):
    """Of a key: its queue, when its message is due (null if none waits), and since when."""

    def seen(self, id, rows, known, now) -> Iterator[Row]:
        row = max(rows, key=lambda r: (r["at"], r["status"]))
        if id in known and row["at"] < known[id][2]:
            return
        due = row["due"] if row["status"] == "PENDING" else None
        known[id] = [row["queue_name"], due, row["at"]]
        if due is not None and due // 1000 <= now:
            yield from self.expired(id, known)

    def timer(self, last) -> int | None:
        return None if last[1] is None else last[1] // 1000

    def expired(self, id, known) -> Iterator[Row]:
        queue_name, due, at = known[id]
        known[id] = [queue_name, None, at]
        yield Row(channel=f"task_queue_{queue_name}", payload=id, deliver_at=due)


def due_messages(tasks: DataFrame, time: str = "updated_at", delay: str = "0 seconds") -> DataFrame:
    """(channel, payload, deliver_at): what tasks that wait for a retry send to their queue, once the stream's time has reached it.

    Each row is a task after an update; a later one moves or cancels its message.
    """
    seen = tasks.filter(F.col("id").isNotNull()).withWatermark(time, delay).filter(F.col(time).isNotNull()).select(F.col("id").cast("string").alias("id"), "status", "queue_name", F.unix_micros("next_retry_at").alias("due"), F.unix_micros(time).alias("at"))
    return _instants(keyed(seen, _Due(), "channel string, payload string, deliver_at long", "eventTime"), "deliver_at")


class _Alive(_Keys):
    """Of a key that is not silent: when it was last heard of, and its timer."""

    def __init__(self, timeout: int) -> None:
        self.timeout = timeout

    def seen(self, id, rows, known, now) -> Iterator[Row]:
        newest, new = max(r["sent_at"] for r in rows), id not in known
        if new or newest > known[id][0]:
            known[id] = [newest, max(newest // 1000 + self.timeout * 1000, now + 1)]
        if new:
            yield Row(task_id=id, last_seen=newest, alive=True)

    def timer(self, last) -> int | None:
        return last[1]

    def expired(self, id, known) -> Iterator[Row]:
        last, _ = known.pop(id)
        yield Row(task_id=id, last_seen=last, alive=False)


def liveness(heartbeats: DataFrame, timeout: int = 300, delay: str = "10 minutes") -> DataFrame:
    """(task_id, last_seen, alive): a row when a task is heard of for the first time, or again after silence, and one when it falls silent."""
    seen = heartbeats.filter(F.col("task_id").isNotNull()).select("task_id", "sent_at").withWatermark("sent_at", delay).filter(F.col("sent_at").isNotNull()).select(F.col("task_id").cast("string").alias("id"), F.unix_micros("sent_at").alias("sent_at"))
    return _instants(keyed(seen, _Alive(timeout), "task_id string, last_seen long, alive boolean", "eventTime"), "last_seen")
