"""A work queue's leases as a stateful stream: timers end them, and an item out of attempts becomes a dead letter.

The state of an item follows the rules of ``queues.queue_state``; here it is kept in the state store, so that a stream need not
read its whole log again. Needs RocksDB as the state store's provider (``STORE``).
"""

from __future__ import annotations

import contextlib
import datetime
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weftline.streaming.queues import ATTEMPTS, LEASE_MINUTES

#: Setting under which the state of timers can be kept.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
CHANGES = "id long, seq long, at timestamp, attempts long, status string, dead boolean"
_NEVER = -1
_EPOCH = datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)


class LeaseProcessor(StatefulProcessor):
    """Log rows of an item (micros, what: claim, done, error, any other) to a row for each change of its state.

    Rows may come in any order within a batch and from batch to batch: what counts are the number of claims, whether any row
    says done, and the latest claim and error. A claim sets a timer for the end of its lease.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("item", "attempts long, done boolean, claimed long, failed long, seq long, status string")

    def _status(self, attempts: int, done: bool, claimed: int, failed: int, now: int) -> str:
        if done:
            return "done"
        if claimed != _NEVER and claimed + LEASE_MINUTES * 60_000_000 > now and failed < claimed:
            return "claimed"
        return "failed" if attempts >= ATTEMPTS else "pending"

    def _told(self, key, state: tuple, at: int) -> Iterator[Row]:
        attempts, done, claimed, failed, seq, before = state
        status = self._status(attempts, done, claimed, failed, at)
        self.state.update((attempts, done, claimed, failed, seq + 1, status))
        yield Row(id=key[0], seq=seq + 1, at=_EPOCH + datetime.timedelta(microseconds=at), attempts=attempts, status=status, dead=status == "failed")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        found = self.state.get()
        attempts, done, claimed, failed, seq, status = found if found is not None else (0, False, _NEVER, _NEVER, 0, "")
        latest, before = max(claimed, failed), claimed
        for row in rows:
            ts, what = _NEVER if row["micros"] is None else row["micros"], row["what"]
            latest = max(latest, ts)
            if what == "claim":
                attempts, claimed = attempts + 1, max(claimed, ts)
            elif what == "done":
                done = True
            elif what == "error":
                failed = max(failed, ts)
        if claimed != before:
            if before != _NEVER:
                self.handle.deleteTimer(self._ends(before))
            self.handle.registerTimer(self._ends(claimed))
        yield from self._told(key, (attempts, done, claimed, failed, seq, status), latest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        attempts, done, claimed, failed, seq, before = self.state.get()
        now = claimed + LEASE_MINUTES * 60_000_000
        if self._status(attempts, done, claimed, failed, now) != before:
            yield from self._told(key, (attempts, done, claimed, failed, seq, before), now)

    @staticmethod
    def _ends(claimed: int) -> int:
        """Milliseconds, as timers have them: the first whole one at which the lease is over."""
        return -(-(claimed + LEASE_MINUTES * 60_000_000) // 1000)

    def close(self) -> None:
        pass


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The setting that timers need, while streams of this kind are started and run."""
    key, value = STORE
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def lease_changes(log: DataFrame, late: str = "0 seconds") -> DataFrame:
    """A streaming log (id, ts, what) to the changes of its items; the state as of the watermark is each item's last one.

    ``late`` is how long after the latest row another may come and still end or prolong a lease in time; later ones are dropped.
    """
    timed = log.select("id", "ts", "what", F.unix_micros("ts").alias("micros")).withWatermark("ts", late)
    # By rows: an item has few, for which a data frame of each item would be most of the work.
    return timed.groupBy("id").transformWithState(LeaseProcessor(), CHANGES, "append", "EventTime")


def dead_letters(changes: DataFrame) -> DataFrame:
    """Items whose last change left them without attempts."""
    return last_changes(changes).where("dead")


def last_changes(changes: DataFrame) -> DataFrame:
    """The last change of each item, from a sink's table; repeated deliveries of one change are one."""
    last = Window.partitionBy("id").orderBy(F.desc("seq"))
    return changes.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")
