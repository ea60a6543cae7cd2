"""The index queue on arbitrary state: one job a document, retry timers, dead letters, outcomes once only.

State is in the RocksDB store (`spark.sql.streaming.stateStore.providerClass`, see
`STORE`), keyed by document: a value for the open job, a list of what its attempts
failed of, and the last event that was seen, which ends with its time to live. A
retry is a timer; a restart finds it where the last batch left it.

Sinks write by batch number: a batch that runs again after a restart replaces what
it had written, so readers of the tables see each action and each outcome once.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lorewell.streaming.jobs import step, work  # noqa: F401  the worker is the same

#: The session needs this before the first stateful stream starts.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Without delays an action is to be acted upon now; `errors` are those of the job so far, for a dead letter.
ACTIONS = "doc_id long, seq long, action string, attempt int, delay_seconds long, errors array<string>"


class Jobs(StatefulProcessor):
    """start, ignored, retry, done, dead and cancelled for events (doc_id, seq, kind, error); what `step` says."""

    def __init__(self, max_attempts: int = 3, base: int = 5, keep_hours: int = 24, timers: bool = True) -> None:
        self.max_attempts, self.base, self.keep_hours, self.timers = max_attempts, base, keep_hours, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "attempt int, due long")
        self.errors = handle.getListState("errors", "error string")
        self.seen = handle.getValueState("seen", "seq long", self.keep_hours * 3_600_000 if self.timers else None)

    def _forget_timer(self, due: int | None) -> None:
        if due:
            self.handle.deleteTimer(due)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs() if self.timers else 0
        last = self.seen.get()[0] if self.seen.exists() else None
        for row in sorted(rows, key=lambda r: r.seq):
            if last is not None and row.seq <= last:  # an event that comes again
                continue
            last = row.seq
            attempt, due = self.job.get() if self.job.exists() else (0, None)
            state, action, number, delay = step((attempt, attempt > 0), row.kind, row.error, self.max_attempts, self.base)
            if action != "ignored":
                self._forget_timer(due)
            if row.kind == "failure" and action != "ignored":
                self.errors.appendValue((row.error or "",))
            told = [e[0] for e in self.errors.get()] if action in ("dead", "retry") else []
            if action == "retry":
                due = now + 1000 * delay if self.timers else None
                if due:
                    self.handle.registerTimer(due)
                self.job.update((state[0], due))
            elif action == "start":
                self.job.update((state[0], None))
            elif action != "ignored":
                self.job.clear()
                self.errors.clear()
            yield Row(doc_id=key[0], seq=row.seq, action=action, attempt=number, delay_seconds=delay, errors=told)
        if last is not None:
            self.seen.update((last,))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: N802, N803
        """The delay of a retry has passed: the job starts again, if that retry is still the document's state."""
        if self.job.exists():
            attempt, due = self.job.get()
            if due == expiredTimerInfo.getExpiryTimeInMs():
                self.job.update((attempt, None))
                yield Row(doc_id=key[0], seq=-1, action="start", attempt=attempt, delay_seconds=0, errors=[])

    def close(self) -> None:
        pass


def actions(events: DataFrame, max_attempts: int = 3, base: int = 5, keep_hours: int = 24, timers: bool = True) -> DataFrame:
    """Actions for a stream of events (doc_id, seq, kind, error); one event of a document comes once, however often it is delivered.

    Without timers, as for a replay that has an end, nothing starts again by itself
    and nothing ends by the clock.
    """
    return events.groupBy("doc_id").transformWithState(Jobs(max_attempts, base, keep_hours, timers), ACTIONS, "Append", "ProcessingTime" if timers else "None")


class Sessions(StatefulProcessor):
    """The last turns of each session; the list ends when nothing was said for its time to live."""

    def __init__(self, keep: int, ttl_minutes: int) -> None:
        self.keep, self.ttl = keep, ttl_minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", "role string, content string", self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        said = [tuple(r) for r in self.turns.get()] if self.turns.exists() else []
        said = [*said, *((r.role, r.content) for r in sorted(rows, key=lambda r: r.ts))][-self.keep :]
        self.turns.put(said)  # anew, so that the time to live begins again for all of it
        yield Row(session_id=key[0], turns=len(said), last=said[-1][1])

    def close(self) -> None:
        pass


def session_lists(messages: DataFrame, keep: int = 20, ttl_minutes: int = 60) -> DataFrame:
    """(session_id, turns, last) after every batch of (session_id, ts, role, content), by the clock of the engine; `jobs.session_turns` goes by event time."""
    return messages.groupBy("session_id").transformWithState(Sessions(keep, ttl_minutes), "session_id string, turns int, last string", "Update", "ProcessingTime")


def deliver(acts: DataFrame, path: str, dead: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Writes actions to the table `path`, and those that are dead letters, with their errors, to the table `dead`; both by batch."""

    def batch(rows: DataFrame, number: int) -> None:
        # written first, so that both tables come from the same rows
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
        stored = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/batch={number}")
        stored.where("action = 'dead'").write.mode("overwrite").parquet(f"{dead}/batch={number}")

    return acts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "0 seconds"})).start()
