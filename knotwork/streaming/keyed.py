"""Keyed state machines with timers: the merged ledger, and graph loads of which the latest wins.

Both come as a batch over a whole log and as a stream; ``transformWithState``
needs the state store ``RocksDBStateStoreProvider``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.schema_text import reconnect_delay

# --- ledger ------------------------------------------------------------------------------------------------

#: ``updates``: key, seq, ts, status (collected, failed, blocked), forced, file (null: as before).
UPDATE = ["key", "seq", "ts", "status", "forced", "file"]
FIELDS = ["seq", "ts", "status", "attempts", "file"]
ENTRY = "key string, seq long, ts timestamp, status string, attempts long, file string, decision string"
STORED = "seq long, ts timestamp, status string, attempts long, file string"
EMPTY = (-1, None, None, 0, None)


def merged(entry: tuple, update: tuple) -> tuple[tuple, str]:
    """An entry after an update, and what became of that: late, skip_blocked, skip or applied.

    Blocked outweighs forced, forced outweighs collected, and a failed source is
    tried again. An update whose number was seen before, or a lower one, is late.
    """
    seq, _, status, attempts, file = entry
    new_seq, ts, new_status, forced, new_file = update
    if new_seq <= seq:
        return entry, "late"
    if status == "blocked":
        return (new_seq, *entry[1:]), "skip_blocked"
    if new_status != "blocked" and status == "collected" and not forced:
        return (new_seq, *entry[1:]), "skip"
    tries = attempts + (new_status != "blocked")
    return (new_seq, ts, new_status, tries, new_file if new_file is not None else file), "applied"


def none_of(value):
    return None if value is None or value is pd.NaT or value != value else value


def updates_in(frame: pd.DataFrame) -> Iterator[tuple]:
    for row in frame[UPDATE].itertuples(index=False):
        key, seq, ts, status, forced, file = map(none_of, row)
        yield key, (int(seq), ts, status, bool(forced), file)


def asked(updates: DataFrame) -> DataFrame:
    return updates.where("key is not null and seq is not null").select(*UPDATE).withColumn("ts", F.col("ts").cast("timestamp"))


def ledger_batch(updates: DataFrame) -> DataFrame:
    """The ledger after all updates, in the order of ``seq``: (key, seq, ts, status, attempts, file).

    A task reads its keys' updates in order and holds one entry.
    """

    def run(frames):
        key, entry, made = None, EMPTY, []
        for frame in frames:
            for k, update in updates_in(frame):
                if k != key:
                    if key is not None:
                        made.append((key, *entry))
                    key, entry = k, EMPTY
                entry, _ = merged(entry, update)
            yield pd.DataFrame(made, columns=["key", *FIELDS])
            made = []
        if key is not None:
            yield pd.DataFrame([(key, *entry)], columns=["key", *FIELDS])

    rows = asked(updates)
    return rows.repartition("key").sortWithinPartitions("key", "seq").mapInPandas(run, f"key string, {STORED}")


class Ledger(StatefulProcessor):
    """One entry a key; a failed one sets a timer for its next try."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", STORED)

    def held(self) -> tuple:
        if not self.entry.exists():
            return EMPTY
        seq, ts, status, attempts, file = map(none_of, self.entry.get())
        return int(seq), ts, status, int(attempts), file

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (names of the interface)
        entry, out = self.held(), []
        frame = pd.concat(list(rows)).sort_values("seq")
        for _, update in updates_in(frame):
            entry, decision = merged(entry, update)
            out.append((key[0], *entry, decision))
            if decision == "applied" and entry[2] == "failed":
                self.handle.registerTimer(retry_at(entry))
        self.entry.update(entry)
        yield pd.DataFrame(out, columns=["key", *FIELDS, "decision"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        entry = self.held()
        # Only the timer of the last failure counts: a newer one has its own, anything else ended the wait.
        if entry[2] == "failed" and retry_at(entry) == expiredTimerInfo.getExpiryTimeInMs():
            yield pd.DataFrame([(key[0], *entry, "retry")], columns=["key", *FIELDS, "decision"])


def retry_at(entry: tuple) -> int:
    """When a failed source is due again, in milliseconds: its waits grow as those of reconnections do."""
    stamp = pd.Timestamp(entry[1])
    stamp = stamp.tz_localize("UTC") if stamp.tzinfo is None else stamp
    return int(stamp.timestamp() * 1000) + reconnect_delay(min(int(entry[3]), 30))


def ledger_stream(updates: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Each update with the entry after it and its decision, and a row ``retry`` once the watermark passes a failed entry's next try."""
    rows = asked(updates).withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(Ledger(), ENTRY, "Update", "EventTime")


def keep_versions(entries: DataFrame, folder: str, checkpoint: str):
    """The stream's last entry of each key and batch, as a table of versions; a batch that runs again replaces itself."""

    def add(batch: DataFrame, number: int) -> None:
        changed = batch.where("decision <> 'late'").select("key", *FIELDS)
        ledger_of(changed).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return entries.writeStream.foreachBatch(add).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ledger_of(versions: DataFrame) -> DataFrame:
    """The newest version of each key."""
    last = versions.groupBy("key").agg(F.max_by(F.struct(*FIELDS), "seq").alias("e"))
    return last.select("key", "e.*")


def read_ledger(spark, folder: str) -> DataFrame:
    return ledger_of(spark.read.parquet(folder))


def compact(spark, folder: str, target: str) -> DataFrame:
    """All versions as one table of their newest, written to ``target``; readers turn to it once it is whole."""
    read_ledger(spark, folder).write.parquet(f"{target}/batch=0")
    return read_ledger(spark, target)


# --- loads -------------------------------------------------------------------------------------------------

#: ``log``: viewer, seq, request, outcome (null: the request begins; ok, cancelled, error: its answer).
LOAD = ["viewer", "seq", "request", "outcome"]
VERDICT = "viewer string, seq long, request long, verdict string"


def load_verdicts(log: DataFrame) -> DataFrame:
    """(viewer, seq, request, verdict) of each answer: superseded if a newer request began before it, else replaced, cancelled or failed."""
    so_far = Window.partitionBy("viewer").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = F.last(F.when(F.col("outcome").isNull(), F.col("request")), ignorenulls=True).over(so_far)
    verdict = F.when(F.col("latest").isNull() | (F.col("latest") != F.col("request")), "superseded").when(F.col("outcome") == "ok", "replaced").when(F.col("outcome") == "cancelled", "cancelled").otherwise("failed")
    return log.select(*LOAD).withColumn("latest", latest).where("outcome is not null").select("viewer", "seq", "request", verdict.alias("verdict"))


def shown(verdicts: DataFrame) -> DataFrame:
    """(viewer, request): whose graph each viewer sees."""
    last = verdicts.where("verdict = 'replaced'").groupBy("viewer").agg(F.max_by("request", "seq").alias("request"))
    return last.select("viewer", "request")


class Loads(StatefulProcessor):
    """The latest request of each viewer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "request long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        latest = self.latest.get()[0] if self.latest.exists() else None
        out = []
        for row in pd.concat(list(rows)).sort_values("seq")[LOAD].itertuples(index=False):
            outcome = none_of(row.outcome)
            if outcome is None:
                latest = int(row.request)
            else:
                own = {"ok": "replaced", "cancelled": "cancelled"}.get(outcome, "failed")
                out.append((key[0], int(row.seq), int(row.request), own if latest == row.request else "superseded"))
        if latest is not None:
            self.latest.update((latest,))
        yield pd.DataFrame(out, columns=["viewer", "seq", "request", "verdict"])


def load_stream(log: DataFrame) -> DataFrame:
    return log.select(*LOAD).groupBy("viewer").transformWithStateInPandas(Loads(), VERDICT, "Append", "None")


def keep_verdicts(verdicts: DataFrame, folder: str, checkpoint: str):
    return verdicts.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
