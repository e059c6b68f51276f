"""The push hub's retained state: as a batch over the log, and as a stateful stream."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ROUTES = {"graph": ["graph.show", "graph.refresh"], "highlight": ["highlight.set", "highlight.clear"]}
#: Which message types put an end to a retained one.
ENDS = {"graph.show": ["graph.refresh"], "highlight.set": ["highlight.clear", "graph.refresh"]}
STATE = "channel string, type string, seq long, ts timestamp, payload string"


def valid(messages: DataFrame, route: str, most_chars: int) -> DataFrame:
    """Messages whose type the route allows and whose payload isn't too large."""
    return messages.where(F.col("type").isin(ROUTES[route]) & (F.length("payload") <= most_chars))


def retained(log: DataFrame) -> DataFrame:
    """(channel, type, seq, ts, payload): the last retained message of each type that nothing has ended since.

    ``log(channel, seq, ts, type, payload)``; one aggregation by channel, of bounded state.
    """
    last = [F.max_by(F.struct("seq", "ts", "payload"), F.when(F.col("type") == t, F.col("seq"))).alias(t.replace(".", "_")) for t in ENDS]
    ended = [F.max(F.when(F.col("type").isin(e), F.col("seq"))).alias(f"end_{t.replace('.', '_')}") for t, e in ENDS.items()]
    state = log.groupBy("channel").agg(*last, *ended)
    rows = None
    for t in ENDS:
        c = t.replace(".", "_")
        part = state.where(F.col(f"{c}.seq").isNotNull() & (F.coalesce(f"end_{c}", F.lit(-1)) < F.col(f"{c}.seq"))).select("channel", F.lit(t).alias("type"), f"{c}.seq", f"{c}.ts", f"{c}.payload")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def replay(state: DataFrame) -> DataFrame:
    """The message that a new subscriber gets: the newest by time, of two equal ones the graph."""
    order = F.struct(F.coalesce("ts", F.lit(0).cast("timestamp")), F.when(F.col("type") == "graph.show", 1).otherwise(0))
    return state.groupBy("channel").agg(F.max_by(F.struct("type", "seq", "ts", "payload"), order).alias("m")).select("channel", "m.*")


def _advance(key, frames, state: GroupState):
    """Keep (seq, ts, payload) for each retained type and the last end of each."""
    held = dict(zip(("show", "set"), state.get, strict=True)) if state.exists else {"show": None, "set": None}
    held = {k: tuple(v) if v is not None else None for k, v in held.items()}
    rows = pd.concat(list(frames)).sort_values("seq")
    for r in rows.itertuples():
        if r.type == "graph.show":
            held["show"] = (r.seq, r.ts, r.payload)
        elif r.type == "highlight.set":
            held["set"] = (r.seq, r.ts, r.payload)
        elif r.type == "graph.refresh":
            held = {"show": None, "set": None}
        elif r.type == "highlight.clear":
            held["set"] = None
    state.update((held["show"], held["set"]))
    out = [(key[0], t, *held[k]) for k, t in (("show", "graph.show"), ("set", "highlight.set")) if held[k] is not None]
    yield pd.DataFrame(out, columns=["channel", "type", "seq", "ts", "payload"])


def retained_stream(messages: DataFrame) -> DataFrame:
    """The same as a stream: after each batch the retained messages of the channels it touched (update mode)."""
    one = "struct<seq:bigint,ts:timestamp,payload:string>"
    return messages.groupBy("channel").applyInPandasWithState(_advance, STATE, f"show {one}, set {one}", "update", GroupStateTimeout.NoTimeout)


def upsert_stream(updates: DataFrame, folder: str, checkpoint: str):
    """Ledger updates as a stream: each micro-batch's last entry per key is added to a table of versions.

    The batch number is part of the folder, so a batch that runs again replaces itself.
    """
    from ..operators.workflow import ledger_latest

    def add(batch: DataFrame, number: int) -> None:
        ledger_latest(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return updates.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
