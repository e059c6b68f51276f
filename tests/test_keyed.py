"""Keyed state machines: stream against batch with a restart between, batch against a plain fold."""

from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from knotwork import catalog
from knotwork.streaming import keyed

SF = "/root/testdata/sf0.001"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, before)


def halves(df, column, folder):
    """The log in two files, by order."""
    middle = df.approxQuantile(column, [0.5], 0)[0]
    return [df.where(F.col(column) <= middle).coalesce(1), df.where(F.col(column) > middle).coalesce(1)]


def run(rocks, df, column, tmp_path, make, keep):
    for i, part in enumerate(halves(df, column, tmp_path)):
        part.write.mode("append").parquet(f"{tmp_path}/in")
        source = rocks.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        # A query of its own each time: state comes from the checkpoint.
        keep(make(source), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()


def test_loads(rocks, tmp_path):
    log = catalog._loads(rocks, SF)
    run(rocks, log, "seq", tmp_path, keyed.load_stream, keyed.keep_verdicts)
    want = keyed.load_verdicts(log)
    got = rocks.read.parquet(f"{tmp_path}/out").select(*want.columns)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert {r.verdict for r in want.select("verdict").distinct().collect()} == {"superseded", "replaced", "cancelled", "failed"}


def test_ledger(rocks, tmp_path):
    updates = catalog._attempts(rocks, SF)
    run(rocks, updates, "seq", tmp_path, keyed.ledger_stream, keyed.keep_versions)
    want = keyed.ledger_batch(updates)
    got = keyed.read_ledger(rocks, f"{tmp_path}/out").select(*want.columns)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    whole = keyed.compact(rocks, f"{tmp_path}/out", f"{tmp_path}/compact").select(*want.columns)
    assert whole.exceptAll(want).count() == 0 and len(rocks.read.parquet(f"{tmp_path}/compact").inputFiles()) < len(rocks.read.parquet(f"{tmp_path}/out").inputFiles()) + 1


def test_ledger_is_the_fold(spark):
    rows = defaultdict(list)
    for r in catalog._attempts(spark, SF).orderBy("seq").collect():
        rows[r.key].append(r)
    want = {}
    for key, updates in rows.items():
        status, tries, file, ts = None, 0, None, None
        for r in updates:
            if status == "blocked" or (status == "collected" and r.status != "blocked" and not r.forced):
                continue
            status, tries, file, ts = r.status, tries + (r.status != "blocked"), r.file or file, r.ts
        want[key] = (status, tries, file, ts)
    got = {r.key: (r.status, r.attempts, r.file, r.ts) for r in keyed.ledger_batch(catalog._attempts(spark, SF)).collect()}
    assert got == want and {w[0] for w in want.values()} == {"collected", "failed", "blocked"}


def test_retry(rocks, tmp_path):
    schema = "key string, seq long, ts timestamp, status string, forced boolean, file string"
    batches = [
        [("a", 1, "2026-01-01 00:00:00", "failed", False, "f"), ("b", 2, "2026-01-01 00:00:00", "failed", False, None), ("c", 3, "2026-01-01 00:00:00", "blocked", False, None)],
        [("b", 4, "2026-01-01 00:00:00.5", "collected", False, "g"), ("c", 5, "2026-01-01 00:00:00.5", "collected", True, "h"), ("a", 1, "2026-01-01 00:00:00.6", "collected", True, None)],
        [("z", 6, "2026-01-01 00:01:00", "collected", False, None)],
        [("z", 7, "2026-01-01 00:02:00", "collected", False, None)],
    ]
    for i, rows in enumerate(batches):
        df = rocks.createDataFrame(rows, schema.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = rocks.readStream.schema(schema).parquet(f"{tmp_path}/in")
        out = keyed.ledger_stream(source)
        seen = f"{tmp_path}/seen"
        out.writeStream.foreachBatch(lambda b, n, seen=seen: b.write.mode("append").parquet(seen)).outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.key, r.seq, r.status, r.decision) for r in rocks.read.parquet(seen).collect())
    assert got == [("a", 1, "failed", "applied"), ("a", 1, "failed", "late"), ("a", 1, "failed", "retry"), ("b", 2, "failed", "applied"), ("b", 4, "collected", "applied"), ("c", 3, "blocked", "applied"), ("c", 5, "blocked", "skip_blocked"), ("z", 6, "collected", "applied"), ("z", 7, "collected", "skip")]
