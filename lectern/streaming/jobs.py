"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from lectern.functions import constants as K
from lectern.operators.generation import generation_throughput
from lectern.operators.segments import SegmentedIndex
from lectern.operators.study import study_progress
from lectern.operators.stopping import Stopping
from lectern.plans.ingest import process_documents
from lectern.sources.tables import delete

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


#: Default trigger: work off what has arrived, then stop.  A query that stays up takes another
#: one, such as {"processingTime": "10 seconds"}.
ONCE = {"availableNow": True}


#: Batches between two snapshots of a keyed table.
SNAPSHOT_EVERY = 8


def latest_table(
    results: DataFrame, folder: str, mode: str = "complete", trigger: dict | None = None,
    key: str | None = None, every: int = SNAPSHOT_EVERY,
) -> StreamingQuery:
    """Keep the current state of an aggregating stream under ``folder``.

    Each batch goes to a folder of its number, written by the executors; re-running a batch
    after a failure overwrites that folder.  With ``key``, every ``every`` batches the last rows by key are written
    as a snapshot, and what the snapshot before it already held is deleted; so a reader meets two
    snapshots and at most ``2 * every`` batches, however long the stream has run.  A complete state keeps two batches.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch={batch_id}")
        if key is not None and batch_id % every == every - 1:
            _state(spark, folder, key, batch_id).write.mode("overwrite").parquet(f"{folder}/snapshot/batch={batch_id}")
            for old in range(max(batch_id - 2 * every + 1, 0), batch_id - every + 1):
                delete(spark, f"{folder}/table/batch={old}")
            delete(spark, f"{folder}/snapshot/batch={batch_id - 2 * every}")
        elif mode == "complete":
            delete(spark, f"{folder}/table/batch={batch_id - 2}")

    return (
        results.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", f"{folder}/progress").trigger(**(trigger or ONCE)).start()
    )


def _state(spark: SparkSession, folder: str, key: str, upto: int | None = None) -> DataFrame:
    """Last row by key: of the last snapshot before batch ``upto`` and the batches after it."""
    table = spark.read.parquet(f"{folder}/table")
    if upto is not None:
        table = table.filter(F.col("batch") <= upto)
    try:
        kept = spark.read.schema(table.schema).parquet(f"{folder}/snapshot")
        if upto is not None:
            kept = kept.filter(F.col("batch") < upto)
        last = kept.agg(F.max("batch")).first()[0]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        last = None
    if last is not None:
        table = table.filter(F.col("batch") > last).unionByName(kept.filter(F.col("batch") == last))
    cols = [c for c in table.columns if c != "batch"]
    return table.groupBy(F.col(key).alias("_k")).agg(
        F.max_by(F.struct(*cols), "batch").alias("r")).select("r.*")


def read_latest(spark: SparkSession, folder: str, key: str | None = None) -> DataFrame:
    """State after the last batch: the last folder, or with ``key`` the last row per key."""
    if key is not None:
        return _state(spark, folder, key)
    table = spark.read.parquet(f"{folder}/table")
    return table.filter(F.col("batch") == table.agg(F.max("batch").alias("b")).scalar()).drop("batch")


def stream_study_progress(activity: DataFrame, folder: str, trigger: dict | None = None) -> StreamingQuery:
    """Progress counters kept current; only users changed by a batch are written."""
    return latest_table(study_progress(activity), folder, "update", trigger, "user_id")


def stream_throughput(log: DataFrame, folder: str, trigger: dict | None = None) -> StreamingQuery:
    return latest_table(generation_throughput(log), folder, "update", trigger, "generation_id")


def stream_ingest(
    docs: DataFrame, folder: str, target: int = K.TARGET_WORDS, trigger: dict | None = None,
) -> StreamingQuery:
    """Arriving (doc_id, source, text) documents become finished chunks and a segment of the index.

    A batch runs the same steps on its documents as ``process_documents`` does on all, and appends one
    segment to the index under ``folder``/index; small segments are merged as they pile up.  A document
    that arrives again replaces its earlier chunks and postings; of two arrivals in one batch either
    may stay.  A batch that is repeated after a failure overwrites its files.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, at = batch.sparkSession, f"batch={batch_id}"
        batch.dropDuplicates(["doc_id"]).write.mode("overwrite").parquet(f"{folder}/arrived/{at}")
        arrived = spark.read.schema(batch.schema).parquet(f"{folder}/arrived/{at}")
        process_documents(arrived, target).write.mode("overwrite").parquet(f"{folder}/chunks/{at}")
        index = ingested_index(spark, folder, batch.schema["doc_id"].dataType.simpleString())
        index.append(arrived.select("doc_id", "text"), f"b{batch_id}").settle(f"m{batch_id}")

    return (
        docs.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{folder}/progress").trigger(**(trigger or ONCE)).start()
    )


def ingested_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of the last batch in which their document arrived."""
    last = spark.read.parquet(f"{folder}/arrived").groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{folder}/chunks").join(last, ["doc_id", "batch"], "left_semi").drop("batch")


def ingested_index(spark: SparkSession, folder: str, id_type: str = "bigint") -> SegmentedIndex:
    """The index of all documents that have arrived; a new one before the first."""
    path = f"{folder}/index"
    try:
        return SegmentedIndex.load(spark, path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return SegmentedIndex.create(spark, path, id_type)


#: Iterations per bucket of held reports, and reports of a run and batch that are in memory before buckets are written.
SPAN, IN_MEMORY = 4096, 100_000


class EarlyStopping(StatefulProcessor):
    """Early stopping of one run whose reports may arrive in any order.

    Reports wait in the state store, in buckets of ``SPAN`` iterations, equal ones as one with a count.  A bucket that
    ends more than ``lateness`` iterations before the newest report is folded into the state for good; the
    result of a batch also counts the buckets that still wait.  ``IN_MEMORY`` reports of a batch are folded without
    passing through the state store, which then gets what has to wait; beyond them one bucket is in memory at a time.
    """

    OUTPUT = (
        "run_id bigint, best_loss double, best_iteration bigint, patience_counter int, "
        "stopped_at bigint"
    )
    STATE = "best double, patience int, best_iteration bigint, stopped_at bigint, newest bigint, bucket bigint"
    HELD = "iteration array<bigint>, loss array<double>, n array<bigint>"

    def __init__(self, patience: int, delta: float, lateness: int):
        self.patience, self.delta, self.lateness = patience, delta, lateness

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("early_stopping", self.STATE)
        self.held = handle.getMapState("held", "bucket bigint", self.HELD)

    @staticmethod
    def merged(iterations: np.ndarray, losses: np.ndarray, old: tuple | None) -> tuple:
        """Reports in order, equal ones counted, with those of a bucket."""
        counts = np.ones(len(iterations), dtype=np.int64)
        if old is not None:
            iterations, losses, counts = (
                np.concatenate([np.asarray(a, dtype=b.dtype), b]) for a, b in zip(old, (iterations, losses, counts)))
        order = np.lexsort((losses, iterations))
        iterations, losses, counts = iterations[order], losses[order], counts[order]
        same = (losses[1:] == losses[:-1]) | (np.isnan(losses[1:]) & np.isnan(losses[:-1]))
        first = np.flatnonzero(np.concatenate([[True], ~(same & (iterations[1:] == iterations[:-1]))]))
        return iterations[first], losses[first], np.add.reduceat(counts, first)

    def hold(self, bucket: int, reports: tuple) -> None:
        self.held.updateValue((bucket,), tuple(a.tolist() for a in reports))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        *fields, newest, bucket = self.state.get() or (float("inf"), 0, 0, None, None, None)
        run = Stopping(*fields)
        waiting = {k[0] for k in self.held.keys()}
        fresh: list[tuple] = []

        def by_bucket() -> Iterator[tuple]:
            """(bucket, reports) of what has come and not been written, with what is held."""
            if not fresh:
                return
            iterations, losses = (np.concatenate(a) for a in zip(*fresh))
            fresh.clear()
            at = iterations // SPAN if bucket is None else np.maximum(iterations // SPAN, bucket)
            order = np.argsort(at, kind="stable")
            names, opens = np.unique(at[order], return_index=True)
            for b, mine in zip(names.tolist(), np.split(order, opens[1:])):
                yield b, self.merged(iterations[mine], losses[mine], self.held.getValue((b,)) if b in waiting else None)

        for part in rows:
            if run.stopped_at is not None:
                continue  # whatever comes after a stop changes nothing
            iterations = part["iteration"].to_numpy(np.int64)
            newest = int(iterations.max()) if newest is None else max(newest, int(iterations.max()))
            fresh.append((iterations, part["valid_loss"].to_numpy(float)))
            if sum(len(f[0]) for f in fresh) > IN_MEMORY:
                for b, reports in by_bucket():
                    self.hold(b, reports)
                    waiting.add(b)
        now, came = replace(run), dict(by_bucket())
        for b in sorted(waiting | set(came)):
            now.reports(*(came[b] if b in came else self.held.getValue((b,))), self.patience, self.delta)
            if (b + 1) * SPAN <= newest - self.lateness:
                run, bucket = replace(now), b + 1
                if b in waiting:
                    self.held.removeKey((b,))
            elif b in came:
                self.hold(b, came[b])
        self.state.update((run.best, run.patience, run.best_iteration, run.stopped_at, newest, bucket))
        yield pd.DataFrame({
            "run_id": [key[0]], "best_loss": [now.best], "best_iteration": [now.best_iteration],
            "patience_counter": [now.patience], "stopped_at": pd.array([now.stopped_at], dtype="Int64"),
        })

    def close(self) -> None:
        pass


def stream_early_stopping(
    log: DataFrame, folder: str,
    patience: int = K.EARLY_STOP_PATIENCE, delta: float = K.EARLY_STOP_DELTA,
    trigger: dict | None = None, lateness: int = 0,
) -> StreamingQuery:
    """Early stopping over a stream of (run_id, iteration, valid_loss).

    Reports of a run may arrive in any order: one that is at most ``lateness`` iterations behind the newest
    is judged in its place, as by ``early_stopping`` over all of them.  A later one whose stretch is
    already folded counts as the first of those that still wait.  State grows with ``lateness``.
    """
    conf = log.sparkSession.conf
    before = conf.get(STATE_PROVIDER, None)
    seen = log.filter("valid_loss is not null and iteration is not null")
    states = seen.groupBy("run_id").transformWithStateInPandas(
        EarlyStopping(patience, delta, lateness), EarlyStopping.OUTPUT, "update", "none")
    conf.set(STATE_PROVIDER, ROCKSDB)  # a query keeps the settings it was started with
    try:
        return latest_table(states, folder, "update", trigger, "run_id")
    finally:
        if before is None:
            conf.unset(STATE_PROVIDER)
        else:
            conf.set(STATE_PROVIDER, before)
