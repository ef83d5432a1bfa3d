"""Early stopping as a fold that many tasks share.

A run's reports are cut, in order, into stretches.  What a stretch does to the state before it depends on
that state in one way only: which report is the first to beat the best loss by more than ``delta``.  Such a
report is always a new low of the stretch, and from there on the stretch runs the same whatever came before.
So a stretch is summed up as its possible first reports and the state each of them ends in, and a run is
folded over its summaries.  The lows of the stretches before bound the best loss to within ``delta``, which
leaves few first reports to tell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import constants as K
from lectern.sources.tables import materialize

#: Most distinct reports in a stretch.
STRETCH = 8192
SUMMARY = (
    "total bigint, lead_at array<bigint>, lead array<bigint>, loss array<double>, at array<bigint>, "
    "best array<double>, best_iteration array<bigint>, counter array<bigint>, stopped_at array<bigint>")
RESULT = "best_loss double, best_iteration bigint, patience_counter int, stopped_at bigint"


@dataclass
class Stopping:
    """Best loss, its iteration, the patience counter and the stop of one run."""

    best: float = float("inf")
    patience: int = 0
    best_iteration: int = 0
    stopped_at: int | None = None

    def report(self, iteration: int, loss: float, patience: int, delta: float) -> None:
        """The best moves only when a loss beats it by more than ``delta``; NaN never does."""
        if self.stopped_at is not None:
            return
        if loss < self.best - delta:
            self.best, self.patience, self.best_iteration = loss, 0, iteration
        else:
            self.patience += 1
            if self.patience >= patience:
                self.stopped_at = iteration

    def reports(self, iterations, losses, counts, patience: int, delta: float) -> None:
        """Ordered reports, each given ``counts`` times, at once."""
        if len(iterations):
            self.stretch(summarize(iterations, losses, counts, self.best, patience, delta), patience, delta)

    def stretch(self, s: dict, patience: int, delta: float) -> None:
        """Pass all reports of a summary at once."""
        if self.stopped_at is not None:
            return
        patience = max(patience, 1)
        first = int(np.searchsorted(-np.asarray(s["loss"], float), -(self.best - delta), side="right"))
        entered = first < len(s["loss"])
        quiet = int(s["at"][first] if entered else s["total"])
        if self.patience + quiet >= patience:
            left = patience - self.patience
            where = int(np.searchsorted(s["lead_at"], left - 1, side="right")) - 1
            self.stopped_at, self.patience = int(s["lead"][where]), self.patience + left
        elif entered:
            stop = s["stopped_at"][first]
            self.best, self.patience = float(s["best"][first]), int(s["counter"][first])
            self.best_iteration = int(s["best_iteration"][first])
            self.stopped_at = None if pd.isna(stop) else int(stop)
        else:
            self.patience += quiet


def summarize(
    iterations, losses, counts, low: float, patience: int, delta: float,
) -> dict:
    """Summary of a stretch of reports, each given ``counts`` times, after reports with minimum ``low``.

    ``loss`` and ``at`` are the loss and place of each possible first improvement, the other arrays the state
    after the stretch if it is the one.  ``lead`` names the iterations of the first ``patience`` places.
    """
    x, c, it = np.asarray(losses, float), np.asarray(counts, np.int64), np.asarray(iterations, np.int64)
    at, total, patience = np.cumsum(c) - c, int(c.sum()), max(patience, 1)
    before = np.concatenate([[np.inf], np.fmin.accumulate(x)[:-1]])
    lows = np.flatnonzero(x < np.where(np.isnan(before), np.inf, before))
    lows = lows[x[lows] < low]
    v, places = x[lows], at[lows]
    after = np.searchsorted(-v, -(v - delta), side="right")  # the next to improve on each
    quiet = np.append(places, total)[after] - places - 1
    ends: dict[int, tuple] = {}

    def end(i: int) -> tuple:
        path = []
        while i not in ends:
            path.append(i)
            if quiet[i] >= patience:
                stop = it[np.searchsorted(at, places[i] + patience, side="right") - 1]
                ends[i] = float(v[i]), int(it[lows[i]]), patience, int(stop)
            elif after[i] == len(v):
                ends[i] = float(v[i]), int(it[lows[i]]), int(quiet[i]), None
            else:
                i = int(after[i])
        for j in path:
            ends[j] = ends[i]
        return ends[i]

    first = [i for i in range(len(v)) if i == 0 or v[i - 1] >= low - delta] if np.isfinite(low) else [0][:len(v)]
    out = [end(i) for i in first]
    lead = at < patience
    return {
        "total": total, "lead_at": at[lead].tolist(), "lead": it[lead].tolist(),
        "loss": v[first].tolist(), "at": places[first].tolist(), "best": [e[0] for e in out],
        "best_iteration": [e[1] for e in out], "counter": [e[2] for e in out], "stopped_at": [e[3] for e in out]}


def _grouped(batches: Iterator[pd.DataFrame], keys: list[str], cols: list[str]) -> Iterator[tuple]:
    """(key, rows) of every stretch of equal keys in sorted batches, rows as lists per column."""
    key, held = None, None
    for batch in batches:
        names = list(zip(*(batch[k].tolist() for k in keys)))
        values = [batch[c].tolist() for c in cols]
        start = 0
        for i in range(1, len(names) + 1):
            if i < len(names) and names[i] == names[start]:
                continue
            if held is None or names[start] != key:
                if held is not None:
                    yield key, held
                key, held = names[start], [[] for _ in cols]
            for mine, column in zip(held, values):
                mine.extend(column[start:i])
            start = i
    if held is not None:
        yield key, held


def stretches(log: DataFrame, patience: int, delta: float, size: int = STRETCH) -> DataFrame:
    """(run_id, stretch, summary columns): one row per run and stretch of at most ``size`` distinct reports.

    Equal reports are counted before they travel.  Ordered reports are written once; only the minimum per
    stretch is ordered within a run.
    """
    seen = log.select("run_id", F.col("iteration").cast("long").alias("iteration"), "valid_loss").filter(
        "valid_loss is not null and iteration is not null")
    order = ["run_id", "iteration", "valid_loss"]
    counted = seen.groupBy(*order).agg(F.count("*").alias("n"))
    placed = materialize(counted.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "place", F.monotonically_increasing_id()), "reports")
    placed = placed.withColumn("stretch", F.expr(f"place div {size}"))
    lows = placed.groupBy("run_id", "stretch").agg(F.min("valid_loss").alias("low"))
    before = Window.partitionBy("run_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    bounds = lows.select(
        "run_id", "stretch", F.lit(-1).cast("long").alias("place"), F.lit(0).cast("long").alias("iteration"),
        F.coalesce(F.min("low").over(before), F.lit(float("inf"))).alias("valid_loss"), F.lit(0).cast("long").alias("n"))
    cols = bounds.columns
    together = placed.select(cols).union(bounds).repartition("run_id", "stretch").sortWithinPartitions(
        "run_id", "stretch", "place")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (run, stretch), (its, losses, counts) in _grouped(
                batches, ["run_id", "stretch"], ["iteration", "valid_loss", "n"]):
            low = float("inf") if np.isnan(losses[0]) else losses[0]
            told = summarize(its[1:], losses[1:], counts[1:], low, patience, delta)
            yield pd.DataFrame([{"run_id": run, "stretch": stretch, **told}])

    run_type = seen.schema["run_id"].dataType.simpleString()
    return together.mapInPandas(_packed(fold), f"run_id {run_type}, stretch bigint, {SUMMARY}")


def _packed(fold: Callable, rows: int = 1000) -> Callable:
    """The frames of ``fold`` put together, so that small results do not travel one by one."""
    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for frame in fold(batches):
            held.append(frame)
            if len(held) == rows:
                yield pd.concat(held, ignore_index=True)
                held = []
        if held:
            yield pd.concat(held, ignore_index=True)

    return packed


def early_stopping(
    log: DataFrame, patience: int = K.EARLY_STOP_PATIENCE, delta: float = K.EARLY_STOP_DELTA, size: int = STRETCH,
) -> DataFrame:
    """Per run: best loss, its iteration, the patience counter and the stopping iteration.

    A fold over all validation reports of a run in the order of (iteration, loss), not a running
    minimum.  Reports are summed up by stretches of ``size``, by as many tasks as there are stretches; the
    summaries of a run pass through a state of four numbers.  ``log`` has (run_id, iteration, valid_loss);
    reports without a validation loss or an iteration do not count.  ``delta`` must not be negative.
    """
    if not delta >= 0:
        raise ValueError("delta must not be negative")
    ordered = stretches(log, patience, delta, size).repartition("run_id").sortWithinPartitions("run_id", "stretch")
    cols = [c.split()[0] for c in SUMMARY.split(", ")]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, state, done = None, None, []
        for batch in batches:
            for name, *values in zip(batch["run_id"].tolist(), *(batch[c] for c in cols)):
                if state is None or name != run:
                    if state is not None:
                        done.append((run, state.best, state.best_iteration, state.patience, state.stopped_at))
                    run, state = name, Stopping()
                state.stretch(dict(zip(cols, values)), patience, delta)
            if done:
                yield table(done)
                done = []
        if state is not None:
            yield table([(run, state.best, state.best_iteration, state.patience, state.stopped_at)])

    def table(rows: list[tuple]) -> pd.DataFrame:
        names = ["run_id", "best_loss", "best_iteration", "patience_counter", "stopped_at"]
        return pd.DataFrame(rows, columns=names).astype({"stopped_at": "Int64"})

    run_type = ordered.schema["run_id"].dataType.simpleString()
    return ordered.mapInPandas(fold, f"run_id {run_type}, {RESULT}")
