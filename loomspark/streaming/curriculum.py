"""State machines over ordered metrics: adaptive stages and early stopping, in batch per run or as a stream."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Rules:
    least_epochs: int = 2
    most_epochs: int = 10
    patience: int = 3
    least_delta: float = 1e-3
    last_stage: int = 4


@dataclass
class State:
    stage: int = 0
    epochs: int = 0
    worse: int = 0
    best: float = float("inf")
    stopped: bool = False

    def step(self, loss: float, rules: Rules) -> str:
        """Take one epoch's validation loss; returns what happened: stay, advance:<reason>, stop:<reason> or over."""
        if self.stopped:
            return "over"
        self.epochs += 1
        if loss < self.best - rules.least_delta:
            self.best, self.worse = loss, 0
        else:
            self.worse += 1
        why = "max_epochs" if self.epochs >= rules.most_epochs else "patience" if self.epochs >= rules.least_epochs and self.worse >= rules.patience else ""
        if not why:
            return "stay"
        if self.stage >= rules.last_stage:
            self.stopped = True
            return f"stop:{why}"
        self.stage, self.epochs, self.worse, self.best = self.stage + 1, 0, 0, float("inf")
        return f"advance:{why}"


def replay(metrics: DataFrame, run: str, order: str, loss: str, rules: Rules | None = None) -> DataFrame:
    """Rows of a run in order, with the stage in which each epoch was trained and what followed. A run is a few hundred epochs."""
    rules = rules or Rules()

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, state = pdf.sort_values(order), State()
        stages, events = [], []
        for x in pdf[loss]:
            stages.append(state.stage)
            events.append(state.step(float(x), rules))
        return pdf.assign(stage=stages, event=events)

    kinds = dict(metrics.dtypes)
    return metrics.select(run, order, loss).groupBy(run).applyInPandas(fold, f"{run} {kinds[run]}, {order} {kinds[order]}, {loss} {kinds[loss]}, stage int, event string")


def stream(metrics: DataFrame, run: str, loss: str, rules: Rules | None = None) -> DataFrame:
    """The same over a stream of (run, loss) rows in arrival order; the state of a run is kept between batches."""
    rules = rules or Rules()
    kind = dict(metrics.dtypes)[run]

    def advance(key: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state = State(*held.get) if held.exists else State()
        rows = []
        for pdf in batches:
            for x in pdf[loss]:
                stage = state.stage
                rows.append((key[0], float(x), stage, state.step(float(x), rules)))
        held.update((state.stage, state.epochs, state.worse, state.best, state.stopped))
        yield pd.DataFrame(rows, columns=[run, loss, "stage", "event"])

    return metrics.select(run, F.col(loss).cast("double").alias(loss)).groupBy(run).applyInPandasWithState(
        advance, f"{run} {kind}, {loss} double, stage int, event string", "stage int, epochs int, worse int, best double, stopped boolean", "append", "NoTimeout"
    )


def early_stop(metrics: DataFrame, run: str, order: str, loss: str, patience: int) -> DataFrame:
    """The first epoch of each run after which `patience` epochs brought no new best; null if there is none."""
    w = Window.partitionBy(run).orderBy(order)
    best = F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = metrics.withColumn("_new", F.coalesce(F.col(loss) < best, F.lit(True)).cast("int"))
    rows = rows.withColumn("_n", F.row_number().over(w))
    rows = rows.withColumn("_since", F.col("_n") - F.max(F.when(F.col("_new") == 1, F.col("_n"))).over(w))
    return rows.groupBy(run).agg(F.min(F.when(F.col("_since") >= patience, F.col(order))).alias("stop_at"), F.count("*").alias("n_epochs"))


def filtered_lines(spark, path: str, most: int) -> DataFrame:
    """A stream of text lines that are not longer than `most`; memory does not grow."""
    return spark.readStream.text(path).where(F.length("value") <= most)
