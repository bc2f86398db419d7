"""The scan as files arrive.

Everything up to the decision depends on one file alone, so the batch chain runs
on a stream as it is. Only first-wins needs memory of what was seen.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructField, StructType

from keysieve.operators.context import add_context
from keysieve.operators.features import add_features
from keysieve.operators.heuristic import Scorer, baseline_scorer
from keysieve.operators.recover import recover_candidates
from keysieve.operators.report import build_findings, rank_findings, report_rows

IDENTITY = ["repository", "file_path", "value", "line_number"]
#: The batch rule: earliest file, then signature, then place.
ORDER = ["file_ord", "sig_ord", "start_index"]
_STORE = "spark.sql.streaming.stateStore.providerClass"
_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Least(StatefulProcessor):
    """Lets a row pass if it comes before all rows of its identity so far."""

    def __init__(self, order: list[str], state: StructType, memory_ms: int) -> None:
        self._order, self._schema, self._memory_ms = order, state, memory_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._first = handle.getValueState("first", self._schema, self._memory_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        least, place = None, None
        for frame in rows:
            own = frame.sort_values(self._order, kind="stable").head(1)
            at = tuple(int(own[c].iloc[0]) for c in self._order)
            if place is None or at < place:
                least, place = own, at
        before = tuple(self._first.get()) if self._first.exists() else None
        if place is not None and (before is None or place < before):
            self._first.update(place)
            yield least.assign(revises=before is not None)

    def close(self) -> None:
        pass


def first_wins_as_it_arrives(rows: DataFrame, memory: str = "1 day") -> DataFrame:
    """The first row of each identity, by the batch rule and not by arrival; adds ``revises``.

    State holds three numbers per identity and forgets them after ``memory`` without an
    earlier row. A row goes out when it comes before all others so far, with
    ``revises`` if one went out already; so the last row of an identity is the one that
    a batch over the same rows keeps, in whatever order they arrive. Run it in update
    mode. This session is set to the RocksDB store, and to forget with batches of data
    only: a time to live would else keep an idle stream busy with empty ones.
    """
    rows.sparkSession.conf.set(_STORE, _ROCKS)
    rows.sparkSession.conf.set(_EMPTY_BATCHES, "false")
    state = StructType([rows.schema[c] for c in ORDER])
    out = StructType([*rows.schema.fields, StructField("revises", BooleanType())])
    processor = _Least(ORDER, state, int(pd.Timedelta(memory).total_seconds() * 1000))
    return rows.groupBy(*IDENTITY).transformWithStateInPandas(
        processor, out, outputMode="Update", timeMode="ProcessingTime"
    )


def incremental_analyses(arriving: DataFrame, memory: str = "1 day", scorer: Scorer | None = None) -> DataFrame:
    """Analyses of a stream of files; of copies within ``memory`` the earliest file's stays.

    Which of several signatures keeps a text is settled inside its segment before
    state; segments and copies are left to it.
    """
    found = add_features(add_context(recover_candidates(arriving, once_per_line=True)))
    return (scorer or baseline_scorer())(first_wins_as_it_arrives(found, memory))


def report_each_batch(analyses: DataFrame, sink: Callable[[DataFrame, int], None]):
    """Stream writer that hands ranked report rows of every batch to ``sink``.

    A row that revises an earlier one has the same repository, file, line and value.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        sink(report_rows(rank_findings(build_findings(batch))), batch_id)

    return analyses.writeStream.outputMode("update").foreachBatch(write)


# The processor travels to the executors whole, so they need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
