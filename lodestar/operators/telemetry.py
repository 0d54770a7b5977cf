"""Metrics of queries as they run: rows are counted in the plan that passes them, and shown in the scrapers' text format.

``observed`` puts named aggregates into a DataFrame; Spark fills them when an action has passed all its rows, with no
second scan. ``StreamMetrics`` listens to streams and adds up what their micro-batches observed. Both keep one number
for each name and series, whatever the number of rows.
"""

from __future__ import annotations

import threading
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

SERIES = "series string, name string, value long"


def observed(df: DataFrame, series: str, **values: Column) -> tuple[DataFrame, Observation]:
    """``df`` with its rows counted, and beside them ``values`` aggregated, whenever it is run for the first time.

    Rows that a limit or a join above leaves out aren't seen. ``get`` of the observation waits for an action to end.
    """
    seen = Observation(series)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(v.alias(n) for n, v in values.items())), seen


class StreamMetrics(StreamingQueryListener):
    """Sums of what streams observe under ``df.observe(series, ...)``, over all their micro-batches.

    A batch that is run again after a failure is reported by the run that completes it, so it counts once.
    """

    def __init__(self, *series: str):
        self.wanted, self.totals = set(series), {}
        self._lock = threading.Lock()
        self._ended: dict[str, threading.Event] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end_of(str(event.runId)).set()

    def _end_of(self, run: str) -> threading.Event:
        with self._lock:
            return self._ended.setdefault(run, threading.Event())

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Until the query has ended and its last reports are in; they come some time after the end itself."""
        query.awaitTermination()
        if not self._end_of(str(query.runId)).wait(seconds):
            raise TimeoutError(f"no report of the end of run {query.runId}")

    def onQueryProgress(self, event) -> None:
        with self._lock:
            for series, row in event.progress.observedMetrics.items():
                if series in self.wanted:
                    own = self.totals.setdefault(series, {})
                    for name, value in row.asDict().items():
                        own[name] = own.get(name, 0) + (value or 0)


def as_rows(spark: SparkSession, found: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """(series, name, value) of what was observed."""
    return spark.createDataFrame([(s, n, v) for s, values in found.items() for n, v in values.items()], SERIES)


def exposition(prefix: str, found: Mapping[str, Mapping[str, int]]) -> str:
    """The text that a scraper reads: a counter for each name, a line for each series."""
    escaped = lambda s: s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
    lines = []
    for name in sorted({n for values in found.values() for n in values}):
        lines.append(f"# TYPE {prefix}_{name}_total counter")
        lines += [f'{prefix}_{name}_total{{series="{escaped(s)}"}} {values[name]}' for s, values in sorted(found.items()) if name in values]
    return "\n".join(lines) + "\n"
