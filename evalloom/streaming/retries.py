"""Rows of a stream that are tried again: waiting between tries, giving up after so many or so long, and a tally.

Each row is a key of its own with a small state: the row, its tries and when the first one was. A failed try sets a timer;
when it fires, the row is tried again, also by another executor after a loss, as state and timers are in the checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "key string, status string, tries int, result string, error string"
TRIES, LIMIT, WAIT = 5, 1200.0, 2.0  # tries at most, seconds from the first one, seconds before the second; then twice as long each


class Retries(StatefulProcessor):
    """Statuses: done; failed (all tries used up); late (the next try would come after the limit)."""

    def __init__(self, attempt: Callable[[dict, int], object], tries: int, limit: float, wait: float):
        self.attempt, self.tries, self.limit, self.wait = attempt, tries, limit, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("row", "row string, tries int, began long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frames = list(rows)
        if not self.state.exists():  # a key that is under way or repeated isn't begun again
            now = timerValues.getCurrentProcessingTimeInMs()
            yield from self._try(key[0], frames[0]["row"].iloc[0], 0, now, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.state.exists():
            row, tries, began = self.state.get()
            if row is not None:
                yield from self._try(key[0], row, tries, began, timerValues.getCurrentProcessingTimeInMs())

    def _try(self, key: str, row: str, tries: int, began: int, now: int) -> Iterator[pd.DataFrame]:
        tries, status, result, error = tries + 1, "done", None, None
        try:
            result = json.dumps(self.attempt(json.loads(row), tries))
        except Exception as e:  # told in the result
            error = f"{type(e).__name__}: {e}"
            pause = int(self.wait * 1000 * 2 ** (tries - 1))
            status = "failed" if tries >= self.tries else "late" if now + pause - began > self.limit * 1000 else None
            if status is None:
                self.state.update((row, tries, began))
                self.handle.registerTimer(now + pause)
                return
        self.state.update((None, tries, began))  # ended: only the key stays
        yield pd.DataFrame({"key": [key], "status": [status], "tries": [tries], "result": [result], "error": [error]})

    def close(self) -> None:
        pass


def retried(stream: DataFrame, key: str, attempt: Callable[[dict, int], object], tries: int = TRIES, limit: float = LIMIT, wait: float = WAIT) -> DataFrame:
    """key, status, tries, result (JSON), error of each row once it has ended; ``attempt`` gets the row and the number of the try.

    Needs the RocksDB state store, as Spark's stateful operators with timers do.
    """
    rows = stream.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*stream.columns)).alias("row"))
    return rows.groupBy("key").transformWithStateInPandas(Retries(attempt, tries, limit, wait), OUT, "Update", "ProcessingTime")


def tally(ended: DataFrame) -> DataFrame:
    """status, rows, tries of what has ended."""
    return ended.groupBy("status").agg(F.count(F.lit(1)).alias("rows"), F.sum("tries").alias("tries"))
