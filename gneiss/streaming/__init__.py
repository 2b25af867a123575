"""Streams: appends that never repeat a key, budgets kept per run, and windowed counts with late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gneiss.sources.files import append_new


def append_once(stream: DataFrame, path: str, key: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write each key of a stream to the Parquet table at path once; a batch that runs again adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        append_new(batch.dropDuplicates([key]), path, key)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed(stream: DataFrame, at: str, by: str, length: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts by window of event time and by key; events later than `late` are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, length), by).agg(F.count("*").alias("n")).select("window.start", by, "n")


BUDGETS = "run_id string, steps long, tool_calls long, tokens long, seconds double, breach string"


def budgets(stream: DataFrame, limits: dict[str, float]) -> DataFrame:
    """The spending of every run so far and the first budget that it broke, if any, after each batch.

    stream: run_id, is_tool boolean, tokens long, seconds double. limits: steps, tool_calls, tokens, seconds. State is one row a run.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        steps, calls, tokens, seconds, breach = state.get if state.exists else (0, 0, 0, 0.0, None)
        for frame in frames:
            for r in frame.itertuples(index=False):
                steps, calls, tokens, seconds = steps + 1, calls + int(bool(r.is_tool)), tokens + int(r.tokens or 0), seconds + float(r.seconds or 0)
                spent = {"steps": steps, "tool_calls": calls, "tokens": tokens, "seconds": seconds}
                breach = breach or next((name for name, most in limits.items() if spent[name] > most), None)
        state.update((steps, calls, tokens, seconds, breach))
        yield pd.DataFrame([(key[0], steps, calls, tokens, seconds, breach)], columns=[c.split()[0] for c in BUDGETS.split(", ")])

    return stream.groupBy("run_id").applyInPandasWithState(fold, BUDGETS, "steps long, tool_calls long, tokens long, seconds double, breach string", "update", GroupStateTimeout.NoTimeout)
