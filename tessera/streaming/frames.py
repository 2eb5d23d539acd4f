"""Frames of many videos in order: in batch by a window, as a stream by keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.lineage import stored
from tessera.operators.order import ranked


def ordered(df: DataFrame, video: str, order: list[str], value: str = "value") -> DataFrame:
    """Adds frame (0, 1, ... per video) and change (of the value since the frame before). A video may hold most rows: frames are numbered by ranges, and
    the frame before comes by a join, so no video is a task."""
    rows = stored(ranked(df, [video], order, "frame"), "frames")
    before = rows.select(video, (F.col("frame") + 1).alias("frame"), F.col(value).alias("_before"))
    return rows.join(before, [video, "frame"], "left").withColumn("change", F.col(value) - F.col("_before")).drop("_before")


def carried(stream: DataFrame) -> DataFrame:
    """From a stream of video (long), frame (long), value (double): video, frame, change, late.

    State per video: the next frame, the last value and the frames that came too early. Frames are emitted in order however they
    arrive; a frame before the next one has been emitted already and is returned once more with late set."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        after, last, frames, values = state.get if state.exists else (0, None, [], [])
        waiting = dict(zip(frames, values, strict=True))
        out: dict[str, list] = {"video": [], "frame": [], "change": [], "late": []}

        def emit(frame: int, change: float | None, late: bool) -> None:
            for k, v in zip(out, (key[0], frame, change, late), strict=True):
                out[k].append(v)

        for pdf in batches:
            for frame, value in zip(pdf["frame"].tolist(), pdf["value"].tolist(), strict=True):
                if frame < after or frame in waiting:
                    emit(frame, None, True)
                else:
                    waiting[frame] = value
        while after in waiting:
            value = waiting.pop(after)
            emit(after, None if last is None else value - last, False)
            after, last = after + 1, value
        state.update((after, last, list(waiting), list(waiting.values())))
        yield pd.DataFrame(out).astype({"change": "float64", "late": bool})

    return stream.groupBy("video").applyInPandasWithState(step, "video long, frame long, change double, late boolean", "after long, last double, frames array<long>, vals array<double>", "append", "NoTimeout")
