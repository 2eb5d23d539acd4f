"""Several videos in one table, and region parameters that are carried from frame to frame: as a batch fold and as a stream.

A region's posterior covariance in a frame is its prior in the next one in which it has pixels. Both forms apply the same step (``advance``) to a frame's regions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Frames of a video have numbers below this.
STRIDE = 1 << 16


def keyed(p: DataFrame, video: str = "video", frame: str = "frame") -> DataFrame:
    """Adds t, the key that all operators group by: a video's number times STRIDE, and its frame. The frames before a video's first and after its last belong to no video, so what looks
    from frame to frame stays inside a video. Videos are numbered from 0 up to 127 as they stand in the column (components need t below 2^23)."""
    fits = F.col(video).between(0, 127) & F.col(frame).between(0, STRIDE - 2)
    return p.withColumn("t", F.when(fits, F.col(video) * STRIDE + F.col(frame)).otherwise(F.raise_error(F.lit("videos must be 0 to 127 and frames below 65535"))).cast("int"))


def unkeyed(df: DataFrame, video: str = "video", frame: str = "frame") -> DataFrame:
    """video and frame from t, which goes."""
    return df.withColumns({video: F.floor(F.col("t") / STRIDE).cast("int"), frame: (F.col("t") % STRIDE).cast("int")}).drop("t")


SPREADS = ("sxx", "sxy", "syy")


def spreads(p: DataFrame) -> DataFrame:
    """From pixels with video, frame, spix, x, y: per region video, frame, spix, n, sxx, sxy, syy (sums of products of offsets from its mean place)."""
    g = p.where("spix >= 0").groupBy("video", "frame", "spix").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(a) * F.col(b)).cast("double").alias(f"_{a}{b}") for a, b in ("xx", "xy", "yy")], F.sum("x").cast("double").alias("_x"), F.sum("y").cast("double").alias("_y"))
    part = lambda a, b: F.col(f"_{a}{b}") - F.col(f"_{a}") / F.col("n") * F.col(f"_{b}")
    return g.select("video", "frame", "spix", "n", *[part(a, b).alias(f"s{a}{b}") for a, b in ("xx", "xy", "yy")])


def advance(prior: tuple | None, n: int, s: tuple) -> tuple:
    """(count, xx, xy, yy) of a region after a frame: its sample covariance if it is new, else the prior's, scaled to its count over the root of its determinant, smoothed with the spread."""
    if prior is None:
        return (float(n), *(v / n for v in s))
    count, xx, xy, yy = prior
    scale = count / max(xx * yy - xy * xy, 1e-5) ** 0.5 * count
    low = n + count * 50.0 + 3.0
    return (float(n), *((q * scale + v) / low for q, v in zip((xx, xy, yy), s, strict=True)))


CARRIED = "video int, frame int, spix int, n long, xx double, xy double, yy double"


def carried_parameters(regions: DataFrame) -> DataFrame:
    """The fold in batch. From spreads(): the posterior covariances. A region's frames go by in order as a stream of sorted rows, with one region's parameters in memory; the key is (video, region), so no
    video is a task."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, prior = None, None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if (r.video, r.spix) != key:
                    key, prior = (r.video, r.spix), None
                prior = advance(prior, r.n, (r.sxx, r.sxy, r.syy))
                out.append((r.video, r.frame, r.spix, r.n, *prior[1:]))
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in CARRIED.split(", ")])

    rows = regions.select("video", "frame", "spix", "n", *SPREADS)
    return rows.repartition("video", "spix").sortWithinPartitions("video", "spix", "frame").mapInPandas(fold, CARRIED)


def as_frames(regions: DataFrame) -> DataFrame:
    """One row per frame with the arrays of its regions, which is what the stream reads: a frame is complete when its row is there."""
    each = F.sort_array(F.collect_list(F.struct("spix", "n", *SPREADS)))
    rows = regions.groupBy("video", "frame").agg(each.alias("r"))
    return rows.select("video", "frame", *[F.col(f"r.{c}").alias(c) for c in ("spix", "n", *SPREADS)])


class _Carry(StatefulProcessor):
    """State of a video: the next frame; a map of the frames that came too early; a map of its regions' parameters, of which a frame changes only its own."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.after = handle.getValueState("after", "frame int")
        self.waiting = handle.getMapState("waiting", "frame int", "spix array<int>, n array<bigint>, sxx array<double>, sxy array<double>, syy array<double>")
        self.known = handle.getMapState("known", "spix int", "count double, xx double, xy double, yy double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        after = self.after.get()[0] if self.after.exists() else 0
        out = []
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                frame = int(r.frame)
                if frame >= after and not self.waiting.containsKey((frame,)):  # a frame that comes again changes nothing
                    self.waiting.updateValue((frame,), ([int(v) for v in r.spix], [int(v) for v in r.n], *[[float(v) for v in getattr(r, s)] for s in SPREADS]))
        while self.waiting.containsKey((after,)):
            for spix, n, *s in zip(*self.waiting.getValue((after,)), strict=True):
                prior = tuple(self.known.getValue((spix,))) if self.known.containsKey((spix,)) else None
                new = advance(prior, n, tuple(s))
                self.known.updateValue((spix,), new)
                out.append((int(key[0]), after, spix, n, *new[1:]))
            self.waiting.removeKey((after,))
            after += 1
        self.after.update((after,))
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in CARRIED.split(", ")])

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        """Rows video, frame (the next one), spix, count, xx, xy, yy of an earlier run."""
        for r in initialState.itertuples(index=False):
            self.after.update((int(r.frame),))
            self.known.updateValue((int(r.spix),), (float(r.count), float(r.xx), float(r.xy), float(r.yy)))

    def close(self) -> None:
        pass


def carried_stream(frames: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """The fold as a stream over as_frames() rows, in whatever order frames arrive. start: where an earlier run has left each video (see handleInitialState). Needs the RocksDB state store."""
    initial = None if start is None else start.groupBy("video")
    return frames.groupBy("video").transformWithStateInPandas(statefulProcessor=_Carry(), outputStructType=CARRIED, outputMode="Append", timeMode="None", initialState=initial)
