"""Label maps, images and flow fields from files, and back."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FLOW_MAGIC = 202021.25
PARAMS = ["label", "mu_i.x", "mu_i.y", "mu_i.z", "p_mu_i.x", "p_mu_i.y", "p_mu_i.z", "mu_s.x", "mu_s.y", "sigma_s.x", "sigma_s.y", "sigma_s.z", "prior_icov.x", "prior_icov.y", "prior_icov.z", "count", "prior_count"]


def read_labels(spark: SparkSession, root: str, pattern: str = "*.csv", offset: int = 0) -> DataFrame:
    """t, y, x, spix from one file without header per frame, named by its number."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(root)
    t = F.regexp_extract("path", r"(\d+)\.[^./]*$", 1).cast("int") - offset
    lines = files.select(t.alias("t"), F.posexplode(F.filter(F.split(F.col("content").cast("string"), r"\r?\n"), lambda v: v != "")).alias("y", "line"))
    return lines.select("t", "y", F.posexplode(F.split("line", ",")).alias("x", "v")).select("t", "y", "x", F.trim("v").cast("int").alias("spix"))


def write_labels(labels: DataFrame, root: str) -> None:
    """One folder per frame (t=...) with one line per row of the raster, in order. Negative labels are an error."""
    line = labels.groupBy("t", "y").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", F.when(F.col("spix") < 0, F.raise_error(F.lit("negative label"))).otherwise(F.col("spix")).alias("v")))), lambda s: s["v"]), ",").alias("value"))
    line.repartition("t").sortWithinPartitions("t", "y").select("t", "value").write.partitionBy("t").text(root)


def read_written_labels(spark: SparkSession, root: str) -> DataFrame:
    """What write_labels wrote."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(root)
    t = F.regexp_extract("path", r"/t=(\d+)/", 1).cast("int")
    lines = files.select(t.alias("t"), F.posexplode(F.filter(F.split(F.col("content").cast("string"), "\n"), lambda v: v != "")).alias("y", "line"))
    return lines.select("t", "y", F.posexplode(F.split("line", ",")).alias("x", "v")).select("t", "y", "x", F.col("v").cast("int").alias("spix"))


def decode_flow(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """dx, dy (height x width) of a .flo file."""
    magic, width, height = struct.unpack("<fii", content[:12])
    if magic != FLOW_MAGIC:
        raise ValueError("not a .flo file")
    data = np.frombuffer(content, "<f4", 2 * width * height, 12).reshape(height, width, 2)
    if np.isnan(data).any():
        raise ValueError("flow holds NaN")
    return data[..., 0], data[..., 1]


def encode_flow(dx: np.ndarray, dy: np.ndarray) -> bytes:
    height, width = dx.shape
    return struct.pack("<fii", FLOW_MAGIC, width, height) + np.stack([dx, dy], -1).astype("<f4").tobytes()


def read_flow(spark: SparkSession, root: str) -> DataFrame:
    """t, y, x, dx, dy from .flo files named by their number; missing numbers are skipped."""

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t, content in zip(pdf["t"], pdf["content"], strict=True):
                dx, dy = decode_flow(content)
                y, x = np.mgrid[: dx.shape[0], : dx.shape[1]]
                yield pd.DataFrame({"t": np.int32(t), "y": y.ravel().astype(np.int32), "x": x.ravel().astype(np.int32), "dx": dx.ravel().astype(float), "dy": dy.ravel().astype(float)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.flo").load(root)
    rows = files.select(F.regexp_extract("path", r"(\d+)\.flo$", 1).cast("int").alias("t"), "content")
    return rows.mapInPandas(decoded, "t int, y int, x int, dx double, dy double")


def flow_files(flow: DataFrame) -> DataFrame:
    """name, content: one .flo file per frame, from t, y, x, dx, dy of a dense raster. A frame is one file, so one row."""

    def encoded(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = pdf.pivot(index="y", columns="x", values=["dx", "dy"])
        return pd.DataFrame({"name": [f"{int(pdf['t'].iloc[0]):05d}.flo"], "content": [encode_flow(grid["dx"].to_numpy(), grid["dy"].to_numpy())]})

    return flow.groupBy("t").applyInPandas(encoded, "name string, content binary")


def binary_masks(gray: DataFrame, value: str = "v", least: int = 128) -> DataFrame:
    return gray.withColumn("gt", F.when(F.col(value) >= least, 1).otherwise(0))


def stacked_masks(masks: DataFrame) -> DataFrame:
    """From object (name), t, y, x, on: gt; objects are numbered from 1 in the order of their names, later ones lie on top."""
    names = masks.select("object").distinct().withColumn("n", F.expr("row_number() over (order by object)"))
    return masks.join(names, "object").groupBy("t", "y", "x").agg(F.max(F.when(F.col("on") > 0, F.col("n")).otherwise(0)).alias("gt"))


def write_params(regions: DataFrame, path: str) -> None:
    """The 17 columns of a region table as CSV with a header."""
    regions.select(*[F.col(f"`{c}`") for c in PARAMS]).write.option("header", True).csv(path)


def read_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(", ".join(f"`{c}` {'int' if c in ('label', 'count') else 'double'}" for c in PARAMS)).csv(path)


def bayer_planes(raster: DataFrame, value: str = "v") -> DataFrame:
    """t, y, x and the four phases p00, p01, p10, p11 of each 2x2 block."""
    phase = F.concat(F.lit("p"), (F.col("y") % 2).cast("string"), (F.col("x") % 2).cast("string"))
    block = [F.floor(F.col(c) / 2).cast("int").alias(c) for c in ("y", "x")]
    return raster.withColumn("_p", phase).groupBy("t", *block).pivot("_p", ["p00", "p01", "p10", "p11"]).agg(F.first(value))


def from_bayer(planes: DataFrame) -> DataFrame:
    """The way back from bayer_planes."""
    each = F.explode(F.array(*[F.struct((F.col("y") * 2 + i).alias("y"), (F.col("x") * 2 + j).alias("x"), F.col(f"p{i}{j}").alias("v")) for i in (0, 1) for j in (0, 1)])).alias("e")
    return planes.select("t", each).select("t", "e.*")


def read_frames(spark: SparkSession, root: str, offset: int = 0, pattern: str = "*.png") -> DataFrame:
    """t, y, x, c0, c1, c2 (red, green, blue in 0..1) from image files named by their number less offset; grey images repeat their value, transparency is left out.

    A file is one task's row, as images are decoded whole; its pixels are made from its bytes in batches."""
    files = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", pattern).load(root)
    t = F.regexp_extract("image.origin", r"(\d+)\.[^./]*$", 1).cast("int") - offset

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t, height, width, n, data in zip(pdf["t"], pdf["height"], pdf["width"], pdf["nChannels"], pdf["data"], strict=True):
                bgr = np.frombuffer(data, np.uint8).reshape(height, width, n) / 255.0
                rgb = np.repeat(bgr, 3, axis=2) if n == 1 else bgr[..., 2::-1]
                y, x = np.mgrid[:height, :width]
                yield pd.DataFrame({"t": np.int32(t), "y": y.ravel().astype(np.int32), "x": x.ravel().astype(np.int32), **{f"c{k}": rgb[..., k].ravel() for k in range(3)}})

    return files.select(t.alias("t"), "image.height", "image.width", "image.nChannels", "image.data").mapInPandas(decoded, "t int, y int, x int, c0 double, c1 double, c2 double")


def read_summaries(spark: SparkSession, root: str) -> DataFrame:
    """method, param, video, metric, mean from files <method>/<param>/<video>/summary.csv below root; missing ones are left out."""
    rows = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "summary.csv").csv(root)
    place = lambda k: F.element_at(F.split(F.col("_metadata.file_path"), "/"), -k)
    return rows.select(place(4).alias("method"), place(3).alias("param"), place(2).alias("video"), "metric", F.col("`mean[0]`").cast("double").alias("mean"))


def write_summary_cache(summaries: DataFrame, path: str) -> None:
    """Parquet, one folder per method and setting, so that a reader of some reads no others; those present are replaced."""
    summaries.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("method", "param").parquet(path)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """name: the lines of a list of videos, without blanks and empty lines."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name != ''")
