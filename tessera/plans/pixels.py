"""Pixel tables derived from the given tables (there is no video among them), and the same as SQL.

Every row of lineitem is a pixel. A line number's rows, in their total order, fill frames of 64 x 128 pixels, line by line; the frames of the seven line numbers
take turns, so that a frame has a bounded size and the one before it belongs to another line number. The last frame of a line number has fewer lines, and its
last line may be short. Channels are whole numbers, so sums are exact."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.lineage import dropped, stored
from tessera.operators.order import ranked

#: Pixels across and down a frame, side of the blocks that labels come from, line numbers.
WIDTH, HEIGHT, BLOCK, TURNS = 64, 128, 8, 7
ORDER = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]

PIX_SQL = f"""
r0 AS (
  SELECT l_linenumber - 1 AS line, row_number() OVER (PARTITION BY l_linenumber ORDER BY {", ".join(ORDER)}) - 1 AS p,
         CAST(l_quantity AS INT) AS c0, CAST(round(l_discount * 100) AS INT) AS c1, CAST(round(l_tax * 100) AS INT) AS c2,
         CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 0 END AS gt,
         CAST(l_suppkey % 3 AS INT) - 1 AS dx, CAST(l_partkey % 3 AS INT) - 1 AS dy
  FROM lineitem),
r1 AS (
  SELECT CAST(floor(p / {WIDTH * HEIGHT}.0) * {TURNS} + line AS INT) AS t, CAST(floor((p % {WIDTH * HEIGHT}) / {WIDTH}.0) AS INT) AS y, CAST(p % {WIDTH} AS INT) AS x, c0, c1, c2, gt, dx, dy FROM r0),
pix AS (
  SELECT t, y, x, c0, c1, c2, gt, dx, dy, CAST(floor(y / {BLOCK}.0) * 8 + floor(x / {BLOCK}.0) AS INT) + CASE WHEN c0 > 45 THEN 1 ELSE 0 END AS spix FROM r1)
"""

#: After the pixel CTEs: a line number's frames one below the other again, so labels go on from frame to frame instead of starting anew.
WHOLE_SQL = f"""
, whole AS (
  SELECT CAST(line AS INT) AS t, CAST(floor(p / {WIDTH}.0) AS INT) AS y, CAST(p % {WIDTH} AS INT) AS x,
         CAST(floor(floor(p / {WIDTH}.0) / {BLOCK}.0) * 8 + floor((p % {WIDTH}) / {BLOCK}.0) AS INT) + CASE WHEN c0 > 45 THEN 1 ELSE 0 END AS spix
  FROM r0)
"""

#: Where the view of a folder lies, by application and folder.
_STORED: dict[tuple[str, str], str] = {}


def derived(spark: SparkSession, sf_dir: str, made: list[DataFrame] | None = None) -> DataFrame:
    """t, y, x, c0, c1, c2, gt, dx, dy, spix."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_linenumber", *ORDER)
    p = ranked(rows, ["l_linenumber"], ORDER, "p", made=made)
    inside = F.col("p") % (WIDTH * HEIGHT)
    y, x = F.floor(inside / WIDTH), inside % WIDTH
    flag = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 2).otherwise(0)
    quantity = F.col("l_quantity").cast("int")
    label = (F.floor(y / BLOCK) * 8 + F.floor(x / BLOCK)).cast("int") + F.when(quantity > 45, 1).otherwise(0)
    return p.select(
        (F.floor(F.col("p") / (WIDTH * HEIGHT)) * TURNS + F.col("l_linenumber") - 1).cast("int").alias("t"),
        y.cast("int").alias("y"),
        x.cast("int").alias("x"),
        quantity.alias("c0"),
        F.round(F.col("l_discount") * 100).cast("int").alias("c1"),
        F.round(F.col("l_tax") * 100).cast("int").alias("c2"),
        flag.alias("gt"),
        (F.col("l_suppkey") % 3 - 1).cast("int").alias("dx"),
        (F.col("l_partkey") % 3 - 1).cast("int").alias("dy"),
        label.alias("spix"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view, stored in the shared folder when an application first asks for it; a table that changes under the same path needs another session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _STORED:
        try:
            return spark.read.parquet(_STORED[key])
        except AnalysisException:  # the shared folder has been cleared meanwhile
            del _STORED[key]
    made: list[DataFrame] = []
    view = stored(derived(spark, sf_dir, made), "pixels")
    dropped(*made)
    _STORED[key] = view.__dict__["_stored"]
    return spark.read.parquet(_STORED[key])


def whole(p: DataFrame) -> DataFrame:
    """t, y, x, spix of the rasters that the frames were cut from, one for each line number: as many labels as its lines need, so their number grows with the table."""
    before = F.floor(F.col("t") / TURNS).cast("int")
    return p.select((F.col("t") % TURNS).alias("t"), (before * HEIGHT + F.col("y")).alias("y"), "x", (before * (HEIGHT // BLOCK * 8) + F.col("spix")).alias("spix"))


def height(p: DataFrame) -> DataFrame:
    """One row: hh, the number of rows of the tallest frame; npix, of its pixels; frames."""
    return p.agg((F.max("y") + 1).alias("hh"), ((F.max("y") + 1) * WIDTH).cast("double").alias("npix"), F.count_distinct("t").alias("frames"))


def unit_channels(p: DataFrame) -> DataFrame:
    """Channels scaled to about 0..1."""
    return p.withColumns({"c0": F.col("c0") / 50.0, "c1": F.col("c1") / 10.0, "c2": F.col("c2") / 8.0})


def missing(p: DataFrame) -> DataFrame:
    """Some labels become -1."""
    return p.withColumn("spix", F.when(F.col("c1") == 10, -1).otherwise(F.col("spix")))
