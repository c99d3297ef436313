"""Sources and sinks of geometry frames.

A geometry frame has rec_id, gtype, pts, xmin, ymin, xmax, ymax and any further columns. Boxes are flat columns, so that
Parquet statistics prune row groups under a window's filter.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.functions import geometry as g
from quadrille.functions.kernels import valid_column
from quadrille.types import Bounds, DataType, FileType, UnsupportedFeature, member

BOX = ("xmin", "ymin", "xmax", "ymax")


@dataclass(frozen=True)
class Geometries:
    """A frame with the one type that its rows have, and what is known of it.

    bounds hold all rows; april: order and bounds of the raster intervals in its column april; cells: the rows by cell of grid.
    """

    df: DataFrame
    kind: DataType
    bounds: Bounds | None = None
    april: tuple[int, Bounds] | None = None
    cells: DataFrame | None = None
    grid: object = None

    def where(self, condition) -> Geometries:
        return replace(self, df=self.df.where(condition), bounds=None, cells=None, grid=None)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 0) and value of a text file, of any size: lines are numbered in each block, blocks by their place."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mid"))
    blocks = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("mid").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a block
    base = blocks.select("file", "block", "first", before.alias("before"))
    return raw.join(base, ["file", "block"]).select((F.col("before") + F.col("mid") - F.col("first")).alias("line"), F.rtrim(F.col("value"), F.lit("\r")).alias("value"))


def _frame(rows: DataFrame, kind: DataType, pts: Column, validate: bool) -> Geometries:
    if kind == DataType.POLYGON:
        rows = g.computed(g.computed(rows, ring_=pts), ring_=g.closed_ring(F.col("ring_")))
        pts = F.col("ring_")
    least = {DataType.POINT: 1, DataType.LINESTRING: 2, DataType.POLYGON: 4, DataType.BOX: 2}[kind]
    rows = g.computed(rows, pts=pts).drop("ring_").where(F.size("pts") >= least)
    if kind == DataType.POINT:
        rows = rows.where(F.size("pts") == 1)
    elif validate and kind != DataType.BOX:
        rows = rows.where(valid_column(F.lit(kind.value), g.flat(F.col("pts"))))
    rows = g.computed(rows, **g.mbr(F.col("pts")))
    if kind == DataType.POLYGON:  # after the box, so that what reads boxes alone turns no ring
        rows = rows.withColumn("pts", g.clockwise(F.col("pts")))
    return Geometries(rows.withColumn("gtype", F.lit(kind.value)), kind)


def read_wkt(spark: SparkSession, path: str, kind, validate: bool = True) -> Geometries:
    """Lines with WKT before the first tab; rec_id is the line number. Other types, multi-part, empty and invalid rows go."""
    kind = member(DataType, kind)
    rows = numbered_lines(spark, path).select(F.col("line").alias("rec_id"), F.split("value", "\t")[0].alias("wkt"), F.regexp_extract("value", r"\t(.*)$", 1).alias("attributes"))
    rows = rows.where(g.wkt_tag(F.col("wkt")) == kind.value)
    rows = g.computed(rows, raw=g.wkt_points(F.col("wkt"))).where(F.col("raw").isNotNull())
    return Geometries(_frame(rows, kind, F.col("raw"), validate).df.drop("raw", "wkt"), kind)


def read_csv(spark: SparkSession, path: str, kind, validate: bool = True) -> Geometries:
    """`id,x y,x y,...` after a first line with the number of objects; coordinates have single precision."""
    kind = member(DataType, kind)
    fields = F.split("value", ",")
    rows = numbered_lines(spark, path).where(F.col("line") > 0).select((F.col("line") - 1).alias("rec_id"), F.slice(fields, 2, F.size(fields)).alias("parts"))
    at = lambda p, i: F.get(F.split(F.trim(p), r"\s+"), F.lit(i)).try_cast("float").cast("double")
    rows = rows.withColumn("raw", F.transform("parts", lambda p: F.struct(at(p, 0).alias("x"), at(p, 1).alias("y"))))
    rows = rows.where((F.size("raw") > 0) & F.forall("raw", lambda p: p["x"].isNotNull() & p["y"].isNotNull()))
    made = _frame(rows, kind, F.col("raw"), validate)
    return Geometries(made.df.drop("raw", "parts"), kind)


def read_geometries(spark: SparkSession, path: str, file_type, kind) -> Geometries:
    return (read_wkt if member(FileType, file_type) == FileType.WKT else read_csv)(spark, path, kind)


def from_points(df: DataFrame, rec_id: Column, x: Column, y: Column, *keep: Column) -> Geometries:
    x, y = x.cast("double"), y.cast("double")
    rows = df.select(rec_id.cast("long").alias("rec_id"), x.alias("xmin"), y.alias("ymin"), x.alias("xmax"), y.alias("ymax"), *keep)
    pts = F.array(F.struct(F.col("xmin").alias("x"), F.col("ymin").alias("y")))
    return Geometries(rows.withColumns({"pts": pts, "gtype": F.lit("POINT")}), DataType.POINT)


def from_boxes(df: DataFrame, rec_id: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column, *keep: Column) -> Geometries:
    """Boxes; inverted sides are swapped."""
    xmin, ymin, xmax, ymax = (c.cast("double") for c in (xmin, ymin, xmax, ymax))
    rows = df.select(rec_id.cast("long").alias("rec_id"), F.least(xmin, xmax).alias("xmin"), F.least(ymin, ymax).alias("ymin"), F.greatest(xmin, xmax).alias("xmax"), F.greatest(ymin, ymax).alias("ymax"), *keep)
    pts = g.box_points(*[F.col(c) for c in BOX])
    return Geometries(rows.withColumns({"pts": pts, "gtype": F.lit("BOX")}), DataType.BOX)


def from_vertices(df: DataFrame, rec_id: Column, kind, pts: Column, *keep: Column) -> Geometries:
    """Lines or polygons from an array of (x, y) structs, taken as valid."""
    kind = member(DataType, kind)
    return _frame(df.select(rec_id.cast("long").alias("rec_id"), pts.cast(g.PTS).alias("pts"), *keep), kind, F.col("pts"), False)


def read_range_queries(spark: SparkSession, path: str, file_type="WKT") -> DataFrame:
    """qid (line number) and wkt of a file of windows."""
    if member(FileType, file_type) != FileType.WKT:
        raise UnsupportedFeature("query files are WKT")
    rows = numbered_lines(spark, path).where(F.trim("value") != "")
    return rows.select(F.col("line").cast("int").alias("qid"), F.split("value", "\t")[0].alias("wkt"))


def read_knn_queries(spark: SparkSession, path: str, k: int, file_type="WKT") -> DataFrame:
    return read_range_queries(spark, path, file_type).withColumn("k", F.lit(k))


def save(geometries: Geometries, path: str, mode: str = "error") -> None:
    """Rows as Parquet; raster intervals go with them, and with their order and bounds."""
    df = geometries.df.drop("april_frame")
    if geometries.april:
        order, b = geometries.april
        df = df.withColumn("april_frame", F.struct(F.lit(order).alias("order"), *[F.lit(float(getattr(b, c))).alias(c) for c in BOX]))
    df.write.mode(mode).parquet(path)


def load(spark: SparkSession, path: str, kind) -> Geometries:
    df = spark.read.parquet(path)
    if "april_frame" not in df.columns:
        return Geometries(df, member(DataType, kind))
    frame = df.select("april_frame.*").head()  # the same in every row
    april = (frame["order"], Bounds(*[frame[c] for c in BOX])) if frame else None
    return Geometries(df.drop("april_frame"), member(DataType, kind), april=april)


def dataset_bounds(geometries: Geometries) -> DataFrame:
    return geometries.df.agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"), F.count(F.lit(1)).alias("n"))
