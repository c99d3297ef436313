"""Range queries over a stream of points: a stateless filter, the same for a stream as for a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions import geometry as g
from quadrille.operators.selection import MOST_STREAM_WINDOWS, windows
from quadrille.sources.geometry import Geometries, from_points
from quadrille.types import InvalidParameter


def stream_points(stream: DataFrame, rec_id: str, x: str, y: str) -> Geometries:
    return from_points(stream, F.col(rec_id), F.col(x), F.col(y))


def stream_range(points: Geometries, queries: DataFrame) -> DataFrame:
    """qid, rec_id of a stream's points in a fixed table of windows (qid, wkt); append mode, no state.

    The windows are broadcast, MOST_STREAM_WINDOWS at most: more are an error, to be run as several streams.
    """
    w = windows(queries)
    if queries.limit(MOST_STREAM_WINDOWS + 1).count() > MOST_STREAM_WINDOWS:
        raise InvalidParameter(f"over {MOST_STREAM_WINDOWS} windows on a stream")
    own, box = {c: F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")}, {c: F.col(f"w_{c}") for c in ("xmin", "ymin", "xmax", "ymax")}
    pairs = points.df.join(F.broadcast(w), g.overlap(own, box))
    return pairs.where((F.col("wtype") == "BOX") | g.point_meets_ring(F.col("xmin"), F.col("ymin"), F.col("wedges"))).select("qid", "rec_id")
