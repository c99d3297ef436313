"""The engine: datasets by number, queries as described in types. It takes a session and never makes or stops one."""

from __future__ import annotations

import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import geometry as g
from quadrille.operators.joins import disjoint_count, distance_join, find_relation, intervals, predicate_join, relation_counts
from quadrille.operators.selection import count_by_query, knn_batch, knn_queries, range_batch, range_wkt
from quadrille.plans.grid import grid_for, layer_class
from quadrille.sources import geometry as source
from quadrille.types import (
    Bounds, DataType, DistanceJoinQuery, FileType, IndexType, InvalidParameter, InvalidQueryType, KNNQuery, PredicateJoinQuery, Query, QueryType,
    RangeQuery, ResultType, UnknownDataset, member,
)


class SpatialEngine:
    def __init__(self, spark: SparkSession, cells_per_dim: int | None = None, april_order: int | None = None):
        self.spark, self.cells_per_dim, self.april_order = spark, cells_per_dim, april_order
        self.datasets: dict[int, source.Geometries] = {}
        self.indexes: dict[int, DataFrame] = {}

    # datasets

    def prepare_dataset(self, path: str, file_type="WKT", data_type="POLYGON", bounds: Bounds | None = None) -> int:
        """A number for the file's geometries, the smallest that is free."""
        if not path:
            raise InvalidParameter("a dataset has a path")
        return self.add(replace(source.read_geometries(self.spark, path, member(FileType, file_type), data_type), bounds=bounds))

    def add(self, geometries: source.Geometries) -> int:
        number = next(i for i in range(len(self.datasets) + 1) if i not in self.datasets)
        self.datasets[number] = geometries
        return number

    def dataset(self, number: int) -> source.Geometries:
        try:
            return self.datasets[number]
        except KeyError:
            raise UnknownDataset(str(number)) from None

    def partition(self, numbers: list[int]) -> None:
        """Computes the bounds that the datasets share, where none were given."""
        missing = [i for i in numbers if self.dataset(i).bounds is None]
        if missing:
            b = grid_for(*[self.datasets[i] for i in missing], n=None).bounds
            for i in missing:
                self.datasets[i] = replace(self.datasets[i], bounds=b)

    def build_index(self, numbers: list[int], index_type=IndexType.TWO_LAYER) -> None:
        """Keeps the datasets' rows by cell in memory, with layer classes for the two-layer index.

        With april_order, the rows have their raster intervals. Joins of datasets that were indexed together meet there, cell by
        cell, without a shuffle. What an index held before is let go.
        """
        index_type = member(IndexType, index_type)
        self.partition(numbers)
        grid = grid_for(*[self.dataset(i) for i in numbers], n=self.cells_per_dim)
        for i in numbers:
            self._forget(i)
            data = self.datasets[i]
            if self.april_order and data.kind in (DataType.LINESTRING, DataType.POLYGON, DataType.BOX):
                data = intervals(data, self.april_order, grid.bounds)
            cells = grid.exploded(data.df)
            if index_type == IndexType.TWO_LAYER:
                cells = cells.withColumn("cls", layer_class())
            self.indexes[i] = cells.repartition("cell").persist()
            self.datasets[i] = replace(data, cells=self.indexes[i], grid=grid)

    def _forget(self, number: int) -> None:
        if index := self.indexes.pop(number, None):
            index.unpersist()
            self.datasets[number] = replace(self.datasets[number], cells=None, grid=None)

    def save(self, number: int, path: str) -> None:
        source.save(self.dataset(number), path)

    def load(self, path: str, data_type) -> int:
        return self.add(source.load(self.spark, path, data_type))

    def unload_dataset(self, number: int) -> None:
        if number in self.datasets:
            self._forget(number)
        self.datasets.pop(number, None)

    def finalize(self) -> None:
        for number in list(self.datasets):
            self.unload_dataset(number)

    # queries

    def query(self, q: Query) -> DataFrame:
        """COUNT: n, or relation and n. COLLECT: ids. KNN: rank, rec_id, dist."""
        if isinstance(q, RangeQuery):
            hits = range_wkt(self.dataset(q.dataset), q.wkt)
        elif isinstance(q, KNNQuery):
            return self.query_batch([q], QueryType.KNN).drop("qid")
        elif isinstance(q, DistanceJoinQuery):
            hits = distance_join(self.dataset(q.r), self.dataset(q.s), q.distance, self.cells_per_dim)
        elif isinstance(q, PredicateJoinQuery):
            r, s = self.dataset(q.r), self.dataset(q.s)
            if q.kind == QueryType.FIND_RELATION:
                found = find_relation(r, s, self.cells_per_dim, self.april_order)
                return relation_counts(found) if q.result == ResultType.COUNT else found
            if q.kind == QueryType.DISJOINT and q.scope == "all" and q.result == ResultType.COUNT:
                return disjoint_count(r, s, self.cells_per_dim, self.april_order)
            hits = predicate_join(r, s, q.kind, self.cells_per_dim, q.scope, self.april_order)
        else:
            raise InvalidQueryType(type(q).__name__)
        return hits.agg(F.count(F.lit(1)).alias("n")) if q.result == ResultType.COUNT else hits

    def query_batch(self, queries, kind: QueryType, dataset: int = 0, result=ResultType.COUNT, k: int | None = None) -> DataFrame:
        """One job for a batch: a list of RangeQuery or KNNQuery, or a frame of (qid, wkt[, k]). Results carry qid."""
        if kind not in (QueryType.RANGE, QueryType.KNN):
            raise InvalidQueryType(f"no batches of {kind!r}")
        if isinstance(queries, (list, tuple)):
            if not queries:
                raise InvalidParameter("an empty batch")
            if len({q.dataset for q in queries}) > 1:
                raise InvalidParameter("a batch has one dataset")
            dataset, result = queries[0].dataset, queries[0].result
            rows = [(q.query_id, q.wkt, getattr(q, "k", 0)) for q in queries]
            queries = self.spark.createDataFrame(rows, "qid int, wkt string, k int")
        data = self.dataset(dataset)
        if kind == QueryType.KNN:
            return knn_batch(data, knn_queries(queries.withColumn("k", F.lit(k)) if k else queries))
        hits = range_batch(data, queries, self.cells_per_dim)
        return count_by_query(queries, hits) if member(ResultType, result) == ResultType.COUNT else hits

    def load_range_queries(self, path: str, file_type="WKT") -> DataFrame:
        return source.read_range_queries(self.spark, path, file_type)

    def load_knn_queries(self, path: str, k: int, file_type="WKT") -> DataFrame:
        return source.read_knn_queries(self.spark, path, k, file_type)

    def wkt(self, number: int) -> DataFrame:
        return self.dataset(number).df.select("rec_id", g.to_wkt(F.col("gtype"), F.col("pts")).alias("wkt"))

    @staticmethod
    def time() -> float:
        return time.perf_counter()
